"""The log table every registered query starts from, derived from ``events``.

The SELECT below is the one in FIXTURES.md and runs unchanged in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.session import prepare_session, spread

LOGS_SELECT = """
SELECT event_id AS line_no,
  CASE WHEN event_type = 'error' AND event_id % 4 = 1 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS ts,
  'host' || CAST(user_id % 5 AS STRING) AS hostname,
  CASE WHEN event_id % 997 = 0 THEN 'snmpd'
       WHEN event_type = 'error'    THEN CASE event_id % 4 WHEN 0 THEN 'sshd(pam_unix)' WHEN 1 THEN 'sshd' WHEN 2 THEN 'kernel' ELSE 'named' END
       WHEN event_type = 'click'    THEN 'crond(pam_unix)'
       WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'su(pam_unix)' WHEN 1 THEN 'su(pam_unix)' ELSE 'sudo' END
       WHEN event_type = 'signup'   THEN CASE event_id % 2 WHEN 0 THEN 'xinetd' ELSE 'cups' END
       ELSE CASE event_id % 3 WHEN 0 THEN 'syslogd 1.4.1' WHEN 1 THEN 'ftpd' ELSE 'logrotate' END END AS service,
  CASE WHEN event_id % 997 = 0 THEN 'odd condition ' || substr('abcdefghijklmnopqrstuvwxyz', CAST((event_id - event_id % 997) / 997 % 26 AS INT) + 1, 1) || ' on link'
       WHEN event_type = 'error' THEN CASE event_id % 4
            WHEN 0 THEN 'authentication failure; logname= uid=0 euid=0 tty=NODEVssh ruser= rhost=10.0.' || CAST(user_id % 20 AS STRING) || '.' || CAST(event_id % 10 AS STRING) || ' user=user' || CAST(user_id % 7 AS STRING)
            WHEN 1 THEN 'Failed password for invalid user u' || CAST(user_id AS STRING) || ' from 10.1.' || CAST(user_id % 3 AS STRING) || '.7 port ' || CAST(1024 + event_id % 60000 AS STRING) || ' ssh2'
            WHEN 2 THEN 'end_request: I/O error, dev sda, sector ' || CAST(event_id AS STRING)
            ELSE 'zone transfer failed: code 0x1F' || CAST(event_id % 10 AS STRING) END
       WHEN event_type = 'click' THEN CASE event_id % 2 WHEN 0 THEN 'session opened for user user' || CAST(user_id % 7 AS STRING) || ' by (uid=0)' ELSE 'session closed for user user' || CAST(user_id % 7 AS STRING) END
       WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'session opened for user root by user' || CAST(user_id % 7 AS STRING) || '(uid=500)' WHEN 1 THEN 'session closed for user root' ELSE 'user' || CAST(user_id % 7 AS STRING) || ' : TTY=pts/0 ; COMMAND=/bin/ls' END
       WHEN event_type = 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'xinetd startup succeeded' WHEN 1 THEN 'cupsd shutdown succeeded' WHEN 2 THEN 'warning: can not get client address' ELSE 'cupsd startup succeeded' END
       ELSE CASE event_id % 3 WHEN 0 THEN 'restart.' WHEN 1 THEN 'connection from 10.2.0.' || CAST(user_id % 50 AS STRING) ELSE 'rotating log files' END END AS message,
  CASE WHEN event_id % 997 = 0 OR (event_type = 'error' AND event_id % 4 = 1) THEN 'anomaly' ELSE 'normal' END AS label
FROM {events}
"""


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def logs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical log rows of the events table."""
    columns = ("event_id", "ts", "user_id", "event_type")
    events = spread(events_table(spark, sf_dir).select(*columns))
    rows = spark.sql(LOGS_SELECT.format(events="{events}"), events=events)
    return rows.withColumn("timestamp", rows["ts"].cast("timestamp")).drop("ts")
