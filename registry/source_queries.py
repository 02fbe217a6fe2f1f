"""Scans: text lines and CSV rows rendered from the log table, parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.operators import features as X
from emberlog.sources import csv_logs, sinks, text_logs
from emberlog.session import ensure_checkpoint_dir
from emberlog.sources.text_logs import parse_lines, resolve_timestamps
from registry.base import scored_table
from registry.catalogue import query
from registry.logs import logs_table
from registry.sql import clean_ctes, from_events, from_logs

TIME = "yyyy-MM-dd HH:mm:ss"


def _classic(ts="timestamp"):
    day = F.lpad(F.dayofmonth(ts).cast("string"), 2, " ")
    return F.concat(F.date_format(ts, "MMM "), day, F.date_format(ts, " HH:mm:ss"))


def _line(time, pid=None):
    tail = F.lit("") if pid is None else F.concat(F.lit("["), pid.cast("string"), F.lit("]"))
    return F.concat(time, F.lit(" "), "hostname", F.lit(" "), "service", tail, F.lit(": "), "message")


def _iso(ts="timestamp"):
    return F.when(F.col("line_no") % 2 == 0, F.date_format(ts, TIME)).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    )


def _pid():
    return F.col("line_no") % 30000 + 1


def _shown(rows: DataFrame) -> DataFrame:
    return text_logs.to_logs(rows).select(
        "line_no", F.date_format("timestamp", TIME).alias("time_text"), "hostname", "service", "pid", "message"
    )


@query(
    "parse_classic_lines",
    from_logs(
        "SELECT line_no, strftime(event_time, '1900-%m-%d %H:%M:%S') AS time_text, hostname, service,"
        " CASE WHEN service LIKE '% %' THEN NULL ELSE CAST(line_no % 30000 + 1 AS VARCHAR) END AS pid, message FROM logs"
    ),
)
def parse_classic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = logs_table(spark, sf_dir)
    versioned = F.col("service").contains(" ")
    line = F.when(versioned, _line(_classic())).otherwise(_line(_classic(), _pid()))
    lines = logs.select("line_no", line.alias("value"))
    return _shown(resolve_timestamps(parse_lines(lines), "classic"))


@query(
    "parse_iso_lines",
    from_logs(
        "SELECT line_no, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS time_text, hostname, service,"
        " CAST(line_no % 30000 + 1 AS VARCHAR) AS pid, message FROM logs WHERE service NOT LIKE '% %'"
    ),
)
def parse_iso_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = logs_table(spark, sf_dir).select("line_no", _line(_iso(), _pid()).alias("value"))
    return _shown(resolve_timestamps(parse_lines(lines), "iso"))


def _mixed_lines(spark: SparkSession, sf_dir: str, iso_of_ten: int) -> DataFrame:
    """Lines in both formats; ``iso_of_ten`` in ten ids carry an ISO time."""
    iso = F.col("line_no") % 10 < iso_of_ten
    line = F.when(iso, _line(_iso())).otherwise(_line(_classic()))
    return logs_table(spark, sf_dir).select("line_no", line.alias("value"))


@query(
    "timestamps_classic_majority",
    from_logs(
        "SELECT line_no, strftime(event_time, '1900-%m-%d %H:%M:%S') AS time_text FROM logs WHERE line_no % 10 >= 3"
    ),
)
def timestamps_classic_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most lines are yearless, so ISO times do not parse and their lines drop out."""
    return _shown(resolve_timestamps(parse_lines(_mixed_lines(spark, sf_dir, 3)), "reference")).select("line_no", "time_text")


@query(
    "timestamps_iso_majority",
    from_logs(
        "SELECT line_no, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS time_text FROM logs"
        " WHERE line_no % 10 < 8 AND service NOT LIKE '% %'"
    ),
)
def timestamps_iso_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(resolve_timestamps(parse_lines(_mixed_lines(spark, sf_dir, 8)), "reference")).select("line_no", "time_text")


@query(
    "timestamps_per_row",
    from_logs(
        "SELECT line_no, CASE WHEN line_no % 10 < 5 THEN strftime(event_time, '%Y-%m-%d %H:%M:%S')"
        " ELSE strftime(event_time, '1900-%m-%d %H:%M:%S') END AS time_text FROM logs"
        " WHERE line_no % 10 >= 5 OR service NOT LIKE '% %'"
    ),
)
def timestamps_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve_timestamps(parse_lines(_mixed_lines(spark, sf_dir, 5)), "per_row")
    return _shown(rows).select("line_no", "time_text")


def _untidy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank, shapeless and impossible-date lines among good ones."""
    n = F.col("line_no")
    line = (
        F.when(n % 11 == 0, F.lit("  \t "))
        .when(n % 13 == 0, F.lit("junk without structure"))
        .when(n % 17 == 0, _line(F.lit("Feb 29 01:00:00")))
        .otherwise(_line(_classic()))
    )
    return logs_table(spark, sf_dir).select("line_no", line.alias("value"))


_GOOD = "line_no % 11 <> 0 AND line_no % 13 <> 0 AND line_no % 17 <> 0"


@query(
    "parse_report",
    from_logs(
        f"""SELECT 'messages.log' AS filename, 'Syslog text' AS detected_format,
        count_if(line_no % 11 <> 0) AS total_lines, count_if({_GOOD}) AS parsed_rows,
        count_if(line_no % 11 <> 0) - count_if({_GOOD}) AS dropped_rows,
        round(count_if({_GOOD}) * 100.0 / greatest(count_if(line_no % 11 <> 0), 1), 1) AS parse_rate_pct,
        false AS has_year,
        strftime(min(CASE WHEN {_GOOD} THEN event_time END), '1900-%m-%d %H:%M:%S') AS time_start,
        strftime(max(CASE WHEN {_GOOD} THEN event_time END), '1900-%m-%d %H:%M:%S') AS time_end FROM logs"""
    ),
)
def parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve_timestamps(parse_lines(_untidy_lines(spark, sf_dir)))
    report = text_logs.parse_report(rows, filename="messages.log", detected_format="Syslog text")
    return report.withColumns(
        {c: F.date_format(c, TIME) for c in ("time_start", "time_end")}
    )


@query(
    "rejected_lines",
    from_logs(
        """SELECT line_no, CASE WHEN line_no % 13 = 0 THEN 'junk without structure'
          ELSE 'Feb 29 01:00:00 ' || hostname || ' ' || service || ': ' || message END AS line,
        CASE WHEN line_no % 13 = 0 THEN 'unrecognised line' ELSE 'invalid timestamp' END AS reason
        FROM logs WHERE line_no % 11 <> 0 AND (line_no % 13 = 0 OR line_no % 17 = 0)"""
    ),
)
def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_logs.rejected_lines(resolve_timestamps(parse_lines(_untidy_lines(spark, sf_dir)), "classic"))


def _csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header names in need of the alias rules; some cells are empty."""
    n = F.col("line_no")
    level = (
        F.when(n % 7 == 0, F.lit("error")).when(n % 7 == 1, F.lit("Warning"))
        .when(n % 7 == 2, F.lit("SERVICE_STOP")).when(n % 7 == 3, F.lit("restart"))
    )
    return logs_table(spark, sf_dir).select(
        "line_no",
        F.date_format("timestamp", TIME).alias(" Time "),
        F.when(n % 19 != 0, F.col("hostname")).alias("Host"),
        F.when(n % 23 != 0, F.col("service")).alias("Program"),
        F.col("message").alias("Msg"),
        level.alias("Level"),
        F.when(n % 997 == 0, F.lit("-1")).otherwise((n % 3).cast("string")).alias("DBSCAN_Cluster"),
        F.col("label").alias("actual_label"),
    )


_CSV = """csvrows AS (SELECT line_no, event_time, label,
  CASE WHEN line_no % 19 = 0 THEN 'unknown' ELSE hostname END AS hostname,
  CASE WHEN line_no % 23 = 0 THEN 'unknown' ELSE service END AS service, message,
  CASE line_no % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'Warning' WHEN 2 THEN 'SERVICE_STOP' WHEN 3 THEN 'restart' END AS raw_event_type,
  CASE WHEN line_no % 997 = 0 THEN -1 ELSE line_no % 3 END AS dbscan_cluster FROM logs)"""


@query(
    "csv_alias_mapping",
    from_logs(
        "SELECT line_no, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS time_text, hostname, service, message,"
        " raw_event_type, dbscan_cluster, label FROM csvrows",
        _CSV,
    ),
)
def csv_alias_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = csv_logs.csv_to_logs(_csv_rows(spark, sf_dir))
    return rows.select(
        "line_no", F.date_format("timestamp", TIME).alias("time_text"), "hostname", "service", "message",
        "raw_event_type", F.col("dbscan_cluster").cast("long").alias("dbscan_cluster"), "label",
    )


@query(
    "csv_files",
    from_logs(
        """SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S') AS time_text, hostname, service,
        CASE line_no % 3 WHEN 0 THEN message WHEN 1 THEN '"' || message || '",' || chr(10) || chr(10) || 'line ' || line_no
          ELSE message || chr(10) || '"' END AS message, raw_event_type FROM csvrows""",
        _CSV,
    ),
)
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files on disk, with quotes and line breaks in cells, read in splits."""
    n = F.col("line_no") % 3
    quoted = F.concat(F.lit('"'), "Msg", F.lit('",\n\nline '), F.col("line_no").cast("string"))
    message = F.when(n == 0, F.col("Msg")).when(n == 1, quoted).otherwise(F.concat("Msg", F.lit('\n"')))
    rows = _csv_rows(spark, sf_dir).withColumn("Msg", message).drop("line_no")
    folder = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    rows.write.option("header", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(folder)
    found = csv_logs.read_csv_logs(spark, folder, multi_line=True)
    return found.select(F.date_format("timestamp", TIME).alias("time_text"), "hostname", "service", "message", "raw_event_type")


#: Spellings of the same moment; the first number of the sixth is a day whenever it is over 12.
_SPELLINGS = (
    "MMM d HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "dd.MM.yyyy HH:mm:ss", "MMMM d, yyyy h:mm:ss a", "EEE, d MMM yyyy HH:mm:ss 'GMT'",
    "d/M/yyyy HH:mm", "dd/MMM/yyyy:HH:mm:ss '+0000'", "yyyyMMdd HHmmss", "yyyy/MM/dd, h:mm a", "EEE MMM d HH:mm:ss 'UTC' yyyy", "'at' HH:mm:ss", "yyyy-MM-dd",
)


@query(
    "timestamps_lenient",
    from_logs(
        """SELECT line_no, strftime(CASE line_no % 12 WHEN 0 THEN event_time - to_years(CAST(year(event_time) - 1900 AS INT))
          WHEN 2 THEN CASE WHEN day(event_time) > 12 THEN event_time ELSE make_timestamp(year(event_time), day(event_time), month(event_time), hour(event_time), minute(event_time), second(event_time)) END
          WHEN 5 THEN CASE WHEN day(event_time) > 12 THEN date_trunc('minute', event_time)
            ELSE make_timestamp(year(event_time), day(event_time), month(event_time), hour(event_time), minute(event_time), 0.0) END
          WHEN 8 THEN date_trunc('minute', event_time) WHEN 10 THEN NULL WHEN 11 THEN date_trunc('day', event_time)
          ELSE event_time END, '%Y-%m-%d %H:%M:%S') AS time_text FROM logs
        WHERE NOT (line_no % 12 = 0 AND month(event_time) = 2 AND day(event_time) = 29)"""
    ),
)
def timestamps_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve spellings in one input, each understood by its shape."""
    spelt = F
    for k, pattern in enumerate(_SPELLINGS):
        spelt = spelt.when(F.col("line_no") % len(_SPELLINGS) == k, F.date_format("timestamp", pattern))
    rows = logs_table(spark, sf_dir).select("line_no", spelt.alias("time_text"), (F.date_format("timestamp", "MMdd") == "0229").alias("leap"))
    found = resolve_timestamps(rows, "lenient").where(~(F.col("leap") & (F.col("line_no") % len(_SPELLINGS) == 0)))
    return found.select("line_no", F.date_format("timestamp", TIME).alias("time_text"))


@query(
    "csv_level_classes",
    from_logs("SELECT line_no, event_class FROM clean", _CSV, clean_ctes("csvrows", "upper(COALESCE(raw_event_type, ''))")),
)
def csv_level_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event classes when the input carries its own level column."""
    return X.clean(csv_logs.csv_to_logs(_csv_rows(spark, sf_dir))).select("line_no", "event_class")


@query(
    "precomputed_clusters",
    from_logs(
        "SELECT dbscan_cluster, dbscan_cluster = -1 AS dbscan_noise, count(*) AS events FROM csvrows GROUP BY dbscan_cluster",
        _CSV,
    ),
)
def precomputed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = csv_logs.csv_to_logs(_csv_rows(spark, sf_dir))
    return rows.groupBy(F.col("dbscan_cluster").cast("long").alias("dbscan_cluster")).agg(
        (F.first("dbscan_cluster") == -1).alias("dbscan_noise"), F.count("*").alias("events")
    )


_COLUMNS = "event_id, time_text AS \"timestamp\", hostname, service, event_class, severity, status, risk_score"


@query("export_explorer", from_events(f"SELECT {_COLUMNS}, message FROM ev"))
def export_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.explorer_export(scored_table(spark, sf_dir))


@query(
    "export_anomalies",
    from_events(f"SELECT {_COLUMNS}, src_host, target_user, message FROM ev WHERE status = 'ANOMALY'"),
)
def export_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.anomaly_export(scored_table(spark, sf_dir))


@query("export_all_events", from_events(f"SELECT {_COLUMNS}, src_host, target_user, message FROM ev"))
def export_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.export_frame(scored_table(spark, sf_dir))
