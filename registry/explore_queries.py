"""Filters, sorts, top-k lists, counts, alerts and patterns on the scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.operators import alerts, explore, patterns
from registry.base import frequency_table, scored_table
from registry.catalogue import query
from registry.sql import from_events, from_freq

TIME = "yyyy-MM-dd HH:mm:ss"


def sql_time(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') AS {name}"


# ---------------------------------------------------------------- filters
@query(
    "search_events",
    from_events(
        """SELECT event_id, message FROM ev WHERE contains(lower(message), 'user3') OR contains(lower(service), 'user3')
        OR contains(lower(event_id), 'user3') OR contains(lower(COALESCE(src_host, '')), 'user3')
        OR contains(lower(COALESCE(target_user, '')), 'user3')"""
    ),
)
def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.search(scored_table(spark, sf_dir), " USER3 ").select("event_id", "message")


@query(
    "filtered_events",
    from_events(
        """SELECT event_id, service, severity, event_class FROM ev WHERE service IN ('sshd', 'su', 'kernel')
        AND severity IN ('HIGH', 'MEDIUM') AND event_class IN ('AUTH_FAIL', 'PRIVILEGE_EVENT')"""
    ),
)
def filtered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.matching(
        scored_table(spark, sf_dir), ["sshd", "su", "kernel"], ["HIGH", "MEDIUM"], ["AUTH_FAIL", "PRIVILEGE_EVENT"]
    )
    return rows.select("event_id", "service", "severity", "event_class")


@query("normal_events", from_events("SELECT event_id, status FROM ev WHERE status = 'NORMAL'"))
def normal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.with_status(scored_table(spark, sf_dir), "Normal only").select("event_id", "status")


def _range_query(name: str, choice: str, interval: str):
    sql = from_events(
        f"SELECT event_id, service FROM ev WHERE event_time > (SELECT max(event_time) FROM ev) - INTERVAL {interval}"
    )

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return explore.in_time_range(scored_table(spark, sf_dir), choice).select("event_id", "service")

    return run


_range_query("last_hour_events", "Last 1 hour", "1 HOUR")
_range_query("last_day_events", "Last 24 hours", "24 HOUR")
_range_query("last_week_events", "Last 7 days", "7 DAY")


@query(
    "high_risk_events",
    from_events("SELECT event_id, severity, risk_score FROM ev WHERE status = 'ANOMALY' AND severity IN ('HIGH', 'CRITICAL')"),
)
def high_risk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.high_risk(scored_table(spark, sf_dir)).select("event_id", "severity", "risk_score")


@query("event_by_id", from_events("SELECT event_id, line_no, service, message FROM ev WHERE event_id = 'EVT-000123'"))
def event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.by_id(scored_table(spark, sf_dir), " evt-000123 ").select("event_id", "line_no", "service", "message")


# ------------------------------------------------------------ sorts, top-k
def _sort_query(name: str, choice: str, order: str):
    @query(
        name,
        from_events(f"SELECT event_id, risk_score, row_number() OVER (ORDER BY {order}, row_idx) AS position FROM ev"),
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = scored_table(spark, sf_dir).select("event_id", "risk_score", "timestamp", "row_idx")
        placed = explore.with_position(events, choice)
        return placed.select("event_id", "risk_score", "position")

    return run


_sort_query("newest_events", "Newest first", "event_time DESC")
_sort_query("oldest_events", "Oldest first", "event_time")
_sort_query("riskiest_events", "Highest risk", "risk_score DESC")
_sort_query("least_risky_events", "Lowest risk", "risk_score")


@query(
    "triage_queue",
    from_events(
        "SELECT event_id, service, event_class, risk_score FROM ev WHERE status = 'ANOMALY' ORDER BY risk_score DESC, row_idx LIMIT 300"
    ),
)
def triage_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.triage_queue(scored_table(spark, sf_dir)).select("event_id", "service", "event_class", "risk_score")


def _top_query(name: str, column: str, where: str, pick):
    sql = from_events(
        f"SELECT {column}, count(*) AS events FROM ev WHERE status = 'ANOMALY' AND {column} IS NOT NULL{where}"
        f" GROUP BY {column} ORDER BY events DESC, {column} LIMIT 8"
    )

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pick(scored_table(spark, sf_dir))

    return run


_top_query("top_suspicious_services", "service", "", lambda e: explore.top_anomalous(e, "service"))
_top_query("top_suspicious_classes", "event_class", "", lambda e: explore.top_anomalous(e, "event_class"))
_top_query("top_failing_sources", "src_host", " AND event_class = 'AUTH_FAIL'", explore.top_failing_sources)


# ----------------------------------------------------------------- counts
@query(
    "kpis",
    from_events(
        """SELECT count(*) AS total, count_if(status = 'ANOMALY') AS anomalies, count_if(status <> 'ANOMALY') AS normal,
        count_if(status = 'ANOMALY' AND severity IN ('HIGH', 'CRITICAL')) AS high_risk, count(DISTINCT service) AS services,
        round(count_if(status = 'ANOMALY') * 100.0 / count(*), 2) AS anomaly_rate_pct FROM ev"""
    ),
)
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.kpis(scored_table(spark, sf_dir))


@query(
    "severity_counts",
    from_events(
        """SELECT severity, count(e.event_id) AS events,
        round(count(e.event_id) * 100.0 / (SELECT count(*) FROM ev WHERE status = 'ANOMALY'), 2) AS share_pct
        FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) b(severity)
        LEFT JOIN (SELECT event_id, severity FROM ev WHERE status = 'ANOMALY') e USING (severity) GROUP BY severity"""
    ),
)
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.severity_counts(scored_table(spark, sf_dir))


@query(
    "status_shares",
    from_events(
        "SELECT status, count(*) AS events, round(count(*) * 100.0 / (SELECT count(*) FROM ev), 2) AS share_pct FROM ev GROUP BY status"
    ),
)
def status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.status_shares(scored_table(spark, sf_dir))


_BIN = """span AS (SELECT greatest((epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1e6 / 48, 60) AS step FROM ev),
binned AS (SELECT CASE WHEN step <= 60 THEN 60 WHEN step <= 300 THEN 300 WHEN step <= 900 THEN 900 WHEN step <= 1800 THEN 1800
  WHEN step <= 3600 THEN 3600 WHEN step <= 10800 THEN 10800 WHEN step <= 21600 THEN 21600 WHEN step <= 43200 THEN 43200
  WHEN step <= 86400 THEN 86400 ELSE 604800 END::BIGINT AS bin_seconds FROM span)"""


@query("trend_bin", from_events("SELECT CAST(bin_seconds AS BIGINT) AS bin_seconds FROM binned", _BIN))
def trend_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.trend_bin(scored_table(spark, sf_dir))


@query(
    "anomaly_trend",
    from_events(
        """SELECT strftime(make_timestamp((epoch_us(event_time) // (bin_seconds * 1000000)) * bin_seconds * 1000000), '%Y-%m-%d %H:%M:%S') AS bin,
        count_if(status = 'NORMAL') AS normal, count_if(status = 'ANOMALY') AS anomaly FROM ev, binned GROUP BY 1""",
        _BIN,
    ),
)
def anomaly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.trend(scored_table(spark, sf_dir)).withColumn("bin", F.date_format("bin", TIME))


# ----------------------------------------------------------------- alerts
_INTERVALS = """anomalies AS (SELECT event_time AS t, count(*) AS c FROM ev WHERE status = 'ANOMALY' GROUP BY event_time),
intervals AS (SELECT t, sum(c) OVER w AS anomalies, min(t) OVER w AS start FROM anomalies
  WINDOW w AS (ORDER BY t RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW))"""


def _interval_sql(tail: str) -> str:
    shown = f"{sql_time('start', 'interval_start')}, {sql_time('t', 'interval_end')}, CAST(anomalies AS BIGINT) AS anomalies"
    return from_events(f"SELECT {shown} FROM intervals {tail}", _INTERVALS)


def _shown_intervals(found: DataFrame) -> DataFrame:
    return found.select(
        F.date_format("start", TIME).alias("interval_start"), F.date_format("end", TIME).alias("interval_end"), "anomalies"
    )


@query("alert_intervals", _interval_sql("WHERE anomalies >= 2"))
def alert_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_intervals(alerts.alert_intervals(scored_table(spark, sf_dir), 2, 5))


@query("densest_alert", _interval_sql("WHERE anomalies >= 2 ORDER BY anomalies DESC, t LIMIT 1"))
def densest_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_intervals(alerts.densest_interval(scored_table(spark, sf_dir), 2, 5))


# --------------------------------------------------------------- patterns
@query(
    "source_activity",
    from_events(
        f"""SELECT src_host, count(*) AS failures, count(DISTINCT target_user) AS target_accounts,
        count_if(status = 'ANOMALY') AS flagged, max(burst) AS peak_burst, {sql_time('min(event_time)', 'first_seen')},
        {sql_time('max(event_time)', 'last_seen')} FROM ev WHERE event_class = 'AUTH_FAIL' AND src_host IS NOT NULL
        GROUP BY src_host"""
    ),
)
def source_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patterns.source_activity(scored_table(spark, sf_dir))
    return rows.withColumns({c: F.date_format(c, TIME) for c in ("first_seen", "last_seen")})


@query(
    "failing_sources",
    from_freq(
        """SELECT src_host, count(*) AS failures, count(DISTINCT target_user) AS target_accounts, max(burst) AS peak_burst
        FROM freq WHERE event_class = 'AUTH_FAIL' AND src_host IS NOT NULL GROUP BY src_host"""
    ),
)
def failing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All failing sources straight from the logs, before any detection."""
    rows = frequency_table(spark, sf_dir).withColumn("status", F.lit("NORMAL"))
    return patterns.source_activity(rows).drop("flagged", "first_seen", "last_seen")


@query(
    "template_activity",
    from_events(
        """SELECT template, count(*) AS events, count(DISTINCT service) AS services, count_if(status = 'ANOMALY') AS anomalous,
        arg_min(message, row_idx) AS example FROM ev GROUP BY template"""
    ),
)
def template_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.template_activity(scored_table(spark, sf_dir))


@query(
    "template_rarity",
    from_events(
        """SELECT DISTINCT template, tmpl_freq, round(tmpl_freq * 100.0 / (SELECT count(*) FROM ev), 6) AS share_pct,
        CASE WHEN tmpl_freq <= 3 THEN 'very rare' WHEN tmpl_freq * 100.0 / (SELECT count(*) FROM ev) < 1 THEN 'uncommon' ELSE 'common' END AS rarity
        FROM ev"""
    ),
)
def template_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.operators.explain import rarity_word, template_share

    events = scored_table(spark, sf_dir)
    total = events.agg(F.count("*").alias("n")).scalar()
    counted = events.groupBy("template").agg(F.count("*").alias("tmpl_freq"))
    return counted.withColumns({"share_pct": F.round(template_share(total), 6), "rarity": rarity_word(total)})


_ITEMS = """items AS MATERIALIZED (SELECT DISTINCT win, unnest(list_filter([ 'svc=' || service, 'evt=' || event_class,
  CASE WHEN status = 'ANOMALY' THEN 'ANOMALY_IN_WINDOW' END ], lambda x: x IS NOT NULL)) AS item FROM ev),
wins AS MATERIALIZED (SELECT count(DISTINCT win) AS n FROM items),
one AS MATERIALIZED (SELECT item AS a, count(*) AS found FROM items GROUP BY item HAVING count(*) / (SELECT n FROM wins) >= {support} AND (SELECT n FROM wins) >= 5),
fi AS MATERIALIZED (SELECT win, item FROM items WHERE item IN (SELECT a FROM one)),
two AS MATERIALIZED (SELECT x.item AS a, y.item AS b, count(*) AS found FROM fi x JOIN fi y ON x.win = y.win AND x.item < y.item
  GROUP BY ALL HAVING count(*) / (SELECT n FROM wins) >= {support}),
three AS MATERIALIZED (SELECT x.item AS a, y.item AS b, z.item AS c, count(*) AS found FROM fi x JOIN fi y ON x.win = y.win AND x.item < y.item
  JOIN fi z ON x.win = z.win AND y.item < z.item GROUP BY ALL HAVING count(*) / (SELECT n FROM wins) >= {support}),
sets AS MATERIALIZED (SELECT [a] AS s, found FROM one UNION ALL SELECT [a, b], found FROM two UNION ALL SELECT [a, b, c], found FROM three),
supp AS MATERIALIZED (SELECT s, found, found / n AS support FROM sets, wins)"""
LOW_SUPPORT = 0.0005


def _items(support: float) -> str:
    return _ITEMS.replace("{support}", str(support))


@query(
    "window_flags",
    from_events(
        f"SELECT {sql_time('make_timestamp(win * 300000000)', 'win')}, bool_or(status = 'ANOMALY') AS anomalous, count(DISTINCT service) AS services FROM ev GROUP BY ev.win"
    ),
)
def window_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_table(spark, sf_dir).groupBy("window_start").agg(
        F.bool_or(F.col("status") == "ANOMALY").alias("anomalous"), F.countDistinct("service").alias("services")
    )
    return rows.select(F.date_format("window_start", TIME).alias("win"), "anomalous", "services")


@query(
    "window_items",
    from_events(f"SELECT {sql_time('make_timestamp(win * 300000000)', 'win')}, item FROM items", _items(0.05)),
)
def window_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.window_items(scored_table(spark, sf_dir)).withColumn("win", F.date_format("win", TIME))


def _itemset_query(name: str, support: float):
    @query(
        name,
        from_events(
            "SELECT array_to_string(s, ' + ') AS itemset, CAST(len(s) AS BIGINT) AS size, round(support, 9) AS support, found AS windows FROM supp",
            _items(support),
        ),
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        params = _params(support)
        items = patterns.window_items(scored_table(spark, sf_dir), params)
        found = patterns.itemset_report(patterns.frequent_itemsets(items, params))
        return found.withColumns({"size": F.col("size").cast("long"), "support": F.round("support", 9)})

    return run


def _params(support: float):
    from emberlog.params import DEFAULTS

    return DEFAULTS.with_(min_support=support, min_confidence=0.1 if support < 0.05 else 0.7)


_itemset_query("frequent_itemsets", 0.05)
_itemset_query("frequent_itemsets_low_support", LOW_SUPPORT)

_RULES = """parts AS (SELECT s, support, found, list_filter(s, lambda x, i: (m >> (i - 1)) & 1 = 1) AS ante,
  list_filter(s, lambda x, i: (m >> (i - 1)) & 1 = 0) AS cons FROM (SELECT *, unnest(range(1, (1 << len(s)) - 1)) AS m FROM supp WHERE len(s) > 1)),
rules AS (SELECT p.ante, p.cons, p.support, p.found, p.support / a.support AS confidence, p.support / a.support / c.support AS lift
  FROM parts p JOIN supp a ON p.ante = a.s JOIN supp c ON p.cons = c.s)"""


def _rule_query(name: str, support: float, confidence: float, only_anomalies: bool = False):
    extra = " AND (list_contains(ante, 'ANOMALY_IN_WINDOW') OR list_contains(cons, 'ANOMALY_IN_WINDOW'))" if only_anomalies else ""
    sql = from_events(
        f"""SELECT array_to_string(ante, ' + ') AS "if", array_to_string(cons, ' + ') AS "then", round(support, 9) AS support,
        round(confidence, 9) AS confidence, round(lift, 6) AS lift, found AS windows FROM rules
        WHERE confidence >= {confidence} AND lift > 1.0{extra}""",
        _items(support),
        _RULES,
    )

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        params = _params(support)
        items = patterns.window_items(scored_table(spark, sf_dir), params)
        rules = patterns.association_rules(patterns.frequent_itemsets(items, params), params)
        if only_anomalies:
            rules = patterns.about_anomalies(rules)
        shown = patterns.rule_report(rules)
        return shown.withColumns(
            {"support": F.round("support", 9), "confidence": F.round("confidence", 9), "lift": F.round("lift", 6)}
        )

    return run


_rule_query("association_rules", 0.05, 0.7)
_rule_query("association_rules_low_support", LOW_SUPPORT, 0.1)
_rule_query("anomaly_rules", LOW_SUPPORT, 0.1, only_anomalies=True)


@query(
    "cluster_summary",
    from_events(
        """SELECT dbscan_cluster, CASE WHEN dbscan_cluster = -1 THEN 'Noise (anomalous)' ELSE 'Cluster ' || dbscan_cluster END AS cluster,
        (SELECT service FROM ev x WHERE x.dbscan_cluster = e.dbscan_cluster GROUP BY service ORDER BY count(*) DESC, service LIMIT 1) AS top_service,
        (SELECT event_class FROM ev x WHERE x.dbscan_cluster = e.dbscan_cluster GROUP BY event_class ORDER BY count(*) DESC, event_class LIMIT 1) AS top_event,
        count(*) AS size, round(avg(message_length), 6) AS avg_length, round(count(*) * 100.0 / (SELECT count(*) FROM ev), 2) AS share_pct
        FROM ev e GROUP BY dbscan_cluster"""
    ),
)
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.cluster_summary(scored_table(spark, sf_dir)).withColumn("avg_length", F.round("avg_length", 6))


@query(
    "stage_counts",
    from_events(
        """SELECT count(*) AS input_rows, count(DISTINCT service) AS services, count(DISTINCT event_class) AS event_classes,
        count(DISTINCT CASE WHEN NOT dbscan_noise THEN dbscan_cluster END) AS dbscan_clusters, count_if(dbscan_noise) AS dbscan_noise,
        count_if(iforest_noise) AS isolation_forest_anomalies, count_if(dbscan_noise OR iforest_noise) AS ensemble_anomalies FROM ev"""
    ),
)
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.plans.analysis import stage_counts as counted

    return counted(scored_table(spark, sf_dir))
