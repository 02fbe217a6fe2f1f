"""Explanations, context, related events, analyst texts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog import constants as K
from emberlog.functions.timing import format_time
from emberlog.operators import explain, report, summaries
from registry.base import explained_table, scored_table
from registry.catalogue import query
from registry.sql import from_events, q

_PARTS = (
    ("event_class", "'Event type (' || event_class || ')'", 0.30, "t_event"),
    ("service", "'Service sensitivity (' || service || ')'", 0.15, "t_service"),
    ("burst", "'Repetition / burst size'", 0.15, "t_burst"),
    ("rarity", "'Message-pattern rarity'", 0.10, "t_rarity"),
    ("dbscan", "'DBSCAN noise membership'", 0.15, "t_dbscan"),
    ("forest", "'Isolation Forest anomaly score'", 0.15, "t_forest"),
)


@query(
    "risk_breakdown",
    from_events(
        " UNION ALL ".join(
            f"SELECT event_id, {name} AS component, round({w} * {term}, 6) + 0.0 AS contribution, CAST({w} AS DOUBLE) AS max_weight FROM ev"
            for _, name, w, term in _PARTS
        )
    ),
)
def risk_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = scored_table(spark, sf_dir)
    top = events.agg(F.max("tmpl_freq").alias("t")).scalar()
    rows = explain.risk_breakdown(events, top)
    return rows.withColumn("contribution", F.round("contribution", 6) + F.lit(0.0))


@query(
    "headlines",
    from_events(
        f"""SELECT event_id, CASE WHEN auth_burst THEN {q(K.HEADLINE_BURST)} WHEN dbscan_noise AND iforest_noise THEN {q(K.HEADLINE_BOTH)}
        WHEN dbscan_noise AND tmpl_freq <= 3 THEN {q(K.HEADLINE_RARE)} WHEN dbscan_noise THEN {q(K.HEADLINE_DBSCAN)}
        WHEN iforest_noise THEN {q(K.HEADLINE_FOREST)} ELSE {q(K.HEADLINE_NONE)} END AS headline FROM ev"""
    ),
)
def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_table(spark, sf_dir).select("event_id", explain.headline().alias("headline"))


@query(
    "source_facts",
    from_events(
        """SELECT src_host, count(*) AS source_rows, count_if(event_class = 'AUTH_FAIL') AS source_failures,
        count(DISTINCT CASE WHEN event_class = 'AUTH_FAIL' THEN target_user END) AS source_accounts
        FROM ev WHERE src_host IS NOT NULL GROUP BY src_host"""
    ),
)
def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.source_facts(scored_table(spark, sf_dir))


@query(
    "account_facts",
    from_events(
        """SELECT target_user, count(*) AS account_rows, count_if(event_class = 'AUTH_FAIL') AS account_failures
        FROM ev WHERE target_user IS NOT NULL GROUP BY target_user"""
    ),
)
def account_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.account_facts(scored_table(spark, sf_dir))


_FACTS = """src AS (SELECT src_host, count_if(event_class = 'AUTH_FAIL') AS source_failures,
  count(DISTINCT CASE WHEN event_class = 'AUTH_FAIL' THEN target_user END) AS source_accounts FROM ev WHERE src_host IS NOT NULL GROUP BY src_host),
acc AS (SELECT target_user, count_if(event_class = 'AUTH_FAIL') AS account_failures FROM ev WHERE target_user IS NOT NULL GROUP BY target_user),
clu AS (SELECT dbscan_cluster, count(*) AS cluster_size FROM ev GROUP BY dbscan_cluster),
hrs AS (SELECT hour, count(*) * 100.0 / (SELECT count(*) FROM ev) AS hour_share FROM ev GROUP BY hour),
told AS MATERIALIZED (SELECT * FROM ev LEFT JOIN src USING (src_host) LEFT JOIN acc USING (target_user) LEFT JOIN clu USING (dbscan_cluster) LEFT JOIN hrs USING (hour))"""


@query(
    "event_facts_joined",
    from_events(
        "SELECT event_id, source_failures, source_accounts, account_failures, cluster_size, round(hour_share, 6) AS hour_share FROM told",
        _FACTS,
    ),
)
def event_facts_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = scored_table(spark, sf_dir)
    return explain.with_facts(events, events).select(
        "event_id", "source_failures", "source_accounts", "account_failures", "cluster_size",
        F.round("hour_share", 6).alias("hour_share"),
    )


def _sentence(template: str, **values: str) -> str:
    """SQL concatenation for a text template."""
    from string import Formatter

    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(q(literal))
        if name is not None:
            parts.append(f"CAST({values[name]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"


def _commas(value: str) -> str:
    return f"format('{{:,}}', {value})"


def _score2(value: str) -> str:
    return f"CAST(CAST(round(CAST({value} AS DECIMAL(12, 3)), 2) AS DECIMAL(12, 2)) AS VARCHAR)"


_TOTAL = "(SELECT count(*) FROM ev)"
_EVIDENCE_ITEMS = ",\n  ".join(
    [
        "CASE WHEN dbscan_noise THEN " + _sentence(K.EVIDENCE_NOISE, min_samples="10", eps="'0.5'")
        + " ELSE " + _sentence(K.EVIDENCE_CLUSTER, cluster="dbscan_cluster", size=_commas("cluster_size")) + " END",
        _sentence(
            K.EVIDENCE_TEMPLATE, count=_commas("tmpl_freq"), pct=f"printf('%.2f', tmpl_freq * 100.0 / {_TOTAL})",
            rarity=f"(CASE WHEN tmpl_freq <= 3 THEN 'very rare' WHEN tmpl_freq * 100.0 / {_TOTAL} < 1 THEN 'uncommon' ELSE 'common' END)",
        ),
        "CASE WHEN burst > 1 THEN "
        + _sentence(K.EVIDENCE_REPETITION, burst="burst", event_class="event_class", service="service", window="'5min'") + " END",
        "CASE WHEN auth_burst THEN " + _sentence(K.EVIDENCE_BURST, threshold="20", window="'5min'") + " END",
        "CASE WHEN src_host <> '' THEN " + _sentence(K.EVIDENCE_SOURCE, source="src_host", count=_commas("source_failures"))
        + " || CASE WHEN source_accounts > 0 THEN " + _sentence(K.EVIDENCE_SOURCE_ACCOUNTS, users="source_accounts") + " ELSE '' END || '.' END",
        "CASE WHEN target_user <> '' AND account_failures > 1 THEN "
        + _sentence(K.EVIDENCE_ACCOUNT, user="target_user", count=_commas("account_failures")) + " END",
        "CASE WHEN hour_share < 3 THEN "
        + _sentence(K.EVIDENCE_TIMING, share="printf('%.1f', hour_share)", hour="printf('%02d', hour)") + " END",
        _sentence(
            K.EVIDENCE_FOREST, score=_score2("model_prob"),
            agree="(CASE WHEN iforest_noise = (status = 'ANOMALY') THEN 'agrees' ELSE 'disagrees' END)",
        ),
        "CASE WHEN t_service >= 0.7 THEN " + _sentence(K.EVIDENCE_SENSITIVE, service="service") + " END",
    ]
)
_ACTIONS = "CASE event_class " + " ".join(
    f"WHEN '{c}' THEN [{', '.join(q(a) for a in items)}]" for c, items in K.RECOMMENDED_ACTIONS.items()
) + f" ELSE [{', '.join(q(a) for a in K.DEFAULT_ACTIONS)}] END"
_SIGNALS = """(dbscan_noise OR contains(detection_method, 'DBSCAN')) AS s_density,
  (iforest_noise OR contains(detection_method, 'Isolation Forest')) AS s_forest"""
_HEADLINE = f"""CASE WHEN auth_burst THEN {q(K.HEADLINE_BURST)} WHEN dbscan_noise AND iforest_noise THEN {q(K.HEADLINE_BOTH)}
  WHEN dbscan_noise AND tmpl_freq <= 3 THEN {q(K.HEADLINE_RARE)} WHEN dbscan_noise THEN {q(K.HEADLINE_DBSCAN)}
  WHEN iforest_noise THEN {q(K.HEADLINE_FOREST)} ELSE {q(K.HEADLINE_NONE)} END"""
_EXPLAINED = f"""exp0 AS (SELECT *, {_SIGNALS}, {_HEADLINE} AS headline, {_ACTIONS} AS actions,
  list_filter([{_EVIDENCE_ITEMS}], lambda x: x IS NOT NULL) AS evidence FROM told),
exp AS MATERIALIZED (SELECT *, list_filter(evidence, lambda x: (s_density OR NOT contains(x, 'DBSCAN'))
    AND (s_forest OR NOT contains(x, 'Isolation Forest')) AND (auth_burst OR NOT contains(x, 'Burst rule'))) AS relevant,
  list_filter([CASE WHEN s_density THEN {q(K.DETAIL_DBSCAN)} END,
    CASE WHEN s_density AND tmpl_freq <= 3 THEN {_sentence(K.DETAIL_RARE, count='tmpl_freq')} END,
    CASE WHEN s_forest THEN {q(K.DETAIL_FOREST)} END,
    CASE WHEN auth_burst THEN {_sentence(K.DETAIL_BURST, count='burst')} END], lambda x: x IS NOT NULL) AS details FROM exp0)"""


def _told(body: str) -> str:
    return from_events(body, _FACTS, _EXPLAINED)


def _lines(column: str):
    return F.array_join(column, "\n").alias(column)


@query("evidence", _told("SELECT event_id, array_to_string(evidence, chr(10)) AS evidence FROM exp"))
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explained_table(spark, sf_dir).select("event_id", _lines("evidence"))


@query("recommended_actions", _told("SELECT event_id, array_to_string(actions, chr(10)) AS actions FROM exp"))
def recommended_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.with_actions(scored_table(spark, sf_dir)).select("event_id", _lines("actions"))


@query(
    "shown_times",
    from_events("SELECT event_id, time_text AS dated, strftime(event_time, '%b %d %H:%M:%S') AS yearless FROM ev"),
)
def shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("timestamp")
    return scored_table(spark, sf_dir).select(
        "event_id", format_time(ts, True).alias("dated"), format_time(ts, False).alias("yearless")
    )


_PRIORITY = "CASE severity WHEN 'CRITICAL' THEN 'P1 — urgent' WHEN 'HIGH' THEN 'P2 — prompt' ELSE 'P3 — routine' END"
_TRIAGE_PRIORITY = "CASE severity WHEN 'CRITICAL' THEN 'P1 — urgent analyst review' WHEN 'HIGH' THEN 'P2 — prompt review' ELSE 'P3 — routine review' END"


@query("priorities", from_events(f"SELECT event_id, {_PRIORITY} AS priority FROM ev"))
def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = summaries.priority(K.PRIORITY_SUMMARY, K.PRIORITY_SUMMARY_OTHER)
    return scored_table(spark, sf_dir).select("event_id", priority.alias("priority"))


@query("signal_details", _told("SELECT event_id, array_to_string(details, chr(10)) AS details FROM exp WHERE status = 'ANOMALY'"))
def signal_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_table(spark, sf_dir).where("status = 'ANOMALY'")
    return rows.select("event_id", F.array_join(summaries.signal_details(), "\n").alias("details"))


@query("relevant_evidence", _told("SELECT event_id, array_to_string(relevant, chr(10)) AS evidence FROM exp"))
def relevant_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explained_table(spark, sf_dir).select(
        "event_id", F.array_join(summaries.relevant_evidence(), "\n").alias("evidence")
    )


def _redacted(value: str) -> str:
    for name in ("hostname", "src_host", "target_user"):
        value = f"CASE WHEN COALESCE({name}, '') <> '' THEN replace({value}, {name}, '[redacted]') ELSE {value} END"
    return value


@query(
    "redacted_evidence",
    _told(f"SELECT event_id, array_to_string(list_transform(relevant, lambda x: {_redacted('x')}), chr(10)) AS evidence FROM exp"),
)
def redacted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explained_table(spark, sf_dir).select(
        "event_id", F.array_join(summaries.redacted_evidence(), "\n").alias("evidence")
    )


@query(
    "event_facts",
    from_events(
        f"""SELECT event_id, 'Event ID: ' || event_id || chr(10) || 'Timestamp: ' || time_text || chr(10) || 'Service: ' || service
        || chr(10) || 'Event class: ' || event_class || chr(10) || 'Severity: ' || severity || chr(10) || 'Risk score: ' || {_score2('risk_score')}
        || '/1.00' || chr(10) || {q(K.FACTS_WITHHELD)} AS facts FROM ev"""
    ),
)
def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_table(spark, sf_dir).select("event_id", summaries.event_facts().alias("facts"))


_N = "chr(10)"
_BULLETS = f"array_to_string(list_transform({{}}, lambda x: '- ' || x), {_N})"
_NUMBERS = f"array_to_string(list_transform({{}}, lambda x, i: i || '. ' || x), {_N})"


@query(
    "event_summaries",
    _told(
        f"""SELECT event_id, '**Alert:** ' || headline || {_N} || {_N} || '**Event context:** ' || event_id || ' | ' || time_text || ' | host `' || hostname
        || '` | service `' || service || '` | `' || event_class || '`' || {_N} || {_N} || '**Priority:** ' || {_PRIORITY} || ' (' || severity || ') | Risk score: '
        || {_score2('risk_score')} || '/1.00' || {_N} || {_N}
        || CASE WHEN len(details) > 0 THEN '**Relevant detection signals:**' || {_N} || {_BULLETS.format('details')} || {_N} || {_N} ELSE '' END
        || '**Why it was flagged:**' || {_N} || {_BULLETS.format('relevant')} || {_N} || {_N} || '**Assessment:** '
        || CASE WHEN event_class = 'AUTH_FAIL' THEN {q(K.ASSESSMENT_AUTH)} ELSE {q(K.ASSESSMENT_OTHER)} END || ' ' || {q(K.SUMMARY_CAVEAT)} || {_N} || {_N}
        || '**Recommended analyst actions:**' || {_N} || {_NUMBERS.format('actions')} || {_N} || {_N} || {q(K.SUMMARY_ESCALATION)} AS summary
        FROM exp WHERE status = 'ANOMALY'"""
    ),
)
def event_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyst note of every anomaly."""
    events = scored_table(spark, sf_dir)
    told = explain.explain(events, events.where("status = 'ANOMALY'"))
    return told.select("event_id", summaries.event_summary().alias("summary"))


@query(
    "triage_notes",
    _told(
        f"""SELECT event_id, {_TRIAGE_PRIORITY} || {_N} || {q(K.TRIAGE_REASON)} || {_N} || 'Risk score: ' || {_score2('risk_score')} || '/1.00 (' || severity || ')'
        || {_N} || 'Suggested triage:' || {_N} || {_NUMBERS.format('actions')} || {_N} || {_N} || {q(K.TRIAGE_CAVEAT)} AS triage
        FROM exp WHERE status = 'ANOMALY'"""
    ),
)
def triage_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explain.with_actions(scored_table(spark, sf_dir).where("status = 'ANOMALY'"))
    return rows.select("event_id", summaries.triage_note().alias("triage"))


# ----------------------------------------------------- context and relations
@query(
    "event_context",
    from_events(
        """SELECT s.event_id AS seed_id, CAST(e.row_idx - s.row_idx AS BIGINT) AS "offset", e.event_id, e.message
        FROM ev s JOIN ev e ON e.row_idx BETWEEN s.row_idx - 8 AND s.row_idx + 8 WHERE s.status = 'ANOMALY'"""
    ),
)
def event_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = scored_table(spark, sf_dir)
    found = explain.event_context(events, events.where("status = 'ANOMALY'"))
    return found.select("seed_id", F.col("offset").cast("long").alias("offset"), "event_id", "message")


def _related(name: str, key: str):
    sql = from_events(
        f"""SELECT {key}, rank, event_id, status = 'ANOMALY' AS seed FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY row_idx) AS rank,
        count_if(status = 'ANOMALY') OVER (PARTITION BY {key}) AS seeds FROM ev WHERE {key} IS NOT NULL) WHERE seeds > 0"""
    )

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All events that share a value with an anomaly, in order, and which of them are anomalies."""
        events = scored_table(spark, sf_dir)
        links, ranked = explain.related_by_key(events, events.where("status = 'ANOMALY'"), key)
        seeds = links.select(F.col("seed_id").alias("event_id"), F.lit(True).alias("seed"))
        found = ranked.select(key, F.col("rank").cast("long").alias("rank"), "event_id").join(seeds, "event_id", "left")
        return found.select(key, "rank", "event_id", F.coalesce("seed", F.lit(False)).alias("seed"))

    return run


_related("events_of_same_source", "src_host")
_related("events_of_same_template", "template")


@query(
    "template_totals",
    from_events("SELECT template, count(*) AS events, count_if(status = 'ANOMALY') AS anomalies FROM ev GROUP BY template"),
)
def template_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.key_totals(scored_table(spark, sf_dir), "template")


def _saved(events: DataFrame) -> DataFrame:
    """A disposition log: every anomaly is judged up to three times."""
    n = F.col("line_no")
    picks = ["Unreviewed", "Escalate to incident response", "Benign / expected", "False positive", "Needs more data"]
    rounds = F.explode(F.sequence(F.lit(0), (n % 3).cast("int"))).alias("round")
    return events.where("status = 'ANOMALY'").select("event_id", "line_no", rounds).select(
        "event_id",
        F.array(*[F.lit(p) for p in picks])[((F.col("line_no") + F.col("round")) % 5).cast("int")].alias("status"),
        F.concat(F.lit("note "), F.col("round").cast("string")).alias("note"),
        F.col("round").alias("saved_at"),
    )


_SAVED = """saved AS (SELECT event_id, (['Unreviewed', 'Escalate to incident response', 'Benign / expected', 'False positive', 'Needs more data'])[(line_no + r) % 5 + 1] AS pick,
  'note ' || r AS note, r FROM (SELECT event_id, line_no, unnest(range(line_no % 3 + 1)) AS r FROM ev WHERE status = 'ANOMALY'))"""


@query(
    "dispositions",
    from_events("SELECT event_id, arg_max(pick, r) AS disposition, arg_max(note, r) AS note FROM saved GROUP BY event_id", _SAVED),
)
def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.latest_dispositions(_saved(scored_table(spark, sf_dir)))


@query(
    "events_with_dispositions",
    from_events(
        """SELECT e.event_id, e.status, COALESCE(d.disposition, 'Unreviewed') AS disposition, d.note FROM ev e LEFT JOIN
        (SELECT event_id, arg_max(pick, r) AS disposition, arg_max(note, r) AS note FROM saved GROUP BY event_id) d USING (event_id)""",
        _SAVED,
    ),
)
def events_with_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = scored_table(spark, sf_dir)
    return explain.with_dispositions(events, _saved(events)).select("event_id", "status", "disposition", "note")


# ---------------------------------------------------------------- reports
def _ranked_lines(section: int, column: str, where: str, shape: str) -> str:
    return f"""SELECT {section} AS section, row_number() OVER (ORDER BY n DESC, k) AS line, {shape} AS text FROM (SELECT {column} AS k, count(*) AS n
      FROM ev WHERE status = 'ANOMALY' AND {column} IS NOT NULL{where} GROUP BY {column} ORDER BY n DESC, k LIMIT 5)"""


_KPI = """kpi AS (SELECT count(*) AS total, count_if(status = 'ANOMALY') AS anomalies, count(DISTINCT service) AS services,
  count_if(status = 'ANOMALY' AND severity IN ('HIGH', 'CRITICAL')) AS high_risk, min(time_text) AS t0, max(time_text) AS t1,
  printf('%.2f', round(count_if(status = 'ANOMALY') * 100.0 / count(*), 2)) AS rate FROM ev)"""
_NEXT = " || chr(10) || ".join(q(s) for s in K.REPORT_NEXT_STEPS)
_REPORT_LINES = f"""parts AS (
  SELECT 1 AS section, 1 AS line, {q(K.REPORT_TITLE)} || chr(10) || chr(10) || '**Dataset:** messages.log · ' || format('{{:,}}', total) || ' Linux log events · ' || t0 || ' → ' || t1
    || chr(10) || chr(10) || '## Key figures' || chr(10) || '- Anomalies detected: **' || format('{{:,}}', anomalies) || '** (' || rate || '% of events)' || chr(10)
    || '- High-risk (HIGH + CRITICAL) anomalies: **' || format('{{:,}}', high_risk) || '**' || chr(10) || '- Services monitored: ' || services || chr(10) AS text FROM kpi
  UNION ALL SELECT 2, 1, '## Top suspicious services'
  UNION ALL {_ranked_lines(3, 'service', '', "'- ' || k || ': ' || format('{:,}', n) || ' anomalies'")}
  UNION ALL SELECT 4, 1, chr(10) || '## Top suspicious event types'
  UNION ALL {_ranked_lines(5, 'event_class', '', "'- ' || k || ': ' || format('{:,}', n)")}
  UNION ALL SELECT 6, 1, chr(10) || '## Top source hosts (anomalous authentication failures)'
  UNION ALL {_ranked_lines(7, 'src_host', " AND event_class = 'AUTH_FAIL'", "'- ' || k || ': ' || format('{:,}', n)")}
  UNION ALL SELECT 8, 1, chr(10) || '## Highest-risk events'
  UNION ALL SELECT 9, row_number() OVER (ORDER BY risk_score DESC, row_idx), '- ' || event_id || ' · ' || time_text || ' · ' || service || ' · ' || event_class || ' · risk ' || {_score2('risk_score')}
    FROM (SELECT * FROM ev WHERE status = 'ANOMALY' ORDER BY risk_score DESC, row_idx LIMIT 5)
  UNION ALL SELECT 11, 1, chr(10) || '## Recommended next steps' || chr(10) || {_NEXT} || chr(10) || chr(10) || {q(K.REPORT_CLOSING)})"""


@query(
    "summary_report",
    from_events("SELECT string_agg(text, chr(10) ORDER BY section, line) AS report FROM parts", _KPI, _REPORT_LINES),
)
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_report(scored_table(spark, sf_dir), "messages.log")


def _dict_sql(column: str, limit: str) -> str:
    return f"""(SELECT string_agg('''' || k || ''': ' || n, ', ' ORDER BY n DESC, k) FROM (SELECT {column} AS k, count(*) AS n FROM ev
      WHERE status = 'ANOMALY' GROUP BY {column} ORDER BY n DESC, k{limit}))"""


@query(
    "incident_review",
    from_events(
        f"""SELECT {q(K.REVIEW_TITLE)} || chr(10) || chr(10) || {q(K.REVIEW_NOTICE)} || chr(10) || chr(10) || '## Analysis facts' || chr(10) || (
        'Dataset: messages.log' || chr(10) || 'Events: ' || format('{{:,}}', total) || chr(10) || 'Anomalies: ' || format('{{:,}}', anomalies) || ' (' || rate || '%)' || chr(10)
        || 'High-risk anomalies: ' || format('{{:,}}', high_risk) || chr(10) || 'Severity counts: {{' || {_dict_sql('severity', '')} || '}}' || chr(10)
        || 'Top anomalous services: {{' || {_dict_sql('service', ' LIMIT 10')} || '}}' || chr(10) || 'Top event classes: {{' || {_dict_sql('event_class', ' LIMIT 10')} || '}}' || chr(10)
        || 'Highest-risk event summaries: [' || (SELECT string_agg('{{''event_class'': ''' || event_class || ''', ''service'': ''' || service || ''', ''severity'': ''' || severity
          || ''', ''risk_score'': ' || CAST(round(CAST(risk_score AS DECIMAL(12, 3)), 2) AS DOUBLE) || '}}', ', ' ORDER BY risk_score DESC, row_idx)
          FROM (SELECT * FROM ev WHERE status = 'ANOMALY' ORDER BY risk_score DESC, row_idx LIMIT 10)) || ']' || chr(10) || {q(K.REVIEW_FACTS_CAVEAT)})
        || chr(10) || chr(10) || '## Analyst caveat' || chr(10) || {q(K.REVIEW_CAVEAT)} AS report FROM kpi""",
        _KPI,
    ),
)
def incident_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.incident_review(scored_table(spark, sf_dir), "messages.log")
