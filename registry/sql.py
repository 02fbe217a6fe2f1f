"""SQL building blocks for the oracles: the same tables, written independently for DuckDB."""

from __future__ import annotations

from emberlog import constants as K
from registry.logs import LOGS_SELECT


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(table: dict) -> str:
    return ", ".join(f"({q(k)}, CAST({v} AS DOUBLE))" for k, v in table.items())


LOGS = "logs AS MATERIALIZED (SELECT *, ts AS event_time FROM (" + LOGS_SELECT.format(events="events") + "))"

RAW_TYPE = "''"


def clean_ctes(source: str = "logs", raw: str = "''", prefix: str = "") -> str:
    """``clean`` from a table with line_no, event_time, hostname, service, message, label."""
    p = prefix
    return f"""
{p}c1 AS (SELECT * EXCLUDE (service, message), {raw} AS raw_type,
    regexp_replace(regexp_replace(service, '\\[\\d+\\]', '', 'g'), '\\s[\\d.]+$', '') AS service_raw,
    trim(message) AS message FROM {source}),
{p}c2 AS (SELECT *, CASE WHEN trim(regexp_replace(service_raw, '\\(.*\\)$', '')) = '' THEN 'unknown'
    ELSE trim(regexp_replace(service_raw, '\\(.*\\)$', '')) END AS service, lower(message) AS m FROM {p}c1),
{p}clean AS MATERIALIZED (SELECT * EXCLUDE (m, raw_type),
  CASE
    WHEN regexp_matches(m, 'authentication failure|failed password|failed login|invalid user|illegal user|check pass; user unknown|failed none|login incorrect|auth.*fail') THEN 'AUTH_FAIL'
    WHEN (service IN ('su', 'sudo') OR regexp_matches(m, '\\bsudo\\b|command=|session opened for user root')) AND NOT contains(m, 'session closed') THEN 'PRIVILEGE_EVENT'
    WHEN contains(m, 'session opened') THEN 'SESSION_OPEN'
    WHEN contains(m, 'session closed') THEN 'SESSION_CLOSE'
    WHEN service = 'kernel' AND raw_type <> 'ERROR' THEN 'KERNEL_EVENT'
    WHEN raw_type = 'ERROR' OR regexp_matches(m, '\\berror\\b|exited abnormally|fatal|segfault|\\bdied\\b|failed') THEN 'SERVICE_ERROR'
    WHEN raw_type = 'WARNING' OR contains(m, 'warning') THEN 'WARNING'
    WHEN raw_type = 'SERVICE_STOP' OR regexp_matches(m, 'shutdown succeeded|shutting down|\\bstopped\\b|terminated') THEN 'SERVICE_STOP'
    WHEN raw_type = 'SERVICE_START' OR regexp_matches(m, 'startup succeeded|\\bstarted\\b|\\bstarting\\b') THEN 'SERVICE_START'
    WHEN raw_type = 'RESTART' OR contains(m, 'restart') THEN 'RESTART'
    ELSE 'INFO' END AS event_class,
  COALESCE(NULLIF(regexp_extract(message, 'rhost=([^\\s]+)', 1), ''),
           NULLIF(regexp_extract(message, '\\bfrom\\s+(\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}})\\b', 1), '')) AS src_host,
  COALESCE(NULLIF(regexp_extract(message, '\\buser=([^\\s]+)', 1), ''),
           NULLIF(regexp_extract(message, '\\b(?:for user|for invalid user|for)\\s+([a-zA-Z0-9_.-]+)', 1), '')) AS target_user,
  hour(event_time) AS hour,
  length(message) AS message_length,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
    'rhost=\\S+', 'rhost=H', 'g'), 'user=\\S+', 'user=U', 'g'), 'for user \\S+', 'for user U', 'g'),
    '\\b\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}\\b', 'IP', 'g'), '0x[0-9a-fA-F]+', 'HEX', 'g'), '\\d+', 'N', 'g') AS template,
  epoch_us(event_time) // 300000000 AS win
  FROM {p}c2)"""


FREQ = """
freq AS MATERIALIZED (SELECT *,
  count(*) OVER (PARTITION BY template) AS tmpl_freq,
  count(*) OVER (PARTITION BY service) AS svc_freq,
  count(*) OVER (PARTITION BY service, event_class, win) AS burst
  FROM clean)"""

RAW_FEATURES = """
raw AS MATERIALIZED (SELECT *,
  sin(2 * pi() * hour / 24) AS r0, cos(2 * pi() * hour / 24) AS r1, ln(1 + message_length) AS r2,
  ln(1 + tmpl_freq) AS r3, ln(1 + svc_freq) AS r4, ln(1 + burst) AS r5 FROM freq)"""

MOMENTS = "mom AS MATERIALIZED (SELECT " + ", ".join(
    f"avg(r{i}) AS m{i}, CASE WHEN max(r{i}) = min(r{i}) THEN 1.0 ELSE stddev_pop(r{i}) END AS s{i}" for i in range(6)
) + " FROM raw)"

VECTORS = (
    "vec AS MATERIALIZED (SELECT row_number() OVER (ORDER BY event_class, hour, message_length, tmpl_freq, svc_freq, burst) AS v, * FROM ("
    "SELECT event_class, hour, message_length, tmpl_freq, svc_freq, burst, count(*) AS weight, min((event_time, line_no)) AS first_row, "
    + ", ".join(f"(any_value(r{i}) - any_value(m{i})) / any_value(s{i}) AS z{i}" for i in range(6))
    + " FROM raw, mom GROUP BY event_class, hour, message_length, tmpl_freq, svc_freq, burst))"
)

_DISTANCE = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(6))


def density_ctes(eps: float = 0.5, samples: int = 10) -> str:
    limit = round(eps * eps, 9)
    return f"""
near AS MATERIALIZED (SELECT a.v AS a, b.v AS b, b.weight AS w FROM vec a JOIN vec b ON a.event_class = b.event_class
  WHERE round({_DISTANCE}, 9) <= {limit}),
core AS MATERIALIZED (SELECT a AS v FROM near GROUP BY a HAVING sum(w) >= {samples}),
flags AS MATERIALIZED (SELECT v.*, v.v IN (SELECT v FROM core) AS core,
  v.v NOT IN (SELECT a FROM near WHERE b IN (SELECT v FROM core)) AS dbscan_noise FROM vec v)"""


CLUSTERS = """
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT v FROM core) AND b IN (SELECT v FROM core)),
reach AS (SELECT v AS a, v AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
rooted AS MATERIALIZED (SELECT a AS v, min(b) AS root FROM reach GROUP BY a),
heads AS (SELECT root, min(first_row) AS first_row FROM rooted JOIN vec USING (v) GROUP BY root),
numbered AS (SELECT root, row_number() OVER (ORDER BY first_row) - 1 AS number FROM heads),
cored AS MATERIALIZED (SELECT v, number FROM rooted JOIN numbered USING (root)),
border AS (SELECT a AS v, min(number) AS number FROM near JOIN cored ON near.b = cored.v GROUP BY a),
clustered AS MATERIALIZED (SELECT f.*, CAST(COALESCE(c.number, b.number, -1) AS BIGINT) AS dbscan_cluster
  FROM flags f LEFT JOIN cored c USING (v) LEFT JOIN border b USING (v))"""

_WEIGHTS = f"weights(event_class, event_weight) AS (VALUES {_values(K.EVENT_WEIGHTS)})"
_SENSITIVITY = f"sens(service, sensitivity) AS (VALUES {_values(K.SERVICE_SENSITIVITY)})"

SCORED = f"""
{_WEIGHTS},
{_SENSITIVITY},
det AS MATERIALIZED (SELECT f.*, c.dbscan_cluster, c.dbscan_noise,
  (f.line_no % 101) / 100.0 AS model_prob, (f.line_no % 101) / 100.0 > 0.95 AS iforest_noise,
  row_number() OVER (ORDER BY f.event_time, f.line_no) - 1 AS row_idx
  FROM freq f JOIN clustered c ON f.event_class = c.event_class AND f.hour = c.hour AND f.message_length = c.message_length
    AND f.tmpl_freq = c.tmpl_freq AND f.svc_freq = c.svc_freq AND f.burst = c.burst),
terms AS (SELECT d.*, COALESCE(w.event_weight, 0.05) AS t_event, COALESCE(s.sensitivity, 0.2) AS t_service,
  least(greatest(ln(burst) / ln(51), 0), 1) AS t_burst,
  1 - ln(1 + tmpl_freq) / ln(1 + (SELECT max(tmpl_freq) FROM freq)) AS t_rarity,
  CASE WHEN dbscan_noise THEN 1.0 ELSE 0.0 END AS t_dbscan, CAST(model_prob AS DOUBLE) AS t_forest
  FROM det d LEFT JOIN weights w USING (event_class) LEFT JOIN sens s USING (service)),
risked AS (SELECT *, 'EVT-' || CASE WHEN row_idx + 1 < 1000000 THEN lpad(CAST(row_idx + 1 AS VARCHAR), 6, '0') ELSE CAST(row_idx + 1 AS VARCHAR) END AS event_id,
  CASE WHEN dbscan_noise OR iforest_noise THEN 'ANOMALY' ELSE 'NORMAL' END AS status,
  CASE WHEN dbscan_noise AND iforest_noise THEN 'DBSCAN + Isolation Forest' WHEN dbscan_noise THEN 'DBSCAN'
       WHEN iforest_noise THEN 'Isolation Forest' ELSE '—' END AS detection_method,
  event_class = 'AUTH_FAIL' AND burst >= 20 AS auth_burst,
  CAST(round(CAST(least(greatest(0.30 * t_event + 0.15 * t_service + 0.15 * t_burst + 0.10 * t_rarity + 0.15 * t_dbscan + 0.15 * t_forest, 0), 1) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS risk_score
  FROM terms),
ev AS MATERIALIZED (SELECT *,
  CASE WHEN risk_score >= 0.6 AND status = 'NORMAL' THEN 'MEDIUM' WHEN risk_score >= 0.8 THEN 'CRITICAL'
       WHEN risk_score >= 0.6 THEN 'HIGH' WHEN risk_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN dbscan_noise AND iforest_noise THEN {q(K.REASON_BOTH)} WHEN iforest_noise THEN {q(K.REASON_FOREST)}
       WHEN dbscan_noise AND tmpl_freq <= 3 THEN 'Rare message pattern (seen ' || tmpl_freq || 'x)'
       WHEN dbscan_noise THEN {q(K.REASON_DBSCAN)} ELSE '' END AS reason,
  strftime(event_time, '%Y-%m-%d %H:%M:%S') AS time_text
  FROM risked)"""


def _with(*parts: str, body: str) -> str:
    recursive = "RECURSIVE " if any("reach AS" in p for p in parts) else ""
    return f"WITH {recursive}" + ",\n".join(p.strip() for p in parts) + "\n" + body


def from_logs(body: str, *extra: str) -> str:
    return _with(LOGS, *extra, body=body)


def from_clean(body: str, *extra: str) -> str:
    return _with(LOGS, clean_ctes(), *extra, body=body)


def from_freq(body: str, *extra: str) -> str:
    return _with(LOGS, clean_ctes(), FREQ, *extra, body=body)


def from_raw(body: str, *extra: str) -> str:
    return _with(LOGS, clean_ctes(), FREQ, RAW_FEATURES, MOMENTS, *extra, body=body)


def from_vectors(body: str, *extra: str) -> str:
    return _with(LOGS, clean_ctes(), FREQ, RAW_FEATURES, MOMENTS, VECTORS, *extra, body=body)


def from_flags(body: str, *extra: str) -> str:
    return from_vectors(body, density_ctes(), *extra)


def from_clusters(body: str, *extra: str) -> str:
    return from_vectors(body, density_ctes(), CLUSTERS, *extra)


def from_events(body: str, *extra: str) -> str:
    return from_vectors(body, density_ctes(), CLUSTERS, SCORED, *extra)
