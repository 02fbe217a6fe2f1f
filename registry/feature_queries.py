"""Cleaning, text functions, frequencies and feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog import constants as K
from emberlog.functions import scoring, text
from emberlog.operators import evaluate, features as X
from emberlog.operators.ordering import event_id, with_row_index
from emberlog.operators.projection import covariance
from emberlog.operators.skew import attach_by_key
from emberlog.session import store
from registry.base import cleaned_table, frequency_table, scored_table, vector_table
from registry.catalogue import query
from registry.logs import logs_table
from registry.sql import from_clean, from_events, from_freq, from_logs, from_raw, from_vectors


def six(column):
    return F.round(column, 6) + F.lit(0.0)


@query(
    "normalised_services",
    from_clean("SELECT service_raw, service, count(*) AS events FROM clean GROUP BY ALL"),
)
def normalised_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_table(spark, sf_dir).groupBy("service_raw", "service").agg(F.count("*").alias("events"))


@query("stripped_messages", from_logs("SELECT line_no, message, length(message) AS chars FROM logs"))
def stripped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" \t "), "message", F.lit("\n  "))
    rows = logs_table(spark, sf_dir).select("line_no", text.strip(padded).alias("message"))
    return rows.withColumn("chars", F.length("message").cast("long"))


@query("event_classes", from_clean("SELECT line_no, event_class FROM clean"))
def event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_table(spark, sf_dir).select("line_no", "event_class")


@query("extracted_identities", from_clean("SELECT line_no, src_host, target_user FROM clean"))
def extracted_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_table(spark, sf_dir).select("line_no", "src_host", "target_user")


@query(
    "message_templates",
    from_clean("SELECT template, count(*) AS events, min(message) AS first_text FROM clean GROUP BY template"),
)
def message_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_table(spark, sf_dir).groupBy("template").agg(
        F.count("*").alias("events"), F.min("message").alias("first_text")
    )


@query(
    "document_text_measures",
    """SELECT doc_id, length(text) AS chars,
    length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents""",
)
def document_text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digit count on free, partly non-ASCII text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ratio = text.digit_ratio("text")
    return docs.select(
        "doc_id",
        F.length("text").cast("long").alias("chars"),
        F.round(ratio * F.greatest(F.length("text"), F.lit(1))).cast("long").alias("digits"),
    )


@query(
    "text_measures",
    from_clean(
        """SELECT line_no, hour, message_length, len(regexp_split_to_array(message, '\\s+')) AS token_count,
        round(length(regexp_replace(message, '[^0-9]', '', 'g')) / greatest(length(message), 1), 6) AS digit_ratio FROM clean"""
    ),
)
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.with_text_measures(cleaned_table(spark, sf_dir))
    return rows.select("line_no", "hour", "message_length", "token_count", six(F.col("digit_ratio")).alias("digit_ratio"))


@query(
    "event_ids",
    from_logs(
        "SELECT line_no, 'EVT-' || lpad(CAST(row_number() OVER (ORDER BY event_time, line_no) AS VARCHAR), 6, '0') AS event_id FROM logs"
    ),
)
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = logs_table(spark, sf_dir).select("line_no", "timestamp")
    return with_row_index(slim, "timestamp", "line_no").select("line_no", event_id().alias("event_id"))


@query("frequencies", from_freq("SELECT line_no, tmpl_freq, svc_freq, burst FROM freq"))
def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency_table(spark, sf_dir).select("line_no", "tmpl_freq", "svc_freq", "burst")


@query(
    "template_frequency",
    from_freq("SELECT DISTINCT template, tmpl_freq FROM freq"),
)
def template_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_table(spark, sf_dir).groupBy("template").agg(F.count("*").alias("tmpl_freq"))


@query(
    "burst_windows",
    from_freq(
        "SELECT service, event_class, strftime(make_timestamp(win * 300000000), '%Y-%m-%d %H:%M:%S') AS window_start, burst"
        " FROM freq GROUP BY ALL"
    ),
)
def burst_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["service", "event_class", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")]
    return cleaned_table(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("burst"))


@query(
    "raw_features",
    from_raw(
        "SELECT event_class, hour, message_length, tmpl_freq, svc_freq, burst, count(*) AS weight, "
        + ", ".join(f"round(any_value(r{i}), 6) + 0.0 AS {n}" for i, n in enumerate(X.NUMERIC))
        + " FROM raw GROUP BY event_class, hour, message_length, tmpl_freq, svc_freq, burst"
    ),
)
def raw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyclic hour and log features before scaling, per distinct vector."""
    rows = X.vectors(X.signatures(cleaned_table(spark, sf_dir)))
    raw = {n: six(c) for n, c in X.numeric_features().items()}
    return rows.select(*X.VECTOR_KEY, "weight", *[c.alias(n) for n, c in raw.items()])


@query(
    "scaler_moments",
    from_raw(
        "SELECT "
        + ", ".join(
            f"round(m{i}, 6) + 0.0 AS {n}_mean, round(s{i}, 6) + 0.0 AS {n}_std" for i, n in enumerate(X.NUMERIC)
        )
        + " FROM mom"
    ),
)
def scaler_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = X.scaler_moments(X.vectors(X.signatures(cleaned_table(spark, sf_dir))))
    return moments.select(*[six(F.col(c)).alias(c) for c in moments.columns])


@query(
    "feature_vectors",
    from_vectors(
        "SELECT event_class, hour, message_length, tmpl_freq, svc_freq, burst, weight, "
        + ", ".join(f"round(z{i}, 6) + 0.0 AS {n}" for i, n in enumerate(X.NUMERIC))
        + ", "
        + ", ".join(f"CASE WHEN event_class = '{c}' THEN 1.0 ELSE 0.0 END::DOUBLE AS evt_{c}" for c in K.EVENT_CLASSES)
        + " FROM vec"
    ),
)
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_table(spark, sf_dir)
    return rows.select(
        *X.VECTOR_KEY, "weight", *[six(F.col(n)).alias(n) for n in X.NUMERIC], *X.ONE_HOT
    )


@query(
    "classifier_matrix",
    from_freq(
        f"""SELECT line_no, hour, message_length, len(regexp_split_to_array(message, '\\s+')) AS token_count,
        round(length(regexp_replace(message, '[^0-9]', '', 'g')) / greatest(length(message), 1), 6) + 0.0 AS digit_ratio,
        round(ln(1 + tmpl_freq), 6) AS log_template_freq, round(ln(1 + svc_freq), 6) AS log_service_freq,
        round(ln(1 + burst), 6) AS log_burst, event_class AS flagged_class, service, service_index, n_services FROM freq
        JOIN (SELECT service, row_number() OVER (ORDER BY count(*) DESC, service) - 1 AS service_index, count(*) OVER () AS n_services
          FROM clean GROUP BY service) USING (service)"""
    ),
)
def classifier_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supervised matrix: its class flags are shown as the flagged name, the flags of all services as the place of the one set."""
    cleaned = cleaned_table(spark, sf_dir)
    found = store(X.signatures(cleaned))
    counted = found.groupBy("service").agg(F.sum("n").alias("n"))
    places = store(evaluate.service_places(counted))
    rows = X.with_text_measures(X.attach(cleaned, found))
    placed = attach_by_key(rows, places, ["service"], F.col("line_no"), "n")
    matrix = evaluate.tree_matrix(placed, []).withColumn("n_services", F.lit(places.count()).cast("long"))

    def flagged(prefix: str, names):
        case = F
        for name in names:
            case = case.when(F.col(f"`{prefix}{name}`") == 1, F.lit(name))
        return case.otherwise(F.lit(""))

    numeric = ("digit_ratio", "log_template_freq", "log_service_freq", "log_burst")
    return matrix.select(
        "line_no", "hour", "message_length", "token_count", *[six(F.col(c)).alias(c) for c in numeric],
        flagged("evt_", K.EVENT_CLASSES).alias("flagged_class"), "service", "service_index", "n_services",
    )


@query(
    "feature_covariance",
    from_vectors(
        "SELECT CAST(fi.i AS BIGINT) AS i, CAST(fj.i AS BIGINT) AS j, round(covar_pop(x[fi.i + 1], x[fj.i + 1]), 9) + 0.0 AS cov FROM"
        " (SELECT list_value("
        + ", ".join(f"z{i}" for i in range(6))
        + ", "
        + ", ".join(f"CASE WHEN event_class = '{c}' THEN 1.0 ELSE 0.0 END::DOUBLE" for c in K.EVENT_CLASSES)
        + ") AS x, unnest(range(weight)) FROM vec), (SELECT unnest(range(17)) AS i) fi, (SELECT unnest(range(17)) AS i) fj"
        " WHERE fi.i <= fj.i GROUP BY fi.i, fj.i"
    ),
)
def feature_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = covariance(vector_table(spark, sf_dir))
    return rows.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.round("cov", 9) + F.lit(0.0)).alias("cov"))


@query(
    "label_values",
    from_logs(
        """SELECT line_no, CASE WHEN v IN ('1','true','anomaly','anomalous','abnormal') THEN 1
        WHEN v IN ('0','false','normal') THEN 0 END AS label FROM (SELECT line_no, lower(CASE line_no % 8 WHEN 0 THEN 'TRUE'
        WHEN 1 THEN '0' WHEN 2 THEN 'Abnormal' WHEN 3 THEN '1.0' WHEN 4 THEN 'false' WHEN 5 THEN '1' ELSE label END) AS v FROM logs)"""
    ),
)
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line_no") % 8
    spelled = (
        F.when(n == 0, "TRUE").when(n == 1, "0").when(n == 2, "Abnormal").when(n == 3, "1.0")
        .when(n == 4, "false").when(n == 5, "1").otherwise(F.col("label"))
    )
    return logs_table(spark, sf_dir).select("line_no", scoring.ground_truth(spelled).cast("long").alias("label"))


# ------------------------------------------------------------ scored columns
@query("auth_burst_events", from_events("SELECT line_no, service, burst FROM ev WHERE auth_burst"))
def auth_burst_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_table(spark, sf_dir).where("auth_burst").select("line_no", "service", "burst")


@query(
    "verdicts",
    from_events(
        "SELECT event_id, status, detection_method, CASE WHEN detection_method = '—' THEN 'Normal' ELSE detection_method END AS scored_method FROM ev"
    ),
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_table(spark, sf_dir)
    return rows.select(
        "event_id", "status", "detection_method", scoring.detection_method(K.METHOD_NONE_SCORED).alias("scored_method")
    )


@query("risk_scores", from_events("SELECT event_id, risk_score FROM ev"))
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_table(spark, sf_dir).select("event_id", "risk_score")


@query("severity_bands", from_events("SELECT event_id, severity, reason FROM ev"))
def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_table(spark, sf_dir).select("event_id", "severity", "reason")


@query(
    "scaled_anomaly_score",
    from_events(
        """SELECT line_no, round(CAST((s - lo) / (hi - lo) AS DECIMAL(18, 9)), 3)::DOUBLE AS model_prob, s > 0.5 AS iforest_noise
        FROM (SELECT line_no, sqrt((line_no % 89 + 1) / 89.0) AS s FROM ev), (SELECT min(sqrt((line_no % 89 + 1) / 89.0)) AS lo,
        max(sqrt((line_no % 89 + 1) / 89.0)) AS hi FROM ev)"""
    ),
)
def scaled_anomaly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max scaling and threshold on a given raw score."""
    from emberlog.operators.forest import AUTO_THRESHOLD, scale_scores

    raw = F.sqrt((F.col("line_no") % 89 + 1) / 89.0)
    rows = scored_table(spark, sf_dir).select("line_no", raw.alias("anomaly_score"))
    return scale_scores(rows, AUTO_THRESHOLD).drop("anomaly_score")
