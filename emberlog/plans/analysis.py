"""The whole analysis as one plan: logs in, scored events and summaries out."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog import constants as K
from emberlog.functions import scoring
from emberlog.operators import features as X
from emberlog.operators.dbscan import DensityModel
from emberlog.operators.forest import Forest, fit_forest, scale_scores
from emberlog.operators.meter import Meter
from emberlog.operators.neighbours import density_parameters
from emberlog.params import DEFAULTS, Params
from emberlog.session import cut_lineage, store

EVENT_COLUMNS = (
    "event_id", "timestamp", "hostname", "service", "service_raw", "event_class", "message", "status",
    "detection_method", "severity", "risk_score", "dbscan_cluster", "model_prob", "model_pred", "burst",
    "tmpl_freq", "svc_freq", "src_host", "target_user", "hour", "message_length", "reason", "template",
    "dbscan_noise", "iforest_noise", "auth_burst",
)
SCORED_COLUMNS = ("event_id", "timestamp", "service", "event_class", "message")


def score_events(detected: DataFrame, max_template, params: Params = DEFAULTS) -> DataFrame:
    """Detector columns -> status, method, risk, severity and reason.

    Needs ``dbscan_noise iforest_noise model_prob`` and the frequencies;
    ``max_template`` is the largest ``tmpl_freq`` (a number or a scalar column).
    """
    top = F.lit(max_template) if isinstance(max_template, (int, float)) else max_template
    flagged = detected.withColumns(
        {
            "model_pred": F.col("iforest_noise").cast("int"),
            "auth_burst": scoring.auth_burst(params.burst_threshold),
            "status": scoring.status(),
            "detection_method": scoring.detection_method(),
            "risk_score": scoring.risk_score(top),
            "reason": scoring.short_reason(),
        }
    )
    return flagged.withColumn("severity", scoring.severity())


def verdict_counts() -> dict:
    """Metrics of an event table."""
    noise, forest = F.col("dbscan_noise"), F.col("iforest_noise")
    return {
        "dbscan_noise": F.count_if(noise),
        "isolation_forest_anomalies": F.count_if(forest),
        "ensemble_anomalies": F.count_if(noise | forest),
    }


@dataclass
class Analysis:
    """Lazy result tables of one run plus the facts fixed while fitting."""

    params: Params
    rows: int
    eps_used: float
    min_samples_used: int
    auto_params: bool
    moments: dict
    forest: Forest
    vectors: DataFrame
    scored: DataFrame  # every event with all derived columns and its position ``row_idx``
    max_template: int
    meter: Meter = field(default_factory=Meter)  # counts of the stages that have run

    @cached_property
    def events(self) -> DataFrame:
        extra = [c for c in ("label",) if c in self.scored.columns]
        return self.scored.select(*EVENT_COLUMNS, *extra)

    @cached_property
    def anomalies(self) -> DataFrame:
        return self.events.where(F.col("status") == "ANOMALY")

    def materialised(self) -> "Analysis":
        """The same run with the event table written out, for many queries on it; verdicts are counted on the way."""
        return replace(self, scored=store(self.meter.watch(self.scored, **verdict_counts())))


@dataclass(frozen=True)
class FittedRun:
    """What scoring new logs needs of a run; ``plans.runs`` stores and loads it."""

    params: Params
    rows: int
    eps_used: float
    min_samples_used: int
    moments: dict
    forest: Forest
    max_template: int


@dataclass
class _Prepared:
    indexed: DataFrame
    signatures: DataFrame
    vectors: DataFrame
    rows: int
    max_template: int
    meter: Meter


def _prepare(logs: DataFrame, params: Params) -> _Prepared:
    meter = Meter()
    indexed = X.with_event_ids(logs, params, meter)
    signatures = store(X.signatures(indexed))
    vectors = store(X.vectors(signatures))
    rows, top, services, classes = signatures.agg(
        F.sum("n"), F.max("tmpl_freq"), F.countDistinct("service"), F.countDistinct("event_class")
    ).first()
    if not rows:
        raise ValueError("the input holds no events")
    meter.note(services=services, event_classes=classes, model_features=len(X.FEATURES))
    return _Prepared(indexed, signatures, vectors, int(rows), int(top), meter)


def _attach(prepared: _Prepared, verdicts: DataFrame) -> DataFrame:
    """Vector verdicts -> signatures -> events (one wide join)."""
    facts = store(prepared.signatures.join(verdicts, X.VECTOR_KEY))  # its true size tells Spark whether the events need a shuffle
    return X.attach(prepared.indexed, facts)


def analyze(logs: DataFrame, params: Params = DEFAULTS) -> Analysis:
    """Fit both detectors on ``logs`` and score every row."""
    prepared = _prepare(logs, params)
    moments = X.fit_scaler(prepared.vectors)
    points = X.feature_vectors(prepared.vectors, moments)
    eps, samples, derived = params.eps, params.min_samples, False

    given = params.detection_source == "reference" and "dbscan_cluster" in logs.columns
    if given:
        given = logs.where(F.col("dbscan_cluster").isNull()).isEmpty()
    verdict_columns = [*X.VECTOR_KEY, "anomaly_score"]
    if not given:
        prepared.indexed = prepared.indexed.drop("dbscan_cluster")
        eps, samples, derived = density_parameters(points, prepared.rows, params)
        clusters = DensityModel(points, eps, samples).clusters()
        points = points.join(clusters.select(*X.VECTOR_KEY, "dbscan_cluster"), X.VECTOR_KEY)
        verdict_columns.append("dbscan_cluster")
    source = "reference" if given else "live"
    prepared.meter.note(auto_params=derived, detection_source=source, detection_mode="unsupervised")
    forest = fit_forest(points, params)
    judged = cut_lineage(forest.score(points).select(*verdict_columns, "weight"))
    judged = scale_scores(judged, forest.threshold)
    detected = _attach(prepared, judged.drop("anomaly_score", "weight"))
    detected = detected.withColumn("dbscan_noise", F.col("dbscan_cluster") == -1)
    return Analysis(
        params=params,
        rows=prepared.rows,
        eps_used=round(eps, 3),
        min_samples_used=samples,
        auto_params=derived,
        moments=moments,
        forest=forest,
        vectors=judged,
        scored=score_events(detected, prepared.max_template, params),
        max_template=prepared.max_template,
        meter=prepared.meter,
    )


def score_unseen(
    fitted: Analysis | FittedRun, logs: DataFrame, reuse_training_stats: bool = False
) -> DataFrame:
    """Score new logs with the forest of a run, just fitted or loaded; the density detector runs afresh on them.

    By default the scaler is refitted on the new logs; ``reuse_training_stats``
    keeps the training scale instead.
    """
    params = fitted.params
    prepared = _prepare(logs, params)
    points = X.feature_vectors(prepared.vectors, fitted.moments if reuse_training_stats else None)
    flags = DensityModel(points, fitted.eps_used, fitted.min_samples_used).flags()
    points = points.join(
        flags.select(*X.VECTOR_KEY, F.col("noise").alias("dbscan_noise")), X.VECTOR_KEY
    )
    judged = cut_lineage(
        fitted.forest.score(points).select(*X.VECTOR_KEY, "dbscan_noise", "anomaly_score")
    )
    judged = scale_scores(judged, fitted.forest.threshold)
    rows = _attach(prepared, judged.drop("anomaly_score"))
    extra = {}
    if "label" in rows.columns:
        extra["label"] = scoring.ground_truth("label")
    return rows.select(
        *SCORED_COLUMNS,
        F.col("dbscan_noise").cast("int").alias("dbscan_noise"),
        "model_prob",
        scoring.is_anomaly().cast("int").alias("model_pred"),
        scoring.detection_method(K.METHOD_NONE_SCORED).alias("detection_method"),
        *[column.alias(name) for name, column in extra.items()],
    )


def stage_counts(events: DataFrame) -> DataFrame:
    """One row of counts per stage of a run (distinct counts over a small pre-aggregate)."""
    noise, forest = F.col("dbscan_noise"), F.col("iforest_noise")
    keys = ("service", "event_class", "dbscan_cluster", "dbscan_noise", "iforest_noise")
    counted = events.groupBy(*keys).agg(F.count("*").alias("n"))
    total = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0))
    return counted.agg(
        total(F.lit(True)).alias("input_rows"),
        F.countDistinct("service").alias("services"),
        F.countDistinct("event_class").alias("event_classes"),
        F.countDistinct(F.when(~noise, F.col("dbscan_cluster"))).alias("dbscan_clusters"),
        total(noise).alias("dbscan_noise"),
        total(forest).alias("isolation_forest_anomalies"),
        total(noise | forest).alias("ensemble_anomalies"),
    )


def register_views(spark: SparkSession, analysis: Analysis, prefix: str = "") -> None:
    """Expose the result tables to Spark SQL."""
    analysis.events.createOrReplaceTempView(prefix + "events")
    analysis.anomalies.createOrReplaceTempView(prefix + "anomalies")
    analysis.vectors.createOrReplaceTempView(prefix + "vectors")
