"""Tables the registered queries share.

``scored_table`` is the event table an analysis run leaves behind.  It is
built once per session and input folder, because every triage query reads the
finished table; the forest score in it is a closed-form stand-in (no SQL
engine can redraw random trees), the density verdict is the real one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.operators import features as X
from emberlog.operators.dbscan import DensityModel
from emberlog.operators.explain import explain
from emberlog.operators.meter import Meter
from emberlog.params import DEFAULTS
from emberlog.plans.analysis import score_events, verdict_counts
from emberlog.session import store
from registry.logs import logs_table

_BUILT: dict[tuple, object] = {}


def _once(name: str, spark: SparkSession, sf_dir: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def cleaned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.clean(logs_table(spark, sf_dir))


def frequency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_frequencies(cleaned_table(spark, sf_dir))


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled distinct vectors of the whole log table."""
    build = lambda: store(X.vectors(X.signatures(cleaned_table(spark, sf_dir))))
    return X.feature_vectors(_once("vectors", spark, sf_dir, build))


def stand_in_score() -> dict:
    score = F.col("line_no") % 101 / 100.0
    return {"model_prob": score, "iforest_noise": score > 0.95}


def _build_scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Meter]:
    meter = Meter()
    indexed = X.with_event_ids(logs_table(spark, sf_dir), meter=meter)
    signatures = store(X.signatures(indexed))
    vectors = store(X.vectors(signatures))
    clusters = DensityModel(X.feature_vectors(vectors), DEFAULTS.eps, DEFAULTS.min_samples).clusters()
    verdicts = clusters.select(*X.VECTOR_KEY, "dbscan_cluster", F.col("noise").alias("dbscan_noise"))
    facts = store(signatures.join(verdicts, X.VECTOR_KEY))  # its true size tells Spark whether the events need a shuffle
    rows = X.attach(indexed, facts).withColumns(stand_in_score())
    top, services, classes = signatures.agg(
        F.max("tmpl_freq"), F.countDistinct("service"), F.countDistinct("event_class")
    ).first()
    meter.note(services=services, event_classes=classes, model_features=len(X.FEATURES))
    return store(meter.watch(score_events(rows, top), **verdict_counts())), meter


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.session import prepare_session

    prepare_session(spark)
    return _once("scored", spark, sf_dir, lambda: _build_scored(spark, sf_dir))[0]


def scored_meter(spark: SparkSession, sf_dir: str) -> Meter:
    """Counts taken while the scored table was built."""
    scored_table(spark, sf_dir)
    return _once("scored", spark, sf_dir, None)[1]


def explained_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored event with headline, evidence and actions."""
    return explain(scored_table(spark, sf_dir))
