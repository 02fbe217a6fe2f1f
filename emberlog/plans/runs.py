"""All result tables of a run, and runs that are stored, listed and loaded by version."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.functions import scoring
from emberlog.operators import features as X, patterns, projection as P
from emberlog.operators.evaluate import classification_report
from emberlog.operators.forest import Forest
from emberlog.operators.ordering import with_row_index
from emberlog.params import Params
from emberlog.plans.analysis import Analysis, FittedRun
from emberlog.session import store

TABLES = ("events", "clusters", "importance", "projection", "itemsets", "rules", "metrics", "stages")
STAGES = (
    "input_rows", "cleaned_rows", "services", "event_classes", "auto_params", "dbscan_clusters", "dbscan_noise",
    "detection_source", "isolation_forest_anomalies", "ensemble_anomalies", "detection_mode", "model_features",
    "apriori_windows", "itemsets", "rules",
)
MODEL_SCHEMA = (
    "version int, folder string, params string, rows long, eps double, min_samples int, max_template long,"
    " moments map<string,double>, features array<string>, forest_size int, threshold double"
)


def ranked_clusters(events: DataFrame) -> DataFrame:
    """The cluster summary with its place by falling size (``position`` from 0), ties by cluster id."""
    return with_row_index(patterns.cluster_summary(events), F.col("size").desc(), "dbscan_cluster", name="position")


def ranked_importance(points: DataFrame) -> DataFrame:
    """The feature importance with its place by falling importance, rounded to nine places; ties by name."""
    rounded = P.feature_importance(points).withColumn("importance", F.round("importance", 9))
    return with_row_index(rounded, F.col("importance").desc(), "feature", name="position")


def anomaly_points(scored: DataFrame, vectors: DataFrame) -> DataFrame:
    """Feature vectors weighted by events, apart for normal and anomalous ones."""
    counted = scored.groupBy(*X.VECTOR_KEY, (F.col("status") == "ANOMALY").alias("is_anomaly")).agg(
        F.count("*").alias("weight")
    )
    return counted.join(vectors.drop("weight"), X.VECTOR_KEY)


def stages_row(spark: SparkSession, counts: dict) -> DataFrame:
    """One row with a column per stage; a stage that was not reached is null."""
    kinds = {"auto_params": "boolean", "detection_source": "string", "detection_mode": "string"}
    schema = ", ".join(f"{name} {kinds.get(name, 'long')}" for name in STAGES)
    return spark.createDataFrame([tuple(counts.get(name) for name in STAGES)], schema)


def pattern_counts(windows: DataFrame, itemsets: DataFrame, rules: DataFrame) -> dict:
    """The three counts of the pattern stage; ``windows`` are the (window, item) rows."""
    return {
        "apriori_windows": windows.select("win").distinct().count(),
        "itemsets": itemsets.count(),
        "rules": rules.count(),
    }


def cluster_count(clusters: DataFrame) -> dict:
    return {"dbscan_clusters": clusters.where("dbscan_cluster <> -1").count()}


def result_tables(run: Analysis) -> dict[str, DataFrame]:
    """Every table of ``TABLES``; the event table is written once and all others are built from it.

    ``metrics`` compares verdicts with labels: no row without labels of both classes.  ``importance`` is empty
    without anomalies.
    """
    spark, params = run.scored.sparkSession, run.params
    done = run.materialised()
    vectors = X.feature_vectors(done.vectors.select(*X.VECTOR_KEY, "weight"), done.moments)
    windows = store(patterns.window_items(done.scored, params))
    itemsets = store(patterns.frequent_itemsets(windows, params))
    rules = store(patterns.association_rules(itemsets, params))
    truth = scoring.ground_truth("label") if "label" in done.scored.columns else F.lit(None).cast("int")
    judged = done.scored.withColumns({"truth": truth, "flag": scoring.is_anomaly()})
    clusters = store(ranked_clusters(done.scored))
    counts = done.meter.read() | pattern_counts(windows, itemsets, rules) | cluster_count(clusters)
    return {
        "events": done.events,
        "clusters": clusters,
        "importance": ranked_importance(anomaly_points(done.scored, vectors)),
        "projection": P.projection(vectors, done.scored, X.VECTOR_KEY),
        "itemsets": itemsets,
        "rules": rules,
        "metrics": classification_report(judged, "truth", "flag"),
        "stages": stages_row(spark, counts),
    }


@dataclass
class StoredRun:
    """A loaded run: what scoring needs, and its result tables."""

    version: int
    fitted: FittedRun
    features: list[str]
    tables: dict[str, DataFrame]


def versions(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored run, without rows if there is none."""
    try:
        return spark.read.schema(MODEL_SCHEMA).parquet(f"{path}/models")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MODEL_SCHEMA)


def save_run(run: Analysis, path: str) -> int:
    """Store the fitted parts and all result tables as the next version, which is returned.

    The row in ``models`` is written last, into which folder the rest went, so a run that broke off is never seen
    and hinders none.  Runs stored at the same time may get the same number; then neither can be told apart by it,
    so store runs of one ``path`` one after the other.
    """
    spark = run.scored.sparkSession
    version = (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    folder = f"run-{version:06d}-{uuid.uuid4().hex[:8]}"
    run.forest.save(spark, f"{path}/{folder}/forest")
    for name, table in result_tables(run).items():
        table.write.parquet(f"{path}/{folder}/{name}")
    facts = (
        version, folder, json.dumps(asdict(run.params)), run.rows, float(run.eps_used), int(run.min_samples_used), run.max_template,
        {k: float(v) for k, v in run.moments.items()}, list(X.FEATURES), int(run.forest.size), float(run.forest.threshold),
    )
    spark.createDataFrame([facts], MODEL_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/models")
    return version


def load_run(spark: SparkSession, path: str, version: int | None = None) -> StoredRun:
    """A stored run, by default the latest.  Raises ``ValueError`` if there is none."""
    known = versions(spark, path)
    wanted = known if version is None else known.where(F.col("version") == version)
    facts = wanted.orderBy(F.col("version").desc()).first()
    if facts is None:
        raise ValueError(f"no run {'' if version is None else version} under {path}")
    if list(facts["features"]) != list(X.FEATURES):
        raise ValueError("the run was fitted on other features")
    folder = f"{path}/{facts['folder']}"
    fitted = FittedRun(
        params=Params(**json.loads(facts["params"])),
        rows=facts["rows"],
        eps_used=facts["eps"],
        min_samples_used=facts["min_samples"],
        moments=facts["moments"],
        forest=Forest.load(spark, f"{folder}/forest"),
        max_template=facts["max_template"],
    )
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
    return StoredRun(facts["version"], fitted, list(facts["features"]), tables)
