"""Isolation Forest (Liu, Ting and Zhou 2008) on weighted distinct vectors.

Spark draws the samples, grows one tree per group and scores the vectors;
the numpy helpers only ever see one tree's sample or one batch of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from emberlog.operators.features import FEATURES, VECTOR_KEY
from emberlog.operators.ordering import weighted_quantile
from emberlog.params import DEFAULTS, Params

BUCKETS = 4096
AUTO_THRESHOLD = 0.5
NODE_SCHEMA = "tree int, node int, feature int, threshold double, low int, high int, path double"


def average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    inner = np.maximum(n - 1, 1)
    full = 2 * (np.log(inner) + np.euler_gamma) - 2 * inner / np.maximum(n, 1)
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def draw_samples(points: DataFrame, params: Params) -> tuple[DataFrame, int]:
    """(tree, draw, x): a uniform sample of rows without replacement for each tree.

    Rows are addressed by position in the cumulative weight of the vectors.
    Vectors are spread over ``BUCKETS`` hash buckets whose totals (a bounded
    table) say which bucket a position falls into; inside a bucket an ordered
    window finds the vector.  Neither the rows nor the vectors are collected,
    and the result does not depend on how the input is partitioned.
    """
    spark = points.sparkSession
    bucketed = points.select(
        F.pmod(F.xxhash64(*VECTOR_KEY), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.struct(*VECTOR_KEY).alias("key"),
        F.array(*FEATURES).alias("x"),
        "weight",
    )
    totals = bucketed.groupBy("bucket").agg(F.sum("weight").alias("w")).orderBy("bucket").toArrow().to_pandas()
    ends = np.cumsum(totals["w"].to_numpy(np.int64))
    rows = int(ends[-1])
    size = min(params.subsample, rows)
    generator = np.random.default_rng(params.seed)
    drawn = np.concatenate(
        [generator.choice(rows, size, replace=False) for _ in range(params.trees)]
    ).astype(np.int64)
    slot = np.searchsorted(ends, drawn, side="right")
    draws = pa.table(
        {
            "tree": np.repeat(np.arange(params.trees, dtype=np.int32), size),
            "draw": np.tile(np.arange(size, dtype=np.int32), params.trees),
            "bucket": totals["bucket"].to_numpy()[slot].astype(np.int32),
            "position": drawn - np.where(slot > 0, ends[slot - 1], 0),
        }
    )
    requests = spark.createDataFrame(draws)
    before = W.partitionBy("bucket").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    starts = bucketed.select(
        "bucket",
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("position"),
        "x",
        F.lit(None).cast("int").alias("tree"),
        F.lit(None).cast("int").alias("draw"),
    )
    met = starts.unionByName(requests.withColumn("x", F.lit(None).cast("array<double>")))
    upto = (
        W.partitionBy("bucket")
        .orderBy("position", F.col("tree").asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    found = met.withColumn("x", F.last("x", ignorenulls=True).over(upto)).where("tree IS NOT NULL")
    return found.select("tree", "draw", "x"), size


def _grow(sample: np.ndarray, limit: int, generator: np.random.Generator) -> list[tuple]:
    """Nodes of one tree as (node, feature, threshold, low, high, path)."""
    nodes: list[tuple] = []
    pending = [(np.arange(len(sample)), 0, -1, 0)]
    while pending:
        members, depth, parent, side = pending.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = here
        part = sample[members]
        low, high = part.min(axis=0), part.max(axis=0)
        free = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(free) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(members)))])
            continue
        feature = int(generator.choice(free))
        threshold = float(generator.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:  # rounding on a very narrow range
            threshold = float(low[feature])
        nodes.append([feature, threshold, -1, -1, 0.0])
        goes_low = part[:, feature] <= threshold
        pending.append((members[~goes_low], depth + 1, here, 1))
        pending.append((members[goes_low], depth + 1, here, 0))
    return [(i, *node) for i, node in enumerate(nodes)]


def grow_trees(samples: DataFrame, size: int, params: Params) -> DataFrame:
    """One group per tree, ``size`` rows each."""
    limit = int(np.ceil(np.log2(max(size, 2))))
    seed = params.seed

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("draw")
        tree = int(ordered["tree"].iloc[0])
        nodes = _grow(np.stack(ordered["x"].to_list()), limit, np.random.default_rng([seed, tree]))
        frame = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "low", "high", "path"])
        frame.insert(0, "tree", tree)
        return frame

    # the samples are small, so adaptive coalescing would put all trees into one task
    slots = samples.sparkSession.sparkContext.defaultParallelism
    spread = samples.repartition(min(params.trees, slots), "tree")
    return spread.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


@dataclass
class Forest:
    """Fitted trees: at most ``trees * (2 * subsample - 1)`` nodes, so small enough to broadcast."""

    nodes: pd.DataFrame
    size: int
    threshold: float = AUTO_THRESHOLD

    def score(self, points: DataFrame) -> DataFrame:
        """Add ``anomaly_score`` in (0, 1]; larger is easier to isolate."""
        ordered = self.nodes.sort_values(["tree", "node"])
        columns = ("feature", "threshold", "low", "high", "path")
        trees = [
            tuple(group[c].to_numpy() for c in columns) for _, group in ordered.groupby("tree")
        ]
        shared = points.sparkSession.sparkContext.broadcast(trees)
        norm = float(average_path(self.size)) or 1.0
        kept = [c for c in points.columns if c != "anomaly_score"]

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = batch[FEATURES].to_numpy(float)
                rows = np.arange(len(x))
                depth = np.zeros(len(x))
                for feature, threshold, low, high, path in shared.value:
                    at = np.zeros(len(x), dtype=np.int64)
                    while True:
                        wanted = feature[at]
                        inner = wanted >= 0
                        if not inner.any():
                            break
                        below = x[rows, np.maximum(wanted, 0)] <= threshold[at]
                        at = np.where(inner, np.where(below, low[at], high[at]), at)
                    depth += path[at]
                batch["anomaly_score"] = 2.0 ** (-depth / len(shared.value) / norm)
                yield batch

        fields = points.select(*kept).schema.add("anomaly_score", "double")
        return points.select(*kept).mapInPandas(scored, fields)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(pa.Table.from_pandas(self.nodes, preserve_index=False)).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/nodes"
        )
        facts = [(int(self.size), float(self.threshold))]
        spark.createDataFrame(facts, "size int, threshold double").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Forest":
        facts = spark.read.parquet(f"{path}/facts").first()
        nodes = spark.read.parquet(f"{path}/nodes").toArrow().to_pandas()
        return Forest(nodes, int(facts["size"]), float(facts["threshold"]))


def fit_forest(points: DataFrame, params: Params = DEFAULTS) -> Forest:
    """Fit on weighted vectors; a fractional contamination sets the threshold by quantile."""
    samples, size = draw_samples(points, params)
    forest = Forest(grow_trees(samples, size, params).toArrow().to_pandas(), size)
    if params.contamination != "auto":
        scores = forest.score(points).select("anomaly_score", "weight")
        share = 1.0 - float(params.contamination)
        forest.threshold = float(weighted_quantile(scores, "anomaly_score", "weight", share).first()[0])
    return forest


def scale_scores(scored: DataFrame, threshold: float) -> DataFrame:
    """Add ``iforest_noise`` and ``model_prob`` (min-max of the score, three decimals)."""
    low, high = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    width = (high or 0.0) - (low or 0.0)
    shown = F.round((F.col("anomaly_score") - low) / width, 3) if width > 0 else F.lit(0.0)
    return scored.withColumns(
        {"iforest_noise": F.col("anomaly_score") > threshold, "model_prob": shown}
    )
