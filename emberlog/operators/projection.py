"""Descriptive views of the feature space: importance and a two-dimensional projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from emberlog.operators.features import FEATURES



def feature_importance(points: DataFrame) -> DataFrame:
    """Mean absolute standardised value among the anomalies, per feature.

    ``points`` are weighted vectors with the features and ``is_anomaly``.
    """
    w = F.col("weight").cast("double")
    columns = F.array(
        *[F.struct(F.lit(name).alias("feature"), F.col(name).alias("value")) for name in FEATURES]
    )
    long = points.select("weight", "is_anomaly", F.explode(columns).alias("f")).select(
        "weight", "is_anomaly", "f.*"
    )
    mean = F.sum(w * F.col("value")) / F.sum(w)
    variance = F.sum(w * F.col("value") * F.col("value")) / F.sum(w) - mean * mean
    flat = (F.max("value") == F.min("value")) | (variance <= 0)
    stats = long.groupBy("feature").agg(
        F.when(flat, F.max("value")).otherwise(mean).alias("mean"),
        F.when(flat, F.lit(1.0)).otherwise(F.sqrt(variance)).alias("std"),
    )
    spread = F.abs((F.col("value") - F.col("mean")) / F.col("std"))
    return (
        long.where("is_anomaly")
        .join(F.broadcast(stats), "feature")  # one row per feature
        .groupBy("feature")
        .agg((F.sum(w * spread) / F.sum(w)).alias("importance"))
    )


def covariance(points: DataFrame) -> DataFrame:
    """(i, j, cov): population covariance of the features, one row per pair i <= j."""
    w = F.col("weight").cast("double")
    values = F.array(*FEATURES)
    index = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
            for i in range(len(FEATURES))
            for j in range(i, len(FEATURES))
        ]
    )
    pairs = points.select("weight", values.alias("x"), F.explode(index).alias("p")).select(
        "weight", "p.i", "p.j", F.element_at("x", F.col("p.i") + 1).alias("a"),
        F.element_at("x", F.col("p.j") + 1).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    cov = F.sum(w * a * b) / F.sum(w) - (F.sum(w * a) / F.sum(w)) * (F.sum(w * b) / F.sum(w))
    return pairs.groupBy("i", "j").agg(cov.alias("cov"))


def principal_axes(points: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, 2 axes, explained share) from the 17 x 17 covariance."""
    size = len(FEATURES)
    matrix = np.zeros((size, size))
    for r in covariance(points).collect():  # 153 rows
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["cov"]
    w = F.col("weight").cast("double")
    mean = points.agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in FEATURES]).first()
    values, axes = np.linalg.eigh(matrix)
    best = axes[:, ::-1][:, :2].T
    signs = np.sign(best[np.arange(2), np.abs(best).argmax(axis=1)])
    share = float(values[::-1][:2].sum() / values.sum()) if values.sum() > 0 else 0.0
    return np.array([mean[c] for c in FEATURES]), best * signs[:, None], share


def projection(points: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """Every event in the plane of the first two principal axes; each distinct vector is placed once."""
    mean, axes, share = principal_axes(points)
    coordinates = []
    for axis, name in zip(axes, ("x", "y")):
        total = F.lit(0.0)
        for weight, centre, column in zip(axis, mean, FEATURES):
            total = total + (F.col(column) - F.lit(float(centre))) * F.lit(float(weight))
        coordinates.append(total.alias(name))
    placed = points.select(*key, *coordinates)
    slim = events.select(*key, "event_id", "dbscan_noise", "dbscan_cluster", "service")
    label = F.when(F.col("dbscan_noise"), F.lit("Noise (anomalous)")).otherwise(
        F.concat(F.lit("Cluster "), F.col("dbscan_cluster").cast("string"))
    )
    return slim.join(placed, key).select(
        "event_id", "x", "y", F.col("dbscan_noise").alias("is_noise"), label.alias("cluster"),
        "service", "event_class", F.lit(share).alias("explained"),
    )
