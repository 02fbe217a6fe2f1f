"""High-volume alerts: how many anomalies fall into any closed interval of w minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

MICROS = 1_000_000


def interval_counts(events: DataFrame, window_minutes: int) -> DataFrame:
    """(start, end, anomalies) for the closed interval ending at each anomaly time.

    Times are merged first, then cut into one-second slices.  The interval
    [t - w, t] is the part of t's slice up to t, the whole slices between, and
    the part of the slice w earlier from t - w on.  So a task only needs two
    slices (at most a million distinct microseconds each) and the slice totals,
    however many anomalies share a moment.
    """
    width = window_minutes * 60
    times = (
        events.where((F.col("status") == "ANOMALY") & F.col("timestamp").isNotNull())
        .groupBy(F.unix_micros("timestamp").alias("t"))
        .agg(F.count("*").alias("c"))
        .withColumn("slice", F.floor(F.col("t") / MICROS))
    )
    slices = times.groupBy("slice").agg(F.sum("c").alias("total"), F.min("t").alias("first"))

    # totals of the slices strictly inside the interval: buckets overlap by one
    block = F.floor(F.col("slice") / width)
    shared = slices.withColumn("home", block).withColumn(
        "block", F.explode(F.array(F.col("home"), F.col("home") + 1))
    )
    by_slice = W.partitionBy("block").orderBy("slice")
    inner = (
        shared.withColumns(
            {
                "between": F.sum("total").over(by_slice.rangeBetween(-(width - 1), -1)),
                "next_first": F.min("first").over(by_slice.rangeBetween(-(width - 1), 0)),
            }
        )
        .where(F.col("block") == F.col("home"))
        .select("slice", F.coalesce("between", F.lit(0)).alias("between"), "next_first")
    )

    own = times.select("slice", "t", "c", F.lit(None).cast("long").alias("tail_t"), F.lit(0).cast("long").alias("tail_c"))
    tail = times.select(
        (F.col("slice") + width).alias("slice"),
        (F.col("t") + width * MICROS).alias("t"),
        F.lit(0).cast("long").alias("c"),
        F.col("t").alias("tail_t"),
        F.col("c").alias("tail_c"),
    )
    in_slice = W.partitionBy("slice").orderBy("t")
    upto = in_slice.rangeBetween(W.unboundedPreceding, W.currentRow)
    onward = in_slice.rangeBetween(W.currentRow, W.unboundedFollowing)
    counted = (
        own.unionByName(tail)
        .withColumns(
            {
                "head": F.sum("c").over(upto),
                "rest": F.sum("tail_c").over(onward),
                "rest_first": F.min("tail_t").over(onward),
            }
        )
        .where("c > 0")
    )
    return counted.join(inner, "slice").select(
        F.timestamp_micros(F.coalesce("rest_first", "next_first")).alias("start"),
        F.timestamp_micros("t").alias("end"),
        (F.col("head") + F.col("between") + F.col("rest")).alias("anomalies"),
    )


def alert_intervals(events: DataFrame, threshold: int, window_minutes: int) -> DataFrame:
    """Every interval that reaches the threshold; none for invalid settings."""
    if threshold < 1 or window_minutes < 1:
        return interval_counts(events, 1).where(F.lit(False))
    return interval_counts(events, window_minutes).where(F.col("anomalies") >= threshold)


def densest_interval(events: DataFrame, threshold: int = 10, window_minutes: int = 5) -> DataFrame:
    """At most one row: the fullest interval, the earliest one on ties."""
    found = alert_intervals(events, threshold, window_minutes)
    return found.orderBy(F.col("anomalies").desc(), "end").limit(1)
