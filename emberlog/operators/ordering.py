"""Total orders without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog.session import cut_lineage

_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def with_row_index(df: DataFrame, *order, name: str = "row_idx", keep=cut_lineage) -> DataFrame:
    """Dense 0-based position in the total order ``order`` (which must be unique).

    A range shuffle sorts the rows, the position inside the partition is read
    off ``monotonically_increasing_id`` in the same stage, and ``keep`` (a
    checkpoint, or ``store`` for wide tables) freezes it.  The offsets table
    has one row per partition.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    frozen = keep(ordered.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), _SHIFT)
    inside = F.col("_mid") - F.shiftleft(part, _SHIFT)
    sizes = frozen.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    return (
        frozen.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + inside)
        .drop("_part", "_offset", "_mid")
    )


def event_id(row_idx: str = "row_idx") -> Column:
    return F.format_string("EVT-%06d", F.col(row_idx) + 1)


def running_total(
    df: DataFrame, bucket: Column, order, value: str, name: str, reverse: bool = False
) -> DataFrame:
    """Exclusive running sum of ``value`` in the order (bucket, order).

    ``bucket`` must be a non-decreasing function of the order with a bounded
    number of values; only its totals meet in one task.  ``reverse`` sums from
    the far end.  Adds ``name``.
    """
    staged = df.withColumn("_bucket", bucket)
    totals = staged.groupBy("_bucket").agg(F.sum(value).alias("_total"))
    direction = F.col("_bucket").desc() if reverse else F.col("_bucket").asc()
    before = W.orderBy(direction).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    local_order = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    local = W.partitionBy("_bucket").orderBy(*local_order).rowsBetween(W.unboundedPreceding, -1)
    return (
        staged.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_local", "_offset")
    )


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float, buckets: int = 16384) -> DataFrame:
    """Exact quantile with linear interpolation of a value in [0, 1], as one row ``quantile``.

    Equal values are merged first; a bounded bucket table locates the two
    ranks, so no task ever sees all values.
    """
    merged = df.groupBy(value).agg(F.sum(weight).alias("_w"))
    bucket = F.floor(F.least(F.col(value), F.lit(1.0)) * buckets)
    placed = running_total(merged, bucket, [value], "_w", "_before")
    total = merged.agg(F.sum("_w").alias("t")).scalar()
    rank = (total - 1) * F.lit(float(q))
    low, high = F.floor(rank), F.ceil(rank)
    holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_w"))
    ends = placed.agg(
        F.max(F.when(holds(low), F.col(value))).alias("a"),
        F.max(F.when(holds(high), F.col(value))).alias("b"),
        F.max(rank - low).alias("f"),
    )
    return ends.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("quantile"))
