"""Equi join of a large table with per-key facts that survives hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT_KEYS = 1000
HOT_ROWS = 1_000_000
SALTS = 1024


def attach_by_key(
    left: DataFrame,
    facts: DataFrame,
    keys: list[str],
    spread_by: Column,
    count: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Left rows with the columns of ``facts``, whose ``count`` is the left rows per key.

    At most ``HOT_KEYS`` of the largest keys are broadcast: that bound holds
    whatever the data, and by pigeonhole every other key owns less than
    1/``HOT_KEYS`` of the rows.  Hot rows take their facts from the broadcast
    side and are spread over ``SALTS`` join keys, so none of them meets the
    others in one task; rows with a null key are spread the same way.  Left
    rows without a match keep nulls.
    """
    payload = [c for c in facts.columns if c not in keys]
    hot = (
        facts.where(F.col(count) >= (HOT_ROWS if hot_rows is None else hot_rows))
        .orderBy(F.col(count).desc(), *keys)
        .limit(HOT_KEYS)
        .select(*keys, F.struct(*payload).alias("_hot"))
    )
    settled = F.col("_hot").isNotNull()
    for key in keys:
        settled = settled | F.col(key).isNull()
    spread = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)) + 1
    salted = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(settled, spread).otherwise(F.lit(0)).cast("int")
    )
    cold = facts.select(*keys, F.struct(*payload).alias("_cold"), F.lit(0).alias("_salt"))
    chosen = F.coalesce("_hot", "_cold")
    joined = salted.join(cold, [*keys, "_salt"], "left")
    return joined.select(*left.columns, *[chosen.getField(c).alias(c) for c in payload])
