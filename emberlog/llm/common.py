"""Helpers that several operators of this folder share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlog.session import ensure_checkpoint_dir


def small_batches(spark: SparkSession, rows: int = 512, megabytes: int = 16) -> None:
    """Bound what one Arrow batch of whole texts holds, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    The files survive a lost executor, cut the lineage, and give the planner
    true sizes, so that Spark itself decides by size what may be broadcast.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def text_key() -> Column:
    """With ``doc_id`` this names a row; rows alike in both have the same results."""
    return F.xxhash64("text")


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, th)`` of all rows; a null text becomes an empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("th", text_key())


def attach(docs: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """Join ``facts(doc_id, th, ...)``, one row a key, to keyed rows; null ids meet null ids."""
    named = facts.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    return docs.join(named, on, how).drop("_id", "_th")


#: Held out from learning where crc32(doc_id as text) mod 3 is this.
HELD_OUT = 1


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, targets: list[str], limit: int) -> DataFrame:
    """Texts and labels to learn from: at most ``limit`` rows that are not held out.

    The sample is the rows with the smallest hash of ``doc_id``; labels that
    are null, and ids with several labels that disagree, are left out.
    """
    wanted = labels.where(F.col("doc_id").isNotNull() & ~held_out())
    agreed = wanted.groupBy("doc_id").agg(
        *[F.min(t).alias(t) for t in targets], *[(F.max(t) - F.min(t)).alias(f"_{t}") for t in targets]
    )
    for t in targets:
        agreed = agreed.where(f"`_{t}` = 0").drop(f"_{t}")
    few = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(
        F.broadcast(few), "doc_id"
    )
