"""Lines of text files with positions that do not depend on how files are split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

_SPLIT = ["file", "block"]


def offsets(counts: DataFrame) -> DataFrame:
    """(file, block, offset, in_file) from ``counts(file, block, n)``: items before the split, and those in its own file.

    Files are in the order of their paths.  One row a split; only one row a file meets in one task.
    """
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inside = counts.withColumn("in_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    files = counts.groupBy("file").agg(F.sum("n").alias("_all"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(files), "file").select(*_SPLIT, (F.col("_before") + F.col("in_file")).alias("offset"), "in_file")


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """``(line_no, value)``: lines numbered from 0 over all files sorted by path.

    A first pass counts the lines of each split.  The offsets, one row a split, are broadcast.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        "value", F.monotonically_increasing_id().alias("_at"),
    )
    counts = lines.groupBy(*_SPLIT).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    placed = offsets(counts).join(counts.select(*_SPLIT, "_first"), _SPLIT)
    found = lines.join(F.broadcast(placed), _SPLIT)
    return found.select((F.col("offset") + F.col("_at") - F.col("_first")).alias("line_no"), "value")
