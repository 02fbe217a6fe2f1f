"""CSV files with line breaks in cells, read in splits.

Whether a line begins inside a quoted cell depends on all quotes before it, so
a first pass notes per split whether its quotes are odd, and how many records
begin in it for either state at its start.  Running over the splits of each
file (one row a split) gives every split its state and the number of its first
record.  A second pass cuts records from there.  Records that reach over the end of a
split are put together from their pieces, two a split at most.

Cells that hold quotes, separators or line breaks must be quoted, and quotes in
them doubled, as RFC 4180 says; a quote in the middle of an unquoted cell is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from emberlog.sources.positions import offsets

_SPLIT = ["file", "block"]


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines with the file and split they begin in; only ``\\n`` ends a line, so cells keep their breaks."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _runs(batch: pa.RecordBatch) -> list[tuple[str, int, int, int]]:
    """(file, block, from, to) of the stretches of one split; rows come in the order of the file."""
    file, block = batch.column("file"), batch.column("block")
    n = batch.num_rows
    new = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1)))
    edges = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    return [(file[a].as_py(), block[a].as_py(), a, b) for a, b in zip(edges, edges[1:])]


def _quotes(values: pa.Array) -> np.ndarray:
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per stretch of a split: parity of its quotes, and records that begin in it from either state."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = []
        for file, block, a, b in _runs(batch):
            quotes = _quotes(batch.column("value").slice(a, b - a))
            inside = (np.cumsum(quotes) - quotes) % 2
            rows.append((file, block, int(quotes.sum() % 2), int((inside == 0).sum()), int((inside == 1).sum())))
        names = ["file", "block", "odd", "begun_outside", "begun_inside"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _states(lines: DataFrame) -> DataFrame:
    """(file, block, inside, first, in_file): whether the split begins in a cell, the number of its first record in all files and in its own."""
    schema = "file string, block long, odd long, begun_outside long, begun_inside long"
    # stretches of one split, in order, are merged like splits of one file
    found = lines.mapInArrow(_survey, schema).withColumn("_at", F.monotonically_increasing_id())
    before = W.partitionBy("file").orderBy("block", "_at").rowsBetween(W.unboundedPreceding, -1)
    stretches = found.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    begun = F.when(F.col("inside") == 0, F.col("begun_outside")).otherwise(F.col("begun_inside"))
    splits = stretches.groupBy(*_SPLIT).agg(F.min_by("inside", "_at").alias("inside"), F.sum(begun).alias("n"))
    return splits.select(*_SPLIT, "inside").join(offsets(splits.drop("inside")).withColumnRenamed("offset", "first"), _SPLIT)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and the pieces of records that reach over the ends of the split.

    ``record`` is the number of the record a piece belongs to, ``piece`` the
    split it lies in (null for whole records).
    """
    names = ["record", "in_file", "piece", "value"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    key, parts, number, place, odd, opened = None, [], 0, 0, 0, False

    def close(whole: bool):
        return [(number, place, None if whole and not opened else key[1], "\n".join(parts))] if parts else []

    for batch in batches:
        rows: list[tuple] = []
        for file, block, a, b in _runs(batch) if batch.num_rows else []:
            values = batch.column("value").slice(a, b - a)
            if (file, block) != key:
                rows += close(False)
                key, parts, opened = (file, block), [], False
                odd, first = batch.column("inside")[a].as_py(), batch.column("first")[a].as_py()
                place = batch.column("in_file")[a].as_py() - 1
                number = first - 1
                opened = odd == 1  # what comes first belongs to a record of an earlier split
            quotes = _quotes(values)
            inside = (odd + np.cumsum(quotes) - quotes) % 2
            odd = int((odd + quotes.sum()) % 2)
            for text, within in zip(values.to_pylist(), inside.tolist()):
                if not within:
                    rows += close(True)
                    parts, opened = [], False
                    number, place = number + 1, place + 1
                parts.append(text)
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    rows = close(False)
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_records(spark: SparkSession, path) -> DataFrame:
    """``(record, in_file, value)``: every CSV record as text, numbered from 0 over all files sorted by path.

    Numbers do not depend on how files are split.  A split's state is broadcast: as many rows as there are splits.
    """
    lines = _lines(spark, path)
    cut = lines.join(F.broadcast(_states(lines)), _SPLIT).mapInArrow(_cut, "record long, in_file long, piece long, value string")
    whole = cut.where("piece IS NULL").select("record", "in_file", "value")
    pieces = cut.where("piece IS NOT NULL").groupBy("record", "in_file")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda p: p["value"]), "\n")
    return whole.unionByName(pieces.agg(text.alias("value")))


def read_split_csv(spark: SparkSession, path) -> DataFrame:
    """Rows of the CSV files at ``path`` with a header, every column as text, and ``line_no``, the record number."""
    columns = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
    records = read_records(spark, path).where("in_file > 0")  # the first record of a file is its header
    text = F.regexp_replace("value", "\r$", "")
    parsed = records.where(text != "").select(F.from_csv(text, schema, {"escape": '"', "multiLine": "true"}).alias("row"), F.col("record").alias("line_no"))
    return parsed.select("row.*", "line_no")
