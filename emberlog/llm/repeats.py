"""Finding long repeats in Spark, shared by the two substring operators.

A front end cuts the windows of every text into *blocks*: neighbouring windows
that agree on one anchor, which follows from a window's content alone.  It
names each block by its anchor (``sym``: a context that all windows of the block
contain) and its whole content (``body``).  Equal windows have equal ``sym``.
So anchors that occur once are dropped, blocks with equal bodies are settled as
a whole, and only blocks whose anchor also occurs with another body are opened
into single windows.  Names are 64-bit hashes, 128 bits together.

All groups are met by aggregations with map-side combine; the joins back to
the blocks are plain equi-joins, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import attach, small_batches, stored
from emberlog.llm.hashing import as_long

BLOCKS = "doc_id long, th long, first int, last int, sym long, body long"
WINDOWS = "doc_id long, th long, at int, sym long, body long, wh long"

#: ``(texts) -> row, first, last, sym, body`` and ``(texts, row, first, last) -> block, at, wh``.
Blocks = Callable[[list[str]], tuple[np.ndarray, ...]]
Windows = Callable[[list[str], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def settled(df: DataFrame) -> DataFrame:
    """Store ``df`` and let Spark's cleaner drop the shuffle files of the finished job."""
    out = stored(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def block_table(texts: DataFrame, blocks: Blocks) -> DataFrame:
    """Blocks of all rows of ``texts(doc_id, th, text)``."""
    small_batches(texts.sparkSession)

    def run(batches):
        for batch in batches:
            row, first, last, sym, body = blocks(batch.column("text").to_pylist())
            at = pa.array(row)
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(at),
                    batch.column("th").take(at),
                    pa.array(first, pa.int32()),
                    pa.array(last, pa.int32()),
                    as_long(sym),
                    as_long(body),
                ],
                ["doc_id", "th", "first", "last", "sym", "body"],
            )

    return texts.select("doc_id", "th", "text").mapInArrow(run, BLOCKS)


def open_blocks(texts: DataFrame, chosen: DataFrame, windows: Windows) -> DataFrame:
    """Single windows of the ``chosen`` blocks ``(doc_id, th, first, last, sym, body)``."""
    per_text = chosen.groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("first", "last", "sym", "body")).alias("blocks")
    )
    wanted = attach(texts, per_text.hint("shuffle_hash"), "inner")

    def run(batches):
        for batch in batches:
            column = batch.column("blocks")
            bounds = column.offsets.to_numpy()
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            inner = column.values.slice(bounds[0], bounds[-1] - bounds[0])
            first, last = (inner.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            block, at, wh = windows(batch.column("text").to_pylist(), row, first, last)
            of_text, of_block = pa.array(row[block]), pa.array(block)
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(of_text),
                    batch.column("th").take(of_text),
                    pa.array(at, pa.int32()),
                    inner.field(2).take(of_block),
                    inner.field(3).take(of_block),
                    as_long(wh),
                ],
                ["doc_id", "th", "at", "sym", "body", "wh"],
            )

    return wanted.select("doc_id", "th", "text", "blocks").mapInArrow(run, WINDOWS)


def ranges_per_text(found: DataFrame) -> DataFrame:
    """``(doc_id, th, ranges)`` from ``found(doc_id, th, from, to)``."""
    return found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))


def ranges_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """First and last positions per row of the column ``ranges``; null is none."""
    column = batch.column("ranges")
    bounds = column.offsets.to_numpy()
    low, high = (column.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return [(low[a:b], high[a:b]) for a, b in zip(bounds, bounds[1:])]
