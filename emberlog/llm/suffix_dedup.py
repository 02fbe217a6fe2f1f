"""Removal of byte spans that occur anywhere else, from sampled and named suffixes.

Suffixes are sampled by content: of every window of ``SPAN`` bytes the suffix whose first
``GRAM`` bytes have the smallest hash, the leftmost if several have it.  Any two equal
windows sample the same suffix, which is what a difference cover grants by
counting positions, at a seventh of its samples.  Spark names the samples by grouping
their prefixes, names whole blocks between samples from them, and merges in
the remaining suffixes (single windows) only where names leave the answer open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm import hashing as H
from emberlog.llm.common import attach, keyed, small_batches, stored
from emberlog.llm.repeats import BLOCKS, discard, ranges_of, ranges_per_text, settled

SPAN = 200
GRAM = 80
#: Blocks that stay open are cut into pieces of so many windows, then into single ones.
PIECES = (8, 1)
#: Pieces that are named at a time; bounds memory where every window of a batch of texts is opened.
AT_ONCE = 1 << 19
_U = np.uint64
_PLACE = _U((1 << 20) - 1)


def _chunks(data: np.ndarray):
    """Pieces of all bytes that overlap by a window less one byte."""
    for low in range(0, len(data), H.CHUNK):
        piece = data[low : low + H.CHUNK + SPAN - 1]
        if len(piece) >= SPAN:
            yield low, piece


def _b(piece: np.ndarray) -> H.Spans:
    return H.Spans(H._CODES_B[piece], H.BASE_B)


def blocks(texts: list[str]) -> tuple[np.ndarray, ...]:
    data, text_starts = H.joined(texts)
    found = []
    for low, piece in _chunks(data):
        n = len(piece)
        begin = np.arange(n - GRAM + 1)
        gram = H.Spans(H._CODES_A[piece], H.BASE_A).of(begin, begin + GRAM)
        key = (H.mix(gram) & ~_PLACE) | begin.astype(_U)
        pick = (H.sliding_min(key, SPAN - GRAM + 1) & _PLACE).astype(np.int64)
        text = np.searchsorted(text_starts, low + np.arange(n - SPAN + 1), side="right") - 1
        fits = low + np.arange(n - SPAN + 1) + SPAN < text_starts[text + 1]
        start = np.flatnonzero(fits)
        if not len(start):
            continue
        pick, text = pick[start], text[start]
        new = np.concatenate([[True], (pick[1:] != pick[:-1]) | (np.diff(start) > 1)])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(start)) - 1
        first, last, row = start[head], start[tail], text[head]
        inside = low - text_starts[row]
        found.append((row, first + inside, last + inside, gram[pick[head]], _b(piece).of(first, last + SPAN), pick[head] + inside))
    if not found:
        return tuple(np.array([], t) for t in (np.int64, np.int64, np.int64, _U, _U, np.int64))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def pieces(data: np.ndarray, text_starts: np.ndarray, row, first, last, pick, width: int) -> tuple[np.ndarray, ...]:
    """Pieces of blocks: windows whose distance to the block's sample has the same quotient by ``width``.

    A piece is named by the bytes that all its windows would share if it were complete, and by all its bytes.
    """
    low_part, high_part = (pick - last) // width, (pick - first) // width
    count = (high_part - low_part + 1).astype(np.int64)
    block = np.repeat(np.arange(len(row)), count)
    part = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count) + low_part[block]
    begin = np.maximum(first[block], pick[block] - part * width - (width - 1))
    end = np.minimum(last[block], pick[block] - part * width)
    offset = text_starts[row[block]]
    core = offset + pick[block] - part * width
    sym, body = np.empty(len(block), _U), np.empty(len(block), _U)
    start = offset + begin
    order = np.argsort(start, kind="stable")
    placed = start[order]
    for low in range(0, len(data), H.CHUNK):
        piece = data[low : low + H.CHUNK + SPAN + width]
        mine = order[np.searchsorted(placed, low) : np.searchsorted(placed, low + H.CHUNK)]
        if len(mine):
            at = core[mine] - low
            sym[mine] = H.Spans(H._CODES_A[piece], H.BASE_A).of(at, at + SPAN - width + 1)
            body[mine] = _b(piece).of(start[mine] - low, (offset + end)[mine] - low + SPAN)
    return block, begin, end, sym, body


def slices(row, first, last, pick, width: int) -> list[np.ndarray]:
    """Numbers of blocks that lie side by side, with some ``AT_ONCE`` pieces a slice."""
    order = np.lexsort((first, row))
    count = (pick - first) // width - (pick - last) // width + 1
    return np.split(order, np.flatnonzero(np.diff(np.cumsum(count[order]) // AT_ONCE)) + 1)


_PLACED = BLOCKS + ", pick int"


def _first_blocks(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            row, *numbers, sym, body, pick = blocks(batch.column("text").to_pylist())
            at = pa.array(row)
            yield _records(batch.column("doc_id").take(at), batch.column("th").take(at), *numbers, sym, body, pick)

    return texts.select("doc_id", "th", "text").mapInArrow(run, _PLACED)


def _opened(texts: DataFrame, samples: DataFrame, width: int) -> DataFrame:
    """The pieces of the blocks ``samples(doc_id, th, first, last, pick)``."""
    per_text = samples.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "last", "pick")).alias("blocks"))
    wanted = attach(texts, per_text.hint("shuffle_hash"), "inner").select("doc_id", "th", "text", "blocks")

    def run(batches):
        for batch in batches:
            column = batch.column("blocks")
            bounds = column.offsets.to_numpy()
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            inner = column.values.slice(bounds[0], bounds[-1] - bounds[0])
            first, last, pick = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            joined = H.joined(batch.column("text").to_pylist())
            for some in slices(row, first, last, pick, width):
                block, begin, end, sym, body = pieces(*joined, row[some], first[some], last[some], pick[some], width)
                at = pa.array(row[some][block])
                yield _records(batch.column("doc_id").take(at), batch.column("th").take(at), begin, end, sym, body, pick[some][block])

    return wanted.mapInArrow(run, _PLACED)


def _records(doc_id, th, first, last, sym, body, pick) -> pa.RecordBatch:
    small = [pa.array(x, pa.int32()) for x in (first, last)]
    columns = [doc_id, th, *small, H.as_long(sym), H.as_long(body), pa.array(pick, pa.int32())]
    return pa.record_batch(columns, ["doc_id", "th", "first", "last", "sym", "body", "pick"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, ranges)``: byte ranges of windows that start at least twice in the table."""
    texts = keyed(docs)
    sample = F.struct("doc_id", "th", "first", "last", "pick")
    found = None
    table = settled(_first_blocks(texts))
    for width in (*PIECES, None):
        shared = table.groupBy("sym").agg(F.count("*").alias("n")).where("n > 1")
        # sums are stored before they are joined back, so that the joins stand alone and hot keys can be split
        kept = settled(table.join(stored(shared.select("sym")), "sym"))
        discard(table)
        bodies = settled(kept.groupBy("sym", "body").agg(F.count("*").alias("n"), F.min(sample).alias("at")))
        whole = settled(
            kept.join(bodies.where("n > 1").select("sym", "body"), ["sym", "body"]).select(
                "doc_id", "th", F.col("first").alias("from"), (F.col("last") + SPAN).alias("to")
            )
        )
        found = whole if found is None else found.unionByName(whole)
        discard(kept)
        if width:
            mixed = bodies.groupBy("sym").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low < high")
            table = settled(_opened(texts, bodies.join(stored(mixed.select("sym")), "sym").select("at.*"), width))
        discard(bodies)
    return ranges_per_text(found)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` of every row; ``kept`` is the remaining bytes.

    Null and empty texts have no bytes; texts under ``SPAN`` bytes lose nothing;
    repeated rows remove each other; other columns are ignored; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    full = attach(keyed(docs), settled(repeated_spans(docs)).hint("shuffle_hash"))

    def cut(batches):
        for batch in batches:
            out = []
            for text, (low, high) in zip(batch.column("text").to_pylist(), ranges_of(batch)):
                raw = text.encode(errors="surrogatepass")
                left, at, low, high = [], 0, *H.merged(low, high)
                for a, b in zip(low, high):
                    left.append(raw[at:a])
                    at = b
                left.append(raw[at:])
                kept = b"".join(left)
                out.append((len(raw), len(raw) - len(kept), len(low), kept))
            columns = list(zip(*out)) or [()] * 4
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return full.select("doc_id", "text", "ranges").mapInArrow(cut, schema)


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))

