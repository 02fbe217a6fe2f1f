"""Removal of long word spans that an earlier document holds, by recompression.

Rounds rename runs of one token and then left-right pairs of tokens; a name
follows from what it stands for, so all tasks give equal spans equal interior
symbols without exchanging them.  The longest symbol well inside a window of ``SPAN`` words is
the window's anchor.  Spark groups the anchors' contexts, so shared symbols
reveal long repeats, and verifies them block by block or window by window.

How far inside: in a round, only symbols at the edge of a window depend on what
stands outside.  A run step loses at most ``cap`` words a side, a pair step one symbol.
With the rounds below that is ``EDGE`` = (2 + 2) + 2 + 4 = 10 words, and
what is left always holds a whole symbol of at most 8 words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm import hashing as H
from emberlog.llm.common import attach, keyed, small_batches, stored
from emberlog.llm.repeats import block_table, discard, open_blocks, ranges_of, ranges_per_text, settled

SPAN = 50
#: Longest symbol after each round, in words, and whether runs are renamed before the pairs.
ROUNDS = ((2, True), (4, False), (8, False))
EDGE = 10
_CHUNK = 1 << 17
_U = np.uint64


def recompress(codes: np.ndarray, new_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(symbol, begin, size)`` after all rounds; ``new_text`` marks tokens that begin a text."""
    symbol, begin, fresh = codes, np.arange(len(codes)), new_text.copy()
    size = np.ones(len(codes), np.int64)
    for number, (cap, with_runs) in enumerate(ROUNDS):
        if with_runs and len(symbol):
            change = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | fresh[1:]])
            head = np.flatnonzero(change)
            count = np.diff(np.append(head, len(symbol)))
            whole = (count > 1) & (count * size[head] <= cap)
            keep = np.ones(len(symbol), bool)
            keep[np.repeat(whole, count) & ~change] = False
            at = head[whole]
            symbol, size = symbol.copy(), size.copy()
            symbol[at] = H.mix(symbol[at] * _U(0xA24BAED4963EE407) + count[whole].astype(_U))
            size[at] *= count[whole]
            symbol, begin, size, fresh = symbol[keep], begin[keep], size[keep], fresh[keep]
        right = (H.mix(symbol + _U(number + 1)) & _U(1)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & ~fresh[1:] & (size[:-1] + size[1:] <= cap))
        keep = np.ones(len(symbol), bool)
        keep[pair + 1] = False
        symbol, size = symbol.copy(), size.copy()
        symbol[pair] = H.mix(symbol[pair] * _U(0x9FB21C651E98DF25) + symbol[pair + 1] * _U(0xC2B2AE3D27D4EB4F))
        size[pair] += size[pair + 1]
        symbol, begin, size, fresh = symbol[keep], begin[keep], size[keep], fresh[keep]
    return symbol, begin, size


class _Words:
    """Word codes of a batch of texts."""

    def __init__(self, texts: list[str]):
        data, text_starts = H.joined(texts)
        begin, end = H.words(data)
        self.a, self.b = H.word_codes(data, begin, end)
        self.text = np.searchsorted(text_starts, begin, side="right") - 1
        self.base = np.searchsorted(self.text, np.arange(len(texts)))  # first word of each text


def blocks(texts: list[str]) -> tuple[np.ndarray, ...]:
    words = _Words(texts)
    found = [_blocks(words, low, min(low + _CHUNK + SPAN - 1, len(words.a))) for low in range(0, len(words.a), _CHUNK)]
    found = [f for f in found if f is not None]
    if not found:
        return tuple(np.array([], t) for t in (np.int64, np.int64, np.int64, _U, _U))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _blocks(words: _Words, low: int, high: int):
    text = words.text[low:high]
    n = high - low
    if n < SPAN:
        return None
    start = np.flatnonzero(text[: n - SPAN + 1] == text[SPAN - 1 :])
    if not len(start):
        return None
    symbol, begin, size = recompress(words.a[low:high], np.concatenate([[True], text[1:] != text[:-1]]))
    # the longest symbol first, then the smallest name, then the leftmost
    length_rank = (8 - size).astype(_U) << _U(60)
    key = length_rank | (H.mix(symbol) >> _U(24) << _U(20)) & _U((1 << 60) - 1) | np.arange(len(symbol), dtype=_U)
    first = np.searchsorted(begin, start + EDGE)
    last = np.searchsorted(begin + size, start + SPAN - EDGE, side="right")
    pick = (H.range_min(key, first, last) & _U((1 << 20) - 1)).astype(np.int64)
    new = np.concatenate([[True], (pick[1:] != pick[:-1]) | (np.diff(start) > 1)])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    first, last, pick = start[head], start[tail], pick[head]
    sym = H.Spans(words.a[low:high], H.BASE_A).of(begin[pick] - EDGE, begin[pick] + size[pick] + EDGE)
    body = H.Spans(words.b[low:high], H.BASE_B).of(first, last + SPAN)
    row = text[first]
    inside = low - words.base[row]
    return row, first + inside, last + inside, sym, body


def windows(texts: list[str], row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    words = _Words(texts)
    count = (last - first + 1).astype(np.int64)
    block = np.repeat(np.arange(len(row)), count)
    at = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count) + first[block]
    start = words.base[row[block]] + at
    wh = np.empty(len(start), _U)
    order = np.argsort(start, kind="stable")
    placed = start[order]
    for low in range(0, len(words.b), _CHUNK):
        mine = order[np.searchsorted(placed, low) : np.searchsorted(placed, low + _CHUNK)]
        if len(mine):
            spans = H.Spans(words.b[low : low + _CHUNK + SPAN], H.BASE_B)
            wh[mine] = spans.of(start[mine] - low, start[mine] - low + SPAN)
    return block, at, wh


#: Rows without id come after all others: no id is smaller than theirs because of them.
_LAST = (1 << 63) - 1


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, ranges)``: word ranges whose windows also start in a row with a smaller ``doc_id``.

    Rows with the same ``doc_id`` never remove each other's words; a null id is larger than all
    (and as large as 2**63 - 1, so rows with these two ids leave each other's words).
    """
    texts = keyed(docs)
    order = F.coalesce(F.col("doc_id"), F.lit(_LAST))
    table = settled(block_table(texts, blocks))
    shared = table.groupBy("sym").agg(F.min(order).alias("low"), F.max(order).alias("high")).where("low < high")
    # sums are stored before they are joined back, so that the joins stand alone and hot keys can be split
    kept = settled(table.join(stored(shared.select("sym")), "sym"))
    discard(table)
    bodies = settled(kept.groupBy("sym", "body").agg(F.min(order).alias("earliest")))
    held = kept.join(bodies, ["sym", "body"])
    whole = held.where(order > F.col("earliest")).select("doc_id", "th", F.col("first").alias("from"), (F.col("last") + SPAN).alias("to"))
    mixed = bodies.groupBy("sym").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low < high")
    earliest = held.where(order == F.col("earliest")).select("doc_id", "th", "first", "last", "sym", "body")
    opened = settled(open_blocks(texts, earliest.join(stored(mixed.select("sym")), "sym"), windows))
    sources = opened.groupBy("sym", "wh").agg(F.min(order).alias("low"), F.max(order).alias("high")).where("low < high")
    single = (
        opened.join(stored(sources), ["sym", "wh"])
        .where(order > F.col("low"))
        .select("doc_id", "th", F.col("at").alias("from"), (F.col("at") + SPAN).alias("to"))
    )
    return ranges_per_text(whole.unionByName(single))


def drop_repeats(docs: DataFrame, with_key: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` of every row; ``kept`` is the words left, joined by a space.

    ``with_key`` adds ``th``, the hash that names a row together with its id.

    Null and empty texts have no words and an empty ``kept``; texts of fewer than ``SPAN``
    words lose nothing; other columns are ignored; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    full = attach(keyed(docs), settled(repeated_spans(docs)).hint("shuffle_hash"))

    def cut(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, (low, high) in zip(batch.column("text").to_pylist(), ranges_of(batch)):
                words = text.encode(errors="surrogatepass").split()
                left, at = [], 0
                for a, b in zip(*H.merged(low, high)):
                    left += words[at:a]
                    at = b
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("th"), pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "th", "n_words", "n_removed", "kept"],
            )

    schema = "doc_id long, th long, n_words long, n_removed long, kept string"
    done = full.select("doc_id", "th", "text", "ranges").mapInArrow(cut, schema)
    return done if with_key else done.drop("th")


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))

