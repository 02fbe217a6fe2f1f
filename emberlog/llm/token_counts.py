"""Token counts without token ids.

Pre-tokens are counted over the corpus, the tokenizer sees every distinct one
once, and documents sum the piece counts of their pre-token frequencies.  The
tokenizer's rules turn white space into breaks, make letters small, and split
words into contractions, runs of letters, single digits and runs of marks.
Words of characters for which these rules are plain are split likewise;
any other word, and one that may hold a special token, is a unit of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import small_batches, stored

#: Most frequent units whose counts travel to every task, and their longest form: at most 32 MB.
HOT_WORDS = 131_072
HOT_LENGTH = 32

_FLUSH = 200_000
_MEMO = 200_000
#: Unchanged by composition, small by one character, and letter, digit or mark in every version of Unicode.
_PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]+")
_UNIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:\W|_)+")
#: str.split() also breaks at these, the tokenizers' rules do not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PLAIN_BREAKS = re.compile("[ \t\n\r]+")


def words_of(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [w for w in _PLAIN_BREAKS.split(text) if w]
    return text.split()


def units_of(word: str) -> list[str]:
    """Pre-tokens of a word; pieces never span two of them."""
    if "<|" in word or not _PLAIN.fullmatch(word):
        return [word]
    return _UNIT.findall(word.lower())


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()

    def flush():
        seen: Counter[str] = Counter()
        for word, n in words.items():
            for unit in units_of(word):
                seen[unit] += n
        words.clear()
        return pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            words.update(words_of(text))
            if len(words) > _FLUSH:
                yield flush()
    if words:
        yield flush()


def word_pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(word, n, pieces)``: how often each distinct unit occurs and its number of pieces."""

    def count(batches):
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            encoded = tokenizer.encode_batch_fast(batch.column("word").to_pylist(), add_special_tokens=False)
            pieces = pa.array([len(e.ids) for e in encoded], pa.int32())
            yield pa.record_batch([batch.column("word"), batch.column("n"), pieces], ["word", "n", "pieces"])

    texts = docs.where("text IS NOT NULL").select("text")
    words = texts.mapInArrow(_vocabulary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(count, "word string, n long, pieces int")


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for every row of ``docs(doc_id, text, ...)``.

    A null text counts as empty (0, 0).  Repeated rows and null ids each give
    their own row; other columns are ignored; an empty table gives no row.
    The ``HOT_WORDS`` most frequent units are summed where the text is read;
    all others are joined, so the join has no heavy key.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = stored(word_pieces(docs, tokenizer_path))
    top = pieces.where(F.length("word") <= HOT_LENGTH).orderBy(F.desc("n"), "word").limit(HOT_WORDS)
    hot = spark.sparkContext.broadcast({r.word: r.pieces for r in top.toLocalIterator()})

    def frequencies(batches):
        known = hot.value
        memo: dict[str, tuple[int, list[str]]] = {}  # pieces of the hot units of a word, and its other units

        def parts(word):
            units = units_of(word)
            found = sum(known.get(u, 0) for u in units), [u for u in units if u not in known]
            if len(memo) >= _MEMO:
                memo.clear()
            memo[word] = found
            return found

        for batch in batches:
            sizes, sums, offsets, rest, times = [], [], [0], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                total, rare = 0, Counter()
                for word, n in Counter(words_of(text)).items():
                    pieces_hot, others = memo.get(word) or parts(word)
                    total += n * pieces_hot
                    for unit in others:
                        rare[unit] += n
                sums.append(total)
                rest += rare.keys()
                times += rare.values()
                offsets.append(len(rest))
                sizes.append(len(text.encode()))
            pairs = pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(times, pa.int64())], ["word", "n"])
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                ],
                ["doc_id", "n_bytes", "summed", "rest"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, summed long, rest array<struct<word:string,n:long>>"
    counted = docs.select("doc_id", "text").mapInArrow(frequencies, schema)
    rows = stored(counted.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rest").alias("rare")).select("row", "rare.word", F.col("rare.n").alias("times"))
    more = rare.join(pieces.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    full = rows.select("row", "doc_id", "n_bytes", "summed").join(more, "row", "left")
    return full.select("doc_id", "n_bytes", (F.col("summed") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
