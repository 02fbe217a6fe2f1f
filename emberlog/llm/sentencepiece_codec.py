"""Encoding and decoding with a merge-type SentencePiece model, by prefix tables.

For merge-type models the last token of a prefix's encoding is unique.  An
automaton over all pieces lists the pieces that end at each position; the one
that is compatible with the last token of the prefix before it is stored; the
ids are then read off backwards.  Two neighbours are compatible if encoding
their joined text gives exactly the two.

Model traits this needs, checked on loading: identity normalisation apart from the
leading space, byte fallback, and white space only at the start of pieces.
Therefore a text falls apart before each run of spaces, and each distinct part
is encoded once per worker.
"""

from __future__ import annotations

import codecs
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from emberlog.llm.common import small_batches

SPACE = "▁"
_LETTER = r"[^\W\d_]"
#: Bounds of what a Python worker keeps from one task to the next: some 80 MB.
_CACHED_PARTS = 150_000
_CACHED_LENGTH = 48
_CACHED_PAIRS = 300_000


class PrefixTable:
    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.rank: dict[str, int] = {}
        self.byte_id = {}
        self.blob_parts: list[bytes] = []
        self.is_byte = np.zeros(size, bool)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.is_byte[i] = True
                self.blob_parts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_unknown(i):
                self.blob_parts.append(" ⁇ ".encode())
            elif model.is_control(i):
                self.blob_parts.append(b"")
            else:
                self.rank[piece] = i
                self.blob_parts.append(piece.replace(SPACE, " ").encode())
        scores = {p: model.get_score(i) for p, i in self.rank.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank) or len(self.byte_id) != 256:
            raise ValueError("the model has pieces across words, or no byte fallback")
        self.score = scores
        self.piece = {i: p for p, i in self.rank.items()}
        self.size_of = [len(self.piece.get(i, " ")) for i in range(size)]
        self.matches = ahocorasick.Automaton()
        for p, i in self.rank.items():
            if self.merged(p) == [p]:
                self.matches.add_word(p, i)
        self.matches.make_automaton()
        self.part = self._cuts()
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.blob = np.frombuffer(b"".join(self.blob_parts), np.uint8)
        self.lengths = np.array([len(x) for x in self.blob_parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def _cuts(self) -> re.Pattern:
        """Parts that never share a piece, so that more of them are alike.

        A text may be cut around characters without piece, before runs of spaces,
        and between a letter and punctuation that no piece holds after a letter.  ``_LETTER``
        matches numerals like a raised two as well; those that a piece joins to punctuation end no word.
        """
        alone = "".join(c for c in "\n\t" if not any(c in p for p in self.rank))
        behind = {(a, b) for p in self.rank for a, b in zip(p, p[1:]) if re.match(_LETTER, a)}
        after_letters = {b for a, b in behind if a.isalpha()}
        marks = "".join(c for c in ".,;:!?|&*%#$" if c not in after_letters)
        joined = re.escape("".join(sorted({a for a, b in behind if b in marks})))
        last = f"(?<![{joined}])" if joined else ""
        end_of_word = f"{SPACE}*{_LETTER}+{last}(?=[{re.escape(marks)}])|" if marks else ""
        single = f"[{alone}]|" if alone else ""
        return re.compile(f"{end_of_word}{SPACE}+[^{SPACE}{alone}]*|{single}[^{SPACE}{alone}]+")

    def merged(self, text: str) -> list[str]:
        """Merge by score, the leftmost first; only for texts of one or two pieces."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.piece[left], self.piece[right]
        return self.merged(a + b) == [a, b]

    def encode_part(self, part: str) -> list[int]:
        n = len(part)
        last = [-1] * (n + 1)  # the last token of each prefix; -1: a character without piece, or nothing
        size_of, pairs = self.size_of, self.pairs
        done = -1
        for end, token in self.matches.iter(part):
            if end == done:
                continue
            before = last[end + 1 - size_of[token]]
            if before >= 0:
                pair = before << 20 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= _CACHED_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible(before, token)
                if not fits:
                    continue
            last[end + 1] = token
            done = end
        out: list[int] = []
        at = n
        while at:
            token = last[at]
            if token < 0:
                out += [self.byte_id[b] for b in reversed(part[at - 1].encode())]
                at -= 1
            else:
                out.append(token)
                at -= size_of[token]
        out.reverse()
        return out

    def _part_ids(self, part: str) -> bytes:
        """What is used again moves from the older to the newer half of the cache."""
        ids = self.older.get(part)
        if ids is None:
            ids = array("i", self.encode_part(part)).tobytes()
        if len(part) <= _CACHED_LENGTH:
            if len(self.parts) >= _CACHED_PARTS:
                self.older = dict(self.parts)
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as int32 in one byte string."""
        if not text:
            return b""
        whole = SPACE + text.replace(" ", SPACE)
        known, get = self.parts.get, self._part_ids
        return b"".join([known(p) or get(p) for p in self.part.findall(whole)])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; ids outside the model raise, wrong byte runs become U+FFFD a byte."""
        if not len(ids):
            return ""
        ids = np.asarray(ids, np.int64)
        if ids.min() < 0 or ids.max() >= len(self.lengths):
            raise ValueError("an id is outside the model")
        sizes = self.lengths[ids]
        shift = np.repeat(self.starts[ids] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        raw = self.blob[np.arange(len(shift)) + shift].tobytes()
        text = raw[1:] if raw[:1] == b" " and not self.is_byte[ids[0]] else raw
        try:
            return text.decode()
        except UnicodeDecodeError:
            return text.decode(errors="emberlog_each_byte")


def _each_byte(error: UnicodeDecodeError):
    return "�", error.start + 1


codecs.register_error("emberlog_each_byte", _each_byte)


@lru_cache(maxsize=2)
def _table(path: str) -> PrefixTable:
    return PrefixTable(path)


def _ids_of(table: PrefixTable, texts: pa.Array) -> pa.ListArray:
    found = [table.encode(t or "") for t in texts.to_pylist()]
    sizes = np.cumsum([0] + [len(x) // 4 for x in found])
    flat = pa.Array.from_buffers(pa.int32(), int(sizes[-1]), [None, pa.py_buffer(b"".join(found))])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)


def _texts_of(table: PrefixTable, ids: pa.ListArray) -> pa.Array:
    flat = ids.values.to_numpy(zero_copy_only=False)
    bounds = ids.offsets.to_numpy()
    return pa.array([table.decode(flat[a:b]) for a, b in zip(bounds, bounds[1:])], pa.string())


def _renamed(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != name]
    return pa.record_batch([c for _, c in kept] + [values], [n for n, _ in kept] + [name])


def _with(df: DataFrame, name: str, kind) -> StructType:
    return StructType([f for f in df.schema if f.name != name] + [StructField(name, kind, False)])


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and rows of ``docs`` and ``ids array<int>``, as the library encodes ``text``.

    No begin or end ids.  Null and empty texts give an empty array; a column
    that is called like ``ids`` is replaced; an empty table stays empty.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        table = _table(model_path)
        for batch in batches:
            yield _renamed(batch, ids, _ids_of(table, batch.column(text)))

    return docs.mapInArrow(run, _with(docs, ids, ArrayType(IntegerType(), False)))


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and rows of ``encoded`` and the text of ``ids``; null ids give an empty text."""
    small_batches(encoded.sparkSession)

    def run(batches):
        table = _table(model_path)
        for batch in batches:
            yield _renamed(batch, text, _texts_of(table, batch.column(ids)))

    return encoded.mapInArrow(run, _with(encoded, text, StringType()))


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row, by one Python worker a task: encoded, and decoded from the ids."""
    small_batches(docs.sparkSession)

    def run(batches):
        table = _table(model_path)
        for batch in batches:
            ids = _ids_of(table, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), ids, _texts_of(table, ids)], ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", id_type), StructField("ids", ArrayType(IntegerType(), False), False),
                         StructField("decoded", StringType(), False)])
    return rows.mapInArrow(run, schema)


def digests(trip: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``round_trip``'s rows."""
    return trip.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
