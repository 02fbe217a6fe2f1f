"""Vectorised hashes of words, windows and spans of a batch of texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes or words that are hashed at a time; bounds memory for texts of any length.
CHUNK = 1 << 19
#: Longer words are hashed whole: long texts made for it collide modulo 2**64 under any base.
_LONG_WORD = 128
_U = np.uint64

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


class Spans:
    """Hashes of any span of a sequence of 64-bit codes, by prefix sums of a polynomial modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, codes: np.ndarray, base: int):
        n = len(codes)
        known = self._powers.get(base)
        if known is None or len(known[0]) <= n:
            size = max(n, CHUNK + 8192) + 1
            inverse = pow(base, -1, 1 << 64)
            known = tuple(
                np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, b, _U))]) for b in (base, inverse)
            )
            if size <= 4 * CHUNK:
                self._powers[base] = known
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(codes * known[0][:n], dtype=_U)])
        self.inverse = known[1]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


BASE_A, BASE_B = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
_CODES_A, _CODES_B = _byte_codes(11), _byte_codes(97)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, each followed by a line break, and where each begins (one more at the end)."""
    raw = [(t or "").encode(errors="surrogatepass") for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), starts


def small_letters(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs without space or characters 9 to 13."""
    space = np.concatenate([[True], _IS_SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def word_codes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit codes of every word."""
    a, b = np.empty(len(begin), _U), np.empty(len(begin), _U)
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(begin, begin[at] + CHUNK)))
        low = int(begin[at])
        high = min(int(end[stop - 1]), low + CHUNK + _LONG_WORD)
        piece = data[low:high]
        s, e = begin[at:stop] - low, np.minimum(end[at:stop], high) - low
        a[at:stop] = Spans(_CODES_A[piece], BASE_A).of(s, e)
        b[at:stop] = Spans(_CODES_B[piece], BASE_B).of(s, e)
        at = stop
    for k in np.flatnonzero(end - begin > _LONG_WORD):
        digest = hashlib.blake2b(data[begin[k] : end[k]].tobytes(), digest_size=16).digest()
        a[k], b[k] = np.frombuffer(digest, _U)
    return a, b


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(_U).max, _U)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``values[low:high]`` for each pair, none empty."""
    size = high - low
    level = np.zeros(len(size), np.int64)
    level[size > 1] = np.floor(np.log2(size[size > 1])).astype(np.int64)
    out = np.empty(len(low), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        at = level == k
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
    return out


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U, copy=False).view(np.int64))


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges ``[first, last)`` with overlapping and touching ones joined, in order."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > last[:-1]])
    return first[new], last[np.concatenate([new[1:], [True]])]
