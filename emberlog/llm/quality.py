"""Quality scores from a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature in turns, then pair by pair, and
summed into one lookup table per feature and per chosen pair.  A score is the
logistic of an intercept and the table entries of the text's bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import learning_rows, small_batches

#: Labelled rows the model may learn from.
LEARN_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 120
RATE = 0.1
LEAF_WEIGHT = 2.0

FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "distinct_lines", "line_words", "symbols",
    "punctuation", "digits", "capitals", "bars", "non_ascii", "vowels", "symbol_words", "longest_word", "line_ends",
)

_BYTES = np.arange(256)


def _of(chars: bytes) -> np.ndarray:
    return np.isin(_BYTES, np.frombuffer(chars, np.uint8))


_SYMBOLS, _STOPS, _VOWELS = _of(b"#$%&*+<=>@\\^_`{}~"), _of(b".,;:!?"), _of(b"aeiouyAEIOUY")
_DIGITS, _CAPITALS = (_BYTES >= 48) & (_BYTES < 58), (_BYTES >= 65) & (_BYTES < 91)
_LETTERS = _CAPITALS | (_BYTES >= 97) & (_BYTES < 123)


def text_features(text: str | None) -> list[float]:
    """Measures of one whole text; of an empty or null one all are 0."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode(errors="surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n, w, k = len(raw), max(1, len(words)), len(lines)
    letters = max(1, int(counts[_LETTERS].sum()))
    shown = n - int(counts[[9, 10, 13, 32]].sum())
    return [
        np.log1p(n),
        np.log1p(len(words)),
        shown / w,
        len(set(words)) / w,
        len(set(lines)) / k,
        np.log1p(len(words) / k),
        counts[_SYMBOLS].sum() / n,
        counts[_STOPS].sum() / w,
        counts[_DIGITS].sum() / n,
        counts[_CAPITALS].sum() / letters,
        counts[124] / w,
        counts[128:].sum() / n,
        counts[_VOWELS].sum() / letters,
        sum(1 for x in words if not x.isalnum()) / w,
        np.log1p(max(map(len, words), default=0)),
        sum(1 for x in lines if x[-1:] in ".!?") / k,
    ]


def feature_frame(texts: pd.Series) -> np.ndarray:
    return np.array([text_features(t) for t in texts], float).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            rows = np.searchsorted(self.coarse[f], x[:, f], side="right")
            total += table[rows, np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g, h):
    return g / (h + LEAF_WEIGHT)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values per bin of the best tree of that depth on gradient and curvature sums per bin."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = g.sum() - left_g, h.sum() - left_h
        gain = left_g**2 / (left_h + LEAF_WEIGHT) + right_g**2 / (right_h + LEAF_WEIGHT)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + LEAF_WEIGHT) + 1e-9:
            out[:cut] = _shallow_tree(g[:cut], h[:cut], depth - 1)
            out[cut:] = _shallow_tree(g[cut:], h[cut:], depth - 1)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """One cut along the first feature and one on each side along the second, or the other way round."""
    best, best_gain = np.full(g.shape, _leaf(g.sum(), h.sum())), g.sum() ** 2 / (h.sum() + LEAF_WEIGHT)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, a.shape[0]):
            values, gain = np.empty(a.shape), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = a[part].sum(0), b[part].sum(0)
                line = _shallow_tree(pg, ph, 1)
                values[part] = line
                for v in np.unique(line):
                    gain += pg[line == v].sum() ** 2 / (ph[line == v].sum() + LEAF_WEIGHT)
            if gain > best_gain + 1e-9:
                best, best_gain = (values.T if flip else values), gain
    return best, best_gain


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting on log loss; without both classes the model is a constant."""
    n, width = x.shape
    base = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
    if n == 0 or y.min() == y.max():
        empty = [np.array([])] * width
        return AdditiveModel(float(np.log(base / (1 - base))), empty, [np.zeros(1)] * width, [], empty, [])
    intercept = float(np.log(base / (1 - base)))
    edges = [_edges(x[:, f], BINS) for f in range(width)]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slopes()
            size = len(tables[f])
            step = RATE * _shallow_tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size))
            tables[f] += step
            total += step[bins[f]]

    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(width)]
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def grid(f, g_, values):
        shape = len(coarse[f]) + 1, len(coarse[g_]) + 1
        return np.bincount(rough[f] * shape[1] + rough[g_], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(
        ((_grid_tree(grid(a, b, g), grid(a, b, h))[1], a, b) for a in range(width) for b in range(a + 1, width)),
        key=lambda t: (-t[0], t[1], t[2]),
    )
    pairs = [(a, b) for _, a, b in gains[:PAIRS]]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(ROUNDS // 6):
        for k, (a, b) in enumerate(pairs):
            g, h = slopes()
            step = RATE * _grid_tree(grid(a, b, g), grid(a, b, h))[0]
            pair_tables[k] += step
            total += step[rough[a], rough[b]]
    return AdditiveModel(intercept, edges, tables, pairs, coarse, pair_tables)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = LEARN_ROWS) -> AdditiveModel:
    """Learn from at most ``limit`` labelled rows that are not held out; only their measures reach the driver."""
    small_batches(docs.sparkSession)
    rows = learning_rows(docs, labels, [target], limit)

    def measure(frames):
        for frame in frames:
            out = pd.DataFrame(feature_frame(frame["text"]), columns=list(FEATURES))
            out["y"] = frame["y"].to_numpy(float)
            yield out

    schema = ", ".join(f"{f} double" for f in FEATURES) + ", y double"
    seen = rows.select("text", F.col(target).alias("y")).mapInPandas(measure, schema).toPandas()
    seen = seen.drop_duplicates().sort_values([*FEATURES, "y"])  # copies count once; any row order gives the same sums
    return fit(seen[list(FEATURES)].to_numpy(), seen["y"].to_numpy())


def quality_scores(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """All rows and columns of ``docs`` and ``score`` (0 to 1) of the whole text; null counts as empty.

    A column that is called ``score`` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(feature_frame(texts)), dtype=float)

    return docs.withColumn("score", score("text"))
