"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other.  Each model sees the selected
words of the text and the probabilities of all earlier categories; it is
trained with out-of-fold predictions of those, so it learns how far they can
be trusted.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import learning_rows, small_batches, stored

#: The chain: a text of low quality, then a toxic one.
CATEGORIES = ("low_quality", "toxic")
#: Labelled rows to learn from, and words or word beginnings that are measured for each category.
LEARN_ROWS = 12_000
TERMS = 150
MIN_TEXTS = 5
#: Lengths of word beginnings; they catch stems that are rare as whole words.
STEMS = range(4, 9)
FOLDS = 4
#: A text counts as toxic from this probability on.
REJECT_FROM = 0.5
PENALTY = 1.0

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in STEMS if n < len(word))]


def _plain(texts) -> np.ndarray:
    """Share of symbols and of capitals, and the log of the length."""
    out = np.zeros((len(texts), 3))
    for k, t in enumerate(texts):
        if t:
            n = len(t)
            kept = len(t.translate(_NO_SYMBOLS))
            out[k] = (n - kept) / n, _capitals(t) / n, np.log1p(n) / 10
    return out


def _capitals(text: str) -> int:
    """Capitals among all characters, looked up by code point, some at a time."""
    parts = (text[k : k + _CHUNK].encode("utf-32-le", "surrogatepass") for k in range(0, len(text), _CHUNK))
    return sum(int(np.count_nonzero(_CAPITAL[np.frombuffer(p, np.uint32)])) for p in parts)


_CHUNK = 1 << 16
_CAPITAL = np.fromiter((chr(c).isupper() for c in range(sys.maxunicode + 1)), bool)
_NO_SYMBOLS = str.maketrans("", "", "#$%&*+<=>@\\^_`{}~|!")


@dataclass(frozen=True)
class Chain:
    words: dict[str, int]
    weights: list[np.ndarray]

    def features(self, texts) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words)))
        places: dict[str, list[int]] = {}
        for k, text in enumerate(texts):
            for word, n in Counter(words_of(text)).items():
                at = places.get(word)
                if at is None:
                    at = places[word] = [self.words[t] for t in terms_of(word) if t in self.words]
                for j in at:
                    x[k, j] += n
        return np.hstack([np.log1p(x), _plain(texts)])

    def probabilities(self, texts) -> np.ndarray:
        x = self.features(texts)
        found = []
        for weights in self.weights:
            found.append(_probability(weights, np.column_stack([x, *found])))
        return np.column_stack(found)


def _probability(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[1:] + weights[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; without both classes a constant."""
    weights = np.zeros(x.shape[1] + 1)
    base = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    weights[0] = np.log(base / (1 - base))
    if len(y) == 0 or y.min() == y.max():
        return weights
    full = np.column_stack([np.ones(len(x)), x])
    ridge = np.full(full.shape[1], PENALTY)
    ridge[0] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(full @ weights, -30, 30)))
        curve = (full * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ full
        step = np.linalg.solve(curve + np.diag(ridge), full.T @ (y - p) - ridge * weights)
        weights += step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return weights


def fit_chain(words: dict[str, int], texts: list[str], labels: np.ndarray) -> Chain:
    """Fit the categories (columns of ``labels``) in order, feeding out-of-fold probabilities forward."""
    x = Chain(words, []).features(texts)
    return _fit(words, x, labels)


def _fit(words: dict[str, int], x: np.ndarray, labels: np.ndarray) -> Chain:
    fold = np.arange(len(x)) % FOLDS
    weights = []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        weights.append(_logistic(x, y))
        ahead = np.zeros(len(x))
        for part in range(FOLDS):
            inside = fold == part
            ahead[inside] = _probability(_logistic(x[~inside], y[~inside]), x[inside])
        x = np.column_stack([x, ahead])
    return Chain(words, weights)


def train(docs: DataFrame, labels: DataFrame, limit: int = LEARN_ROWS) -> Chain:
    """Learn from at most ``limit`` labelled, distinct texts that are not held out.

    ``labels(doc_id, quality, toxic)``.  Terms are ranked by how far
    their mean log counts differ, per category; ties go by the alphabet.
    Only the measures of the learning rows reach the driver.
    """
    small_batches(docs.sparkSession)
    targets = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    rows = learning_rows(docs, targets, list(CATEGORIES), limit)
    rows = stored(rows.groupBy("text").agg(*[F.max(c).cast("double").alias(c) for c in CATEGORIES]))

    def measured_terms(batches):
        for batch in batches:
            names, values = [], []
            for row in batch.to_pylist():
                found: Counter[str] = Counter()
                for word, n in Counter(words_of(row["text"])).items():
                    for term in terms_of(word):
                        found[term] += n
                names += found
                values += [(math.log1p(n), *[row[c] for c in CATEGORIES]) for n in found.values()]
            columns = np.array(values, float).reshape(-1, 1 + len(CATEGORIES)).T
            yield pa.record_batch([pa.array(names, pa.string()), *map(pa.array, columns)], ["term", "v", *CATEGORIES])

    size, *positive = rows.agg(F.count("*"), *[F.sum(c) for c in CATEGORIES]).first()
    held = rows.mapInArrow(measured_terms, "term string, v double, " + ", ".join(f"{c} double" for c in CATEGORIES))
    sums = held.groupBy("term").agg(
        F.count("*").alias("n"),
        F.round(F.sum("v"), 6).alias("v"),
        F.round(F.sum(F.col("v") * F.col("v")), 6).alias("v2"),
        *[F.round(F.sum(F.col("v") * F.col(c)), 6).alias(c) for c in CATEGORIES],
    )
    sums = sums.where(F.col("n") >= MIN_TEXTS)
    alike = [c for c in sums.columns if c != "term"]  # of terms that always occur together the longest stays
    sums = sums.groupBy(*alike).agg(F.max(F.struct(F.length("term"), "term")).alias("_t")).withColumn("term", F.col("_t.term"))
    chosen: list[str] = []
    for c, total in zip(CATEGORIES, positive):
        inside, outside = max(1.0, total or 0), max(1.0, size - (total or 0))
        gap = F.col(c) / inside - (F.col("v") - F.col(c)) / outside
        spread = F.sqrt(F.greatest(F.col("v2") / max(1, size) - (F.col("v") / max(1, size)) ** 2, F.lit(0.0)) + 1e-3)
        best = sums.orderBy(F.desc(F.round(F.abs(gap) / spread, 6)), "term")
        chosen += [r.term for r in best.select("term").limit(TERMS).collect()]
    words = {w: k for k, w in enumerate(dict.fromkeys(chosen))}
    shared = Chain(words, [])

    def measure(frames):
        for frame in frames:
            out = pd.DataFrame({"x": list(shared.features(frame["text"].tolist()))})
            yield out.assign(**{c: frame[c] for c in CATEGORIES}, h=[hash_of(t) for t in frame["text"]])

    schema = "x array<double>, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", h string"
    seen = rows.mapInPandas(measure, schema).toPandas().sort_values("h")
    x = np.array(seen["x"].tolist(), float).reshape(len(seen), len(words) + 3)
    return _fit(words, x, seen[list(CATEGORIES)].to_numpy(float))


def hash_of(text: str) -> str:
    import hashlib

    return hashlib.md5(text.encode(errors="surrogatepass")).hexdigest()


def toxicity(docs: DataFrame, chain: Chain, column: str = "toxicity") -> DataFrame:
    """All rows and columns of ``docs`` and ``column``, a struct of the probability of each category.

    The whole text is read; null counts as empty; a column of that name is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(", ".join(f"{c} double" for c in CATEGORIES))
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.probabilities(texts.tolist()), columns=list(CATEGORIES))

    return docs.withColumn(column, score("text"))
