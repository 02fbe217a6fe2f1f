"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets.  A first look at the longest
vectors gives every query a score it must reach.  A bucket then turns that into a local
cosine threshold: if it is low, vectors too short for the query are pruned,
otherwise vectors whose largest coordinates lie outside the feasible region;
the products of the rest are computed exactly.  Queries go in blocks to the lanes of buckets that may
hold a result.  Nothing but a length for each lane and a place for each bucket passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from emberlog.llm.common import small_batches, stored

K = 10
BUCKET = 4096
QUERY_BLOCK = 4096
#: Numbers that a bucket or block of queries holds at most, if it has several vectors.
VALUES = 1 << 18
#: Buckets of the first look: so many at least, and this part of all.
SEEDS = 4
SEEDS_PART = 32
#: Buckets of a lane at most: a block of queries is sent once to each lane.
LANE = 32
#: From this local cosine threshold on coordinates prune better than lengths.
COORDINATE_FROM = 0.4
FOCUS = 4
#: Vectors are looked at one by one if at most this part of the bucket lies in the feasible region of a coordinate.
FEW = 64
#: Scores computed at once.
SCORES = 1 << 20

_PACKED = "block long, dim int, n int, low double, high double, ids binary, width int, vectors binary"
_ASKED = "q_dim int, q_ids binary, q_width int, q_vectors binary, need binary, shortest double"
_FOUND = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """``(vec_id, dim, norm, v)`` with ``v = floor(scale * x)``; rows that are null or hold null or non-finite values go."""
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    v = F.transform(x, lambda e: F.floor(e * scale).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    return rows.select("vec_id", F.size("v").alias("dim"), norm.alias("norm"), "v")


def _narrow(v: np.ndarray) -> tuple[int, bytes]:
    """Bytes a number, and the numbers in as few bytes as hold all of them."""
    for kind in (np.int16, np.int32):
        if not v.size or (v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max):
            return kind().itemsize, v.astype(kind).tobytes()
    return 8, v.tobytes()


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The dimension and the columns of up to ``size`` vectors that follow each other and have that dimension."""
    waiting: list[dict] = []
    dim = held = 0

    def flush():
        return dim, {name: np.concatenate([part[name] for part in waiting]) for name in waiting[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        others = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n not in ("dim", "v")}
        ends, changes = np.cumsum(dims), np.flatnonzero(np.diff(dims)) + 1
        for begin, end in zip([0, *changes], [*changes, len(dims)]):
            if waiting and dim != dims[begin]:
                yield flush()
                waiting, held = [], 0
            dim = int(dims[begin])
            most = max(1, min(size, VALUES // max(1, dim)))
            v = flat[ends[begin] - dim : ends[end - 1]].reshape(end - begin, dim)
            while begin < end:
                n = min(end - begin, most - held)
                waiting.append({"v": v[:n]} | {name: x[begin : begin + n] for name, x in others.items()})
                begin, v, held = begin + n, v[n:], held + n
                if held == most:
                    yield flush()
                    waiting, held = [], 0
    if waiting:
        yield flush()


def _row(values: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x], t) for x, t in zip(values, kinds)], names)


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    names = ["dim", "n", "low", "high", "ids", "width", "vectors"]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.int32(), pa.binary()]
    for dim, rows in _runs(batches, size):
        norms = rows["norm"]
        values = [dim, len(norms), float(norms.min()), float(norms.max()), rows["vec_id"].tobytes(), *_narrow(rows["v"])]
        yield _row(values, kinds, names)


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors in order of length, up to ``size`` of them a row."""
    by_length = ["dim", F.desc("norm"), "vec_id"]
    ordered = vectors.repartitionByRange(*by_length).sortWithinPartitions(*by_length)
    rows = ordered.mapInArrow(lambda b: _pack(b, size), _PACKED.split(", ", 1)[1])
    return rows.withColumn("block", F.monotonically_increasing_id())


def _pack_queries(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _ASKED.split(", ")]
    kinds = [pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.float64()]
    for dim, rows in _runs(batches, size):
        need = rows["need"].astype(float)
        shortest = float(np.min(np.where(need > 0, need / np.maximum(rows["norm"], 1e-300), -1.0)))
        yield _row([dim, rows["vec_id"].tobytes(), *_narrow(rows["v"]), need.tobytes(), shortest], kinds, names)


def _asked(queries: DataFrame, reached: DataFrame | None) -> DataFrame:
    """Query blocks with the score each query needs and the length of the shortest vector that can give one of them its score."""
    rows = queries.withColumn("need", F.lit(float("-inf")))
    if reached is not None:
        known = reached.withColumnRenamed("need", "known")
        rows = queries.hint("merge").join(known, queries["vec_id"] == known["query_id"], "left")
        rows = rows.withColumn("need", F.coalesce("known", F.lit(float("-inf"))))
    rows = rows.select("vec_id", "dim", "norm", "v", "need")
    ordered = rows.repartitionByRange("dim", "norm", "vec_id").sortWithinPartitions("dim", "norm", "vec_id")
    blocks = ordered.mapInArrow(lambda b: _pack_queries(b, QUERY_BLOCK), _ASKED)
    return blocks.withColumn("q_block", F.monotonically_increasing_id())


def _unpack(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}ids"], np.int64)
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[row[f"{side}width"]]
    return ids, np.frombuffer(row[f"{side}vectors"], kind).reshape(len(ids), row["dim"])


def _expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` items of entry i: i, and 0, 1, 2 ..."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Bucket:
    """Vectors in order of length, longest first."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        lengths = np.sqrt((v.astype(float) ** 2).sum(1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.v, self.lengths = ids[order], v[order], lengths[order]
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted_ids = self.ids[self.by_id]
        self._kept: dict = {}

    def unit(self) -> np.ndarray:
        """The vectors at length 1, a row for each coordinate."""
        return np.ascontiguousarray((self.v / np.maximum(self.lengths, 1e-300)[:, None]).T)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and the largest value of each coordinate."""
        if "ends" not in self._kept:
            unit = self.unit()
            self._kept["ends"] = unit.min(1), unit.max(1)
        return self._kept["ends"]

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """The vectors' places and values in order of each coordinate; 4 is added from coordinate to coordinate, so that all are one sorted list."""
        if "lists" not in self._kept:
            unit = self.unit()
            order = np.argsort(unit, axis=1)
            by_value = np.take_along_axis(unit, order, 1) + 4.0 * np.arange(len(order))[:, None]
            self._kept["lists"] = order.astype(np.int32).ravel(), by_value.ravel()
        return self._kept["lists"]


class Asked:
    """A block of queries and the best ``k`` found so far for each of them."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, need: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k, self.need = ids, q, k, need.copy()
        self.values = q.astype(float)
        self.sizes = np.sqrt((self.values**2).sum(1))
        self.focus = np.argsort(-np.abs(self.values), axis=1, kind="stable")[:, :FOCUS]
        self.count = np.zeros(len(ids), np.int64)
        self.found = np.zeros((len(ids), k), np.int64)
        self.scores = np.zeros((len(ids), k), np.int64)

    def offer(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Results of the queries at these places; what is not among the best goes."""
        worst = (self.count[at] == self.k) & (
            (scores < self.scores[at, -1]) | ((scores == self.scores[at, -1]) & (ids > self.found[at, -1]))
        )
        at, ids, scores = at[~worst], ids[~worst], scores[~worst]
        if not len(at):
            return
        who = np.unique(at)
        owner, place = _expanded(self.count[who])
        at = np.concatenate([who[owner], at])
        ids = np.concatenate([self.found[who[owner], place], ids])
        scores = np.concatenate([self.scores[who[owner], place], scores])
        order = np.lexsort((ids, ~scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        at, ids, scores, rank = (x[rank < self.k] for x in (at, ids, scores, rank))
        self.found[at, rank], self.scores[at, rank] = ids, scores
        self.count[who] = np.bincount(np.searchsorted(who, at), minlength=len(who))
        full = who[self.count[who] == self.k]
        self.need[full] = np.maximum(self.need[full], self.scores[full, -1].astype(float))

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, place = _expanded(self.count)
        return self.ids[owner], self.found[owner, place], self.scores[owner, place]


def _regions(asked: Asked, at: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the focus coordinates of a vector lie if its cosine with the query is ``local`` or more."""
    c = np.take_along_axis(asked.values[at], asked.focus[at], 1) / asked.sizes[at][:, None]
    local = local[:, None]
    width = np.sqrt(np.maximum(0.0, 1 - c * c) * np.maximum(0.0, 1 - local * local)) + 1e-7
    return np.where(c >= -local, c * local - width, -1.5), np.where(c <= local, c * local + width, 1.5)


def _by_coordinates(bucket: Bucket, asked: Asked, at: np.ndarray, local: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Serves the queries for which coordinates leave few vectors, and returns the others."""
    low, high = _regions(asked, at, local)
    focus, n = asked.focus[at], len(bucket.ids)
    smallest, largest = bucket.ends()
    cut = ((low > smallest[focus]) | (high < largest[focus])).any(axis=1)
    whole, at, least, low, high, focus = at[~cut], at[cut], least[cut], low[cut], high[cut], focus[cut]
    if not len(at):
        return whole
    order, by_value = bucket.lists()
    begin = np.searchsorted(by_value, low + 4.0 * focus, side="left")
    counts = np.searchsorted(by_value, high + 4.0 * focus, side="right") - begin
    narrow = np.argmin(counts, axis=1)
    mine = np.arange(len(at))
    few = counts[mine, narrow] <= n // FEW
    owner, step = _expanded(counts[few, narrow[few]])
    who = mine[few][owner]
    row = order[begin[who, narrow[who]] + step]
    keep = (bucket.lengths[row] * asked.sizes[at[who]] >= least[who]) & (bucket.ids[row] != asked.ids[at[who]])
    who, row = who[keep], row[keep]
    for f in range(focus.shape[1]):
        x = bucket.v[row, focus[who, f]] / np.maximum(bucket.lengths[row], 1e-300)
        keep = (x >= low[who, f]) & (x <= high[who, f])
        who, row = who[keep], row[keep]
    for i in range(0, len(who), step := max(1, SCORES // max(1, bucket.v.shape[1]))):
        w, r = who[i : i + step], row[i : i + step]
        asked.offer(at[w], bucket.ids[r], np.einsum("ij,ij->i", bucket.v[r].astype(float), asked.values[at[w]]).astype(np.int64))
    return np.concatenate([whole, at[~few]])


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]


def _reaching(scores: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that reach what their row needs; most rows have none, which their largest score tells."""
    some = np.flatnonzero(scores.max(axis=1) >= need)
    who, row = np.divmod(np.flatnonzero(scores[some] >= need[some][:, None]), scores.shape[1])
    return some[who], row


def _exactly(bucket: Bucket, asked: Asked, at: int, rows: int) -> None:
    """Products too large for floating point."""
    one = [int(x) for x in asked.q[at]]
    chosen = np.flatnonzero(bucket.ids[:rows] != asked.ids[at])
    exact = [sum(int(a) * b for a, b in zip(v, one)) for v in bucket.v[chosen]]
    scores = np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact], np.int64)
    asked.offer(np.full(len(chosen), at), bucket.ids[chosen], scores)


def search_bucket(bucket: Bucket, asked: Asked) -> None:
    """Looks through one bucket for each query that may find what it needs there; ``need`` may be -inf."""
    k, top, n = asked.k, float(bucket.lengths[0]), len(bucket.ids)
    reach = asked.sizes * top
    least = asked.need - 1e-9 * np.maximum(1.0, reach)
    at = np.flatnonzero(reach >= least)
    large = at[reach[at] >= 2**52]
    at = at[reach[at] < 2**52]
    pruned = (asked.need > 0) & (reach > 0)
    local = np.where(pruned, asked.need, 0.0) / np.where(pruned, reach, 1.0)
    if (near := local[at] >= COORDINATE_FROM).any():
        left = _by_coordinates(bucket, asked, at[near], np.minimum(1.0, local[at[near]]), least[at[near]])
        at = np.concatenate([at[~near], left])
    # so many of the longest vectors are long enough
    rows = np.full(len(reach), n)
    rows[pruned] = np.searchsorted(-bucket.lengths, -(least[pruned] / asked.sizes[pruned]), side="right")
    for i in large:
        _exactly(bucket, asked, i, rows[i])
    if not len(at):
        return
    kind = np.float32 if reach[at].max() < 2**24 else np.float64  # integers up to there are exact, and so are sums of them
    values = np.ascontiguousarray(bucket.v.T, kind)
    begin, end = (np.searchsorted(bucket.sorted_ids, asked.ids, side=s) for s in ("left", "right"))
    own, step = _expanded(end - begin)  # vectors that have the query's id
    own_row = bucket.by_id[begin[own] + step]
    at = at[np.argsort(rows[at], kind="stable")]
    place = np.full(len(reach), -1)
    for i in range(0, len(at), step := max(1, SCORES // n)):
        some = at[i : i + step]
        if not (m := rows[some[-1]]):
            continue
        scores = asked.values[some].astype(kind) @ values[:, :m]
        place[some] = np.arange(len(some))
        mine = (place[own] >= 0) & (own_row < m)
        scores[place[own[mine]], own_row[mine]] = -np.inf
        place[some] = -1
        need = np.maximum(asked.need[some], np.finfo(kind).min).astype(kind)
        if len(free := np.flatnonzero(np.isneginf(asked.need[some]))) and m > k:
            need[free] = np.maximum(need[free], _kth(scores[free], k))
        who, row = _reaching(scores, need)
        many = np.flatnonzero(np.bincount(who, minlength=len(some)) > 4 * k)
        if len(many):
            need[many] = np.maximum(need[many], _kth(scores[many], k))
            who, row = _reaching(scores, need)
        asked.offer(some[who], bucket.ids[row], scores[who, row].astype(np.int64))


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        names = [x.split()[0] for x in _FOUND.split(", ")]
        asked, asked_key, lane, buckets = None, None, None, {}

        def found():
            return pa.record_batch([pa.array(c, pa.int64()) for c in asked.results()], names)

        for batch in batches:
            for row in batch.to_pylist():
                if (key := (row["dim"], row["lane"], row["q_block"])) != asked_key:
                    if asked:
                        yield found()
                    asked, asked_key = Asked(*_unpack(row, "q_"), np.frombuffer(row["need"], float), k), key
                if lane != key[:2]:
                    lane, buckets = key[:2], {}
                if row["block"] not in buckets:
                    buckets[row["block"]] = Bucket(*_unpack(row, ""))
                search_bucket(buckets[row["block"]], asked)
        if asked:
            yield found()

    return pairs.mapInArrow(run, _FOUND)


def _met(asked: DataFrame, blocks: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """Each block of queries with each of the ``n`` buckets of ``places`` that is long enough for one of them.

    Buckets that follow each other in length share a lane, and query blocks go to lanes, so that
    the copies of queries grow with lanes.  Both sides are shuffled, whatever the planner thinks of their size: it
    knows them before they are copied, and compressed.
    """
    cores = asked.sparkSession.sparkContext.defaultParallelism
    each = max(1, min(LANE, n // (3 * cores)))
    placed = places.select("block", F.floor((F.col("at") - 1) / each).cast("int").alias("lane"), "dim", "high")
    highs = placed.groupBy("dim", "lane").agg(F.max("high").alias("high")).groupBy("dim").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("lane", "high"))), lambda x: x["high"]).alias("highs")
    )
    least = F.col("shortest") * F.when(F.col("shortest") > 0, 1 - 1e-9).otherwise(1.0)
    lanes = F.filter(F.sequence(F.lit(0), F.size("highs") - 1), lambda i: F.get("highs", i) >= least)
    sent = asked.withColumnRenamed("q_dim", "dim").join(F.broadcast(highs), "dim").withColumn("lane", F.explode(lanes)).drop("highs")
    buckets = blocks.select("block", "ids", "width", "vectors").join(F.broadcast(placed), "block")
    parts = max(cores, 2 * -(-n // each))
    by_lane = ["dim", "lane"]
    pairs = sent.repartition(parts, *by_lane).hint("merge").join(buckets.repartition(parts, *by_lane), by_lane)
    return pairs.where(F.col("high") >= least).drop("high", "shortest")


def top_k(table: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows whose ``vec_id`` is divisible by ``every``.

    Ties go to the smaller ``vec_id``.  Rows without id or usable vector take no part, rows
    that repeat id and vector count once, vectors of different lengths are not compared (so a query may have fewer than
    ``k`` results), scores beyond a long are cut off at its ends.  An empty table gives no row.
    """
    spark = table.sparkSession
    small_batches(spark)
    vectors = stored(integer_vectors(table))
    blocks = stored(packed(vectors, BUCKET))
    queries = stored(vectors.where(F.col("vec_id") % every == 0))
    places = stored(blocks.select("block", "dim", "high").withColumn("at", F.row_number().over(_by_length())))
    n = places.count()

    # the longest vectors of each dimension: a score that k others reach
    seeds = max(SEEDS, n // SEEDS_PART)
    unknown = stored(_asked(queries, None))
    small_batches(spark, rows=8)
    tried = _searched(_met(unknown, blocks, places.where(F.col("at") <= seeds), min(n, seeds)), k)
    reached = tried.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # k values a lane
    reached = stored(reached.select("query_id", F.try_element_at("s", F.lit(k)).cast("double").alias("need")))

    small_batches(spark)
    asked = stored(_asked(queries, reached))
    small_batches(spark, rows=8)
    ranked = _searched(_met(asked, blocks, places, n), k).withColumn("rank", F.row_number().over(_by_score()))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length():
    return Window.partitionBy("dim").orderBy(F.desc("high"), "block")


def _by_score():
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
