"""Near-duplicate groups by min-max hashing.

Each permutation gives two signature values, the smallest and the largest hash of
a shingle set, so half the hash evaluations serve the same bands.  Texts
with equal shingle sets are one node from the start.  In each band bucket all
nodes are compared with one hub; only buckets whose nodes then still fall into
several components are looked at again, with another hub and at last block by
block.  Every link is confirmed on the full shingle sets.

Small sets, whose minimum and maximum depend on each other, take an exact way to their
buckets: two sets that are similar enough share one of their rarest shingles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm import hashing as H
from emberlog.llm.common import attach, keyed, small_batches, stored
from emberlog.llm.repeats import settled

SHINGLE = 5
#: Linked at this share of common shingles, in hundredths.
SIMILARITY = 80
#: Three permutations, so six values, a band: at similarity 0.8 a pair shares some band but once in 200,000 times.
BANDS = 40
PER_BAND = 3
HUB_ROUNDS = 1
#: Pairs of sets up to this size meet by their rarest shingles and are never missed.
SMALL = 40
#: Nodes of a bucket that are compared with each other at a time.
BLOCK = 256

_U = np.uint64
_CHUNK = 1 << 15


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = H.mix(np.arange(1, 2 * BANDS * PER_BAND + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return seeds[::2], seeds[1::2] | _U(1)


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes of all texts in a row, and where each text's begin (one more at the end)."""
    data, text_starts = H.joined(texts)
    data = H.small_letters(data)
    begin, end = H.words(data)
    codes, _ = H.word_codes(data, begin, end)
    text = np.searchsorted(text_starts, begin, side="right") - 1
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    count = np.diff(first)
    n = len(codes)
    if n >= width:
        shingle = np.zeros(n - width + 1, _U)
        for k in range(width):
            shingle = H.mix(shingle * _U(0xC2B2AE3D27D4EB4F) + codes[k : n - width + 1 + k] + _U(k))
        inside = text[: n - width + 1] == text[width - 1 :]
        owner, shingle = text[: n - width + 1][inside], shingle[inside]
    else:
        owner, shingle = np.array([], np.int64), np.array([], _U)
    short = np.flatnonzero((count > 0) & (count < width))  # the whole sequence as one
    whole = np.zeros(len(short), _U)
    for k in range(width - 1):
        more = count[short] > k
        whole[more] = H.mix(whole[more] * _U(0xC2B2AE3D27D4EB4F) + codes[first[short][more] + k] + _U(100 + k))
    owner, shingle = np.concatenate([owner, short]), np.concatenate([shingle, whole])
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    owner, shingle = owner[new], shingle[new]
    return shingle, np.searchsorted(owner, np.arange(len(texts) + 1))


def band_keys(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``BANDS`` keys per text from the min-max signatures; texts without shingles must be left out."""
    xor, times = _permutations()
    out = np.zeros((len(starts) - 1, BANDS), _U)
    low = 0
    while low < len(starts) - 1:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + _CHUNK, side="right")) - 1)
        part, at = codes[starts[low] : starts[high]], starts[low:high] - starts[low]
        for k in range(BANDS * PER_BAND):
            h = (part ^ xor[k]) * times[k]
            band = k // PER_BAND
            key = out[low:high, band]
            key = H.mix(key + np.minimum.reduceat(h, at) * _U(0xA24BAED4963EE407) + _U(band))
            out[low:high, band] = H.mix(key + np.maximum.reduceat(h, at))
        low = high
    return out


def _runs(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Offsets of a list column whose ``rows`` hold ``sizes`` values and the others none."""
    return np.cumsum(np.concatenate([[0], np.where(rows, sizes, 0)]))


def signatures(docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """``(doc_id, th, n, set_a, set_b, bands, few)``: set size, a 128-bit name of the set, band keys, a small set itself.

    Sets whose partners are all ``SMALL`` at most have no bands.  ``few`` is empty for larger sets and for those so
    small that no other set is similar enough.
    """
    small_batches(docs.sparkSession, megabytes=4)  # the arrays over a batch take some 30 times its bytes

    def run(batches):
        for batch in batches:
            codes, starts = shingle_sets(batch.column("text").to_pylist(), width)
            n = np.diff(starts)
            banded = 100 * n >= similarity * (SMALL + 1)
            few = (n <= SMALL) & (100 * n >= similarity * (n + 1))
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(H.mix(codes), dtype=_U)])
            other = np.concatenate([np.zeros(1, _U), np.cumsum(H.mix(codes * _U(0x9FB21C651E98DF25)), dtype=_U)])
            long_codes = codes[np.repeat(banded, n)]
            bands = band_keys(long_codes, _runs(banded, n)[np.append(banded, True)]) if banded.any() else np.zeros((0, BANDS), _U)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array(n, pa.int64()),
                    as_sum(sums, starts),
                    as_sum(other, starts),
                    pa.ListArray.from_arrays(pa.array(_runs(banded, BANDS), pa.int32()), H.as_long(bands.ravel())),
                    pa.ListArray.from_arrays(pa.array(_runs(few, n), pa.int32()), H.as_long(codes[np.repeat(few, n)])),
                ],
                ["doc_id", "th", "n", "set_a", "set_b", "bands", "few"],
            )

    return keyed(docs).select("doc_id", "th", "text").mapInArrow(
        run, "doc_id long, th long, n long, set_a long, set_b long, bands array<long>, few array<long>"
    )


def as_sum(sums: np.ndarray, starts: np.ndarray) -> pa.Array:
    return H.as_long(H.mix(sums[starts[1:]] - sums[starts[:-1]] + _U(1)))


def small_keys(nodes: DataFrame, similarity: int) -> DataFrame:
    """``(node, key)``: bucket keys of ``nodes(node, few)``, so that all similar pairs of them share a bucket.

    Of two sets that share enough, the first ``n - ceil(similarity * n / 100) + 1`` shingles in any one order
    overlap.  The order is by rarity among all nodes, so buckets stay small; shingles of one node need none.
    """
    held = nodes.select("node", F.explode("few").alias("code"))
    common = stored(held.groupBy("code").agg(F.count("*").alias("times")).where("times > 1"))
    ranked = held.join(common, "code", "left").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "code"))).alias("order")
    )
    first = F.expr(f"slice(order, 1, size(order) - (size(order) * {similarity} + 99) div 100 + 1)")
    keys = ranked.select("node", F.explode(first).alias("rare")).where("rare.times > 1")
    return keys.select("node", F.xxhash64("rare.code", F.lit("few")).alias("key"))


def _sets(docs: DataFrame, samples: DataFrame, width: int) -> DataFrame:
    """``(node, codes)``: the full shingle sets of ``samples(node, doc_id, th)``."""

    def run(batches):
        for batch in batches:
            codes, starts = shingle_sets(batch.column("text").to_pylist(), width)
            codes = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), H.as_long(codes))
            yield pa.record_batch([batch.column("node"), codes], ["node", "codes"])

    texts = attach(keyed(docs), samples.hint("shuffle_hash"), "inner").select("node", "text")
    # repeated rows would give a node's set several times
    return texts.mapInArrow(run, "node long, codes array<long>").groupBy("node").agg(F.any_value("codes").alias("codes"))


def _linked(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The ``pairs(a, b)`` that are similar enough, by exact comparison of their sets."""
    left = sets.select(F.col("node").alias("a"), F.col("codes").alias("codes_a"))
    right = sets.select(F.col("node").alias("b"), F.col("codes").alias("codes_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("codes_a", "codes_b"))
    of_all = F.size("codes_a") + F.size("codes_b") - F.col("common")
    return both.withColumn("common", common).where(100 * F.col("common") >= similarity * of_all).select("a", "b")


def _linked_in_blocks(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links ``(a, b)`` that join different components of ``members(key, node, comp)``.

    A bucket is split into blocks of about ``BLOCK`` nodes; each task compares two blocks of one bucket and
    returns a link only if it joins what its earlier links have not, so the result stays linear.  Nodes of a
    bucket's largest component need no comparison with each other: they have blocks of their own, which meet
    only the blocks of the other nodes.
    """
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key")
    sizes = counts.agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.max("n").alias("n"), F.sum("n").alias("all"))
    blocks = [F.ceil(F.col("n") / BLOCK).alias("inner"), F.ceil((F.col("all") - F.col("n")) / BLOCK).alias("outer")]
    placed = members.join(stored(sizes.select("key", "largest", *blocks)), "key")
    inside, spread = F.col("comp") == F.col("largest"), F.xxhash64("node")
    own = F.when(inside, F.col("outer") + F.pmod(spread, F.col("inner"))).otherwise(F.pmod(spread, F.col("outer")))
    last = F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    placed = placed.select(
        "key", "node", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    ).join(sets, "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, comps, own = rows["node"].tolist(), rows["comp"].tolist(), rows["own"].tolist()
        held = [frozenset(c) for c in rows["codes"]]
        across = rows["i"].iat[0] != rows["j"].iat[0]
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        found = []
        order = sorted(range(len(nodes)), key=lambda k: len(held[k]))
        for n, p in enumerate(order):
            for q in order[n + 1 :]:
                if 100 * len(held[p]) < similarity * len(held[q]):
                    break
                if across and own[p] == own[q] or find(comps[p]) == find(comps[q]):
                    continue
                common = len(held[p] & held[q])
                if 100 * common >= similarity * (len(held[p]) + len(held[q]) - common):
                    root[find(comps[p])] = find(comps[q])
                    found.append((nodes[p], nodes[q]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return placed.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` of all nodes on ``edges(a, b)``.

    Each round every node moves to its smallest smaller neighbour, and on to where that one moved;
    edges are kept between the places reached, until none is left.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    labels = now.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node"))
    while not now.isEmpty():
        moves = stored(now.groupBy("a").agg(F.min("b").alias("to")))
        for _ in range(2):
            on = moves.select(F.col("a").alias("to"), F.col("to").alias("further"))
            moves = stored(moves.join(on, "to", "left").select("a", F.coalesce("further", "to").alias("to")))
        labels = stored(_moved(labels, moves, "comp"))
        now = stored(_moved(_moved(now, moves, "a"), moves, "b").where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return labels


def _moved(rows: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    to = moves.select(F.col("a").alias(column), F.col("to").alias("_to"))
    rest = [F.coalesce("_to", column).alias(column) if c == column else F.col(c) for c in rows.columns]
    return rows.join(to, column, "left").select(*rest)


def _placed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the component ``comp`` of ``node``, by default itself."""
    if labels is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components after some more links; only the components they touch are looked at."""
    for side in ("a", "b"):
        rest = [c for c in links.columns if c != side]
        links = _placed(links.withColumnRenamed(side, "node"), labels).select(F.col("comp").alias(side), *rest)
    links = stored(links.where("a <> b").distinct())
    if links.isEmpty():
        return labels
    moved = components(links)
    if labels is None:
        return stored(moved)
    to = moved.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    old = labels.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return stored(old.unionByName(moved.join(labels, "node", "left_anti")))


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, similarity: int = SIMILARITY, with_key: bool = False
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs(doc_id, text, ...)``.

    Null and empty texts, and texts without words, have no shingles, are linked with nothing and
    kept.  A null ``doc_id`` is larger than all others and stands for itself (a component of
    null ids has the id null and keeps all of them).  Repeated rows fall into one component;
    those that carry its id are all kept.  Other columns are ignored; an empty table gives no row.

    ``with_key`` adds ``th``, the hash of the text, and ``chosen``: whether ``(doc_id, th)`` is the one of its
    component that stands for all, which is the smallest id, of equal ids the smallest hash.
    """
    signed = settled(signatures(docs, width, similarity))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("order"), "th")
    nodes = stored(
        signed.where("n > 0")
        .groupBy("set_a", "set_b")
        .agg(
            F.min(place).alias("smallest"),
            F.min(F.struct("doc_id", "th")).alias("sample"),
            F.any_value("bands").alias("bands"),
            F.any_value("few").alias("few"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    spread = nodes.select("node", F.explode("bands").alias("key")).unionByName(stored(small_keys(nodes, similarity)))
    crowded = stored(spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    members = settled(spread.join(crowded, "key"))
    involved = members.select("node").distinct()
    sets = settled(_sets(docs, nodes.select("node", "sample.*").join(involved, "node"), width))

    labels, left = None, members
    for turn in range(max(0, HUB_ROUNDS) + 2):
        placed = stored(_placed(left, labels))
        first = F.xxhash64("node", F.lit(turn))  # one order for all buckets, so that they tend to have the same hubs
        mixed = placed.groupBy("key").agg(
            F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.min_by(F.struct("node", "comp"), first).alias("hub")
        )
        mixed = stored(mixed.where("_low < _high").select("key", "hub"))
        if mixed.isEmpty():
            break
        open_rows = placed.join(mixed, "key")
        if turn == 0 and HUB_ROUNDS >= 0:  # each node with one hub: most groups are whole after this
            chosen = open_rows.where("node <> hub.node").groupBy("node")
            pairs = chosen.agg(F.min_by("hub.node", F.xxhash64("hub.node", F.lit(turn))).alias("b")).withColumnRenamed("node", "a")
        elif turn <= HUB_ROUNDS:  # each bucket with one hub, which then leaves it
            pairs = open_rows.where("comp <> hub.comp").select(
                F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")
            )
            left = open_rows.where("node <> hub.node").select("key", "node")
        else:  # what is left is compared inside its bucket, in blocks, and only links come out
            labels = _joined(labels, settled(_linked_in_blocks(open_rows.select("key", "node", "comp"), sets, similarity)))
            break
        labels = _joined(labels, settled(_linked(pairs.distinct(), sets, similarity)))

    if labels is None:
        grouped = nodes.select("set_a", "set_b", F.col("smallest").alias("first"))
    else:
        placed = nodes.select("node", "set_a", "set_b", "smallest").join(labels, "node", "left")
        placed = stored(placed.withColumn("comp", F.coalesce("comp", "node")))
        lowest = stored(placed.groupBy("comp").agg(F.min("smallest").alias("first")))
        grouped = placed.join(lowest, "comp").select("set_a", "set_b", "first")
    rows = signed.select("doc_id", "th", "n", "set_a", "set_b")
    known = stored(grouped).withColumnsRenamed({"set_a": "_a", "set_b": "_b"})
    full = rows.join(known, (F.col("n") > 0) & (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")), "left")
    component = F.when(F.col("first").isNull(), F.col("doc_id")).when(~F.col("first.no_id"), F.col("first.order"))
    chosen = F.col("first").isNull() | (F.col("first") == place)
    more = ["th", chosen.alias("chosen")] if with_key else []
    return full.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *more).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
