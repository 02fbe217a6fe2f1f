"""Distributed list ranking: sums of weights along a linked list of any length.

Each round shortens the list.  A task takes a range of the elements by id and
joins every chain of successors that it holds whole to one element; ids should
be chosen so that successors tend to be near.  Where few are, neighbours are
joined by coin flips instead, which removes a quarter of the elements whatever
the ids.  The sums found for the short list are then handed back, round by round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import stored

#: Elements that one task chains in memory.
CHUNK = 1 << 15
_SHRUNK = 0.7
_NONE = -(1 << 63)  # all parts of an id that names nothing


def _chains(ids: np.ndarray, nexts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per element: its chain's head, the weights before it in the chain, and the chain's last element."""
    places = {tuple(x): i for i, x in enumerate(ids.tolist())}
    after = [places.get(tuple(x), -1) for x in nexts.tolist()]
    first = np.ones(len(ids), bool)
    first[[a for a in after if a >= 0]] = False
    head, tail, before = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64), np.empty_like(weights)
    for h in np.flatnonzero(first).tolist():
        chain = [h]
        while after[chain[-1]] >= 0:
            chain.append(after[chain[-1]])
        sums = np.cumsum(weights[chain], axis=0)
        head[chain], tail[chain], before[chain] = h, chain[-1], sums - weights[chain]
    return head, before, tail


def _joined(elements: DataFrame, ids: list[str], weights: list[str]) -> DataFrame:
    """``(id, head, before, last, next, total)``: chains that lie in one partition, joined."""
    nexts = [f"next_{c}" for c in ids]
    schema = ", ".join(
        [f"{c} long" for c in ids] + [f"head_{c} long" for c in ids] + [f"before_{w} long" for w in weights]
        + ["last boolean"] + [f"{c} long" for c in nexts] + [f"total_{w} long" for w in weights]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        held = pa.Table.from_batches(batches).combine_chunks()
        numbers = lambda cs: np.stack([pc.fill_null(held.column(c), _NONE).to_numpy() for c in cs], axis=1)
        own, after, weight = numbers(ids), numbers(nexts), numbers(weights)
        head, before, tail = _chains(own, after, weight)
        last, arrays = tail == np.arange(len(own)), lambda block: [pa.array(np.ascontiguousarray(column)) for column in block.T]
        flat = [*arrays(own), *arrays(own[head]), *arrays(before), pa.array(last), *[held.column(c) for c in nexts], *arrays(before + weight)]
        yield from pa.Table.from_arrays(flat, [f.split()[0] for f in schema.split(", ")]).to_batches(8192)

    return elements.select(*ids, *nexts, *weights).mapInArrow(run, schema)


def _by_coins(elements: DataFrame, ids: list[str], weights: list[str], seed: int) -> DataFrame:
    """The same table: an element with heads takes up its successor with tails."""
    nexts = [f"next_{c}" for c in ids]
    coin = lambda cs: F.pmod(F.xxhash64(F.lit(seed), *cs), F.lit(2)) == 1
    takes = coin(ids) & ~coin(nexts) & F.col(f"next_{ids[0]}").isNotNull()
    row = F.struct(takes.alias("takes"), *ids, *nexts, *weights)
    keys = [F.when(takes, F.col(n)).otherwise(F.col(c)).alias(f"_{c}") for c, n in zip(ids, nexts)]
    met = elements.select(*keys, row.alias("row")).groupBy(*[f"_{c}" for c in ids]).agg(F.collect_list("row").alias("rows"))  # two rows at most
    first = lambda keep: F.get(F.filter("rows", keep), F.lit(0))
    met = met.select(first(lambda r: r["takes"]).alias("t"), first(lambda r: ~r["takes"]).alias("o"))
    both = F.col("t").isNotNull()

    def out(x, head, before, last, after, total):
        return F.struct(
            *[x[c].alias(c) for c in ids], *[head[c].alias(f"head_{c}") for c in ids], *[b.alias(f"before_{w}") for w, b in zip(weights, before)],
            F.lit(last).alias("last"), *[after[c].alias(c) for c in nexts], *[t.alias(f"total_{w}") for w, t in zip(weights, total)],
        )

    t, o, zero = F.col("t"), F.col("o"), [F.lit(0).cast("long")] * len(weights)
    alone = out(o, o, zero, True, o, [o[w] for w in weights])
    taken = F.array(
        out(t, t, zero, False, t, [t[w] for w in weights]),
        out(o, t, [t[w] for w in weights], True, o, [t[w] + o[w] for w in weights]),
    )
    return met.select(F.inline(F.when(both, taken).otherwise(F.array(alone))))


def sums_before(elements: DataFrame, ids: list[str], weights: list[str], chunk: int = CHUNK) -> DataFrame:
    """``(*ids, before_<weight> ...)``: the weights of all elements before each element of one list.

    ``elements`` has the columns ``ids`` (whole numbers that name an element),
    ``next_<id>`` (null at the end of the list) and ``weights``.  At most
    ``chunk`` elements, the last round's, meet in one task.
    """
    nexts = [f"next_{c}" for c in ids]
    rounds, now, count, seed = [], elements, elements.count(), 0
    near = True
    while True:
        if count <= chunk:
            level = _joined(now.coalesce(1), ids, weights)
        elif near:
            level = _joined(now.repartitionByRange(-(-count // chunk), *ids), ids, weights)
        else:
            level, seed = _by_coins(now, ids, weights, seed), seed + 1
        level = stored(level)
        rounds.append(level)
        if count <= chunk:
            break
        left = level.where("last").select(
            *[F.col(f"head_{c}").alias(c) for c in ids], *nexts, *[F.col(f"total_{w}").alias(w) for w in weights]
        )
        before, count, now = count, left.count(), left
        near = near and count <= _SHRUNK * before
    found = rounds[-1].select(*ids, *[f"before_{w}" for w in weights])
    for level in reversed(rounds[:-1]):
        of_head = found.select(*[F.col(c).alias(f"head_{c}") for c in ids], *[F.col(f"before_{w}").alias(f"_{w}") for w in weights])
        found = level.join(of_head, [f"head_{c}" for c in ids]).select(
            *ids, *[(F.col(f"before_{w}") + F.col(f"_{w}")).alias(f"before_{w}") for w in weights]
        )
        found = stored(found)
    return found
