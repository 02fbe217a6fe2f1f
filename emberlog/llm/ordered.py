"""Running sums along sorted groups of any size, and joins with per-key facts, for groups of any heat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import stored

#: A key with at least this share of the rows is broadcast: at most so many keys, whatever the data.
HOT_SHARE = 1000


def attach_by_count(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, one row a key, whose ``count`` is the rows per key.

    A key with one ``HOT_SHARE``-th of all rows or more takes its facts from a
    broadcast table, which holds ``HOT_SHARE`` keys at most since counts add up
    to the rows; more on clusters with more shuffle partitions.  The other keys
    meet in a plain join.  Keys must not be null; rows without facts keep
    nulls.  Both inputs are read twice and should be stored tables.
    """
    share = max(HOT_SHARE, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = facts.where(F.col(count) * share >= max(total, 1)).drop(count)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.drop(count), keys, "left")
    return near.unionByName(far)


def _sums_schema(df: DataFrame, values: list[str]) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return ", ".join([*fields, *[f"`{v}_sum` long" for v in values], "_part int, _run long, _at long"])


def running_sums(df: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Adds ``<value>_sum``, the sum of ``value`` up to and with the row, in the group ``key`` sorted by ``order``.

    Sums are taken modulo 2**64.  Keys must not be null; ``order`` sorts nulls
    first and should be unique.  A range shuffle sorts by both, so a group of
    any size is spread over tasks; each task sums its part of a group in one
    pass, and what a group's earlier parts hold (one row per partition) is
    added afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, ordinal, inside, carry = TaskContext.get().partitionId(), None, -1, 0, [np.uint64(0)] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in key:
                column = batch.column(k)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = [batch.column(k)[0] for k in key]
            new[0] = last is None or first != last
            starts = np.flatnonzero(new)
            runs = ordinal + np.cumsum(new)
            at = np.arange(n)
            # the row before the run of each row; -1 is the row before the batch, a run from earlier batches began before that
            origin = np.full(n, -1 - inside) if not len(starts) else np.where(
                runs > ordinal, starts[np.maximum(runs - ordinal - 1, 0)] - 1, -1 - inside
            )
            sums = []
            for i, v in enumerate(values):
                total = np.cumsum(batch.column(v).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), dtype=np.uint64)
                before = np.where(origin >= 0, total[np.maximum(origin, 0)], np.uint64(0))
                found = total - before
                found[runs == ordinal] += carry[i]
                carry[i] = found[-1]
                sums.append(pa.array(found.view(np.int64)))
            local = at - origin - 1
            last, ordinal, inside = [batch.column(k)[n - 1] for k in key], int(runs[-1]), int(local[-1]) + 1
            extra = [pa.array(np.full(n, part, np.int32)), pa.array(runs.astype(np.int64)), pa.array(local.astype(np.int64))]
            yield pa.record_batch([*batch.columns, *sums, *extra], [*batch.schema.names, *[f"{v}_sum" for v in values], "_part", "_run", "_at"])

    sorted_rows = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    parts = stored(sorted_rows.mapInArrow(run, _sums_schema(df, values)))

    sums = F.struct(*[F.col(f"{v}_sum") for v in values])
    ends = parts.groupBy("_part").agg(
        F.min_by(F.struct(*key), "_run").alias("first"),
        F.max_by(F.struct(*key), "_run").alias("last"),
        F.max("_run").alias("runs"),
        F.max_by(sums, F.struct("_run", "_at")).alias("tail"),
    )
    added, open_key, open_sums = {}, None, [0] * len(values)
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row per partition
        if open_key is not None and r["first"] == open_key:
            added[r["_part"]] = open_sums
        held = added.get(r["_part"], [0] * len(values)) if r["runs"] == 0 else [0] * len(values)
        open_key, open_sums = r["last"], [a + b for a, b in zip(held, r["tail"])]
    names = [f"{v}_sum" for v in values]
    wanted = parts.select(*df.columns, *names, "_part", "_run")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("_part").to_numpy()
            late = (batch.column("_run").to_numpy() == 0) & np.isin(part, list(added))
            out = batch.columns[:-2]
            if late.any():
                for i, name in enumerate(names):
                    found = batch.column(name).to_numpy().copy().view(np.uint64)
                    found[late] += np.array([added[p][i] % (1 << 64) for p in part[late]], np.uint64)
                    out[len(df_names) + i] = pa.array(found.view(np.int64))
            yield pa.record_batch(out, [*df_names, *names])

    df_names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name not in ("_part", "_run"))
    return wanted.mapInArrow(add, schema) if added else wanted.drop("_part", "_run")
