"""Trie of conversation prefixes, measured along its Euler tour.

A turn's code depends on its depth, role and text; the codes of the first d
turns sum to the name of a prefix (128 bits), so names follow from running
sums however long a conversation is.  Equal names are one node.  Each node
has an arc that enters it and one that leaves it; the tour through all arcs
is a linked list, ranked distributedly.  What lies between a node's two arcs
is its subtree, so differences of the sums at both give leaves and savings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import stored
from emberlog.llm.list_ranking import CHUNK, sums_before
from emberlog.llm.ordered import attach_by_count, running_sums

FAMILY = 5  # conversations c with equal c - c % FAMILY share the first turns of that one
SHARED = 9  # at most SHARED - 1 turns
_IDS_A_CHUNK = 4096
_NAME = ["depth", "name_a", "name_b"]


def _shared(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("int")


def _base(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def _turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, at, code, bytes)``: turns in order, counted from 0."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    code = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", code.alias("code"), F.octet_length(text).cast("long").alias("bytes"),
        F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("tie"),
    )
    placed = running_sums(stored(rows), ["conv_id"], ["turn", "code", "tie"], ["one"])
    return stored(placed.select("conv_id", (F.col("one_sum") - 1).alias("at"), "code", "bytes"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, depth, code, bytes, total)`` per rebuilt turn, and ``(conv_id, total)`` per conversation.

    Conversation ``c`` is the first h turns of conversation ``c - c % FAMILY``
    (all if fewer), then its own turns after its first h.
    """
    turns = _turns(conversations)
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    plans = own.withColumn("h", _shared(F.col("conv_id"))).withColumn("base", _base(F.col("conv_id")))
    plans = plans.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("held")), "base", "left")
    begun = F.least(F.col("h").cast("long"), F.coalesce("held", F.lit(0).cast("long")))
    plans = plans.withColumn("begun", begun)
    total = F.col("begun") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))
    plans = stored(plans.select("conv_id", "n", "h", "begun", total.alias("total")))

    mine = attach_by_count(turns, plans.withColumn("rows", F.col("n")), ["conv_id"], "rows").where("at >= h")
    mine = mine.select("conv_id", (F.col("begun") + F.col("at") - F.col("h") + 1).alias("depth"), "code", "bytes", "total")
    heads = turns.where(F.col("at") < SHARED - 1).where(_base(F.col("conv_id")) == F.col("conv_id"))
    kin = F.explode(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)))
    sent = heads.withColumnRenamed("conv_id", "base").select("*", kin.alias("o")).withColumn("conv_id", F.try_add("base", F.col("o").cast("long")))
    sent = sent.where(_base(F.col("conv_id")) == F.col("base")).where(F.col("at") < _shared(F.col("conv_id")))
    taken = sent.join(plans.select("conv_id", "total"), "conv_id")
    taken = taken.select("conv_id", (F.col("at") + 1).alias("depth"), "code", "bytes", "total")
    return mine.unionByName(taken), plans.select("conv_id", "total")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Rebuilt turns with the name of the prefix they end, and of the one before (``up_a``, ``up_b``)."""
    half = lambda k: F.conv(F.substring("code", 1 + 15 * k, 15), 16, 10).cast("long")
    coded = turns.select(
        "conv_id", "depth", "bytes", "total",
        F.xxhash64(F.lit(1), "depth", half(0), half(1)).alias("a"), F.xxhash64(F.lit(2), "depth", half(2), half(3)).alias("b"),
    )
    summed = running_sums(stored(coded), ["conv_id"], ["depth"], ["a", "b"])
    # bitwise, since a plain difference may overflow
    less = lambda s, v: F.expr(f"CAST(((CAST({s} AS DECIMAL(20,0)) - {v} + 27670116110564327424BD) % 18446744073709551616BD) - 9223372036854775808BD AS BIGINT)")  # noqa: E731,E501
    return summed.select(
        "conv_id", "depth", "bytes", "total", F.col("a_sum").alias("name_a"), F.col("b_sum").alias("name_b"),
        less("a_sum", "a").alias("up_a"), less("b_sum", "b").alias("up_b"),
    )


def _end_digests(ends: DataFrame) -> DataFrame:
    """``(*_NAME, ends_sha256)`` from ``ends(*_NAME, conv_id)``.

    Sorting and writing the ids is spread over tasks however many end at one
    node; a digest reads the finished chunks of its ids as a stream.
    """
    schema = "depth long, name_a long, name_b long, first long, ids string"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, ids = None, []

        def close():
            if ids:
                rows.append((*key, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for d, a, b, c in zip(*[batch.column(k).to_pylist() for k in (*_NAME, "conv_id")]):
                if (d, a, b) != key or len(ids) == _IDS_A_CHUNK:
                    close()
                    key, ids = (d, a, b), []
                ids.append(c)
            if len(rows) >= 256:
                yield _batch(rows, schema)
                rows = []
        close()
        if rows:
            yield _batch(rows, schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, rows = None, None, []
        for batch in batches:
            for d, a, b, ids in zip(*[batch.column(k).to_pylist() for k in (*_NAME, "ids")]):
                if (d, a, b) != key:
                    if key:
                        rows.append((*key, digest.hexdigest()))
                    key, digest = (d, a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if rows:
                yield _batch(rows, out)
                rows = []
        if key:
            yield _batch([(*key, digest.hexdigest())], out)

    out = "depth long, name_a long, name_b long, ends_sha256 string"
    in_order = ends.repartitionByRange(*_NAME, "conv_id").sortWithinPartitions(*_NAME, "conv_id")
    met = in_order.select(*_NAME, "conv_id").mapInArrow(chunks, schema).repartition(*_NAME).sortWithinPartitions(*_NAME, "first")
    return met.mapInArrow(digests, out)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes with parent and children: ``node`` (its smallest member) and ``depth`` name a node."""
    deep = prefixes.groupBy(*_NAME, "up_a", "up_b").agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in (*_NAME, "up_a", "up_b")], "node", "n_convs", zero.alias("bytes"))
    nodes = stored(deep.unionByName(root))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("name_a"), F.col("up_b").alias("name_b"))
    below = below.agg(F.count("*").alias("n_children"), F.min("node").alias("first_child"))
    nodes = nodes.join(below, _NAME, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = stored(nodes)
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("name_a").alias("up_a"), F.col("name_b").alias("up_b"),
        F.col("node").alias("parent"), F.col("n_children").alias("rows"),
    )
    deep = attach_by_count(nodes.where("depth > 0"), parents, ["depth", "up_a", "up_b"], "rows")
    return stored(deep.unionByName(nodes.where("depth = 0").withColumn("parent", F.lit(None).cast("long"))))


def _arcs(nodes: DataFrame) -> DataFrame:
    """The Euler tour as a linked list: arcs ``(node, depth, leaves_it)`` with successor and weights."""
    siblings = running_sums(
        nodes.where("depth > 0").select("parent", "depth", "node", F.lit(1).cast("long").alias("one")), ["parent", "depth"], ["node"], ["one"]
    )
    siblings = stored(siblings)
    following = siblings.select("parent", "depth", (F.col("one_sum") - 1).alias("one_sum"), F.col("node").alias("sibling"))
    beside = siblings.join(following, ["parent", "depth", "one_sum"]).select("node", "depth", "sibling")
    full = nodes.join(beside, ["node", "depth"], "left")
    inner = F.col("n_children") > 0
    enter = F.struct(
        F.lit(0).cast("long").alias("leaves_it"),
        F.when(inner, F.col("first_child")).otherwise(F.col("node")).alias("next_node"),
        F.when(inner, F.col("depth") + 1).otherwise(F.col("depth")).alias("next_depth"),
        F.when(inner, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("next_leaves_it"),
        F.when(inner, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    goes_on, top = F.col("sibling").isNotNull(), F.col("depth") == 0
    leave = F.struct(
        F.lit(1).cast("long").alias("leaves_it"),
        F.when(top, F.lit(None)).when(goes_on, F.col("sibling")).otherwise(F.col("parent")).alias("next_node"),
        F.when(top, F.lit(None)).when(goes_on, F.col("depth")).otherwise(F.col("depth") - 1).alias("next_depth"),
        F.when(top, F.lit(None)).when(goes_on, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("next_leaves_it"),
        F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
    )
    return full.select("node", "depth", F.inline(F.array(enter, leave)), F.lit(1).cast("long").alias("arcs"))


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enters_at``.

    ``conv_id`` is the smallest member, which with ``depth`` names a node;
    ``enters_at`` is the place of the entering arc in the tour.  Null roles
    and texts are empty; turns are sorted null first, equal ones by SHA-256
    of role and text; repeated rows are turns like others.  Rows without
    ``conv_id`` belong to no conversation and are left out.  Other columns are
    ignored; an empty table gives no row.
    """
    turns, convs = rebuilt(conversations)
    prefixes = stored(_prefixes(turns))
    nodes = _nodes(prefixes, convs)

    zero = F.lit(0).cast("long")
    without = convs.where("total = 0").select(*[zero.alias(c) for c in _NAME], "conv_id")
    ends = prefixes.where("depth = total").select(*_NAME, "conv_id").unionByName(without)
    digests = _end_digests(stored(ends))

    sums = ["arcs", "leaves", "saved"]
    at = sums_before(stored(_arcs(nodes)), ["node", "depth", "leaves_it"], sums, chunk)
    enters, leaves = F.col("leaves_it") == 0, F.col("leaves_it") == 1
    span = lambda w: F.max(F.when(leaves, F.col(f"before_{w}"))) - F.max(F.when(enters, F.col(f"before_{w}")))
    below = at.groupBy("node", "depth").agg(
        span("leaves").alias("n_leaves"), span("saved").alias("saved_tokens"), F.max(F.when(enters, F.col("before_arcs"))).alias("enters_at")
    )
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(below, ["node", "depth"]).join(digests, _NAME, "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "enters_at",
    )
