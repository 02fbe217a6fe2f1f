"""Merkle manifest of a dataset by butterfly exchange.

Leaves of a group stand in order and are cut into partitions of ``FANOUT ** LOCAL``
leaves.  A partition hashes its own subtree.  Then aligned groups of ``FANOUT``
subtrees swap their roots round by round: in each round every partition meets
one partner from each sibling subtree, learns that sibling's root, and hashes
the parent itself.  All partitions below a node compute it, so after the last
round each of them holds its own path to the root and nothing is sent down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import stored
from emberlog.llm.ordered import attach_by_count, running_sums

FANOUT = 3
LOCAL = 5  # levels inside a partition of 243 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(parts: Column) -> Column:
    """Hash of an array of hex digests, concatenated."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf(fields: dict[str, Column]) -> Column:
    """Hash of the fields in order: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""

    def encoded(value):
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[encoded(fields[f]) for f in FIELDS]), 256)


def _raised(level: Column) -> Column:
    """The level above: every ``FANOUT`` consecutive hashes become one."""
    runs = F.ceil(F.size(level) / FANOUT).cast("int")
    return F.transform(F.sequence(F.lit(0), runs - 1), lambda i: _digest(F.slice(level, i * FANOUT + 1, F.lit(FANOUT))))


def _around(level: Column, at: Column) -> Column:
    """Hashes left and right of place ``at`` in its run."""
    first = at - at % FANOUT
    run = F.slice(level, first + 1, F.lit(FANOUT))
    here = at - first
    right = F.slice(run, here + 2, F.lit(FANOUT))
    return F.struct(F.array_join(F.slice(run, 1, here), "").alias("left"), F.array_join(right, "").alias("right"))


def _exchange(state: DataFrame, round_: int) -> DataFrame:
    """One round: partitions of sibling subtrees swap roots and hash the parent.

    A subtree spans ``width`` partitions, the last one of a group perhaps
    fewer; its partitions then serve all partners of the full siblings in turn.
    """
    width = FANOUT**round_
    open_ = F.col("parts") > width
    tree = F.floor(F.col("part") / width)
    child, low = tree % FANOUT, F.col("part") % width
    span = F.least(F.lit(width), F.col("parts") - tree * width)
    reach = F.when(child == 0, span).otherwise(F.lit(width))
    partners = F.when(open_, F.sequence(low, reach - 1, span)).otherwise(F.array(F.col("part")))
    sent = state.select(
        "*", open_.alias("_open"), child.alias("_child"), F.when(open_, low).otherwise(F.col("part")).alias("_low"),
        F.when(open_, F.floor(F.col("part") / (width * FANOUT))).otherwise(F.lit(-1)).alias("_above"), partners.alias("_to"),
    ).withColumn("_to", F.explode("_to"))
    home = F.col("_to") == F.col("_low")
    member = F.struct(
        F.col("_child").alias("child"), "hash", home.alias("home"), "part", F.when(home, F.col("path")).alias("path")
    )
    # one member a sibling, FANOUT at most
    met = sent.groupBy("group", "parts", "_open", "_above", "_to").agg(F.collect_list(member).alias("met"))
    met = met.withColumn("met", F.array_sort("met", lambda a, b: (a["child"] - b["child"]).cast("int")))
    hashes = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda x: x["hash"]), "")
    own = met.select("*", F.explode(F.filter("met", lambda x: x["home"])).alias("own"))
    step = F.struct(
        hashes(lambda x: x["child"] < F.col("own.child")).alias("left"), hashes(lambda x: x["child"] > F.col("own.child")).alias("right")
    )
    return own.select(
        "group", "parts", F.col("own.part").alias("part"),
        F.when(F.col("_open"), F.sha2(hashes(lambda x: F.lit(True)), 256)).otherwise(F.col("own.hash")).alias("hash"),
        F.when(F.col("_open"), F.concat("own.path", F.array(step))).otherwise(F.col("own.path")).alias("path"),
    )


def climb(nodes: DataFrame) -> DataFrame:
    """``nodes(group, at, hash, kept)`` with ``top``, the root of the group, and ``path`` up to it.

    ``at`` counts from 0 in each group, ``kept`` is a struct carried along.
    ``path`` lists the steps from the node to the root: the concatenated
    hashes to the left and to the right of it in its run.
    """
    size = FANOUT**LOCAL
    cut = nodes.withColumn("part", F.floor(F.col("at") / size))
    parts = cut.groupBy("group", "part").agg(F.array_sort(F.collect_list(F.struct("at", "hash", "kept")), lambda a, b: (a["at"] - b["at"]).cast("int")).alias("nodes"))
    parts = stored(parts)
    counts = stored(parts.groupBy("group").agg(F.count("*").alias("parts")).withColumn("n", F.col("parts")))
    levels = attach_by_count(parts, counts, ["group"], "n").withColumn("l0", F.transform("nodes", lambda x: x["hash"]))
    for k in range(LOCAL):
        more = (F.col("parts") > 1) | (F.size(f"l{k}") > 1)
        levels = levels.withColumn(f"l{k + 1}", F.when(more, _raised(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    own = F.array(*[f"l{k}" for k in range(LOCAL)])
    used = F.filter(own, lambda level: (F.col("parts") > 1) | (F.size(level) > 1))
    local = stored(levels.select("group", "part", "parts", "nodes", used.alias("levels"), F.col(f"l{LOCAL}")[0].alias("hash")))

    state = local.select("group", "parts", "part", "hash", F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"))
    most, round_ = counts.agg(F.max("parts")).first()[0] or 1, 0
    while FANOUT**round_ < most:
        state = _exchange(state, round_)
        round_ += 1
    state = stored(state)

    def steps(i):
        place = lambda j: F.floor(i / F.pow(F.lit(float(FANOUT)), j)).cast("int")
        return F.transform("levels", lambda level, j: _around(level, place(j)))

    tops = state.select("group", "part", F.col("hash").alias("top"), F.col("path").alias("upper"))
    full = local.select("group", "part", "nodes", "levels").join(tops, ["group", "part"])
    each = F.transform("nodes", lambda x, i: F.struct(x["at"].alias("at"), x["hash"].alias("hash"), x["kept"].alias("kept"), steps(i).alias("steps")))
    out = full.select("group", "top", "upper", F.explode(each).alias("x"))
    return out.select("group", "x.at", "x.hash", "x.kept", "top", F.concat("x.steps", "upper").alias("path"))


def manifest(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per document: ``doc_id, source, at, leaf, subroot, root, path`` and the columns ``keep``.

    Leaves of a source ascend by ``doc_id``: null first, equal ids by leaf.
    Sources ascend bytewise, null first.  ``path`` is the proof: steps
    ``{left, right}`` of concatenated sibling hashes from the leaf via its
    subroot to the root, which ``fold`` recomputes.  Any field may be null; an
    empty table gives no row; other columns are ignored.
    """
    group = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))  # null before all texts
    rows = docs.select(
        group.alias("group"), "doc_id", leaf({f: F.col(f) for f in FIELDS}).alias("hash"),
        F.struct("doc_id", "source", *keep).alias("kept"), F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("tie"),
    )
    placed = running_sums(stored(rows), ["group"], ["doc_id", "hash", "tie"], ["one"])
    nodes = placed.select("group", (F.col("one_sum") - 1).alias("at"), "hash", "kept")
    leaves = stored(climb(nodes))

    tops = leaves.groupBy("group").agg(F.first("top").alias("hash"), F.count("*").alias("n"))
    tops = stored(tops.select(F.lit("").alias("all"), "group", "hash", "n", F.lit(1).cast("long").alias("one")))
    ordered = running_sums(tops, ["all"], ["group"], ["one"])
    above = climb(
        ordered.select(F.col("all").alias("group"), (F.col("one_sum") - 1).alias("at"), "hash", F.struct("group", "n").alias("kept"))
    )
    facts = stored(above.select("kept.group", "kept.n", F.col("top").alias("root"), F.col("path").alias("above")))
    full = attach_by_count(leaves, facts, ["group"], "n")
    return full.select(
        "kept.doc_id", "kept.source", "at", F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "root",
        F.concat("path", "above").alias("path"), *[F.col(f"kept.`{c}`") for c in keep],
    )


def fold(found: Column, path: Column) -> Column:
    """The root that a leaf hash gives along a path."""
    return F.aggregate(path, found, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all sibling hashes of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tampered(docs: DataFrame) -> Column:
    """Leaf of a row whose text lost its line breaks, if 2 divides the CRC of its id; else its own leaf."""
    changed = {f: F.col(f) for f in FIELDS} | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, leaf(changed)).otherwise(leaf({f: F.col(f) for f in FIELDS}))


def check(docs: DataFrame) -> DataFrame:
    """Digests of ``manifest``, and whether a tampered copy of each row still folds to the root."""
    found = manifest(docs.select(*FIELDS, tampered(docs).alias("given")), ["given"])
    folded = fold(F.col("given"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
