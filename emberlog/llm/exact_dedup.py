"""Exact duplicates by deterministic block naming, in DataFrame functions only.

Texts are cut into blocks of ``BLOCK`` characters.  The distinct blocks are sorted
and numbered; then the distinct pairs of neighbouring numbers are sorted and
numbered, and so on, until each text has a single number.  Texts with as many
rounds and the same last number are equal, and no others: numbers stand for
contents, not for hashes of them.  Blocks are sorted by (hash, content), so
contents travel once, when distinct ones are sought; only where two contents
share a hash are they told apart by content again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog.llm.common import stored
from emberlog.llm.ordered import attach_by_count

BLOCK = 1024
_ABSENT = -1  # the partner of the last of an odd number of names


def blocks_of(text: Column, size: int) -> Column:
    """Blocks of ``size`` characters, the last one shorter; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _hash(block: Column) -> Column:
    return F.xxhash64(block)


def _ordinals(docs: DataFrame, size: int) -> DataFrame:
    """``(h, block, k)``: contents that share their hash with another one, numbered in sorted order."""
    cut = docs.select(F.explode_outer(blocks_of(F.col("text"), size)).alias("block"))
    hashed = cut.select(_hash(F.coalesce("block", F.lit(""))).alias("h"), F.coalesce("block", F.lit("")).alias("block"))
    distinct = hashed.distinct()
    shared = stored(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    if shared.isEmpty():
        return distinct.limit(0).withColumn("k", F.lit(0))
    found = hashed.join(shared, "h", "left_semi").distinct()
    return stored(found.withColumn("k", F.row_number().over(W.partitionBy("h").orderBy("block"))))


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored ``rows`` with ``name``, the number of their ``keys`` in sorted order."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    names = stored(found.sort(*keys).withColumn("name", F.monotonically_increasing_id()))
    return attach_by_count(rows, names, keys, "n").drop(*keys)


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(row, doc_id, text_sha256, rounds, name)``: equal ``rounds`` and ``name`` mean equal texts.

    ``row`` numbers the rows, since ids may be null or repeated.
    """
    told_apart = _ordinals(docs, size)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(text, 256).alias("text_sha256"),
        blocks_of(F.col("text"), size).alias("blocks"),
    )
    cut = rows.select(
        "row", "doc_id", "text_sha256", F.greatest(F.size("blocks"), F.lit(1)).alias("left"), F.posexplode_outer("blocks").alias("at", "block")
    ).withColumn("block", F.coalesce("block", F.lit("")))
    cells = cut.withColumn("h", _hash(F.col("block")))
    if told_apart.isEmpty():
        cells = cells.withColumn("k", F.lit(0))
    else:
        cells = cells.join(told_apart, ["h", "block"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    cells = stored(cells.select("row", "doc_id", "text_sha256", "left", F.coalesce("at", F.lit(0)).alias("at"), "h", "k"))

    heads = cells.where("at = 0").select("row", "doc_id", "text_sha256")
    longest = cells.agg(F.max("left")).first()[0] or 1
    now = _named(cells.select("row", "left", "at", "h", "k"), ["h", "k"])
    done, rounds = None, 0
    while True:
        now = stored(now)
        ended = now.where("left = 1").select("row", F.lit(rounds).alias("rounds"), "name")
        done = ended if done is None else done.unionByName(ended)
        if longest <= 1:
            break
        even, half = F.col("at") % 2 == 0, F.shiftright("at", 1).alias("at")
        pairs = now.where("left > 1").groupBy("row", half, F.shiftright(F.col("left") + 1, 1).alias("left")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(_ABSENT)).alias("b"),
        )
        now = _named(stored(pairs), ["a", "b"])
        longest, rounds = (longest + 1) // 2, rounds + 1
    return done.join(heads, "row")


def exact_duplicates(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays; a null id is
    smaller than any other, and of several rows with that id one stays.  A null
    text equals an empty one.  Texts may be of any length and a group may
    hold any number of rows.  Other columns are ignored; an empty table gives
    no row.
    """
    named = stored(identities(docs, size))
    groups = stored(
        named.groupBy("rounds", "name").agg(
            F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("stays")
        ).withColumn("n", F.col("group_size"))
    )
    found = attach_by_count(named, groups, ["rounds", "name"], "n")
    return found.select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256"
    )
