"""Repeated activity and co-occurrence patterns per time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberlog import constants as K
from emberlog.functions.timing import window_start
from emberlog.operators.ordering import with_row_index
from emberlog.params import DEFAULTS, Params
from emberlog.session import cut_lineage

JOINER = " + "
CHUNK_WORDS = 64  # a bitmap row covers 4096 windows


def source_activity(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Activity of every source with authentication failures; with ``limit``, of those with the most."""
    failing = events.where((F.col("event_class") == "AUTH_FAIL") & F.col("src_host").isNotNull())
    table = failing.groupBy("src_host").agg(
        F.count("*").alias("failures"),
        F.countDistinct("target_user").alias("target_accounts"),
        F.count_if(F.col("status") == "ANOMALY").alias("flagged"),
        F.max("burst").alias("peak_burst"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
    if limit is None:
        return table
    return table.orderBy(F.col("failures").desc(), "src_host").limit(limit)


def template_activity(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Every message pattern with the earliest message as example; with ``limit``, the most repeated ones."""
    table = events.groupBy("template").agg(
        F.count("*").alias("events"),
        F.countDistinct("service").alias("services"),
        F.count_if(F.col("status") == "ANOMALY").alias("anomalous"),
        F.min_by("message", F.struct("timestamp", "line_no")).alias("example"),
    )
    if limit is None:
        return table
    return table.orderBy(F.col("events").desc(), "template").limit(limit)


def window_items(events: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Distinct (window, item): services, event classes and the anomaly flag."""
    flag = F.when(F.col("status") == "ANOMALY", F.lit(K.ANOMALY_ITEM))
    items = F.array(
        F.concat(F.lit(K.SERVICE_ITEM), "service"), F.concat(F.lit(K.CLASS_ITEM), "event_class"), flag
    )
    return (
        events.select(window_start("timestamp", params.window_minutes).alias("win"), F.explode(items).alias("item"))
        .where("item IS NOT NULL")
        .distinct()
    )


def _bitmaps(items: DataFrame, numbered: DataFrame) -> DataFrame:
    """(item, chunk, words): the windows of each item as bits, ``CHUNK_WORDS`` words of 64 windows a row."""
    place = F.col("row_idx")
    bits = items.join(numbered, "win").select(
        "item",
        F.floor(place / (64 * CHUNK_WORDS)).alias("chunk"),
        (F.floor(place / 64) % CHUNK_WORDS).cast("int").alias("word"),
        F.expr("shiftleft(1L, CAST(row_idx % 64 AS INT))").alias("bit"),
    )
    words = bits.groupBy("item", "chunk", "word").agg(F.bit_or("bit").alias("bits"))
    held = words.groupBy("item", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    word = lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long"))
    return held.select("item", "chunk", F.transform(F.sequence(F.lit(0), F.lit(CHUNK_WORDS - 1)), word).alias("words"))


def _both(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def _counted(found: DataFrame, keys: list[str], windows: Column, minimum: float) -> DataFrame:
    """Item sets (array ``items``) with count and support, frequent ones only, from bits per chunk."""
    ones = F.aggregate("words", F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x))
    counts = found.groupBy(*keys).agg(F.sum(ones).alias("found"))
    return counts.select(
        F.array(*keys).alias("items"), "found", (F.col("found") / windows).alias("support")
    ).where(F.col("support") >= minimum)


def frequent_itemsets(items: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Item sets of one to three items: ``items found support size windows_total``.

    Vertical: each item is a bitmap over the numbered windows, cut into chunks,
    and a set is counted by AND and bit counts, one row per candidate and
    chunk instead of one per candidate and window.  Only frequent items have
    bitmaps beyond the first level; they are few, as their supports add up to
    the mean number of items a window.  Triples are joined from two frequent
    pairs with one first item, and only if the third pair is frequent too.
    """
    items = cut_lineage(items)
    numbered = with_row_index(items.select("win").distinct(), "win")
    windows = F.lit(numbered.count())
    minimum = params.min_support
    counts = items.groupBy(F.col("item").alias("a")).agg(F.count("*").alias("found"))
    singles = counts.select(F.array("a").alias("items"), "found", (F.col("found") / windows).alias("support"))
    singles = singles.where(F.col("support") >= minimum)
    frequent = items.join(singles.select(F.col("items")[0].alias("item")), "item", "left_semi")
    maps = cut_lineage(_bitmaps(frequent, numbered))
    one = lambda n: maps.select(F.col("item").alias(n), "chunk", F.col("words").alias("words_" + n))
    twos = one("a").join(one("b"), "chunk").where(F.col("a") < F.col("b"))
    pairs = cut_lineage(_counted(twos.select("a", "b", _both("words_a", "words_b").alias("words")), ["a", "b"], windows, minimum))
    pair = lambda x, y: pairs.select(F.col("items")[0].alias(x), F.col("items")[1].alias(y))
    candidates = pair("a", "b").join(pair("a", "c"), "a").where(F.col("b") < F.col("c")).join(pair("b", "c"), ["b", "c"], "left_semi")
    threes = candidates.join(one("a"), "a").join(one("b"), ["b", "chunk"]).join(one("c"), ["c", "chunk"])
    threes = threes.withColumn("words", _both("words_a", "words_b")).select("a", "b", "c", _both("words", "words_c").alias("words"))
    triples = _counted(threes, ["a", "b", "c"], windows, minimum)
    found = singles.unionByName(pairs).unionByName(triples)
    return cut_lineage(found.withColumns({"size": F.size("items"), "windows_total": windows}))


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """Readable item sets, longest and best supported first."""
    return itemsets.select(
        F.array_join("items", JOINER).alias("itemset"), "size", "support", F.col("found").alias("windows")
    ).orderBy(F.col("size").desc(), F.col("support").desc(), "itemset")


def association_rules(itemsets: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """All antecedent / consequent splits with enough confidence and lift above one."""
    i = [F.col("items")[k] for k in range(3)]
    split = lambda left, right: F.struct(F.array(*left).alias("ante"), F.array(*right).alias("cons"))
    two = F.array(split([i[0]], [i[1]]), split([i[1]], [i[0]]))
    three = F.array(
        split([i[0]], [i[1], i[2]]),
        split([i[1]], [i[0], i[2]]),
        split([i[2]], [i[0], i[1]]),
        split([i[0], i[1]], [i[2]]),
        split([i[0], i[2]], [i[1]]),
        split([i[1], i[2]], [i[0]]),
    )
    splits = F.explode(F.when(F.col("size") == 2, two).otherwise(three)).alias("s")
    parts = itemsets.where("size >= 2").select("found", "support", splits).select("found", "support", "s.*")
    known = lambda side: itemsets.select(
        F.col("items").alias(side), F.col("support").alias(side + "_support")
    )
    joined = parts.join(known("ante"), "ante").join(known("cons"), "cons")
    confidence = F.col("support") / F.col("ante_support")
    return (
        joined.withColumn("confidence", confidence)
        .withColumn("lift", F.col("confidence") / F.col("cons_support"))
        .where((F.col("confidence") >= params.min_confidence) & (F.col("lift") > 1.0))
        .select("ante", "cons", "support", "confidence", "lift", F.col("found").alias("windows"))
    )


def about_anomalies(rules: DataFrame) -> DataFrame:
    """Rules that mention anomalous windows."""
    return rules.where(
        F.array_contains("ante", K.ANOMALY_ITEM) | F.array_contains("cons", K.ANOMALY_ITEM)
    )


def rule_report(rules: DataFrame, limit: int | None = None) -> DataFrame:
    """Readable rules, strongest first."""
    shown = rules.select(
        F.array_join("ante", JOINER).alias("if"),
        F.array_join("cons", JOINER).alias("then"),
        "support", "confidence", "lift", "windows",
    ).orderBy(F.col("lift").desc(), F.col("confidence").desc(), "if", "then")
    return shown if limit is None else shown.limit(limit)


def cluster_summary(events: DataFrame) -> DataFrame:
    """Size, modal service and class, mean length and share per cluster, from one pass over the events."""
    key = "dbscan_cluster"
    counted = cut_lineage(
        events.groupBy(key, "service", "event_class").agg(
            F.count("*").alias("n"), F.sum("message_length").alias("length")
        )
    )
    total = counted.agg(F.sum("n").alias("n")).scalar()

    def modal(column: str, name: str) -> DataFrame:
        # ties go to the name that comes first
        counts = counted.groupBy(key, column).agg(F.sum("n").alias("c"))
        best = F.min_by(column, F.struct(-F.col("c"), column))
        return counts.groupBy(key).agg(best.alias(name))

    base = counted.groupBy(key).agg(
        F.sum("n").alias("size"), (F.sum("length") / F.sum("n")).alias("avg_length")
    )
    label = F.when(F.col(key) == -1, F.lit("Noise (anomalous)")).otherwise(
        F.concat(F.lit("Cluster "), F.col(key).cast("string"))
    )
    return (
        base.join(modal("service", "top_service"), key)
        .join(modal("event_class", "top_event"), key)
        .withColumns({"cluster": label, "share_pct": F.round(F.col("size") / total * 100, 2)})
    )
