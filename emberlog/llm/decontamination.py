"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every window of ``SPAN`` consecutive words the smallest hash of its
``GRAM``-word grams is kept.  Equal windows keep equal hashes, so joining the
kept hashes of documents and items finds every shared window; hits are then
extended and compared word by word.  Items shorter than a window are one
window of their own length, and are looked up among windows of that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import attach, keyed, stored

SPAN = 10
GRAM = 5
_WORD = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once a row and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words with A-Z made small; other capitals stay as they are."""

    def small(w):
        plain = F.octet_length(w) == F.length(w)
        return F.when(plain, F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))

    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(1)), small)


def _starts(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def window_marks(words: Column, span: int) -> Column:
    """For each window of ``span`` words the smallest gram hash in it, in order of the windows."""
    gram = min(GRAM, span)

    def grams(hashes):
        def one(i):
            return F.xxhash64(*[hashes[i + k] for k in range(gram)])

        return F.transform(_starts(F.size(hashes) - (gram - 1)), one)

    def marks(found):
        if span == gram:
            return found
        return F.transform(
            _starts(F.size(found) - (span - gram)), lambda i: F.array_min(F.slice(found, i + 1, span - gram + 1))
        )

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(grams(h), marks))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``(span, mark, window, item_id)``: distinct windows of all items with words."""
    items = benchmark.select("item_id", words_of("text").alias("words")).where(F.size("words") > 0)
    items = items.withColumn("span", F.least(F.size("words"), F.lit(SPAN)))
    by_span = F.when(F.col("span") == SPAN, window_marks(F.col("words"), SPAN))
    for short in range(1, SPAN):
        by_span = by_span.when(F.col("span") == short, window_marks(F.col("words"), short))
    paired = items.withColumn("marks", by_span).select("item_id", "span", "words", F.posexplode("marks").alias("at", "mark"))
    window = F.array_join(F.slice("words", F.col("at") + 1, F.col("span")), " ")
    return paired.select("span", "mark", window.alias("window"), "item_id").distinct()


def _probed(texts: DataFrame, windows: DataFrame, spans: list[int]) -> DataFrame:
    """``(doc_id, th, span, mark, n_words)``: marks of texts that windows have too.

    One more row a text has ``span`` 0 and the number of its words, so that
    words are cut, hashed and counted in one pass.
    """

    def probe(span, mark, n_words):
        return F.struct(F.lit(span).alias("span"), mark.alias("mark"), n_words.alias("n_words"))

    def probes(words):
        def of_span(span):
            return F.transform(F.array_distinct(window_marks(words, span)), lambda m: probe(span, m, F.lit(0)))

        found = [of_span(span) for span in spans]
        return F.concat(F.array(probe(0, F.xxhash64("doc_id", "th"), F.size(words))), *found)

    # outer: the optimizer would else look at the size first and cut the words a second time
    rows = texts.select("doc_id", "th", F.explode_outer(_let(words_of(F.col("text")), probes)).alias("probe"))
    marks = windows.select("span", "mark", F.lit(True).alias("known")).distinct()
    met = rows.select("doc_id", "th", "probe.*").join(marks, ["span", "mark"], "left").where("span = 0 OR known")
    return stored(met.select("doc_id", "th", "span", "mark", "n_words"))


def _leaks_and_counts(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``find_leaks`` returns, and ``(doc_id, th, n_words)`` of every row."""
    windows = stored(item_windows(benchmark))
    texts = keyed(docs)
    spans = [r.span for r in windows.select("span").distinct().orderBy("span").collect()]  # at most SPAN values
    probed = _probed(texts, windows, spans)
    marked = stored(probed.where("span > 0").groupBy("doc_id", "th").agg(F.collect_set(F.struct("span", "mark")).alias("marks")))

    # extend: the windows that start where a joined mark is kept, compared as words
    suspects = attach(texts, marked, "inner").select("doc_id", "th", "marks", words_of(F.col("text")).alias("words"))
    suspects = stored(suspects)  # what follows must not be planned below the join
    ranges = None
    for span in spans:
        own = F.transform(F.filter("marks", lambda m: m["span"] == span), lambda m: m["mark"])
        starts = suspects.select("doc_id", "th", "words", own.alias("own"), window_marks(F.col("words"), span).alias("all"))
        at = starts.select("doc_id", "th", "words", "own", F.posexplode("all").alias("at", "mark"))
        at = at.where(F.array_contains("own", F.col("mark")))
        window = F.array_join(F.slice("words", F.col("at") + 1, span), " ")
        here = at.select("doc_id", "th", "at", F.size("words").alias("n_words"), window.alias("window"))
        known = stored(windows.where(F.col("span") == span).groupBy("window").agg(F.collect_set("item_id").alias("ids")))
        hit = here.join(known, "window").select(
            "doc_id", "th", "n_words", F.struct(F.col("at").alias("from"), (F.col("at") + span).alias("to")).alias("range"), "ids"
        )
        ranges = hit if ranges is None else ranges.unionByName(hit)
    if ranges is None:
        ranges = texts.limit(0).selectExpr(
            "doc_id", "th", "0 as n_words", "named_struct('from', 0, 'to', 0) as range", "array(0L) as ids"
        )
    per_doc = ranges.groupBy("doc_id", "th", "n_words").agg(
        F.sort_array(F.collect_set("range")).alias("ranges"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("ids")), lambda i: i.cast("string")))).alias("item_ids"),
    )
    leaks = per_doc.select("doc_id", "th", "n_words", merged_ranges(F.col("ranges")).alias("spans"), "item_ids")
    return leaks, probed.where("span = 0").select("doc_id", "th", F.col("n_words").cast("long").alias("n_words"))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, th, n_words, spans, item_ids)`` of rows with words in item windows, one row a (doc_id, text).

    ``spans`` are the merged hit ranges ``{from, to}`` of word positions (``to``
    excluded), ``item_ids`` the items as sorted strings.  Null ids of items do
    not count as items, their windows do.  Null texts, texts without words and
    empty tables give no row; other columns are ignored.
    """
    return _leaks_and_counts(docs, benchmark)[0]


def merged_ranges(ranges: Column) -> Column:
    """Sorted ranges with overlapping and touching ones joined."""

    def add(done, r):
        last = F.element_at(done, -1)
        grown = F.struct(last["from"].alias("from"), F.greatest(last["to"], r["to"]).alias("to"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["to"] >= r["from"]), joined).otherwise(
            F.concat(done, F.array(r))
        )

    nothing = F.slice(ranges, 1, 0)
    return F.aggregate(ranges, nothing, lambda done, r: F.when(F.size(done) == 0, F.array(r)).otherwise(add(done, r)))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Report every row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Rows without words have ``n_words`` 0 and are clean.  A missing item list
    is the empty string in ``items_sha256``.  Repeated rows are all reported.
    """
    leaks, counted = _leaks_and_counts(docs, benchmark)
    facts = stored(
        leaks.select(
            "doc_id", "th",
            F.aggregate("spans", F.lit(0).cast("long"), lambda n, r: n + (r["to"] - r["from"])).alias("n_hit"),
            F.size("item_ids").cast("long").alias("n_items"),
            F.array_join("item_ids", ",").alias("items"),
        )
    )
    full = attach(counted, facts)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return full.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
