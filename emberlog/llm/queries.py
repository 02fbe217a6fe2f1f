"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.llm import (
    conversation_trie,
    decontamination,
    exact_dedup,
    html_text,
    merkle_manifest,
    minhash_dedup,
    quality,
    sentencepiece_codec,
    substring_dedup,
    suffix_dedup,
    token_counts,
    topk_search,
    toxicity,
)
from emberlog.llm.common import held_out

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.quality_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_token_counts(spark, sf_dir):
    counts = token_counts.count_tokens(_table(spark, sf_dir, "documents"), WORD_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_decontamination(spark, sf_dir):
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.digests(sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents"), PIECE_BPE))


def op5_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs.select("doc_id", "text"), chain)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity.low_quality").alias("low_quality_score"),
        F.col("toxicity.toxic").alias("score"),
        (F.col("toxicity.toxic") >= toxicity.REJECT_FROM).cast("int").alias("predicted"),
    )


def op6_topk_search(spark, sf_dir):
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.digests(substring_dedup.drop_repeats(_table(spark, sf_dir, "documents")))


def op8_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, similarity=80)


def op9_html_text(spark, sf_dir):
    texts = html_text.main_text(_table(spark, sf_dir, "pages"), with_counts=True)
    found = ("n_lines", "n_shared", "n_restored", "n_dropped")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), *found)


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(suffix_dedup.drop_repeats(_table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark, sf_dir):
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("enters_at")


def op12_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle_manifest.check(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
spans AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, spans WHERE len(w) >= n)),
hits AS (SELECT d.r, d.i, d.n, x.item_id FROM doc_windows d JOIN item_windows x ON d.n = x.n AND d.s = x.s),
words_hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items_hit AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r)
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP7_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (
    SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS m FROM s GROUP BY h),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM s JOIN first USING (h) WHERE s.doc_id > first.m),
lost AS (SELECT r, list(p) AS p FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN p IS NULL THEN w
    ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(p, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (r)
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
rare AS (SELECT x, count(*) AS df FROM one GROUP BY x HAVING count(*) > 1),
placed AS (
  SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(df, 1), x) AS pos FROM one LEFT JOIN rare USING (x)),
lead_ AS (SELECT doc_id, n, x FROM placed WHERE pos <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
maybe AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM lead_ a JOIN lead_ b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM (
    SELECT a, b, len(list_intersect(p.s, q.s)) AS c, len(p.s) + len(q.s) AS t
    FROM maybe JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b) WHERE 100 * c >= 80 * (t - c)),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN low USING (doc_id)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
s AS (
  SELECT r, i, md5(substr(t, 2 * i + 1, 400)) AS h FROM (
    SELECT r, t, unnest(range(0, len(t) // 2 - 199)) AS i FROM d WHERE len(t) >= 400)),
twice AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM s SEMI JOIN twice USING (h)),
grouped AS (
  SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM hit),
runs AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM grouped GROUP BY r, g),
kept AS (
  SELECT r, string_agg(substr(t, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS front, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM (SELECT r, a, b, t, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS e FROM runs JOIN d USING (r)) GROUP BY r)
SELECT doc_id, CAST(len(t) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN t ELSE front || substr(t, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP12_SQL = """
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER same = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST)
"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text, bit by bit."""
    one_bit = "lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"lambda c, x: list_reduce(list_prepend(xor(c, CAST(x AS BIGINT)), CAST(range(8) AS BIGINT[])), {one_bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {byte}), 4294967295)"


OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code, strlen(coalesce(text, '')) AS bytes,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t GROUP BY conv_id),
c AS (
  SELECT own.*, least(own.h, coalesce(b.n, 0)) AS begun, least(own.h, coalesce(b.n, 0)) + greatest(own.n - own.h, 0) AS total
  FROM own LEFT JOIN own b ON b.conv_id = own.base),
r AS (
  SELECT conv_id, begun + place - h + 1 AS depth, code, bytes FROM t JOIN c USING (conv_id) WHERE place >= h
  UNION ALL
  SELECT c.conv_id, place + 1, code, bytes FROM t JOIN c ON t.conv_id = c.base WHERE place < h),
p AS (
  SELECT conv_id, depth, bytes, sha256(string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (
  SELECT depth, prefix, min(conv_id) AS node, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = total), '')) AS ends
  FROM p JOIN c USING (conv_id) GROUP BY depth, prefix),
up AS (SELECT n.*, p.prefix AS parent FROM node n LEFT JOIN p ON p.conv_id = n.node AND p.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT p.depth, p.prefix, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved
  FROM node d JOIN p ON p.conv_id = d.node AND p.depth <= d.depth LEFT JOIN kids k ON k.depth = d.depth AND k.prefix = d.prefix GROUP BY ALL)
SELECT up.node AS conv_id, CAST(up.depth AS BIGINT) AS depth, q.node AS parent_conv_id, up.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, up.ends AS ends_sha256
FROM up LEFT JOIN node q ON q.depth = up.depth - 1 AND q.prefix = up.parent LEFT JOIN kids k ON k.depth = up.depth AND k.prefix = up.prefix
  JOIN below b ON b.depth = up.depth AND b.prefix = up.prefix
"""

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_LEAF.format(text="text")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")}
      ELSE {_LEAF.format(text="text")} END AS given
  FROM documents),
placed AS (
  SELECT *, coalesce('+' || source, '') AS g, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM leaves),
up AS (
  SELECT g, pos, leaf AS h, n, 0 AS lvl FROM placed
  UNION ALL
  SELECT g, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3, lvl + 1 FROM up WHERE n > 1 GROUP BY g, pos // 3, n, lvl),
tops AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
above AS (
  SELECT pos, h, n, 0 AS lvl FROM tops
  UNION ALL
  SELECT pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3, lvl + 1 FROM above WHERE n > 1 GROUP BY pos // 3, n, lvl),
runs AS (SELECT g, lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY g, lvl, pos // 3),
runs_above AS (SELECT lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM above WHERE n > 1 GROUP BY lvl, pos // 3),
low AS (
  SELECT r, g, pos, given AS h, '' AS proof, 0 AS lvl FROM placed
  UNION ALL
  SELECT r, f.g, f.pos // 3,
    sha256(array_to_string(hs[:f.pos % 3], '') || f.h || array_to_string(hs[f.pos % 3 + 2:], '')),
    proof || array_to_string(hs[:f.pos % 3], '') || array_to_string(hs[f.pos % 3 + 2:], ''), f.lvl + 1
  FROM low f JOIN runs ON runs.g = f.g AND runs.lvl = f.lvl AND runs.run = f.pos // 3),
high AS (
  SELECT r, tops.pos, low.h, proof, 0 AS lvl
  FROM (SELECT r, g, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM low GROUP BY r, g) low JOIN tops USING (g)
  UNION ALL
  SELECT r, f.pos // 3, sha256(array_to_string(hs[:f.pos % 3], '') || f.h || array_to_string(hs[f.pos % 3 + 2:], '')),
    proof || array_to_string(hs[:f.pos % 3], '') || array_to_string(hs[f.pos % 3 + 2:], ''), f.lvl + 1
  FROM high f JOIN runs_above ON runs_above.lvl = f.lvl AND runs_above.run = f.pos // 3),
ends AS (SELECT r, arg_max(h, lvl) AS folded, arg_max(proof, lvl) AS proof FROM high GROUP BY r)
SELECT doc_id, leaf, tops.h AS subroot, root.h AS root, sha256(ends.proof) AS proof_sha256, folded AS folded_root, folded = root.h AS verified
FROM placed JOIN ends USING (r) JOIN tops ON tops.g = placed.g, (SELECT h FROM above WHERE n = 1) root
"""

QUERIES = {
    "op1_quality": (op1_quality, None),
    "op2_token_counts": (op2_token_counts, None),
    "op3_decontamination": (op3_decontamination, OP3_SQL),
    "op4_sentencepiece": (op4_sentencepiece, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_topk_search": (op6_topk_search, OP6_SQL),
    "op7_substring_dedup": (op7_substring_dedup, OP7_SQL),
    "op8_minhash_dedup": (op8_minhash_dedup, OP8_SQL),
    "op9_html_text": (op9_html_text, None),
    "op10_suffix_dedup": (op10_suffix_dedup, OP10_SQL),
    "op11_prefix_trie": (op11_prefix_trie, OP11_SQL),
    "op12_exact_dedup": (op12_exact_dedup, OP12_SQL),
    "op13_merkle_manifest": (op13_merkle_manifest, OP13_SQL),
}
