"""``run()`` on planted documents against the same chain of stages by brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import sentencepiece

from emberlog.llm import toxicity
from emberlog.llm.queries import PIECE_BPE

_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ("id", "th", "doc", "_h", "_id", "_th", "_new", "_row", "fact_id", "fact_th", "new", "toxicity", "again", "codes")


def _near(rows):
    """The rows that stay: one of each group of five-word shingle sets alike at 0.8 or more."""
    sets = []
    for row in rows:
        w = (row["text"] or "").translate(_SMALL).encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups: dict = {}
    for k, row in enumerate(rows):
        groups.setdefault(find(k) if sets[k] else (k,), []).append(row)
    return [min(g, key=lambda r: r["doc_id"]) for g in groups.values()]


def _spans(rows):
    words = [(r["text"] or "").encode().split() for r in rows]
    first: dict = {}
    for r, w in zip(rows, words):
        for p in range(len(w) - 49):
            x = tuple(w[p : p + 50])
            first[x] = min(first.get(x, r["doc_id"]), r["doc_id"])
    out = []
    for r, w in zip(rows, words):
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < r["doc_id"] for q in range(p, p + 50)}
        text = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else r["text"]
        out.append({**r, "text": text, "n_chars": len(text) if gone else r["n_chars"], "cut": len(gone)})
    return out


def _leaks(rows, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(_SMALL))
    windows = set()
    for t in items:
        w = cut(t)
        n = min(10, len(w))
        windows |= {tuple(w[p : p + n]) for p in range(len(w) - n + 1 if n else 0)}
    sizes = {len(x) for x in windows}
    held = lambda w: any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))
    return [r for r in rows if not held(cut(r["text"]))]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables: the given documents and planted ones of each kind, and the rows as dicts."""
    small_dir = "/root/testdata/sf0.01"  # the smallest tables with enough labels to learn toxicity from
    folder = str(tmp_path_factory.mktemp("planted"))
    table = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [r.asDict() for r in table.collect()]
    marked = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    rng = random.Random(8)
    long = [r["text"] for r in rows if r["text"] and len(r["text"].split()) > 150 and marked.get(r["doc_id"]) == 0]
    toxic = [r["text"] for r in rows if r["text"] and marked.get(r["doc_id"]) == 1]
    short = [t for t in items if t and 10 <= len(t.split()) < 50]  # longer ones, if repeated, are cut before
    kinds = {"copy": [], "near": [], "span": [], "leak": [], "toxic": []}
    for k in range(5):
        text = rng.choice(long)
        words = text.split()
        changed = [*words[:70], "quite", "another", "word", *words[73:]]
        fresh = " ".join(f"w{rng.randrange(10**6)}" for _ in range(90))
        kinds["copy"].append(text)
        kinds["near"].append(" ".join(changed))
        kinds["span"].append(f"{fresh} " + " ".join(words[20:90]) + f" {fresh[:200]}")
        kinds["leak"].append(f"{fresh} {short[k]} {k}")
        kinds["toxic"].append(rng.choice(toxic) + f" {fresh[:40]}")
    ids = {}
    for n, (kind, texts) in enumerate(kinds.items()):
        ids[kind] = list(range(10_000 + 100 * n, 10_000 + 100 * n + len(texts)))
        rows += [dict(doc_id=i, text=t, lang="en", source="planted", n_chars=len(t)) for i, t in zip(ids[kind], texts)]
    rows += [dict(doc_id=20_000 + k, text=t, lang=None, source=None, n_chars=None) for k, t in enumerate((None, "", " \n"))]
    wide = [tuple(r[c] for c in table.columns) + (r["doc_id"],) * len(CLASHING) for r in rows]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in table.schema] + [f"{c} long" for c in CLASHING])
    spark.createDataFrame(wide, schema).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder, rows, items, ids


def test_run_equals_brute_force(spark, planted):
    import corpus_pipeline as pipeline

    folder, rows, items, ids = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chain = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = chain.probabilities([r["text"] or "" for r in rows])
    at = list(toxicity.CATEGORIES).index("toxic")
    safe = [r for r, p in zip(rows, scores) if p[at] < toxicity.REJECT_FROM]
    alone = _near(safe)
    cut = _spans(alone)
    clean = _leaks(cut, items)
    codec = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    want = []
    for r in clean:
        tokens = codec.encode(r["text"] or "")
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((r["doc_id"], len(tokens), digest(",".join(map(str, tokens))), digest(codec.decode(tokens))))
    got = sorted(tuple(r) for r in pipeline.run(spark, folder).collect())
    assert got == sorted(want)
    # each planted kind meets its stage, and texts without words stay
    left = {r["doc_id"] for r in clean}
    assert len({r["doc_id"] for r in safe} & set(ids["toxic"])) <= 1
    assert not {r["doc_id"] for r in alone} & {*ids["copy"], *ids["near"]}
    assert all(r["cut"] >= 50 for r in cut if r["doc_id"] in ids["span"]) and {r["doc_id"] for r in cut} & set(ids["span"])
    assert not left & set(ids["leak"]) and {20_000, 20_001, 20_002} <= left


def test_stages_keep_columns_of_any_name(spark, planted):
    import corpus_pipeline as pipeline

    folder, rows, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[1:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        wrong = " OR ".join(f"{c} <> doc_id OR {c} IS NULL" for c in CLASHING)
        assert out.where(wrong).count() == 0 and 0 < out.count() <= len(rows), name


def test_no_documents_give_no_rows(spark, small_dir, tmp_path):
    import corpus_pipeline as pipeline

    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{small_dir}/{name}.parquet")
        (table.limit(0) if name == "documents" else table).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
