"""Operators that compare rows with each other, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows(spark, small_dir):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    rng = random.Random(5)
    big = [t for _, t in base if t and len(t) > 1500]
    for k in range(30):
        a, b, i = rng.choice(big), rng.choice(big), rng.randint(0, 900)
        base.append((5000 + k, b[: rng.randint(0, 500)] + " " + a[i : i + rng.randint(150, 900)] + " " + b[900:1200]))
        words = a.split()[:120]
        words[rng.randrange(len(words))] = "changed"
        base.append((7000 + k, " ".join(words)))
    odd = ["a " * 300, "b " + "a " * 120, "x" * 3000, "y" + "x" * 450, "ab " * 100 + "ba " * 70, None, "", " \n", "one", "ONE", "é" * 400]
    base += [(9000 + k, t) for k, t in enumerate(odd)]
    # two words that no polynomial modulo 2**64 tells apart
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = one.translate({97: 98, 98: 97})
    many = " ".join(f"w{k}" for k in range(30))
    base += [(9300, one), (9301, other), (9302, f"{many} {one} {many}"), (9303, f"{many} {other} {many}"), (2**63 - 1, " ".join(big[2].split()[:9]))]
    return base + [(None, big[0]), (None, big[0]), (9100, big[1]), (9100, big[1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, th string, n long")


def _same(df, want):
    found = sorted((tuple(r) for r in df.collect()), key=str)
    assert found == sorted(want, key=str)


def test_word_spans(docs, rows):
    from emberlog.llm import substring_dedup as op

    none = 1 << 70
    words = [(t or "").encode().split() for _, t in rows]
    first: dict = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - 49):
            x = tuple(w[p : p + 50])
            first[x] = min(first.get(x, none), none if i is None else i)
    want = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < (none if i is None else i):
                gone.update(range(p, p + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert any(w[2] for w in want)
    _same(op.digests(op.drop_repeats(docs)), want)
    assert op.drop_repeats(docs.limit(0)).count() == 0


def test_byte_spans(docs, rows):
    from emberlog.llm import suffix_dedup as op

    raw = [(t or "").encode() for _, t in rows]
    times = Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))
    want = []
    for (i, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if times[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\x01" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    _same(op.digests(op.drop_repeats(docs)), want)
    assert op.drop_repeats(docs.limit(0)).count() == 0


def test_byte_spans_in_slices(docs, monkeypatch):
    """No more than a slice of pieces is named at a time, and the slices change no result."""
    import numpy as np

    from emberlog.llm import suffix_dedup as op

    whole = op.digests(op.drop_repeats(docs)).collect()
    monkeypatch.setattr(op, "AT_ONCE", 500)
    _same(op.digests(op.drop_repeats(docs)), [tuple(r) for r in whole])
    first = np.arange(0, 60_000, 60)[::-1]
    found = op.slices(np.zeros(1000, np.int64), first, first + 59, first + 59, 1)
    assert sorted(np.concatenate(found)) == list(range(1000))
    assert max(map(len, found)) * 60 <= 500 + 60


@pytest.mark.parametrize("width,hubs", [(2, 1), (5, -1)])
def test_near_duplicates(docs, rows, width, hubs, monkeypatch):
    from emberlog.llm import minhash_dedup
    from emberlog.llm.minhash_dedup import near_duplicates

    monkeypatch.setattr(minhash_dedup, "HUB_ROUNDS", hubs)  # -1: everything is compared in blocks
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)

    sets = []
    for _, t in rows:
        w = (t or "").translate(_SMALL).encode().split()
        grams = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
        sets.append(grams or ({tuple(w)} if w else set()))
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
    lowest: dict = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        lowest[r] = min((x for x in (lowest.get(r), i) if x is not None), default=None)
    want = [(i, len(sets[k]), lowest[find(k)], lowest[find(k)] == i) for k, (i, _) in enumerate(rows)]
    _same(near_duplicates(docs, width, 80), want)


@pytest.mark.parametrize("width,similarity", [(2, 80), (1, 70), (1, 100)])
def test_small_sets_lose_no_link(spark, width, similarity):
    from emberlog.llm.minhash_dedup import near_duplicates

    rng = random.Random(width)
    texts = []
    for k in range(220):  # families of short texts with one to five changed words; "the" is in a third of all
        base = [rng.choice(["the", "of", f"u{rng.randint(0, 400)}", f"v{k}x{j}"]) for j in range(rng.randint(1, 44))]
        for _ in range(rng.randint(1, 5)):
            changed = list(base)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(base))] = f"c{rng.randint(0, 10**6)}"
            texts.append(" ".join(changed + rng.choices(["tail", "the"], k=rng.randint(0, 2))))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)})
    least = list(range(len(texts)))  # by repeated passes over all links
    links = [
        (a, b)
        for a in range(len(texts))
        for b in range(a)
        if 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    ]
    assert len(links) > 10
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(least[a], least[b])
            moved |= (least[a], least[b]) != (low, low)
            least[a] = least[b] = low
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _same(near_duplicates(docs, width, similarity), [(i, len(sets[i]), least[i], least[i] == i) for i in range(len(texts))])


def test_contamination(spark, docs, rows, small_dir):
    from emberlog.llm.decontamination import contamination

    items = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(901, "one"), (902, "B a A"), (903, None), (904, "...")]
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(_SMALL))
    windows: dict = {}
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    want = []
    for i, t in rows:
        w, hit, ids = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    ids |= found
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    _same(contamination(docs, bench), want)
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_top_k(spark, monkeypatch):
    from emberlog.llm import topk_search as op

    rng = random.Random(2)
    made = [(k, [rng.gauss(0, 1) * (5 if k % 7 == 0 else 1) for _ in range(6)]) for k in range(400)]
    made += [(k + 400, made[0][1]) for k in range(5)] + [(500, [0.0] * 6), (600, [1.0]), (700, [-1.0]), (800, [])]
    odd = [(1000, None), (1100, [None] * 6), (1200, [float("nan")] * 6), (1300, [float("inf")] * 6), (None, [1.0] * 6)]
    monkeypatch.setattr(op, "BUCKET", 32)
    monkeypatch.setattr(op, "QUERY_BLOCK", 2)
    table = spark.createDataFrame([(*r, 1) for r in made + odd], "vec_id long, embedding array<float>, label int")
    exact = {r.vec_id: r.v for r in op.integer_vectors(table).collect()}
    want = []
    for q in (i for i in exact if i % 100 == 0):
        scores = [(-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q and len(v) == len(exact[q])]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:10], 1)]
    _same(op.top_k(table), want)


def test_top_k_broadcasts_no_vectors(spark, monkeypatch):
    """Copies of query blocks look small to the planner, which knows files before the copies are made, and compressed."""
    from emberlog.llm import topk_search as op

    rng = random.Random(3)
    monkeypatch.setattr(op, "BUCKET", 16)
    made = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(600)]
    out = op.top_k(spark.createDataFrame(made, "vec_id long, embedding array<float>"), every=10)
    assert len(out.collect()) == 60 * 10
    plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = re.findall(r"\) BroadcastExchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert sent and not [x for x in sent if "vectors" in x]


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e9, 1e14])
def test_top_k_of_clusters(spark, monkeypatch, scale):
    """Narrow regions, several lanes, numbers of all widths, equal lengths, an id with two vectors."""
    from emberlog.llm import topk_search as op

    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    made = [(k, [x + rng.gauss(0, 0.01) for x in centres[k % 8]]) for k in range(300)]
    made += [(k + 300, made[k][1]) for k in range(0, 300, 3)] + [(20, made[5][1]), (40, made[40][1])]
    made = [(k, [x * scale for x in v]) for k, v in made]
    for name, value in (("BUCKET", 20), ("QUERY_BLOCK", 7), ("LANE", 3), ("FEW", 2), ("SCORES", 100)):
        monkeypatch.setattr(op, name, value, raising=False)
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    exact = [(r.vec_id, r.v) for r in op.integer_vectors(table).collect()]
    assert len(exact) == len(made) - 1
    cut = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    want = []
    for q in {i for i, _ in exact if i % 20 == 0}:
        scores = [(-cut(sum(a * b for a, b in zip(mine, v))), i) for one, mine in exact if one == q for i, v in exact if i != q]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:10], 1)]
    _same(op.top_k(table, every=20), want)


def test_pipeline_stages(spark, docs, small_dir):
    import corpus_pipeline as pipeline

    table = spark.read.parquet(f"{small_dir}/documents.parquet").limit(80)
    odd = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", None, "s", 0)], table.schema)
    table = table.unionByName(odd).cache()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, table, small_dir)
        assert out.columns == table.columns, name
        assert out.where("doc_id >= 9001").count() == 2, name
        assert out.join(table, "doc_id", "left_anti").count() == 0, name
    assert pipeline.STAGES[-1][1](spark, table, small_dir).count() == table.count()


def test_one_document_of_each_group_stays(spark, small_dir):
    import corpus_pipeline as pipeline

    base = [f"{n} alpha beta gamma delta epsilon zeta eta theta iota {n}" for n in range(6)]
    made = [
        (1, base[0], "a"), (None, base[0], "a"),  # a null id that copies another document
        (None, base[1], "a"), (None, base[2], "a"), (None, base[2], "a"),  # null ids by themselves, one of them twice
        (2, base[3], "b"), (2, base[3], "a"), (2, base[3], "a"), (7, base[3], "a"),  # repeated rows
        (5, base[4], "a"), (5, base[0], "a"), (6, base[4], "a"),  # one id with two texts, one of them a copy
        (5, base[5], None),
        (8, None, "a"), (8, "", "a"), (8, "", "a"), (None, " ", "a"), (None, None, "a"),  # in no group
    ]
    table = spark.createDataFrame(made, "doc_id long, text string, source string")
    want = [made[k] for k in (0, 2, 3, 6, 9, 12, 13, 14, 15, 16, 17)]
    _same(pipeline.drop_near_duplicates(spark, table, small_dir), want)
    _same(pipeline.drop_near_duplicates(spark, table.drop("source"), small_dir), [w[:2] for w in want])
    assert pipeline.drop_near_duplicates(spark, table.limit(0), small_dir).count() == 0
