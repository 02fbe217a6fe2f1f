"""Block naming, the Merkle manifest and the prefix trie, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _same(df, want):
    found = sorted((tuple(r) for r in df.collect()), key=str)
    assert found == sorted(want, key=str)


# ---- exact duplicates

LONG = "".join(random.Random(1).choice("ab\n ") for _ in range(5000))
TEXTS = [
    (1, "one"), (2, "one"), (3, "ONE"), (4, None), (5, ""), (None, "one"), (None, "null id"), (None, "null id"), (6, "x" * 64), (7, "x" * 65),
    (8, "x" * 64), (9, "x" * 128), (10, LONG), (11, LONG[:-1]), (12, LONG), (12, LONG), (12, "other"), (13, "é😀\x00" * 30), (14, "é😀\x00" * 30),
    (2**63 - 1, "one"), (-5, "a\n"), (-6, "a\n"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", "r", 1, "h") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, name string, row string, n int, h string")


def _groups():
    members = defaultdict(list)
    for i, t in TEXTS:
        members[t or ""].append(i)
    out = []
    for text, ids in members.items():
        ids.sort(key=lambda i: (i is not None, i))
        out += [(i, ids[-1], len(ids), k == len(ids) - 1, _sha(text)) for k, i in enumerate(ids)]
    return out


@pytest.mark.parametrize("size", [1024, 7])
def test_exact_duplicates(docs, size):
    from emberlog.llm.exact_dedup import exact_duplicates

    _same(exact_duplicates(docs, size), _groups())


def test_exact_duplicates_tell_blocks_of_one_hash_apart(docs, monkeypatch):
    from emberlog.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "_hash", lambda block: F.length(block).cast("long") % 3)
    _same(exact_dedup.exact_duplicates(docs, 16), _groups())


def test_exact_duplicates_of_nothing(docs):
    from emberlog.llm.exact_dedup import exact_duplicates

    assert exact_duplicates(docs.limit(0)).count() == 0


# ---- Merkle manifest

def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(row):
    return _sha("".join(map(_field, row)))


def _climb(hashes):
    """Root, and for each leaf its steps."""
    paths, places, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, p in enumerate(places):
            run = level[p - p % 3 : p - p % 3 + 3]
            paths[k].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
            places[k] = p // 3
        level = [_sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def _manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    ordered = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in ordered:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[s] = _climb([_leaf(r) for r in sources[s]])
    root, tops = _climb([trees[s][0] for s in ordered])
    for s, above in zip(ordered, tops):
        for r, low in zip(sources[s], trees[s][1]):
            steps = low + above
            given = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                given = (*r[:4], r[4].replace("\n", ""))
            folded = _leaf(given)
            for left, right in steps:
                folded = _sha(left + folded + right)
            yield r[0], _leaf(r), trees[s][0], root, _sha("".join(a + b for a, b in steps)), folded, folded == root


def _rows(seed, n):
    rng = random.Random(seed)
    out = [
        (k, rng.choice(["hot"] * 6 + [f"s{j}" for j in range(9)] + [None, ""]), rng.choice(["en", None]), rng.choice([None, k]), rng.choice(["a\nb", "é", None, "", f"t{k}\n"]))
        for k in range(n)
    ]
    return out + [(None, "hot", None, None, None), (None, "hot", None, None, "x"), (3, "hot", "en", 1, "again\n"), (3, "hot", "en", 1, "again\n")]


MERKLE = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("local", [5, 1, 2])
def test_manifest(spark, monkeypatch, local):
    from emberlog.llm import merkle_manifest

    monkeypatch.setattr(merkle_manifest, "LOCAL", local)
    rows = _rows(local, 150)
    table = spark.createDataFrame(rows, MERKLE).selectExpr("*", "'x' AS group", "'y' AS path", "1 AS part", "2 AS hash")
    want = list(_manifest(rows))
    assert {w[-1] for w in want} == {True, False}
    _same(merkle_manifest.check(table), want)


def test_manifest_of_one_row_and_of_nothing(spark):
    from emberlog.llm import merkle_manifest

    row = (7, None, None, None, "a")
    table = spark.createDataFrame([row], MERKLE)
    _same(merkle_manifest.check(table), _manifest([row]))
    assert merkle_manifest.check(table.limit(0)).count() == 0


@pytest.mark.parametrize("sources", [1, 40])
def test_manifest_of_many_sources(spark, monkeypatch, sources):
    from emberlog.llm import merkle_manifest

    monkeypatch.setattr(merkle_manifest, "LOCAL", 1)
    rows = [(k, f"s{k % sources}", "en", k, f"t\n{k}") for k in range(80)]
    _same(merkle_manifest.check(spark.createDataFrame(rows, MERKLE)), _manifest(rows))


# ---- running sums and list ranking

def test_running_sums(spark):
    from emberlog.llm.ordered import running_sums

    rng = random.Random(3)
    rows = [(rng.choice(["a"] * 20 + ["b", "c", "d"]), k, rng.randint(-(2**63), 2**63 - 1)) for k in range(700)]
    found = running_sums(spark.createDataFrame(rows, "g string, k long, v long").repartition(7), ["g"], ["k"], ["v"])
    sums, want = defaultdict(int), []
    for g, k, v in sorted(rows):
        sums[g] = (sums[g] + v) % 2**64
        want.append((g, k, v, sums[g] - 2**64 if sums[g] >= 2**63 else sums[g]))
    _same(found, want)


@pytest.fixture
def many_batches(spark):
    """Groups over several partitions, and several batches in each."""
    given = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {name: spark.conf.get(name) for name in given}
    for name, value in given.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_running_sums_over_whole_batches_of_a_group(spark, many_batches):
    from emberlog.llm.ordered import running_sums

    rows = [("ab"[k % 2], k, 1) for k in range(300)]
    found = running_sums(spark.createDataFrame(rows, "g string, k long, v long"), ["g"], ["k"], ["v"])
    _same(found, [(g, k, v, k // 2 + 1) for g, k, v in rows])


def test_manifest_over_whole_batches_of_a_source(spark, many_batches):
    from emberlog.llm import merkle_manifest

    rows = [(k, "ab"[k % 2], "en", k, f"t\n{k}") for k in range(300)]
    _same(merkle_manifest.check(spark.createDataFrame(rows, MERKLE)), _manifest(rows))


@pytest.mark.parametrize("shuffled", [False, True])
def test_list_ranking(spark, shuffled):
    from emberlog.llm.list_ranking import sums_before

    order = list(range(300))
    if shuffled:
        random.Random(4).shuffle(order)
    rows = [(a, 1, b, 1 if b is not None else None, a + 1) for a, b in zip(order, [*order[1:], None])]
    table = spark.createDataFrame(rows, "i long, j long, next_i long, next_j long, w long")
    want, total = [], 0
    for a in order:
        want.append((a, 1, total))
        total += a + 1
    _same(sums_before(table, ["i", "j"], ["w"], chunk=16), want)
    assert sums_before(table.limit(0), ["i", "j"], ["w"]).count() == 0


# ---- conversation prefixes

def _trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((t is not None, t or 0, _sha(f"{len(role.encode())}:{role}{text}")), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for x in nodes:
        if x:
            kids[x[:-1]].append(x)

    def below(x):
        saved = (len(nodes[x]) - 1) * len(x[-1][1].encode()) if x else 0
        leaves = 0 if kids[x] else 1
        for k in kids[x]:
            more = below(k)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    for x, members in list(nodes.items()):
        ends = sorted(c for c in members if len(rebuilt[c]) == len(x))
        leaves, saved = below(x)
        yield min(members), len(x), min(nodes[x[:-1]]) if x else None, len(members), len(kids[x]), leaves, saved, _sha(",".join(map(str, ends)))


def _conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), 1000, 1003, 2**63 - 1, -3, -5, -4]:
        turns = rng.choice([0, 1, 2, 5, 12])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é", None, "", "long " * 40])) for t in range(turns)]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]
    rows += [(500, t, "user", f"turn {t}") for t in range(400)]
    rows += [(7, None, "user", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, 0, "user", "other tie"), (None, 1, "user", "lost"), (61, None, None, None)]
    return rows


@pytest.mark.parametrize("chunk", [1 << 15, 64])
def test_prefix_trie(spark, chunk):
    from emberlog.llm.conversation_trie import prefix_trie

    rows = _conversations(chunk)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.selectExpr("*", "'x' AS node", "'y' AS depth", "0 AS parent", "1 AS code", "2 AS one").repartition(5)
    found = prefix_trie(table, chunk).drop("enters_at")
    _same(found, list(_trie(rows)))


def test_prefix_trie_of_nothing(spark):
    from emberlog.llm.conversation_trie import prefix_trie

    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0


def test_tour_order(spark):
    from emberlog.llm.conversation_trie import prefix_trie

    rows = [(c, t, "user", f"{c if t > 1 else 0}") for c in range(0, 20, 5) for t in range(4)]
    found = prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    entered = [(r.conv_id, r.depth) for r in found.orderBy("enters_at").collect()]
    assert entered == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (5, 3), (5, 4), (10, 3), (10, 4), (15, 3), (15, 4)]
