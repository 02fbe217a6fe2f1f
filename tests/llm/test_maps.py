"""Operators that look at one text at a time, against the libraries and held-out labels."""

from __future__ import annotations

import hashlib

import pytest

TEXTS = [
    (1, "The Quick brown fox, it's 12 times'll\nJUMPED  over."),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "<|endoftext|> a <|startoftext|>b \x1c c d 　 é É ﬁ"),
    (6, "x" * 5000 + " " + "ab " * 3000),
    (1, "The Quick brown fox, it's 12 times'll\nJUMPED  over."),
    (None, "▁ under  three   spaces ▁▁ 😀 \x00 ẞ -- == ..."),
]
SCHEMA = "doc_id long, text string, ids string, score string, th string, decoded string"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(*t, "x", "y", "z", "w") for t in TEXTS], SCHEMA)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_token_counts_match_the_library(spark, texts):
    from tokenizers import Tokenizer

    from emberlog.llm import queries, token_counts

    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    want = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS]
    assert _rows(token_counts.count_tokens(texts, queries.WORD_BPE)) == sorted(want, key=str)
    assert token_counts.count_tokens(texts.limit(0), queries.WORD_BPE).count() == 0


def test_units_add_up_to_the_words():
    """Units of a word, encoded one by one, have as many pieces as the word."""
    import random

    from tokenizers import Tokenizer

    from emberlog.llm import queries, token_counts

    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rng = random.Random(11)
    some = ["'s", "'LL", "''", "don't", "ABC", "é", "É", "e\u0301", "ñ", "²", "¼", "ª", "µ", "ß", "İ", "ı", "7", "42", "_", "--", ".", "<|endoftext|>", "<|", "中", "ǅ", "\u00ad", "ŉ", "×", "ÿ", "Я"]
    words = ["".join(rng.choice(some) for _ in range(rng.randint(1, 6))) for _ in range(20000)]
    words += [chr(c) + x + chr(c) for c in range(33, 0x260) if not chr(c).isspace() for x in ("", "a", "'s", ".")]
    assert [w for w in words if sum(map(count, token_counts.units_of(w))) != count(w)] == []
    assert token_counts.units_of("Don't,42") == ["don", "'t", ",", "4", "2"]


def test_token_counts_without_hot_words(spark, texts, monkeypatch):
    from emberlog.llm import queries, token_counts

    want = _rows(token_counts.count_tokens(texts, queries.WORD_BPE))
    monkeypatch.setattr(token_counts, "HOT_WORDS", 1)
    assert _rows(token_counts.count_tokens(texts, queries.WORD_BPE)) == want


def test_pieces_match_the_library_and_come_back(spark, texts, small_dir):
    import sentencepiece

    from emberlog.llm import queries, sentencepiece_codec as codec

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    more = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    both = texts.select("doc_id", "text").unionByName(more)
    want = []
    for i, t in ((r.doc_id, r.text or "") for r in both.collect()):
        ids = library.encode(t)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want.append((i, len(ids), *digest))
    assert _rows(codec.digests(codec.round_trip(both, queries.PIECE_BPE))) == sorted(want, key=str)
    assert codec.round_trip(texts.limit(0), queries.PIECE_BPE).count() == 0
    assert "score" in codec.encode(texts, queries.PIECE_BPE).columns


def test_texts_of_every_piece_match_the_library():
    import sentencepiece

    from emberlog.llm import queries
    from emberlog.llm.sentencepiece_codec import SPACE, PrefixTable

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    table = PrefixTable(queries.PIECE_BPE)
    pieces = [p.replace(SPACE, " ") for p in table.rank]
    assert "²." in pieces
    made = [t for p in pieces for t in (p, f"an area of 12 km{p}. Next", f"{p}{p},.")]
    wrong = [t for t in made if memoryview(table.encode(t)).cast("i").tolist() != library.encode(t)]
    assert not wrong


def test_decode_of_wrong_bytes():
    import numpy as np

    from emberlog.llm import queries
    from emberlog.llm.sentencepiece_codec import PrefixTable

    table = PrefixTable(queries.PIECE_BPE)
    assert table.decode(np.array([3 + 0xE2, 3 + 0x41])) == "�A"
    with pytest.raises(ValueError):
        table.decode(np.array([10**6]))


@pytest.mark.parametrize("name,target,least", [("op1_quality", "quality", 0.95), ("op5_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, target, least):
    from emberlog.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"  # the smaller tables have too few toxic rows to learn from
    scored = QUERIES[name][0](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", target, "score").collect()
    assert rows and all(0 <= r.score <= 1 for r in rows)
    assert sum(r[0] == r[1] for r in rows) / len(rows) >= least


def test_classifiers_on_empty_and_one_sided_labels(spark, texts):
    from emberlog.llm import quality, toxicity

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert quality.quality_scores(texts, quality.train(texts, labels)).where("score BETWEEN 0 AND 1").count() == len(TEXTS)
        assert toxicity.toxicity(texts, toxicity.train(texts, labels)).count() == len(TEXTS)


def test_share_of_capitals_is_of_the_whole_text():
    from emberlog.llm import toxicity

    text = "Some WORDS of a tÉxt, Ǆ and ǅ. " * 65
    for t in (text[:1999], text[:1999] * 2, "a" * 3999 + "B", "aB" * 50_000, "É" + "\ud800" * 2, ""):
        measured = toxicity._plain([t])[0, 1]
        assert measured == pytest.approx(sum(map(str.isupper, t)) / max(1, len(t)))
    once, twice = toxicity._plain([text[:1999], text[:1999] * 2])[:, 1]
    assert once == pytest.approx(twice)


PAGES = [
    (1, "http://h/a/1", "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Big&amp;</h1><p>one\n two<b>x</b><p>three<br>4"
        "<div class='comments'>hi</div><aside>no</aside></article><footer>f</footer>", "Big& one twox three 4"),
    (2, None, None, ""),
    (3, "http://h/b/1", "<body><div>Site</div><p>own text</p><div>Copyright</div>", "own text"),
    (4, "http://h/b/2", "<body><div>Site</div><p>other text</p><p>more</p><div>Copyright</div>", "other text more"),
    (5, "http://alone/x", "<body><p>kept &lt;b&gt;</p><script>no()</script>", "kept <b>"),
    (6, "", "<p>a</p><form>no</form><!-- c --><p>b", "a b"),
]


def test_main_text(spark):
    from emberlog.llm.html_text import main_text

    pages = spark.createDataFrame([p[:3] + ("x",) for p in PAGES], "page_id long, url string, html string, host string")
    assert _rows(main_text(pages)) == sorted(((p[0], p[1], p[3]) for p in PAGES), key=str)
    assert main_text(pages.limit(0)).count() == 0


def test_every_page_is_aligned_with_its_neighbour(spark):
    """Pages that mark an article too; the check by markup comes after the alignment."""
    import os.path
    import random

    from emberlog.llm.html_text import main_text, shared_with

    rng = random.Random(9)
    codes: dict[tuple, int] = {}
    lines, rows = {}, []
    for k in range(60):
        key = f"h{k % 3}", f"/{rng.choice('ab')}/{k}"
        middle = "article" if rng.random() < 0.6 else "div"
        kinds = ["nav", *[middle] * rng.randint(0, 6), "div", "footer"]
        lines[key] = [(t, f"{t[0]} {rng.randint(0, 3)}") for t in kinds]
        html = "".join(f"<{t}>{text}</{t}>" for t, text in lines[key])
        rows += [(k, f"http://{key[0].upper()}{key[1]}?x={k}", html)] * (1 + (k == 5))
    own = lambda key: [codes.setdefault((t in ("nav", "footer"), x), len(codes)) for t, x in lines[key]]
    want = []
    for k, url, html in rows:
        key = next(key for key in lines if key[1].endswith(f"/{k}"))
        paths = sorted(path for host, path in lines if host == key[0])
        at = paths.index(key[1])
        near = [p for p in (paths[at - 1] if at else None, paths[at + 1] if at + 1 < len(paths) else None) if p]
        other = max(near, key=lambda p: len(os.path.commonprefix([p, key[1]])))
        a, b = own(key), own((key[0], other))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        gone = shared_with(a, b)
        assert sum(gone) == table[-1][-1]
        is_marked = any(t == "article" for t, _ in lines[key])
        stays = [t == "article" if is_marked else t == "div" and not g for (t, _), g in zip(lines[key], gone)]
        restored = sum(s and g for s, g in zip(stays, gone))
        dropped = sum(not s and not g for s, g in zip(stays, gone))
        text = " ".join(x for (_, x), s in zip(lines[key], stays) if s)
        want.append((k, url, text, len(a), sum(gone), restored, dropped))
    assert any("<article" in r[2] and w[5] for r, w in zip(rows, want))
    pages = spark.createDataFrame(rows + [(90, "http://h9/", None), (91, None, "<p>a</p><nav>b</nav>")], "page_id long, url string, html string")
    want += [(90, "http://h9/", "", 0, 0, 0, 0), (91, None, "a", 2, 0, 0, 1)]
    assert _rows(main_text(pages.repartition(5), with_counts=True)) == sorted(want, key=str)
    assert main_text(pages.limit(0), with_counts=True).count() == 0


@pytest.mark.parametrize(
    "attributes,marked",
    [
        (' style="overflow:hidden"', False), (" style='x; hidden'", False), (' href="/hidden-gems"', False),
        (" href=/hidden", False), (' alt="a hidden path"', False), (' data-id="search"', False), (' data-class="ad"', False),
        (' title="class=ad id=nav"', False), (' data-hidden aria-hidden="false"', False), (' class="text" class="ad"', False),
        (" hidden", True), (" HIDDEN=''", True), (' style="a"hidden', True), (' aria-hidden = "TRUE"', True),
        (' title="x" class="a navBar-item nav"', True), (" id=search", True), (" role='navigation'/", True),
    ],
)
def test_only_whole_attributes_mark_an_element(attributes, marked):
    from emberlog.llm.html_text import lines_of

    texts, _ = lines_of(f"<article><p>one</p><div{attributes}>two</div></article>")
    assert texts == (["one"] if marked else ["one", "two"])


def test_shared_lines_are_a_longest_common_subsequence():
    from emberlog.llm.html_text import shared_with

    assert shared_with([1, 2, 3, 4], [1, 9, 3, 4]) == [True, False, True, True]
    assert sum(shared_with([5, 1, 2, 6, 3], [1, 7, 2, 3, 5])) == 3
    assert shared_with([], [1]) == []


@pytest.mark.parametrize(
    "html,want",
    [
        ('<div class="layout no-sidebar"><article><p>one</p></article></div>', ["one"]),
        ('<article><div class="post-header"><h1>Title</h1></div><p>one <span class="share">two</span></p></article>', ["Title", "one two"]),
        ('<div class="sidebar"><article>one</article></div><p>menu</p>', ["one"]),
        ('<div class="sidebar"><article>related</article></div><article>one</article>', ["one"]),
        ('<article>one<div class="comments"><article>reply</article></div></article>', ["one"]),
        ('<article>one<div class="cookie-banner">no</div><i hidden>no</i></article>', ["one"]),
        ("<aside><article>no</article></aside><article>one</article></p></div>", ["one"]),
    ],
)
def test_articles_stay_whole(html, want):
    from emberlog.llm.html_text import lines_of

    texts, inside = lines_of(html)
    assert [t for t, i in zip(texts, inside) if i] == want


def test_unmatched_end_tags_take_no_time():
    import time

    from emberlog.llm.html_text import lines_of

    start = time.process_time()
    texts, _ = lines_of("<div>" * 100_000 + "one" + "</p>" * 100_000)
    assert texts == ["one"] and time.process_time() - start < 10


@pytest.mark.parametrize("kinds", [3, 40, 10**6])
def test_shared_lines_of_long_pages(kinds):
    import random

    from emberlog.llm.html_text import shared_with

    rng = random.Random(kinds)
    a = [rng.randint(0, kinds) for _ in range(700)]
    b = [x if rng.random() < 0.7 else rng.randint(0, kinds) for x in a if rng.random() < 0.9]
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    found = [x for x, s in zip(a, shared_with(a, b)) if s]
    rest = iter(b)
    assert len(found) == row[-1] and all(x in rest for x in found)


def test_shared_lines_match_the_quadratic_table():
    import random

    from emberlog.llm.html_text import shared_with

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 25))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = [x for x, s in zip(a, shared_with(a, b)) if s]
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(x in rest for x in found)
