"""Main text of web pages: differences to the nearest page of the same host, checked against page structure.

Pages are paired by URL path within their host, all their text lines are aligned
by longest common subsequence, and shared lines are deleted.  By itself that gives
wrong results where menus, adverts and footers differ from page to page, while
articles repeat each other.  So a check by marked-up structure follows.  It takes
away the lines that are left of menus, headers, footers and the like, puts back
deleted lines of an article, and takes away what stands beside an article.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import small_batches, stored
from emberlog.operators.ordering import with_row_index

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
#: A whole attribute: its name, and its value, which is consumed with it.
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head title nav header footer aside form button menu dialog fieldset".split())
_ARTICLE = frozenset(("article", "main"))
#: Words in class, id or role that mark what is not main text.
_MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus footer form header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
_MARK_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_BY_MARK, _BY_NAME = 1, 2  # why an element is dropped
#: Where a text block lies: in no element that matters, in an article, in a dropped element, in an article of a marked element.
PLAIN, ARTICLE, DROPPED, _HELD = range(4)


def _is_marked(attributes: str, inline: bool) -> bool:
    """Whether an element is hidden or, unless it is inline, a class, id or role of it is made of marks only.

    So ``cookie-banner`` is one and ``no-sidebar`` or ``post-header`` are not.
    """
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")  # of repeated names the first holds
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if inline:
        return False
    tokens = (t for name in ("class", "id", "role") for t in found.get(name, "").split())
    return any((words := [w.lower() for w in _MARK_SPLIT.split(t) if w]) and all(w in _MARKS for w in words) for t in tokens)


def blocks_of(html: str | None) -> tuple[list[str], list[int]]:
    """All text blocks in page order, and whether each is ``PLAIN``, in an ``ARTICLE`` or in a ``DROPPED`` element.

    An article in an element that its marks alone would drop counts if the page has no other one.
    """
    texts: list[str] = []
    marks: list[int] = []
    stack: list[tuple[str, int, bool, bool]] = []  # element, why dropped, in article, in an article of a marked element
    opened: Counter[str] = Counter()
    parts: list[str] = []
    gone: list[str] = []  # what dropped elements hold since the last block
    dropped, article, held = 0, False, False
    html = html or ""

    def add(parts, mark):
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            texts.append(text)
            marks.append(mark)

    def close_block():
        if parts:
            add(parts, _HELD if held else ARTICLE if article else PLAIN)
        if gone:
            add(gone, DROPPED)

    def leave(depth):
        for gone in stack[depth:]:
            opened[gone[0]] -= 1
        del stack[depth:]
        return stack[-1][1:] if stack else (0, False, False)

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            (gone if dropped else parts).append(html[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if m.group(2):
            if name not in _INLINE:
                close_block()
            for depth in range(len(stack) - 1, -1, -1):
                if not opened[name]:
                    break
                if stack[depth][0] == name:
                    dropped, article, held = leave(depth)
                    break
            continue
        if name not in _INLINE:
            close_block()
        if name in _VOID:
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
            dropped, article, held = leave(len(stack) - 1)
        if name == "body":
            dropped = 0
        out, kept = dropped, held
        if name in _DROPPED:
            out, kept = _BY_NAME, False
        elif name in _ARTICLE and out == _BY_MARK and not _is_marked(m.group(4), False):
            out, kept = 0, True
        elif name not in ("html", "body") and (name not in _ARTICLE or article) and _is_marked(m.group(4), name in _INLINE):
            out, kept = max(out, _BY_MARK), False  # an article in an article is a reader comment
        stack.append((name, out, article or name in _ARTICLE, kept))
        opened[name] += 1
        dropped, article, held = stack[-1][1:]
    if at < len(html):
        (gone if dropped else parts).append(html[at:])
    close_block()
    if _HELD in marks:
        counts = DROPPED if ARTICLE in marks else ARTICLE
        marks = [counts if m == _HELD else m for m in marks]
    return texts, marks


def lines_of(html: str | None) -> tuple[list[str], list[bool]]:
    """Text blocks outside dropped elements, and whether each lies in an article."""
    texts, marks = blocks_of(html)
    return [t for t, m in zip(texts, marks) if m != DROPPED], [m == ARTICLE for m in marks if m != DROPPED]


def shared_with(own: list[int], other: list[int]) -> list[bool]:
    """Which lines of ``own`` are on a longest common subsequence with ``other``; equal ends are aligned first."""
    n, m = len(own), len(other)
    front = 0
    while front < min(n, m) and own[front] == other[front]:
        front += 1
    back = 0
    while back < min(n, m) - front and own[n - 1 - back] == other[m - 1 - back]:
        back += 1
    out = [True] * front + [False] * (n - front - back) + [True] * back
    there = set(other[front : m - back])
    a = [k for k in range(front, n - back) if own[k] in there]
    known = {own[k] for k in a}
    b = np.array([x for x in other[front : m - back] if x in known], np.int64)

    def lengths(lines, others):
        """Length of the longest common subsequence of ``lines`` with each beginning of ``others``, a bit for each of these."""
        size = len(others)
        places: dict[int, list[int]] = {}
        for place, code in enumerate(others.tolist()):
            places.setdefault(code, []).append(place)
        masks: dict[int, int] = {}
        row = full = (1 << size) - 1  # a bit is 0 where the length grows
        for k in lines:
            equal = places.get(own[k])
            if equal is None:
                continue
            mask = masks.get(own[k])
            if mask is None:
                bits = bytearray(size // 8 + 1)
                for place in equal:
                    bits[place >> 3] |= 1 << (place & 7)
                mask = int.from_bytes(bits, "little")
                if len(equal) * 256 >= size:  # at most 256 masks are kept, so memory stays linear
                    masks[own[k]] = mask
            found = row & mask
            row = ((row + found) | (row - found)) & full
        grows = np.frombuffer((row ^ full).to_bytes(size // 8 + 1, "little"), np.uint8)
        return np.concatenate([[0], np.cumsum(np.unpackbits(grows, bitorder="little")[:size], dtype=np.int64)])

    todo = [(0, len(a), 0, len(b))]  # halves of ``a`` with their part of ``b``: memory stays linear
    while todo:
        low, high, begin, end = todo.pop()
        if low == high or begin == end:
            continue
        if high - low == 1:
            out[a[low]] = bool((b[begin:end] == own[a[low]]).any())
            continue
        middle = (low + high) // 2
        head, tail = lengths(a[low:middle], b[begin:end]), lengths(a[middle:high][::-1], b[begin:end][::-1])
        cut = begin + int(np.argmax(head + tail[::-1]))
        todo += [(low, middle, begin, cut), (middle, high, cut, end)]
    return out


_URL = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)"


def _placed(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        "page_id", "url", "html",
        F.lower(F.regexp_extract(url, _URL, 1)).alias("host"),
        F.regexp_extract(url, _URL, 2).alias("path"),
    )


def _codes(texts: list[str], marks: list[int]) -> list[bytes]:
    """64 bits a line; a line of a dropped element is another one than the same text elsewhere."""
    return [blake2b(t.encode(), digest_size=8, key=b"-" if m == DROPPED else b"").digest() for t, m in zip(texts, marks)]


def page_lines(placed: DataFrame, with_texts: bool = True) -> DataFrame:
    """``(host, path, hashes)`` of every page, one hash a text line.

    ``with_texts`` adds ``page_id``, ``url``, ``marks`` (a byte a line) and ``packed``: the lines outside dropped elements,
    compressed, as they are shuffled and the blocks that Spark compresses by itself are half as large again.
    """

    def run(batches):
        for batch in batches:
            found = [blocks_of(h) for h in batch.column("html").to_pylist()]
            codes = np.frombuffer(b"".join(c for f in found for c in _codes(*f)), np.int64)
            ends = np.cumsum([0, *(len(f[0]) for f in found)], dtype=np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(codes))
            columns = [batch.column("host"), batch.column("path"), hashes]
            if with_texts:
                kept = ("\n".join(t for t, m in zip(*f) if m != DROPPED) for f in found)  # a line has no line break
                columns += [batch.column("page_id"), batch.column("url"), pa.array([bytes(f[1]) for f in found], pa.binary())]
                columns.append(pa.array([zlib.compress(k.encode(), 1) for k in kept], pa.binary()))
            yield pa.record_batch(columns, names)

    schema = "host string, path string, hashes array<long>"
    if with_texts:
        schema += ", page_id long, url string, marks binary, packed binary"
    names = [c.split()[0] for c in schema.split(", ")]
    small_batches(placed.sparkSession)
    return placed.mapInArrow(run, schema)


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def partners(placed: DataFrame) -> DataFrame:
    """``(host, path, other)``: of every path the neighbour, in order of path, that shares the longer start of the path.

    The one before if both do.  Pages without host, and a path alone on its host, have none.
    """
    paths = placed.where("host <> ''").select("host", "path").distinct()
    order = with_row_index(paths, "host", "path", keep=stored)
    beside = lambda step, name: order.select(
        (F.col("row_idx") + step).alias("row_idx"), F.col("host").alias(f"host_{name}"), F.col("path").alias(f"path_{name}")
    )
    triples = order.join(beside(1, "before"), "row_idx", "left").join(beside(-1, "after"), "row_idx", "left")
    same = lambda name: F.when(F.col("host") == F.col(f"host_{name}"), F.col(f"path_{name}")).alias(name)

    def choose(batches):
        for batch in batches:
            others = []
            for path, before, after in zip(*(batch.column(c).to_pylist() for c in ("path", "before", "after"))):
                if before is not None and after is not None:
                    others.append(after if _common_prefix(path, after) > _common_prefix(path, before) else before)
                else:
                    others.append(before if before is not None else after)
            yield pa.record_batch([batch.column("host"), batch.column("path"), pa.array(others, pa.string())], ["host", "path", "other"])

    found = triples.select("host", "path", same("before"), same("after"))
    return found.mapInArrow(choose, "host string, path string, other string").where("other IS NOT NULL")


def _checked(marks: bytes, gone: list[bool]) -> list[bool]:
    """Which lines stay once markup has been held against those that the alignment deletes."""
    if ARTICLE in marks:
        return [m == ARTICLE for m in marks]
    return [m == PLAIN and not g for m, g in zip(marks, gone)]


def main_text(pages: DataFrame, with_counts: bool = False) -> DataFrame:
    """``(page_id, url, text)`` of every row of ``pages(page_id, url, html, ...)``.

    Null and empty html give an empty text.  Every page is compared with the neighbour, in order of
    path, that shares the longer start of the path (the one before if both do); a page alone on its host, or without host,
    shares no line.  Pages at the same path, repeated rows too, are not compared, as they would delete each other; of a
    neighbour path with several pages the one with the smallest hashes is compared.
    ``with_counts`` adds ``n_lines``, ``n_shared`` (lines that the alignment deletes), ``n_restored`` (of those, lines of an
    article, put back) and ``n_dropped`` (lines that the alignment leaves and markup takes away).
    Other columns are ignored; an empty table gives no row.
    """
    placed = _placed(pages)
    hosted = placed.where("host <> ''")
    # lines are read twice, once as hashes and once with texts: texts would otherwise be stored and shuffled as well
    paths = page_lines(hosted, with_texts=False).groupBy("host", "path").agg(F.min(F.struct("hashes")).alias("one"))
    beside = paths.select("host", F.col("path").alias("other"), F.col("one.hashes").alias("other_hashes"))
    found = partners(placed).join(beside, ["host", "other"]).drop("other")
    compared = page_lines(hosted).join(found, ["host", "path"], "left")
    alone = page_lines(placed.where("host = ''")).withColumn("other_hashes", F.lit(None).cast("array<long>"))
    wanted = ["page_id", "url", "hashes", "other_hashes", "marks", "packed"]
    counts = ["n_lines", "n_shared", "n_restored", "n_dropped"] if with_counts else []

    def difference(batches):
        for batch in batches:
            texts, numbers = [], []
            for own, other, marks, packed in zip(*(batch.column(c).to_pylist() for c in wanted[2:])):
                gone = shared_with(own, other) if other is not None else [False] * len(own)
                stays = _checked(marks, gone)
                kept = zlib.decompress(packed).decode().split("\n")
                texts.append(" ".join(t for t, s in zip(kept, (s for s, m in zip(stays, marks) if m != DROPPED)) if s))
                n_left = sum(s and not g for s, g in zip(stays, gone))
                numbers.append((len(own), sum(gone), sum(stays) - n_left, len(own) - sum(gone) - n_left))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
            columns += [pa.array([n[k] for n in numbers], pa.int64()) for k in range(len(counts))]
            yield pa.record_batch(columns, ["page_id", "url", "text", *counts])

    schema = ", ".join(["page_id long, url string, text string", *(f"{c} long" for c in counts)])
    return compared.select(*wanted).unionByName(alone.select(*wanted)).mapInArrow(difference, schema)
