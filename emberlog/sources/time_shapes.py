"""Lenient timestamps by a dictionary of shapes.

The text of a time is reduced to its shape: digits become 9, names of months
``Mon`` or ``Month``, halves of the day ``PM``, zones ``Z``.  Spark groups the
shapes, one format is inferred for each distinct shape, and the formats are
joined back.  Only shapes with a format are joined, and those are few: the
spellings below in all their combinations, about a thousand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.functions.text import FLAGS

# --- fixed values: names as they are written -----------------------------------
_SHORT = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_LONG = "january|february|march|april|june|july|august|september|october|november|december"
_DAYS = "mon|tue|wed|thu|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday"

_DATES = (
    (r"9999([-/. ])9\1(9)", ("yyyy{0}M{0}d",)),
    (r"9([-/. ])9\1(9999)", ("M{0}d{0}yyyy", "d{0}M{0}yyyy")),  # month first unless it can't be one
    (r"9([-/. ])(Mon|Month)\1(9999)", ("d{0}{1}{0}yyyy",)),
    (r"9999([-/. ])(Mon|Month)\1(9)", ("yyyy{0}{1}{0}d",)),
    (r"(Mon|Month) 9(,?) 9999", ("{0} d{1} yyyy",)),
    (r"9 (Mon|Month),( )9999", ("d {0}, yyyy",)),
    (r"(99999999)()", ("yyyyMMdd",)),
)
_TIMES = ((r"9:9:9", "{h}:m:s"), (r"9:9", "{h}:m"), (r"9:9:9\.9", "{h}:m:s.SSSSSS"), (r"9(?= PM)", "{h}"), (r"999999", "HHmmss"))
_MONTH = {"Mon": "MMM", "Month": "MMMM"}


def tidy(text: Column) -> Column:
    """One space between words, no weekday, fractions of up to six digits after a point, zones as ``+hh:mm``."""
    steps = (
        (FLAGS + r"\s+", " "),
        (r"^ | $", ""),
        (rf"(?i)^(?:{_DAYS})[,.]? ", ""),
        (r"(:\d{1,2})[.,](\d{1,6})\d*", "$1.$2"),
        (r"(?i)(\d) ?(?:Z|UTC|GMT)(?=$| )", "$1 +00:00"),
        (r"(:\d{1,2}(?:\.\d+)?|[AaPp][Mm]) ?([+-]\d{2}):?(\d{2})(?=$| )", "$1 $2:$3"),
        (r"(?i)(\d) ?([ap])\.?m\.?(?=$| )", "$1 $2M"),
        (r"(\d)T(\d)", "$1 $2"),
        (r"^(\d{1,2}/[A-Za-z]{3}/\d{4}):", "$1 "),
    )
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def shape(tidied: Column) -> Column:
    """Shape of a tidied text; digits are told apart by how many stand together: up to 2, 4, 6 or 8."""
    steps = (
        (r" [+-]\d{2}:\d{2}(?=$| )", " Z"),
        (r"(?<=\.)\d{1,6}(?!\d)(?=$| Z| [aApP]M)(?<=:\d{1,2}\.\d{1,6})", "9"),
        (rf"(?i)(?<![a-z])(?:{_LONG})(?![a-z])", "Month"),
        (rf"(?i)(?<![a-z])(?:{_SHORT})(?![a-z])", "Mon"),
        (r"(?i)(?<= )[ap]M(?=$| )", "PM"),
        (r"(?<!\d)\d{1,2}(?!\d)", "9"),
        (r"(?<!\d)\d{4}(?!\d)", "9999"),
        (r"(?<!\d)\d{6}(?!\d)", "999999"),
        (r"(?<!\d)\d{8}(?!\d)", "99999999"),
        (r"(?<!9)[0-8]\d*|(?<!\d)9+[0-8]\d*", "0"),
    )
    for pattern, new in steps:
        tidied = F.regexp_replace(tidied, pattern, new)
    return tidied


def formats_of(found: str) -> list[str]:
    """Datetime patterns to try in turn for a shape; none if it is no known spelling of a time."""
    rest, zone, half, trailing_year = found, "", "", ""
    if re.search(r":.* 9999$", rest) and re.match(r"(?:Mon|Month) ", rest):  # the year comes last
        rest, trailing_year = rest[: -len(" 9999")], " yyyy"
    if rest.endswith(" Z"):
        rest, zone = rest[:-2], " XXX"
    time = ""
    for pattern, form in _TIMES:
        m = re.search(rf"(?:^|,? ){pattern}( PM)?$", rest)
        if m and (m.start() > 0 or m.group().startswith(" ")):
            hour = "h" if m.group(1) else "H"
            half = " a" if m.group(1) else ""
            gap = re.match(r",? ", m.group()).group()
            time = gap + form.format(h=hour) + half
            rest = rest[: m.start()]
            break
    if zone and not time:
        return []
    out = []
    for pattern, forms in _DATES:
        m = re.fullmatch(pattern, rest)
        if m and not trailing_year:
            parts = [_MONTH.get(g, g) for g in m.groups()]
            out += [form.format(*parts) + time + zone for form in forms]
    m = re.fullmatch(r"(Mon|Month) 9", rest)
    if m and time:  # no year, or the year comes last
        out.append(f"{'' if trailing_year else 'yyyy '}{_MONTH[m.group(1)]} d{time}{zone}{trailing_year}")
    return out


def _inferred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        formats = [formats_of(s) for s in batch["shape"]]
        known = [i for i, f in enumerate(formats) if f]
        yield pd.DataFrame(
            {
                "shape": batch["shape"].to_numpy()[known],
                "first_format": [formats[i][0] for i in known],
                "second_format": [formats[i][1] if len(formats[i]) > 1 else None for i in known],
            }
        )


def dictionary(shapes: DataFrame) -> DataFrame:
    """(shape, first_format, second_format) of the distinct shapes that are times."""
    schema = "shape string, first_format string, second_format string"
    return shapes.select("shape").where("shape IS NOT NULL").distinct().mapInPandas(_inferred, schema)


def lenient_timestamps(rows: DataFrame, text: str = "time_text", assume_year: int = 1900) -> DataFrame:
    """``rows`` with ``timestamp``, null where ``text`` is no known spelling or no real time.

    Texts without a year take ``assume_year``; of two numbers that may be
    month and day the first is the month unless it is over 12; texts with a
    zone become that instant.
    """
    shaped = rows.withColumn("_tidy", tidy(F.col(text))).withColumn("shape", shape(F.col("_tidy")))
    found = shaped.join(F.broadcast(dictionary(shaped)), "shape", "left")
    dated = F.when(F.col("first_format").startswith("yyyy MMM") & F.col("_tidy").rlike("^[A-Za-z]"), F.concat(F.lit(f"{assume_year} "), "_tidy"))
    dated = dated.otherwise(F.col("_tidy"))
    first, second = F.try_to_timestamp(dated, F.col("first_format")), F.try_to_timestamp(dated, F.col("second_format"))
    return found.withColumn("timestamp", F.coalesce(first, second)).select(*rows.columns, "timestamp")
