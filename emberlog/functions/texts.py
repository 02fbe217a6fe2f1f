"""Fill text templates with columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F


def fill(template: str, **values) -> Column:
    """``"{n} rows"`` with ``n=column`` as one concatenation; null if a value is null."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            value = values[name]
            parts.append(value.cast("string") if isinstance(value, Column) else F.lit(str(value)))
    return F.concat(*parts)


def with_commas(number: Column) -> Column:
    return F.format_number(number, 0)


def two_places(number: Column) -> Column:
    """A three-decimal score shown with two, rounded half up in decimal arithmetic."""
    return F.round(number.cast("decimal(12,3)"), 2).cast("decimal(12,2)").cast("string")


def present(*items: Column) -> Column:
    """Array of the items that are not null, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def numbered(items: Column) -> Column:
    """``1. first``, ``2. second`` ... one per line."""
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.array_join(lines, "\n")


def bulleted(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
