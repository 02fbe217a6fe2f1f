"""Syslog text: lines -> fields -> canonical log rows, with reject accounting.

The stages are separate transforms so each one can be queried:

    read_text_lines -> parse_lines -> resolve_timestamps -> to_logs
                                                         \\-> rejected_lines
                                                         \\-> parse_report
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlog import constants as K
from emberlog.functions.text import FLAGS, WHITESPACE
from emberlog.sources.positions import numbered_lines
from emberlog.sources.time_shapes import lenient_timestamps

REPLACEMENT = "\ufffd"  # what the reader puts in place of bytes that are not UTF-8
LOG_COLUMNS = ("line_no", "timestamp", "hostname", "service", "pid", "message")

# Other spellings tried once the ISO cast has failed.
OTHER_TIME_FORMATS = (
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "MMM d yyyy H:mm:ss",
    "d MMM yyyy H:mm:ss",
    "d/MMM/yyyy:H:mm:ss",
    "MMM d H:mm:ss yyyy",
)
WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? "


def read_text_lines(spark: SparkSession, path, stable: bool = False) -> DataFrame:
    """One row per line; bytes that are not UTF-8 are dropped from the text.

    ``line_no`` ascends in each file; with ``stable`` it counts lines, whatever the splits.
    """
    if stable:
        lines = numbered_lines(spark, path)
    else:
        lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return lines.select("line_no", F.translate(F.col("value"), REPLACEMENT, "").alias("value"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Split each non-blank line into fields; ``matched`` tells whether it had a known shape.

    One regex pass per format: the match is rewritten as newline-separated
    fields, and a single line can hold no newline of its own.  The fields go
    through ``explode`` (of one element) so that later filters on them are not
    pushed down into repeated copies of the regexes.
    """
    fields = "\n$1\n$2\n$3\n$4\n$5"
    text = F.rtrim(F.col("value"), F.lit(WHITESPACE))
    classic = F.regexp_replace("_line", FLAGS + K.SYSLOG_LINE, fields)
    iso = F.regexp_replace("_line", FLAGS + K.ISO_LINE, fields)
    either = F.when(F.col("_classic").startswith("\n"), F.col("_classic")).otherwise(iso)
    rows = (
        lines.withColumn("_line", text)
        .where(F.col("_line") != "")
        .withColumn("_classic", classic)
        .select("line_no", "_line", F.explode(F.array(F.split(either, "\n", 6))).alias("_part"))
        .withColumn("matched", F.size("_part") > 1)
    )
    part = lambda i: F.get(F.col("_part"), F.lit(i))
    return rows.select(
        "line_no",
        F.col("_line").alias("line"),
        "matched",
        part(1).alias("time_text"),
        part(2).alias("hostname"),
        part(3).alias("service"),
        F.nullif(part(4), F.lit("")).alias("pid"),
        part(5).alias("message"),
    )


def classic_time(text: Column, year: int = 1900) -> Column:
    """``Jun 9 06:06:20`` in the assumed year, null when it does not parse."""
    return F.try_to_timestamp(F.concat(F.lit(f"{year} "), text), F.lit("yyyy MMM d H:mm:ss"))


def flexible_time(text: Column) -> Column:
    """ISO and other common spellings, null when none parses."""
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}"), text.try_cast("timestamp"))
    dated = F.regexp_replace(text, WEEKDAY, "")
    return F.coalesce(iso, *[F.try_to_timestamp(dated, F.lit(f)) for f in OTHER_TIME_FORMATS])


def resolve_timestamps(rows: DataFrame, mode: str = "per_row", assume_year: int = 1900) -> DataFrame:
    """Turn ``time_text`` into ``timestamp``.

    ``reference``  the yearless format, unless more than half of the rows fail
                   it; then every row goes through the flexible formats
    ``per_row``    each row takes whichever format parses
    ``classic`` / ``iso``  one format, no second look at the data
    ``lenient``    each row takes the format inferred for the shape of its text
    """
    if mode == "lenient":
        return lenient_timestamps(rows, assume_year=assume_year)
    text = F.regexp_replace(F.col("time_text"), FLAGS + r"\s+", " ")
    classic, flexible = classic_time(text, assume_year), flexible_time(text)
    if mode == "classic":
        chosen = classic
    elif mode == "iso":
        chosen = flexible
    elif mode == "per_row":
        chosen = F.coalesce(classic, flexible)
    elif mode == "reference":
        present = rows.where("matched") if "matched" in rows.columns else rows
        failed = present.agg(F.avg(classic.isNull().cast("int")).alias("share")).scalar()
        chosen = F.when(failed > 0.5, flexible).otherwise(classic)
    else:
        raise ValueError(f"unknown timestamp mode {mode!r}")
    return rows.withColumn("timestamp", chosen)


def to_logs(rows: DataFrame) -> DataFrame:
    """Canonical rows only: matched lines with a valid timestamp."""
    return rows.where(F.col("timestamp").isNotNull()).select(*LOG_COLUMNS)


def rejected_lines(rows: DataFrame) -> DataFrame:
    """Lines that did not become events, with the reason."""
    reason = F.when(~F.col("matched"), F.lit("unrecognised line")).otherwise(
        F.lit("invalid timestamp")
    )
    return rows.where(F.col("timestamp").isNull()).select("line_no", "line", reason.alias("reason"))


def parse_report(rows: DataFrame, **source) -> DataFrame:
    """One row: what was read, parsed and dropped, and the time span.

    ``source`` adds literal facts such as ``filename`` or ``size_kb``.
    """
    ts = F.col("timestamp")
    facts = rows.agg(
        F.count("*").alias("total_lines"),
        F.count(ts).alias("parsed_rows"),
        F.min(ts).alias("time_start"),
        F.max(ts).alias("time_end"),
    )
    total, parsed = F.col("total_lines"), F.col("parsed_rows")
    return facts.select(
        *[F.lit(v).alias(k) for k, v in source.items()],
        "total_lines",
        "parsed_rows",
        (total - parsed).alias("dropped_rows"),
        F.round(parsed / F.greatest(total, F.lit(1)) * 100, 1).alias("parse_rate_pct"),
        F.coalesce(F.year("time_start") > 1970, F.lit(False)).alias("has_year"),
        "time_start",
        "time_end",
    )


def source_size_kb(spark: SparkSession, path) -> DataFrame:
    """Total size of the input files; reads the listing, not the content."""
    files = spark.read.format("binaryFile").load(path)
    return files.agg(F.round(F.sum("length") / 1024, 2).alias("size_kb"))


def read_text_logs(
    spark: SparkSession, path, mode: str = "per_row", assume_year: int = 1900, strict: bool = False, stable: bool = False
) -> DataFrame:
    """Files or folders of syslog text -> canonical log rows."""
    rows = resolve_timestamps(parse_lines(read_text_lines(spark, path, stable)), mode, assume_year)
    if strict:
        require_rows(rows)
    return to_logs(rows)


def require_rows(rows: DataFrame) -> None:
    """Raise when the input holds no usable line (looks at one row, not all)."""
    if "matched" in rows.columns and rows.where("matched").isEmpty():
        raise ValueError(
            "No lines matched a Linux syslog format, e.g. "
            "'Jun  9 06:06:20 host sshd(pam_unix)[123]: authentication failure ...'."
        )
    if rows.where(F.col("timestamp").isNotNull()).isEmpty():
        raise ValueError("No rows with a valid timestamp were found in this input.")
