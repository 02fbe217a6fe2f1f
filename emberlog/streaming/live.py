"""The stateless and windowed parts of the batch plan on an unbounded input.

The same column functions as in batch; only the time bound is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.operators.features import clean
from emberlog.params import DEFAULTS, Params
from emberlog.sources.text_logs import parse_lines, resolve_timestamps, to_logs


def read_raw_stream(spark: SparkSession, path: str, mode: str = "per_row", assume_year: int = 1900) -> DataFrame:
    """Text files arriving in a folder -> log rows as ``analyze`` and ``score_unseen`` take them.

    ``mode`` cannot be ``reference``: that rule looks at the whole input.
    """
    if mode == "reference":
        raise ValueError("a stream has no whole input to look at; use per_row, classic or iso")
    lines = spark.readStream.text(path).withColumn("line_no", F.lit(None).cast("long"))
    return to_logs(resolve_timestamps(parse_lines(lines), mode, assume_year))


def read_log_stream(spark: SparkSession, path: str, mode: str = "per_row", assume_year: int = 1900) -> DataFrame:
    """Text files arriving in a folder -> cleaned log rows."""
    return clean(read_raw_stream(spark, path, mode, assume_year))


def burst_counts(rows: DataFrame, params: Params = DEFAULTS, late: str = "10 minutes") -> DataFrame:
    """Events per service, class and time window; a window closes ``late`` after its end."""
    window = F.window("timestamp", f"{params.window_minutes} minutes")
    return (
        rows.withWatermark("timestamp", late)
        .groupBy(window, "service", "event_class")
        .agg(F.count("*").alias("burst"))
        .select(F.col("window.start").alias("window_start"), "service", "event_class", "burst")
    )


def auth_bursts(rows: DataFrame, params: Params = DEFAULTS, late: str = "10 minutes") -> DataFrame:
    """Closed windows with at least ``burst_threshold`` authentication failures of one service."""
    counted = burst_counts(rows.where(F.col("event_class") == "AUTH_FAIL"), params, late)
    return counted.where(F.col("burst") >= params.burst_threshold)
