"""CSV logs: header aliases -> canonical columns (a plan-time mapping, no data action)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog import constants as K
from emberlog.sources.split_csv import read_split_csv
from emberlog.sources.text_logs import REPLACEMENT, require_rows, resolve_timestamps


def read_csv_rows(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """Every column as text, cells that mean "no value" as null.

    Large files are split.  ``multi_line=True`` reads line breaks inside cells, in splits too; ``line_no`` is then
    the number of the record whatever the splits.
    """
    if multi_line:
        rows = read_split_csv(spark, path)
    else:
        rows = spark.read.option("header", True).option("escape", '"').csv(path)
        rows = rows.withColumn("line_no", F.monotonically_increasing_id())
    cells = []
    for name in rows.columns[:-1]:
        text = F.translate(F.col(f"`{name}`"), REPLACEMENT, "")
        cells.append(F.when(~text.isin(*K.CSV_NULL_TEXTS), text).alias(name))
    return rows.select(*cells, "line_no")


def map_headers(names) -> dict[str, str]:
    """Canonical column -> header that feeds it."""
    present = {name.strip().lower(): name for name in names}
    found = {}
    for target, aliases in K.CSV_ALIASES.items():
        source = next((present[a] for a in aliases if a in present), None)
        if source is not None:
            found[target] = source
    missing = [name for name in K.CSV_REQUIRED if name not in found]
    if missing:
        raise ValueError(
            "CSV is missing required column(s): " + ", ".join(missing)
            + ". Expected at least a timestamp and a message column."
        )
    return found


def canonicalise(rows: DataFrame) -> DataFrame:
    """Rename by alias and fill the columns every log row must have."""
    headers = map_headers([c for c in rows.columns if c != "line_no"])
    source = {target: F.col(f"`{name}`").cast("string") for target, name in headers.items()}
    default = {"hostname": "unknown", "service": "unknown", "message": ""}
    columns = [F.col("line_no"), source["timestamp"].alias("time_text")]
    for name, value in default.items():
        column = source.get(name, F.lit(None).cast("string"))
        columns.append(F.coalesce(column, F.lit(value)).alias(name))
    columns.append(F.lit(None).cast("string").alias("pid"))
    if "raw_event_type" in source:
        columns.append(source["raw_event_type"].alias("raw_event_type"))
    if "dbscan_cluster" in source:
        columns.append(source["dbscan_cluster"].try_cast("double").cast("int").alias("dbscan_cluster"))
    if "label" in source:
        columns.append(source["label"].alias("label"))
    return rows.select(*columns)


def csv_to_logs(rows: DataFrame, mode: str = "per_row", assume_year: int = 1900) -> DataFrame:
    resolved = resolve_timestamps(canonicalise(rows), mode, assume_year)
    return resolved.where(F.col("timestamp").isNotNull()).drop("time_text")


def read_csv_logs(
    spark: SparkSession,
    path,
    mode: str = "per_row",
    assume_year: int = 1900,
    multi_line: bool = False,
    strict: bool = False,
) -> DataFrame:
    """CSV exports -> canonical log rows."""
    rows = read_csv_rows(spark, path, multi_line)
    if strict:
        require_rows(resolve_timestamps(canonicalise(rows), mode, assume_year))
    return csv_to_logs(rows, mode, assume_year)
