"""Export shapes and writers.  Writers leave one file per task; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog.functions.timing import format_time

EXPLORER_COLUMNS = (
    "event_id", "timestamp", "hostname", "service", "event_class", "severity", "status", "risk_score", "message",
)
REPORT_COLUMNS = (
    "event_id", "timestamp", "hostname", "service", "event_class", "severity", "status", "risk_score",
    "src_host", "target_user", "message",
)


def export_frame(events: DataFrame, columns=REPORT_COLUMNS, has_year=True) -> DataFrame:
    """The given columns with the time as text."""
    shown = events.select(*columns)
    return shown.withColumn("timestamp", format_time(F.col("timestamp"), has_year))


def anomaly_export(events: DataFrame, has_year=True) -> DataFrame:
    return export_frame(events.where(F.col("status") == "ANOMALY"), REPORT_COLUMNS, has_year)


def explorer_export(events: DataFrame, has_year=True) -> DataFrame:
    return export_frame(events, EXPLORER_COLUMNS, has_year)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_events(events: DataFrame, path: str) -> None:
    """Parquet by day, so time filters prune folders."""
    events.withColumn("date", F.to_date("timestamp")).write.mode("overwrite").partitionBy(
        "date"
    ).parquet(path)


def write_text(report: DataFrame, path: str, column: str = "report") -> None:
    report.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
