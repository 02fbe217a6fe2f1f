"""Filters, sorts, top-k lists and counts over the scored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberlog import constants as K
from emberlog.functions.text import contains_text
from emberlog.functions.timing import bin_seconds, floor_seconds
from emberlog.operators.ordering import with_row_index
from emberlog.session import store

SEARCHED = ("message", "service", "event_id", "src_host", "target_user")
SORTS = {
    "Newest first": ("timestamp", False),
    "Oldest first": ("timestamp", True),
    "Highest risk": ("risk_score", False),
    "Lowest risk": ("risk_score", True),
}


def anomalous() -> Column:
    return F.col("status") == "ANOMALY"


# ---------------------------------------------------------------- filters
def search(events: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive literal search over message, service, id, source and account."""
    return events.where(contains_text(needle, *SEARCHED)) if needle else events


def matching(events: DataFrame, services=(), severities=(), classes=()) -> DataFrame:
    """Multi-value filters; an empty list does not restrict."""
    for name, wanted in (("service", services), ("severity", severities), ("event_class", classes)):
        if wanted:
            events = events.where(F.col(name).isin(*wanted))
    return events


def with_status(events: DataFrame, status: str = "All") -> DataFrame:
    wanted = {"Anomalies only": "ANOMALY", "Normal only": "NORMAL"}.get(status)
    return events.where(F.col("status") == wanted) if wanted else events


def in_time_range(events: DataFrame, choice: str) -> DataFrame:
    """Events newer than the newest event minus the range (strictly).

    On a table partitioned by ``date`` the bound also prunes folders.
    """
    if choice not in K.TIME_RANGES:
        return events
    newest = events.agg(F.max("timestamp").alias("t"))
    start = newest.select(F.col("t") - F.make_dt_interval(secs=F.lit(K.TIME_RANGES[choice]))).scalar()
    recent = events.where(F.col("timestamp") > start)
    return recent.where(F.col("date") >= F.to_date(start)) if "date" in events.columns else recent


def high_risk(events: DataFrame) -> DataFrame:
    return events.where(anomalous() & F.col("severity").isin("HIGH", "CRITICAL"))


def by_id(events: DataFrame, typed: str) -> DataFrame:
    return events.where(F.col("event_id") == typed.strip().upper())


# ------------------------------------------------------------ sorts, top-k
def sort_events(events: DataFrame, name: str, position: str = "row_idx") -> DataFrame:
    """Named sort; equal values keep their time order."""
    column, ascending = SORTS[name]
    key = F.col(column).asc() if ascending else F.col(column).desc()
    return events.orderBy(key, position)


def with_position(events: DataFrame, name: str, position: str = "row_idx") -> DataFrame:
    """All events with their 1-based ``position`` in a named order, found without one sorting task."""
    column, ascending = SORTS[name]
    key = F.col(column).asc() if ascending else F.col(column).desc()
    placed = with_row_index(events, key, F.col(position), name="_place", keep=store)
    return placed.withColumn("position", F.col("_place") + 1).drop("_place")


def triage_queue(events: DataFrame, limit: int = 300, position: str = "row_idx") -> DataFrame:
    """Anomalies, highest risk first."""
    return sort_events(events.where(anomalous()), "Highest risk", position).limit(limit)


def top_values(events: DataFrame, column: str, limit: int) -> DataFrame:
    """Most frequent non-null values; equal counts in text order."""
    return (
        events.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("events"))
        .orderBy(F.col("events").desc(), column)
        .limit(limit)
    )


def top_anomalous(events: DataFrame, column: str, limit: int = 8) -> DataFrame:
    return top_values(events.where(anomalous()), column, limit)


def top_failing_sources(events: DataFrame, limit: int = 8) -> DataFrame:
    """Sources of anomalous authentication failures."""
    failing = events.where(anomalous() & (F.col("event_class") == "AUTH_FAIL"))
    return top_values(failing, "src_host", limit)


# ----------------------------------------------------------------- counts
def kpis(events: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: totals, rate, high-risk count and number of services."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    counted = events.agg(
        F.count("*").alias("total"),
        F.count_if(anomalous()).alias("anomalies"),
        F.count_if(anomalous() & F.col("severity").isin("HIGH", "CRITICAL")).alias("high_risk"),
        distinct("service").alias("services"),
    )
    rate = F.when(F.col("total") > 0, F.round(F.col("anomalies") / F.col("total") * 100, 2))
    return counted.withColumns(
        {
            "normal": F.col("total") - F.col("anomalies"),
            "anomaly_rate_pct": F.coalesce(rate, F.lit(0.0)),
        }
    )


def severity_counts(events: DataFrame) -> DataFrame:
    """Anomalies per severity with every band present, and each band's share."""
    flagged = events.where(anomalous())
    bands = [F.count_if(F.col("severity") == band).alias(band) for band in K.SEVERITIES]
    one = flagged.agg(F.count("*").alias("_all"), *bands)
    rows = F.array(*[F.struct(F.lit(b).alias("severity"), F.col(b).alias("events")) for b in K.SEVERITIES])
    listed = one.select("_all", F.explode(rows).alias("r")).select("r.*", "_all")
    share = F.when(F.col("_all") > 0, F.round(F.col("events") / F.col("_all") * 100, 2))
    return listed.select("severity", "events", F.coalesce(share, F.lit(0.0)).alias("share_pct"))


def status_shares(events: DataFrame) -> DataFrame:
    """Normal and anomalous events with their share."""
    one = events.agg(F.count("*").alias("_all"), F.count_if(anomalous()).alias("_anomalous"))
    rows = F.array(
        F.struct(F.lit("NORMAL").alias("status"), (F.col("_all") - F.col("_anomalous")).alias("events")),
        F.struct(F.lit("ANOMALY").alias("status"), F.col("_anomalous").alias("events")),
    )
    listed = one.select("_all", F.explode(rows).alias("r")).select("r.*", "_all")
    share = F.when(F.col("_all") > 0, F.round(F.col("events") / F.col("_all") * 100, 2))
    return listed.select("status", "events", F.coalesce(share, F.lit(0.0)).alias("share_pct"))


def trend_bin(events: DataFrame) -> DataFrame:
    """One row: the bin width in seconds that suits the time span."""
    span = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6
    return events.agg(span.alias("span")).select(
        F.coalesce(bin_seconds(F.col("span")), F.lit(3600)).cast("long").alias("bin_seconds")
    )


def trend(events: DataFrame) -> DataFrame:
    """Normal and anomalous events per adaptive time bin."""
    width = trend_bin(events).scalar()
    return (
        events.groupBy(floor_seconds(F.col("timestamp"), width).alias("bin"))
        .agg(
            F.count_if(F.col("status") == "NORMAL").alias("normal"),
            F.count_if(anomalous()).alias("anomaly"),
        )
    )
