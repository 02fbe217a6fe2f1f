"""Column functions on event time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from emberlog import constants as K


def floor_seconds(ts: Column, seconds) -> Column:
    """Epoch-aligned floor in integer arithmetic; right before 1970 as well."""
    micros = F.unix_micros(ts)
    step = (F.lit(seconds) if isinstance(seconds, int) else seconds).cast("long") * F.lit(1_000_000)
    return F.timestamp_micros(micros - F.pmod(micros, step))


def window_start(ts, minutes: int) -> Column:
    return floor_seconds(F.col(ts) if isinstance(ts, str) else ts, minutes * 60)


def format_time(ts: Column, has_year) -> Column:
    """Timestamps without a known year never show one."""
    flag = F.lit(has_year) if isinstance(has_year, bool) else has_year
    shown = F.when(flag, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(ts, "MMM dd HH:mm:ss")
    )
    return F.coalesce(shown, F.lit("—"))


def bin_seconds(span_seconds: Column) -> Column:
    """Trend bin width: the first allowed step that keeps about 48 bins."""
    step = F.greatest(span_seconds / F.lit(K.BIN_TARGET), F.lit(60.0))
    case = F
    for width in K.BIN_STEPS:
        case = case.when(step <= width, F.lit(width))
    return case.otherwise(F.lit(K.BIN_STEPS[-1]))
