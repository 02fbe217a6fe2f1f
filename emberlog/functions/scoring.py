"""Column functions that turn detector signals into status, risk and severity.

Expected columns: ``event_class service burst tmpl_freq dbscan_noise
iforest_noise model_prob`` (see ``emberlog.operators.features`` and the
detectors).
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, functions as F

from emberlog import constants as K


def lookup(key: Column, table: Mapping[str, float], default: float) -> Column:
    """Literal dimension map, cheaper than any join."""
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(entries[key], F.lit(default))


def is_anomaly() -> Column:
    return F.col("dbscan_noise") | F.col("iforest_noise")


def status() -> Column:
    return F.when(is_anomaly(), F.lit("ANOMALY")).otherwise(F.lit("NORMAL"))


def detection_method(none: str = K.METHOD_NONE) -> Column:
    noise, forest = F.col("dbscan_noise"), F.col("iforest_noise")
    return (
        F.when(noise & forest, F.lit(K.METHOD_BOTH))
        .when(noise, F.lit(K.METHOD_DBSCAN))
        .when(forest, F.lit(K.METHOD_FOREST))
        .otherwise(F.lit(none))
    )


def auth_burst(threshold: int) -> Column:
    return (F.col("event_class") == "AUTH_FAIL") & (F.col("burst") >= threshold)


def _clip(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def event_weight(weights: Mapping[str, float] = K.EVENT_WEIGHTS) -> Column:
    return lookup(F.col("event_class"), weights, K.DEFAULT_EVENT_WEIGHT)


def service_sensitivity(sensitivity: Mapping[str, float] = K.SERVICE_SENSITIVITY) -> Column:
    return lookup(F.col("service"), sensitivity, K.DEFAULT_SENSITIVITY)


def risk_terms(max_template: Column) -> dict[str, Column]:
    """Unweighted 0..1 terms; ``max_template`` is the largest template count."""
    burst = F.log1p(F.col("burst") - 1) / F.log1p(F.lit(K.BURST_SATURATION))
    top = F.log1p(F.greatest(max_template, F.lit(1)))
    return {
        "event": event_weight(),
        "service": service_sensitivity(),
        "burst": _clip(burst),
        "rarity": 1 - F.log1p(F.col("tmpl_freq")) / top,
        "dbscan": F.col("dbscan_noise").cast("double"),
        "forest": F.col("model_prob"),
    }


def risk_score(max_template: Column) -> Column:
    terms = risk_terms(max_template)
    total = F.lit(0.0)
    for name, weight in K.RISK_WEIGHTS.items():
        total = total + F.lit(weight) * terms[name]
    # nine places first: sums that differ in the last bit then round alike
    return F.round(F.round(_clip(total), 9), 3)


def severity(risk: str = "risk_score", status_column: str = "status") -> Column:
    """Band of the risk score; a NORMAL row is never above MEDIUM."""
    value = F.col(risk)
    demoted = F.col(status_column) == "NORMAL"
    case = F
    for band, floor in K.SEVERITY_THRESHOLDS.items():
        shown = F.lit(band)
        if band in ("CRITICAL", "HIGH"):
            shown = F.when(demoted, F.lit("MEDIUM")).otherwise(shown)
        case = case.when(value >= floor, shown)
    return case.otherwise(F.lit("LOW"))


def short_reason() -> Column:
    noise, forest = F.col("dbscan_noise"), F.col("iforest_noise")
    before, after = K.REASON_RARE.split("{count}")
    rare = F.concat(F.lit(before), F.col("tmpl_freq").cast("string"), F.lit(after))
    return (
        F.when(noise & forest, F.lit(K.REASON_BOTH))
        .when(forest, F.lit(K.REASON_FOREST))
        .when(noise & (F.col("tmpl_freq") <= K.RARE_TEMPLATE_COUNT), rare)
        .when(noise, F.lit(K.REASON_DBSCAN))
        .otherwise(F.lit(""))
    )


def ground_truth(label) -> Column:
    """1 / 0 for a recognised spelling, otherwise null."""
    text = F.lower((F.col(label) if isinstance(label, str) else label).cast("string"))
    return F.when(text.isin(*K.POSITIVE_LABELS), F.lit(1)).when(
        text.isin(*K.NEGATIVE_LABELS), F.lit(0)
    )
