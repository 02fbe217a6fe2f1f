"""Texts for analysts, built for whole tables of events at once.

Input: events with ``headline``, ``evidence`` and ``actions`` from
``emberlog.operators.explain``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberlog import constants as K
from emberlog.functions.text import redact
from emberlog.functions.texts import bulleted, fill, numbered, present, two_places

IDENTIFIERS = ("hostname", "src_host", "target_user")


def active_signals() -> tuple[Column, Column, Column]:
    """(dbscan, forest, burst) signals of an event."""
    method = F.coalesce(F.col("detection_method"), F.lit(""))
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    return (
        flag("dbscan_noise") | method.contains("DBSCAN"),
        flag("iforest_noise") | method.contains("Isolation Forest"),
        flag("auth_burst"),
    )


def signal_details() -> Column:
    """Sentences on the signals that contributed to the event."""
    density, forest, burst = active_signals()
    count, size = F.col("tmpl_freq"), F.col("burst")
    rare = density & (count > 0) & (count <= K.RARE_TEMPLATE_COUNT)
    return present(
        F.when(density, F.lit(K.DETAIL_DBSCAN)),
        F.when(rare, fill(K.DETAIL_RARE, count=count)),
        F.when(forest, F.lit(K.DETAIL_FOREST)),
        F.when(
            burst,
            F.when(size > 0, fill(K.DETAIL_BURST, count=size)).otherwise(F.lit(K.DETAIL_BURST_UNSIZED)),
        ),
    )


def relevant_evidence(items: str = "evidence") -> Column:
    """Evidence without the sentences on signals that are not active."""
    density, forest, burst = active_signals()
    keep = lambda x: (
        (density | ~x.contains("DBSCAN"))
        & (forest | ~x.contains("Isolation Forest"))
        & (burst | ~x.contains("Burst rule"))
    )
    return F.filter(F.col(items), keep)


def priority(table: dict[str, str], other: str) -> Column:
    band = F.upper(F.coalesce("severity", F.lit("UNKNOWN")))
    case = F
    for name, text in table.items():
        case = case.when(band == name, F.lit(text))
    return case.otherwise(F.lit(other))


def redacted_evidence(items: str = "evidence") -> Column:
    """Relevant evidence with host, source and account values blanked."""
    return F.transform(relevant_evidence(items), lambda x: redact(x, *IDENTIFIERS))


def event_facts() -> Column:
    """Facts without identifiers or raw text; what is missing is called unknown."""
    text = lambda c: _or(F.col(c), "unknown")
    shown_time = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit("unknown"))
    return F.concat_ws(
        "\n",
        fill("Event ID: {v}", v=text("event_id")),
        fill("Timestamp: {v}", v=shown_time),
        fill("Service: {v}", v=text("service")),
        fill("Event class: {v}", v=text("event_class")),
        fill("Severity: {v}", v=text("severity")),
        fill("Risk score: {v}/1.00", v=F.coalesce(two_places(F.col("risk_score")), F.lit("unknown"))),
        F.lit(K.FACTS_WITHHELD),
    )


def _or(value: Column, fallback: str) -> Column:
    return F.when(value.isNull() | (value == ""), F.lit(fallback)).otherwise(value)


def event_summary() -> Column:
    """The full analyst note of an event."""
    c = F.col
    shown_evidence = relevant_evidence()
    shown_evidence = F.when(F.size(shown_evidence) > 0, shown_evidence).otherwise(
        F.array(F.lit(K.EVIDENCE_FALLBACK))
    )
    shown_actions = F.when(F.size("actions") > 0, F.col("actions")).otherwise(
        F.array(F.lit(K.ACTION_FALLBACK))
    )
    details = signal_details()
    assessment = F.when(c("event_class") == "AUTH_FAIL", F.lit(K.ASSESSMENT_AUTH)).otherwise(
        F.lit(K.ASSESSMENT_OTHER)
    )
    context = fill(
        "**Event context:** {id} | {time} | host `{host}` | service `{service}` | `{event_class}`",
        id=_or(c("event_id"), "Unavailable"),
        time=F.coalesce(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit("Unavailable")),
        host=_or(c("hostname"), "Unavailable"),
        service=_or(c("service"), "Unavailable"),
        event_class=_or(c("event_class"), "Unavailable"),
    )
    rank = fill(
        "**Priority:** {priority} ({severity}) | Risk score: {risk}/1.00",
        priority=priority(K.PRIORITY_SUMMARY, K.PRIORITY_SUMMARY_OTHER),
        severity=F.upper(_or(c("severity"), "UNKNOWN")),
        risk=two_places(c("risk_score")),
    )
    return F.concat_ws(
        "\n\n",
        fill("**Alert:** {v}", v=_or(c("headline"), K.HEADLINE_FALLBACK)),
        context,
        rank,
        F.when(F.size(details) > 0, F.concat(F.lit("**Relevant detection signals:**\n"), bulleted(details))),
        F.concat(F.lit("**Why it was flagged:**\n"), bulleted(shown_evidence)),
        F.concat(F.lit("**Assessment:** "), assessment, F.lit(" " + K.SUMMARY_CAVEAT)),
        F.concat(F.lit("**Recommended analyst actions:**\n"), numbered(shown_actions)),
        F.lit(K.SUMMARY_ESCALATION),
    )


def triage_note() -> Column:
    band = F.upper(F.coalesce("severity", F.lit("LOW")))
    return F.concat(
        priority(K.PRIORITY_TRIAGE, K.PRIORITY_TRIAGE_OTHER),
        F.lit("\n" + K.TRIAGE_REASON + "\n"),
        fill("Risk score: {risk}/1.00 ({band})\n", risk=two_places(F.col("risk_score")), band=band),
        F.lit("Suggested triage:\n"),
        numbered(F.col("actions")),
        F.lit("\n\n" + K.TRIAGE_CAVEAT),
    )


def with_summaries(explained: DataFrame) -> DataFrame:
    """Add ``summary`` and ``triage`` texts to explained events."""
    return explained.withColumns({"summary": event_summary(), "triage": triage_note()})
