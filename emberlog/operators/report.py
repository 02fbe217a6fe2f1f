"""One-row text reports; every fact in them is a small aggregate of the events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberlog import constants as K
from emberlog.functions.texts import fill, two_places, with_commas
from emberlog.functions.timing import format_time
from emberlog.operators.explore import anomalous, kpis, top_anomalous, top_failing_sources, triage_queue


def _section(rows: DataFrame, section: int, text: Column, *order) -> DataFrame:
    """(section, line, text) for a short ordered list."""
    listed = F.collect_list(F.struct(*order, text.alias("_text")))
    lines = F.transform(F.array_sort(listed), lambda x: x["_text"])
    return rows.agg(lines.alias("l")).select(F.lit(section).alias("section"), F.posexplode("l").alias("line", "text"))


def _fixed(one: DataFrame, section: int, *texts) -> DataFrame:
    items = F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])
    return one.select(F.lit(section).alias("section"), F.posexplode(items).alias("line", "text"))


def _span(events: DataFrame) -> tuple[str, str, bool]:
    """First and last time as shown, and whether the year is known (one row)."""
    ends = events.agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end")).withColumn(
        "has_year", F.coalesce(F.year("start") > 1970, F.lit(False))
    )
    shown = [format_time(F.col(c), F.col("has_year")).alias(c) for c in ("start", "end")]
    return tuple(ends.select(*shown, "has_year").first())


def summary_lines(events: DataFrame, dataset: str, ground_truth: DataFrame | None = None) -> DataFrame:
    """The summary report as (section, line, text) rows."""
    facts = kpis(events)
    start, end, has_year = _span(events)
    c = F.col
    times = fill(
        "**Dataset:** " + dataset.replace("{", "{{").replace("}", "}}") + " · {n} Linux log events · {start} → {end}",
        n=with_commas(c("total")),
        start=start,
        end=end,
    )
    head = _fixed(
        facts, 1, K.REPORT_TITLE, "", times, "", "## Key figures",
        fill("- Anomalies detected: **{a}** ({r}% of events)", a=with_commas(c("anomalies")),
             r=F.format_string("%.2f", c("anomaly_rate_pct"))),
        fill("- High-risk (HIGH + CRITICAL) anomalies: **{h}**", h=with_commas(c("high_risk"))),
        fill("- Services monitored: {s}", s=c("services")),
        "",
    )
    count = with_commas(c("events"))
    services = top_anomalous(events, "service", 5)
    classes = top_anomalous(events, "event_class", 5)
    sources = top_failing_sources(events, 5)
    riskiest = triage_queue(events, 5)
    some = facts.where("anomalies > 0")
    parts = [
        head,
        _fixed(some, 2, "## Top suspicious services"),
        _section(services, 3, fill("- {k}: {v} anomalies", k=c("service"), v=count), -c("events"), c("service")),
        _fixed(some, 4, "", "## Top suspicious event types"),
        _section(classes, 5, fill("- {k}: {v}", k=c("event_class"), v=count), -c("events"), c("event_class")),
        _fixed(sources.agg(F.count("*").alias("n")).where("n > 0"), 6, "",
               "## Top source hosts (anomalous authentication failures)"),
        _section(sources, 7, fill("- {k}: {v}", k=c("src_host"), v=count), -c("events"), c("src_host")),
        _fixed(some, 8, "", "## Highest-risk events"),
        _section(
            riskiest, 9,
            fill("- {id} · {t} · {s} · {e} · risk {r}", id=c("event_id"), t=format_time(c("timestamp"), has_year),
                 s=c("service"), e=c("event_class"), r=two_places(c("risk_score"))),
            -c("risk_score"), c("row_idx"),
        ),
    ]
    if ground_truth is not None:
        pct = lambda name: F.format_string("%.1f", c(name) * 100)
        parts.append(
            _fixed(
                ground_truth, 10, "", "## Post-hoc evaluation against supplied ground truth",
                fill("- Accuracy: {a}%, precision: {p}%, recall: {r}%, F1: {f}", a=pct("accuracy"),
                     p=pct("precision"), r=pct("recall"), f=F.format_string("%.3f", c("f1"))),
                "- Ground-truth labels were not used during anomaly detection.",
            )
        )
    parts.append(_fixed(facts, 11, "", "## Recommended next steps", *K.REPORT_NEXT_STEPS, "", K.REPORT_CLOSING))
    return reduce(DataFrame.unionByName, parts)


def summary_report(events: DataFrame, dataset: str, ground_truth: DataFrame | None = None) -> DataFrame:
    """One row ``report``: the Markdown summary (a few dozen lines)."""
    lines = summary_lines(events, dataset, ground_truth)
    ordered = F.array_sort(F.collect_list(F.struct("section", "line", "text")))
    return lines.agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("report"))


def _listing(rows: DataFrame, item: Column, *order) -> Column:
    items = F.array_sort(F.collect_list(F.struct(*order, item.alias("_text"))))
    return rows.agg(F.array_join(F.transform(items, lambda x: x["_text"]), ", ").alias("t")).scalar()


def review_facts(events: DataFrame, dataset: str) -> DataFrame:
    """One row ``facts``: the text an incident review starts from."""
    c = F.col
    flagged = events.where(anomalous())
    pair = lambda name: fill("'{k}': {v}", k=c(name), v=c("events"))
    counted = flagged.groupBy("severity").agg(F.count("*").alias("events"))
    ranked = lambda rows, name: _listing(rows, pair(name), -c("events"), c(name))
    top = fill(
        "{{'event_class': '{e}', 'service': '{s}', 'severity': '{v}', 'risk_score': {r}}}",
        e=c("event_class"), s=c("service"), v=c("severity"), r=F.round("risk_score", 2),
    )
    return kpis(events).select(
        F.concat_ws(
            "\n",
            F.lit("Dataset: " + dataset),
            fill("Events: {n}", n=with_commas(c("total"))),
            fill("Anomalies: {n} ({r}%)", n=with_commas(c("anomalies")), r=F.format_string("%.2f", c("anomaly_rate_pct"))),
            fill("High-risk anomalies: {n}", n=with_commas(c("high_risk"))),
            fill("Severity counts: {{{v}}}", v=ranked(counted, "severity")),
            fill("Top anomalous services: {{{v}}}", v=ranked(top_anomalous(events, "service", 10), "service")),
            fill("Top event classes: {{{v}}}", v=ranked(top_anomalous(events, "event_class", 10), "event_class")),
            fill("Highest-risk event summaries: [{v}]",
                 v=_listing(triage_queue(events, 10), top, -c("risk_score"), c("row_idx"))),
            F.lit(K.REVIEW_FACTS_CAVEAT),
        ).alias("facts")
    )


def incident_review(events: DataFrame, dataset: str) -> DataFrame:
    """One row ``report``: the local incident review around the facts."""
    text = F.concat(
        F.lit(f"{K.REVIEW_TITLE}\n\n{K.REVIEW_NOTICE}\n\n## Analysis facts\n"),
        F.col("facts"),
        F.lit(f"\n\n## Analyst caveat\n{K.REVIEW_CAVEAT}"),
    )
    return review_facts(events, dataset).select(text.alias("report"))
