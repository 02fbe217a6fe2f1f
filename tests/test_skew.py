"""A third of all rows shares one line, source and moment; limits are set so low that hot paths run."""

from __future__ import annotations

import pytest
from pyspark.sql import Window as W, functions as F

from emberlog.operators import explain, features as X, skew
from emberlog.operators.ordering import with_row_index


@pytest.fixture(scope="module")
def skewed(spark, logs):
    one = logs.where("service = 'sshd(pam_unix)'").orderBy("line_no").limit(1)
    copies = one.drop("line_no").crossJoin(spark.range(1_000_000, 1_000_500).withColumnRenamed("id", "line_no"))
    return logs.unionByName(copies.select(*logs.columns))


@pytest.fixture
def hot(monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    monkeypatch.setattr(skew, "HOT_KEYS", 40)


def test_frequencies_match_windows(skewed, hot):
    cleaned = X.clean(skewed)
    got = X.with_frequencies(cleaned).select("line_no", "tmpl_freq", "svc_freq", "burst")
    n = F.count("*")
    want = cleaned.select(
        "line_no",
        n.over(W.partitionBy("template")).alias("tmpl_freq"),
        n.over(W.partitionBy("service")).alias("svc_freq"),
        n.over(W.partitionBy("service", "event_class", "window_start")).alias("burst"),
    )
    assert got.count() == 1500
    assert got.exceptAll(want).count() == 0
    assert got.agg(F.max("burst")).first()[0] >= 500


def test_facts_and_relations_match_plain_joins(skewed, hot):
    events = with_row_index(X.clean(skewed), "timestamp", "line_no")
    events = events.withColumns(
        {"event_id": F.concat(F.lit("E"), "row_idx"), "dbscan_cluster": F.col("row_idx") % 3, "status": F.lit("ANOMALY")}
    )
    told = explain.with_facts(events, events)
    assert told.count() == 1500
    sources = explain.source_facts(events)
    off = told.join(sources.select("src_host", F.col("source_failures").alias("f")), "src_host", "left")
    assert off.where("NOT (f <=> source_failures)").count() == 0

    related = explain.related_events(events, events, "src_host", limit=7).select("seed_id", "rank", "event_id")
    first = explain.earliest_per_key(events, "src_host", 7)
    want = events.select(F.col("event_id").alias("seed_id"), "src_host").join(first, "src_host").select("seed_id", "rank", "event_id")
    assert related.count() == want.count() > 3500
    assert related.exceptAll(want).count() == 0


def test_all_related_events_are_ranked(skewed, hot):
    events = with_row_index(X.clean(skewed), "timestamp", "line_no").withColumn("event_id", F.concat(F.lit("E"), "row_idx"))
    seeds = events.where("row_idx % 3 = 0")
    links, ranked = explain.related_by_key(events, seeds, "src_host")
    known = events.where("src_host IS NOT NULL")
    assert links.count() == seeds.where("src_host IS NOT NULL").count()
    rank = F.row_number().over(W.partitionBy("src_host").orderBy("row_idx")).cast("long")
    want = known.withColumn("rank", rank).join(links.select("src_host").distinct(), "src_host", "left_semi")
    got, want = ({(r.event_id, r["rank"]) for r in d.select("event_id", "rank").collect()} for d in (ranked, want))
    assert got == want and ranked.count() == len(want)
    assert max(n for _, n in got) > 400
