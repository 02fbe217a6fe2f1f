from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import alerts, evaluate, explore, patterns, summaries
from emberlog.params import DEFAULTS

DAY = datetime(2026, 1, 1)


def at(*minutes, status="ANOMALY"):
    return [(DAY + timedelta(minutes=m), status) for m in minutes]


def densest(spark, rows, threshold, minutes):
    events = spark.createDataFrame(rows, "timestamp timestamp, status string")
    found = alerts.densest_interval(events, threshold, minutes).first()
    return found and (found["anomalies"], found["start"], found["end"])


def test_densest_interval(spark):
    assert densest(spark, at(0, 1, 4, 20), 3, 5) == (3, DAY, DAY + timedelta(minutes=4))


def test_normal_events_do_not_count(spark):
    assert densest(spark, at(0, 20) + at(1, status="NORMAL"), 2, 5) is None


def test_invalid_settings_and_missing_times(spark):
    for threshold, minutes in ((0, 5), (1, 0)):
        assert densest(spark, at(0), threshold, minutes) is None
    assert densest(spark, [(None, "ANOMALY")], 1, 5) is None


def test_interval_is_closed_and_ties_go_to_the_earlier(spark):
    assert densest(spark, at(0, 5), 2, 5) == (2, DAY, DAY + timedelta(minutes=5))
    assert densest(spark, at(60, 61, 0, 1), 2, 5) == (2, DAY, DAY + timedelta(minutes=1))


@pytest.mark.parametrize("minutes", [1, 3])
def test_intervals_match_a_scan(spark, minutes):
    rng = np.random.default_rng(minutes)
    micros = np.sort(np.concatenate([rng.integers(0, 3_600_000_000, 200), np.repeat(rng.integers(0, 600_000_000, 3), 40)]))
    rows = [(DAY + timedelta(microseconds=int(m)), "ANOMALY") for m in micros]
    events = spark.createDataFrame(rows, "timestamp timestamp, status string")
    got = {r["end"]: (r["start"], r["anomalies"]) for r in alerts.interval_counts(events, minutes).collect()}
    width = minutes * 60_000_000
    for m in set(micros):
        inside = micros[(micros >= m - width) & (micros <= m)]
        want = (DAY + timedelta(microseconds=int(inside.min())), len(inside))
        assert got[DAY + timedelta(microseconds=int(m))] == want


@pytest.mark.parametrize("count", [1, 4, 5])
def test_item_sets_of_few_windows(spark, count):
    rows = [(DAY + timedelta(minutes=5 * i), "sshd", "INFO", "NORMAL") for i in range(count)]
    events = spark.createDataFrame(rows, "timestamp timestamp, service string, event_class string, status string")
    sets = {tuple(r["items"]): r["found"] for r in patterns.frequent_itemsets(patterns.window_items(events)).collect()}
    assert sets == {("evt=INFO",): count, ("svc=sshd",): count, ("evt=INFO", "svc=sshd"): count}


def test_rules_have_all_splits(spark):
    rows = []
    for i in range(10):
        when = DAY + timedelta(minutes=5 * i)
        rows.append((when, "sshd", "AUTH_FAIL", "ANOMALY") if i < 4 else (when, "cron", "INFO", "NORMAL"))
    events = spark.createDataFrame(rows, "timestamp timestamp, service string, event_class string, status string")
    sets = patterns.frequent_itemsets(patterns.window_items(events))
    rules = patterns.association_rules(sets)
    shown = {(r["if"], r["then"]): r for r in patterns.rule_report(rules).collect()}
    assert ("ANOMALY_IN_WINDOW", "evt=AUTH_FAIL + svc=sshd") in shown
    assert ("evt=AUTH_FAIL + svc=sshd", "ANOMALY_IN_WINDOW") in shown
    rule = shown["ANOMALY_IN_WINDOW", "svc=sshd"]
    assert (rule["support"], rule["confidence"], rule["lift"], rule["windows"]) == (0.4, 1.0, 2.5, 4)
    assert patterns.about_anomalies(rules).count() == len([k for k in shown if "ANOMALY" in k[0] + k[1]])


def test_time_range_is_strict(spark):
    rows = [(DAY,), (DAY + timedelta(minutes=1),), (DAY + timedelta(hours=1),)]
    events = spark.createDataFrame(rows, "timestamp timestamp")
    assert explore.in_time_range(events, "Last 1 hour").count() == 2
    assert explore.in_time_range(events, "All data").count() == 3


def test_kpis_of_no_events(spark):
    events = spark.createDataFrame([], "status string, severity string, service string")
    one = explore.kpis(events).first()
    assert (one["total"], one["anomaly_rate_pct"]) == (0, 0.0)
    assert [r["events"] for r in explore.severity_counts(events).collect()] == [0, 0, 0, 0]


def test_metrics_need_both_classes(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "t int, p int")
    assert evaluate.classification_report(rows, "t", "p").count() == 0


def test_auc_and_curve_against_definition(spark):
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 2, 300)
    score = np.round(np.clip(0.3 * truth + rng.random(300) * 0.7, 0, 1), 2)
    rows = spark.createDataFrame([(int(t), float(s)) for t, s in zip(truth, score)], "t int, s double")
    pos, neg = score[truth == 1], score[truth == 0]
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert evaluate.roc_auc(rows, "t", "s").first()[0] == pytest.approx(wins)
    curve = evaluate.roc_curve(rows, "t", "s").toPandas().sort_values("threshold", ascending=False)
    assert np.trapezoid(curve.tpr, curve.fpr) == pytest.approx(wins)
    assert curve.iloc[0].tolist()[1:] == [0.0, 0.0] and curve.iloc[-1].tolist()[1:] == [1.0, 1.0]


def test_small_decision_tree_check(spark):
    rows = [
        (i, DAY + timedelta(minutes=i), i % 24, 40 + i % 5, 5, 0.1, 10, 20, 1 + 30 * (i % 6 == 0), "AUTH_FAIL" if i % 6 == 0 else "INFO",
         f"s{i % 4}", int(i % 6 == 0)) for i in range(400)
    ]
    frame = spark.createDataFrame(
        rows, "n long, timestamp timestamp, hour int, message_length int, token_count int, digit_ratio double, tmpl_freq long,"
        " svc_freq long, burst long, event_class string, service string, truth int",
    )
    table = {r["split"]: r for r in evaluate.evaluate_tree(frame, "truth", "n", DEFAULTS.with_(tree_max_depth=3)).collect()}
    assert set(table) == {"holdout", "temporal", "fold 1", "fold 2", "fold 3", "fold 4", "fold 5"}
    assert table["temporal"]["n"] == 80
    assert all(r["f1"] == 1.0 and r["roc_auc"] == 1.0 for r in table.values())
    with pytest.raises(ValueError, match="both classes"):
        evaluate.evaluate_tree(frame.where("truth = 0"), "truth", "n")


def test_sorts_are_stable(spark):
    rows = [(DAY, 0.5, 2), (DAY, 0.5, 1), (DAY, 0.9, 0)]
    events = spark.createDataFrame(rows, "timestamp timestamp, risk_score double, row_idx long").withColumn("status", F.lit("ANOMALY"))
    for name, want in {"Newest first": [0, 1, 2], "Oldest first": [0, 1, 2], "Highest risk": [0, 1, 2], "Lowest risk": [1, 2, 0]}.items():
        assert [r["row_idx"] for r in explore.sort_events(events, name).collect()] == want


def test_activity_tables_are_whole(spark):
    rows = spark.range(60).select(
        F.concat(F.lit("host"), "id").alias("src_host"), F.lit("AUTH_FAIL").alias("event_class"), F.lit("root").alias("target_user"),
        F.lit("NORMAL").alias("status"), F.lit(1).alias("burst"), F.timestamp_seconds("id").alias("timestamp"), F.col("id").alias("line_no"),
        F.concat(F.lit("wording "), "id").alias("template"), F.repeat(F.lit("m"), 500).alias("message"), F.lit("sshd").alias("service"),
    )
    assert patterns.source_activity(rows).count() == 60
    assert patterns.source_activity(rows, limit=3).count() == 3
    assert patterns.template_activity(rows).where("length(example) = 500").count() == 60


def test_missing_facts_are_called_unknown(spark):
    row = spark.sql(
        "SELECT 'e1' AS event_id, CAST(NULL AS TIMESTAMP) AS timestamp, CAST(NULL AS STRING) AS service, 'OTHER' AS event_class,"
        " 'LOW' AS severity, CAST(NULL AS DOUBLE) AS risk_score"
    )
    facts = row.select(summaries.event_facts()).first()[0]
    assert "Timestamp: unknown\nService: unknown\nEvent class: OTHER" in facts and "Risk score: unknown/1.00" in facts


@pytest.mark.parametrize("words", [1, 64])
def test_item_sets_match_a_scan(spark, monkeypatch, words):
    """Many windows, so that bitmaps have several words and, if short, several chunks."""
    rng = random.Random(words)
    names = [f"i{k}" for k in range(9)]
    baskets = {w: {n for k, n in enumerate(names) if rng.random() < 0.1 * (k + 1)} for w in range(400)}
    baskets = {w: b for w, b in baskets.items() if b}
    monkeypatch.setattr(patterns, "CHUNK_WORDS", words)
    items = spark.createDataFrame([(w * 300 - 9000, n) for w, b in baskets.items() for n in b], "win long, item string")
    found = patterns.frequent_itemsets(items, DEFAULTS.with_(min_support=0.2)).collect()
    want = {}
    for size in (1, 2, 3):
        for s in itertools.combinations(names, size):
            n = sum(set(s) <= b for b in baskets.values())
            if n / len(baskets) >= 0.2:
                want[s] = n
    assert {tuple(r["items"]): r["found"] for r in found} == want
    assert {len(s) for s in want} == {1, 2, 3} and {r["windows_total"] for r in found} == {len(baskets)}
