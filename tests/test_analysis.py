from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberlog.operators import explain, explore, features as X, projection, report, summaries
from emberlog.params import DEFAULTS
from emberlog.plans.analysis import EVENT_COLUMNS, analyze, register_views, score_unseen, stage_counts


def test_kpis_are_consistent(result, logs):
    k = explore.kpis(result.events).first()
    assert k["total"] == logs.count() > 0
    assert k["normal"] + k["anomalies"] == k["total"]
    assert 0 <= k["anomaly_rate_pct"] <= 100
    assert k["high_risk"] <= k["anomalies"]


def test_density_is_derived_on_request(logs):
    derived = analyze(logs, DEFAULTS.with_(density="derived"))
    assert derived.auto_params and derived.min_samples_used == 10 and derived.eps_used != DEFAULTS.eps


def test_detector_contract(result):
    assert not result.auto_params and result.min_samples_used == 10
    assert {r[0] for r in result.events.select("model_pred").distinct().collect()} <= {0, 1}
    stages = stage_counts(result.scored).first()
    assert stages["input_rows"] == result.rows
    assert stages["ensemble_anomalies"] >= max(stages["dbscan_noise"], stages["isolation_forest_anomalies"])


def test_columns_and_bounds(result):
    assert result.events.columns == [*EVENT_COLUMNS, "label"]
    low, high, p0, p1 = result.events.agg(F.min("risk_score"), F.max("risk_score"), F.min("model_prob"), F.max("model_prob")).first()
    assert 0 <= low <= high <= 1 and (p0, p1) == (0.0, 1.0)
    assert result.events.where("status = 'NORMAL' AND severity IN ('HIGH', 'CRITICAL')").count() == 0


def test_no_label_needed(logs):
    bare = analyze(logs.drop("label"), DEFAULTS.with_(trees=20))
    assert "label" not in bare.events.columns and bare.events.count() == logs.count()


def test_result_does_not_depend_on_partitioning(result, logs):
    again = analyze(logs.repartition(11))
    columns = ("event_id", "message", "dbscan_cluster", "model_prob", "risk_score", "status")
    assert again.events.select(*columns).exceptAll(result.events.select(*columns)).count() == 0


def test_given_clusters_replace_the_density_detector(logs):
    given = logs.withColumn("dbscan_cluster", F.when(F.col("line_no") % 10 == 0, -1).otherwise(2))
    run = analyze(given, DEFAULTS.with_(trees=20, detection_source="reference"))
    got = {r["dbscan_cluster"]: r["n"] for r in run.events.groupBy("dbscan_cluster").agg(F.count("*").alias("n")).collect()}
    assert got == {-1: 100, 2: 900}
    live = analyze(given, DEFAULTS.with_(trees=20))
    plain = analyze(logs, DEFAULTS.with_(trees=20))
    columns = ("event_id", "dbscan_cluster", "risk_score")
    assert live.events.select(*columns).exceptAll(plain.events.select(*columns)).count() == 0


def test_explanations_are_complete(result):
    told = explain.explain(result.scored, result.scored.where("status = 'ANOMALY'"), result.params, result.eps_used, result.min_samples_used)
    noted = summaries.with_summaries(told)
    bad = noted.where("headline = '' OR size(evidence) < 2 OR size(actions) = 0 OR summary IS NULL OR triage IS NULL")
    assert told.count() == result.anomalies.count() > 0 and bad.count() == 0


def test_breakdown_adds_up(result):
    parts = explain.risk_breakdown(result.scored, result.max_template).groupBy("event_id").agg(F.sum("contribution").alias("total"))
    off = parts.join(result.events, "event_id").where(F.abs(F.col("total") - F.col("risk_score")) > 0.00051)
    assert off.count() == 0


def test_unseen_scoring(result, logs):
    part = logs.orderBy("line_no").limit(500)
    scored = score_unseen(result, part)
    assert scored.count() == 500
    assert {r[0] for r in scored.select("model_pred").distinct().collect()} <= {0, 1}
    assert {r[0] for r in scored.select("label").distinct().collect()} <= {0, 1}
    same_scale = score_unseen(result, logs, reuse_training_stats=True)
    joined = same_scale.select("event_id", F.col("model_prob").alias("p")).join(result.events, "event_id")
    assert joined.where("p <> model_prob").count() == 0


def test_projection(result):
    points = X.feature_vectors(result.vectors.select(*X.VECTOR_KEY, "weight"), result.moments)
    plane = projection.projection(points, result.scored, X.VECTOR_KEY)
    rows = plane.collect()
    assert len(rows) == result.rows and 0 < rows[0]["explained"] <= 1
    centre = plane.agg(F.avg("x"), F.avg("y"), F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")).first()
    assert abs(centre[0]) < 1e-9 and abs(centre[1]) < 1e-9 and abs(centre[4]) < 1e-9
    total = projection.covariance(points).where("i = j").agg(F.sum("cov")).first()[0]
    assert (centre[2] + centre[3]) / total == pytest.approx(rows[0]["explained"])


def test_views(spark, result):
    register_views(spark, result, "run_")
    assert spark.sql("SELECT count(*) FROM run_anomalies").first()[0] == result.anomalies.count()


def test_report_of_ground_truth(result):
    from emberlog.functions import scoring
    from emberlog.operators.evaluate import classification_report

    rows = result.scored.withColumns({"truth": scoring.ground_truth("label"), "flag": scoring.is_anomaly()})
    text = report.summary_report(result.scored, "a.log", classification_report(rows, "truth", "flag")).first()[0]
    assert "## Post-hoc evaluation" in text and "**Dataset:** a.log · 1,000 Linux log events" in text
    assert "AI is not configured" in report.incident_review(result.scored, "a.log").first()[0]


EVENT = {
    "event_id": "EVT-2", "timestamp": None, "hostname": "web1", "service": "sshd", "event_class": "SERVICE_ERROR",
    "severity": "HIGH", "risk_score": 0.8, "detection_method": "DBSCAN", "dbscan_noise": True, "iforest_noise": False,
    "auth_burst": False, "tmpl_freq": 2, "burst": 0, "src_host": "192.0.2.10", "target_user": None,
    "headline": "A rare event pattern was flagged",
    "evidence": ["**DBSCAN:** outside groups, seen on web1 (192.0.2.10)", "**Isolation Forest:** score disagreed"],
    "actions": ["Review nearby service errors"],
}
SCHEMA = (
    "event_id string, timestamp timestamp, hostname string, service string, event_class string, severity string, risk_score double,"
    " detection_method string, dbscan_noise boolean, iforest_noise boolean, auth_burst boolean, tmpl_freq long, burst long,"
    " src_host string, target_user string, headline string, evidence array<string>, actions array<string>"
)


def one_event(spark, **changes):
    return spark.createDataFrame([tuple({**EVENT, **changes}.values())], SCHEMA)


def test_summary_names_active_signals_only(spark):
    text = one_event(spark).select(summaries.event_summary()).first()[0]
    assert "message pattern appears only 2 time(s)" in text and "Isolation Forest" not in text
    assert "P2 — prompt (HIGH) | Risk score: 0.80/1.00" in text and "1. Review nearby service errors" in text


def test_summary_of_failed_logins(spark):
    rows = one_event(spark, event_class="AUTH_FAIL", evidence=[], dbscan_noise=None, detection_method=None, severity="CRITICAL")
    note, triage = rows.select(summaries.event_summary(), summaries.triage_note()).first()
    assert "stale credentials" in note and "- The detector identified a pattern" in note
    assert "Relevant detection signals" not in note and triage.startswith("P1 — urgent analyst review")


def test_redaction_hides_identifiers(spark):
    shown = one_event(spark).select(summaries.redacted_evidence()).first()[0]
    assert shown == ["**DBSCAN:** outside groups, seen on [redacted] ([redacted])"]


def test_unknown_class_gets_default_actions(spark):
    rows = spark.createDataFrame([("ODD",), ("AUTH_FAIL",)], "event_class string")
    sizes = {r["event_class"]: len(r["actions"]) for r in explain.with_actions(rows).collect()}
    assert sizes == {"ODD": 3, "AUTH_FAIL": 4}


def test_no_events_is_an_error(logs):
    with pytest.raises(ValueError, match="no events"):
        analyze(logs.where("line_no < 0"))


def test_live_bursts(spark, tmp_path):
    from emberlog.streaming.live import auth_bursts, read_log_stream

    source = tmp_path / "in"
    source.mkdir()
    fail = "2026-01-01 00:0{m}:{s:02} h sshd[1]: Failed password for root from 10.0.0.1 port 22"
    lines = [fail.format(m=1, s=i) for i in range(25)] + [fail.format(m=7, s=0)]
    lines.append("2026-01-01 03:00:00 h sshd[1]: Failed password for root from 10.0.0.1 port 22")
    (source / "a.log").write_text("\n".join(lines) + "\n")
    found = auth_bursts(read_log_stream(spark, str(source)))
    run = found.writeStream.format("memory").queryName("live_bursts").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")
    ).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    got = spark.sql("SELECT date_format(window_start, 'HH:mm'), service, burst FROM live_bursts").collect()
    assert [tuple(r) for r in got] == [("00:00", "sshd", 25)]
    with pytest.raises(ValueError):
        read_log_stream(spark, str(source), "reference")


def test_classifier_sees_every_service(spark):
    """Only services of rank 13 and later are positive."""
    from emberlog.operators import evaluate
    from emberlog.params import DEFAULTS

    made = [(f"s{k:02}", int(k >= 13), 1.0) for k in range(16) for _ in range(40 - k)]
    rows = spark.createDataFrame(made, "service string, truth int, x double")
    unseen = spark.createDataFrame([("new", 0, 1.0), (None, 0, 1.0)], rows.schema)
    scored = evaluate._fit_and_score(rows, rows.unionByName(unseen), "truth", ["x"], DEFAULTS)
    assert scored.count() == len(made) + 2
    assert scored.limit(len(made)).where("truth <> predicted").count() == 0
