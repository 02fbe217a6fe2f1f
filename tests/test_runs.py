"""Stored runs, stage counts, trees grown together, and scored streams."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.operators import evaluate, tree_folds
from emberlog.operators.alerts import alert_intervals
from emberlog.operators.meter import Meter
from emberlog.params import DEFAULTS
from emberlog.plans import runs
from emberlog.plans.analysis import analyze, score_unseen
from emberlog.session import store
from emberlog.sources.text_logs import parse_lines, resolve_timestamps, to_logs
from emberlog.streaming.live import read_raw_stream
from emberlog.streaming.sinks import alert_stream, score_stream


@pytest.fixture(scope="module")
def small_run(logs):
    return analyze(logs, DEFAULTS.with_(trees=20))


def test_a_stored_run_scores_alike(spark, small_run, logs, tmp_path):
    path = str(tmp_path / "runs")
    with pytest.raises(ValueError, match="no run"):
        runs.load_run(spark, path)
    assert runs.save_run(small_run, path) == 1
    (tmp_path / "runs" / "run-000002-broken").mkdir()  # a run that broke off
    assert runs.save_run(small_run, path) == 2
    loaded = runs.load_run(spark.newSession(), path)
    assert loaded.version == 2 and loaded.fitted.params == small_run.params
    assert loaded.fitted.forest.nodes.equals(small_run.forest.nodes)
    assert runs.load_run(spark, path, 1).version == 1 and runs.versions(spark, path).count() == 2
    with pytest.raises(ValueError, match="no run 3"):
        runs.load_run(spark, path, 3)
    kept = runs.load_run(spark, path).fitted
    for reuse in (False, True):
        want, got = score_unseen(small_run, logs, reuse), score_unseen(kept, logs, reuse)
        assert got.count() == logs.count() and got.exceptAll(want).count() == 0


def test_result_tables(spark, small_run, logs):
    tables = runs.result_tables(small_run)
    assert set(tables) == set(runs.TABLES)
    stages = tables["stages"].first()
    events = tables["events"]
    noise = events.agg(F.count_if("dbscan_noise"), F.count_if("iforest_noise"), F.count_if(F.col("status") == "ANOMALY")).first()
    assert stages["input_rows"] == stages["cleaned_rows"] == events.count() == logs.count()
    assert (stages["dbscan_noise"], stages["isolation_forest_anomalies"], stages["ensemble_anomalies"]) == tuple(noise)
    assert stages["services"] == events.select("service").distinct().count()
    assert stages["dbscan_clusters"] == events.where("dbscan_cluster >= 0").select("dbscan_cluster").distinct().count()
    assert (stages["itemsets"], stages["rules"]) == (tables["itemsets"].count(), tables["rules"].count())
    assert (stages["model_features"], stages["detection_source"], stages["auto_params"]) == (17, "live", False)
    assert tables["metrics"].first()["n"] <= events.count() and tables["projection"].count() == events.count()
    for name, by in (("clusters", "size"), ("importance", "importance")):
        values = [r[by] for r in tables[name].orderBy("position").collect()]
        assert values == sorted(values, reverse=True) and len(values) > 1


def test_meter_counts_what_is_written(spark):
    meter = Meter()
    rows = spark.range(100, numPartitions=7).withColumn("k", F.col("id") % 3)
    kept = store(meter.watch(rows, seen=F.count("*")).where("k = 0"))
    meter.note(other="x")
    assert kept.count() == 34 and meter.read() == {"seen": 100, "other": "x"}


def test_one_class_is_reported_on_request(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("b", 0, 0), ("c", None, 1)], "s string, t int, p int")
    alone = rows.where("s = 'a'")
    assert evaluate.classification_report(alone, "t", "p").count() == 0
    one = evaluate.classification_report(alone, "t", "p", both_classes=False).first()
    assert (one["n"], one["accuracy"], one["precision"], one["recall"]) == (2, 0.5, 1.0, 0.5)
    by = evaluate.classification_report(rows, "t", "p", both_classes=False, by=("s",)).collect()
    assert sorted((r["s"], r["tp"], r["fn"], r["tn"]) for r in by) == [("a", 1, 1, 0), ("b", 0, 0, 1)]
    assert evaluate.classification_report(rows.where("t IS NULL"), "t", "p", both_classes=False).count() == 0


# ------------------------------------------------------------------ trees
def _python_tree(rows, depth, min_leaf):
    """Leaves of one tree as {node: [n0, n1]} and a function from bins to a node."""
    c0, c1 = (sum(r[k] for r in rows) for k in (1, 2))
    w0, w1 = (c0 + c1) / (2 * c0), (c0 + c1) / (2 * c1)
    gini = lambda n0, n1: 2 * n0 * w0 * n1 * w1 / (n0 * w0 + n1 * w1) if n0 or n1 else 0.0
    splits = {}

    def grow(node, part, level):
        if level == depth:
            return
        n0, n1 = sum(r[1] for r in part), sum(r[2] for r in part)
        best = (0.0, 0, 0)
        for feature in range(len(part[0][0])):
            for cut in {r[0][feature] for r in part}:
                left = [r for r in part if r[0][feature] <= cut]
                l0, l1 = sum(r[1] for r in left), sum(r[2] for r in left)
                if min(l0 + l1, n0 + n1 - l0 - l1) < min_leaf:
                    continue
                gain = round(gini(n0, n1) - gini(l0, l1) - gini(n0 - l0, n1 - l1), 9)
                best = max(best, (gain, -feature, -cut))
        if best[0] <= 0:
            return
        splits[node] = feature, cut = -best[1], -best[2]
        grow(2 * node, [r for r in part if r[0][feature] <= cut], level + 1)
        grow(2 * node + 1, [r for r in part if r[0][feature] > cut], level + 1)

    grow(1, rows, 0)

    def place(bins):
        node = 1
        while node in splits:
            feature, cut = splits[node]
            node = 2 * node + (bins[feature] > cut)
        return node

    return place


def test_trees_match_one_by_one_growth(spark):
    rng = random.Random(4)
    made = []
    for _ in range(400):
        bins = [rng.randrange(6) for _ in range(4)]
        t = int((bins[0] > 3) != (bins[2] > 1) or rng.random() < 0.1)
        made.append((bins, "s", rng.random() < 0.2, rng.random() < 0.3, rng.randrange(3), t, rng.randrange(1, 4)))
    schema = "bins array<int>, service string, held boolean, late boolean, fold int, t int, n long"
    counted = spark.createDataFrame(made, schema).withColumn("service_bins", F.array(*[F.lit(1)] * 5))
    params = DEFAULTS.with_(tree_max_depth=4, tree_min_leaf=7)
    got = {}
    for r in tree_folds.grow(counted, 3, params).collect():
        got[(r["model"], r["node"], r["tested"])] = (r["n0"], r["n1"])
    want = {}
    tests = [lambda r: r[2], lambda r: r[3]] + [lambda r, f=f: r[4] == f for f in range(3)]
    for model, tested in enumerate(tests):
        weighed = [(r[0], r[6] * (r[5] == 0), r[6] * (r[5] == 1), tested(r)) for r in made]
        place = _python_tree([w for w in weighed if not w[3]], 4, 7)
        for bins, n0, n1, held in weighed:
            key = (model, place(bins), held)
            have = want.get(key, (0, 0))
            want[key] = (have[0] + n0, have[1] + n1)
    assert got == want and len({k[1] for k in got}) > 8


def test_parts_are_stratified_and_trees_learn(spark):
    rows = [(i, f"s{i % 30}", 1 if i % 30 == 7 else 0, "AUTH_FAIL", i % 24, 10, 2, 0.1, 5, 5, 1) for i in range(1203)]
    names = "k long, service string, truth int, event_class string, hour long, message_length long, token_count long,"
    names += " digit_ratio double, tmpl_freq long, svc_freq long, burst long"
    table = spark.createDataFrame(rows, names).withColumn("place", F.col("k"))
    found = tree_folds.evaluate_trees(table, "truth", "k", "place")
    by = {r["split"]: r for r in found.collect()}
    assert set(by) == {"holdout", "temporal", *[f"fold {k}" for k in range(1, 6)]}
    assert (by["holdout"]["test_n"], by["holdout"]["train_n"], by["holdout"]["test_positives"]) == (241, 962, 8)
    assert by["temporal"]["train_n"] == 962
    assert sorted(by[f"fold {k}"]["test_positives"] for k in range(1, 6)) == [8] * 5
    assert all(r["accuracy"] == 1.0 and r["roc_auc"] == 1.0 for r in by.values())  # only the service tells
    cv = tree_folds.fold_summary(found).first()
    assert (cv["folds"], cv["f1_mean"], cv["f1_std"]) == (5, 1.0, 0.0)
    early = table.where("truth = 0 OR k < 900")  # the latest part has one class
    assert "temporal" not in {r["split"] for r in tree_folds.evaluate_trees(early, "truth", "k", "place").collect()}
    odd = table.withColumns({"service": F.lit(None).cast("string"), "digit_ratio": F.lit(None).cast("double")})
    assert tree_folds.evaluate_trees(odd, "truth", "k", "place").count() == 7
    with pytest.raises(ValueError, match="both classes"):
        tree_folds.evaluate_trees(table.where("truth = 0"), "truth", "k", "place")


# ---------------------------------------------------------------- streams
def _finish(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_a_scored_stream_equals_batch_and_can_be_repeated(spark, small_run, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    line = "2026-01-01 00:{m:02}:{s:02} h sshd[1]: Failed password for user{s} from 10.0.0.{s} port {p}"
    for name, minute in (("a", 1), ("b", 40)):
        (source / f"{name}.log").write_text("".join(line.format(m=minute, s=s, p=2000 + s) + "\n" for s in range(30)))
    for attempt in ("one", "two"):  # the second has no memory of the first, so all batches are run again
        _finish(score_stream(read_raw_stream(spark, str(source)), small_run, out, str(tmp_path / attempt)))
    got = spark.read.parquet(out)
    assert got.count() == 60
    lines = spark.read.text(str(source)).withColumn("line_no", F.lit(None).cast("long"))
    want = score_unseen(small_run, to_logs(resolve_timestamps(parse_lines(lines), "per_row", 1900)), True)
    columns = [c for c in want.columns if c != "event_id"]  # rows of one second may change places
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0


def test_stream_alerts_equal_the_batch(spark, tmp_path):
    rng = random.Random(9)
    begin = datetime(2026, 1, 1, tzinfo=timezone.utc)
    times = [begin + timedelta(seconds=rng.randrange(3000), microseconds=rng.choice([0, 0, 250_000])) for _ in range(300)]
    times += [begin + timedelta(minutes=m) for m in (5, 10, 15, 20) for _ in range(3)]  # on the borders of stretches
    rows = [(t, "ANOMALY" if rng.random() < 0.7 else "NORMAL") for t in times] + [(None, "ANOMALY")]
    last = [(begin + timedelta(days=1), "NORMAL"), (begin + timedelta(days=1), "ANOMALY")]
    rng.shuffle(rows)
    source = str(tmp_path / "in")
    schema = "timestamp timestamp, status string"
    for part in (rows[:150], rows[150:], last, last):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        _finish(alert_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), 4, 5, late="2 hours"))
    got = spark.read.parquet(str(tmp_path / "out")).select("start", "end", "anomalies")
    want = alert_intervals(spark.createDataFrame(rows, schema), 4, 5)
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 50
    with pytest.raises(ValueError):
        alert_stream(stream, "x", "y", 0, 5)
