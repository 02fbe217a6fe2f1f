from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.operators import dbscan as D, features as X, forest as I
from emberlog.operators.components import connected_components
from emberlog.operators.neighbours import density_parameters, k_distances
from emberlog.operators.ordering import weighted_quantile, with_row_index
from emberlog.operators.skew import attach_by_key
from emberlog.params import DEFAULTS


def brute_force(frame: pd.DataFrame, eps: float, samples: int):
    z = frame[X.NUMERIC].to_numpy()
    other = (frame.event_class.to_numpy()[:, None] != frame.event_class.to_numpy()[None, :]) * 2.0
    d2 = ((z[:, None, :] - z[None, :, :]) ** 2).sum(-1) + other
    near = np.round(d2, 9) <= round(eps * eps, 9)
    core = near @ frame.weight.to_numpy() >= samples
    label = np.full(len(frame), -1)
    number = 0
    for start in np.argsort(frame.first_row.to_numpy()):
        if core[start] and label[start] < 0:
            label[start], todo = number, [start]
            while todo:
                for k in np.flatnonzero(near[todo.pop()] & core):
                    if label[k] < 0:
                        label[k] = number
                        todo.append(k)
            number += 1
    for k in np.flatnonzero(~core):
        owners = label[near[k] & core]
        if len(owners):
            label[k] = owners.min()
    return core, label


def random_points(seed: int, n: int = 300, spread: float = 3.0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            "event_class": rng.choice(["INFO", "WARNING"], n),
            "hour": np.arange(n) % 24,
            "message_length": np.arange(n),
            "tmpl_freq": 1,
            "svc_freq": 1,
            "burst": 1,
            "weight": rng.integers(1, 4, n),
            "first_row": rng.permutation(n),
        }
    )
    for name in X.NUMERIC:
        frame[name] = 0.0
    frame["hour_sin"] = rng.uniform(0, spread, n)
    frame["log_burst"] = rng.uniform(0, spread, n)
    return frame


def agree(spark, frame, eps, samples):
    core, label = brute_force(frame, eps, samples)
    points = spark.createDataFrame(frame).repartition(5)
    got = D.dbscan(points, eps, samples).toPandas().sort_values("message_length")
    assert (got.core.to_numpy() == core).all()
    assert (got.dbscan_cluster.to_numpy() == label).all()
    noise = D.dbscan_noise(points, eps, samples).toPandas().sort_values("message_length")
    assert (noise.noise.to_numpy() == (label == -1)).all()


@pytest.mark.parametrize("seed, eps, samples", [(1, 0.5, 4), (2, 0.3, 6), (3, 1.6, 30)])
def test_clusters_match_brute_force(spark, seed, eps, samples):
    agree(spark, random_points(seed), eps, samples)


def test_clusters_with_split_cells(spark, monkeypatch):
    """Tiny limits: every cell is hot and every undecided link is halved."""
    monkeypatch.setattr(D, "OPEN_PART", 1)
    monkeypatch.setattr(D, "DIRECT_PAIRS", 0)
    agree(spark, random_points(4, 250, 2.0), 0.6, 5)


def hot_points(n_hot: int, n_thin: int) -> pd.DataFrame:
    """One crowded spot, thin points about as far from it as eps 0.5, and a few far away or in other classes."""
    frame = random_points(7, n_hot + n_thin + 6)
    rng = np.random.default_rng(8)
    frame["event_class"], frame["weight"] = "INFO", 1
    for name in X.NUMERIC:
        frame[name] = rng.uniform(0, 0.15, len(frame))
    thin = slice(n_hot, n_hot + n_thin)
    away = rng.normal(size=(n_thin, len(X.NUMERIC)))
    away *= rng.uniform(0.3, 0.8, (n_thin, 1)) / np.linalg.norm(away, axis=1, keepdims=True)
    frame.loc[frame.index[thin], X.NUMERIC] = 0.07 + away
    frame.loc[frame.index[-6:], X.NUMERIC] = [[9.0 + k] * 6 for k in range(6)]
    frame.loc[frame.index[-3:], "event_class"] = ["WARNING", "ERROR", "WARNING"]
    return frame


def test_clusters_round_a_hot_cell(spark):
    agree(spark, hot_points(900, 250), 0.5, 40)


def test_hot_cells_are_counted_by_weight(spark, monkeypatch):
    """What is written about thin points grows with them, not with the points of a crowded cell they reach."""
    monkeypatch.setattr(D, "OPEN_PART", 8)
    rows = {}
    for n_hot in (300, 2400):
        frame = hot_points(n_hot, 120)
        model = D.DensityModel(spark.createDataFrame(frame).repartition(4), 0.5, 20)
        assert model.counted.agg(F.min("weight")).first()[0] >= 1
        rows[n_hot] = model.counted.count() + model.close.count()
        assert model.counted.groupBy("v", "cell").count().where("count > 1").isEmpty()
    assert rows[2400] <= 2 * rows[300]


@pytest.mark.parametrize("k", [2, 60, 1150])
def test_k_distances_match_brute_force(spark, k):
    frame = hot_points(1000, 200)
    frame.loc[3, "weight"] = 9
    got = k_distances(spark.createDataFrame(frame).repartition(4), k).toPandas().sort_values("message_length")
    z = frame[X.NUMERIC].to_numpy()
    other = (frame.event_class.to_numpy()[:, None] != frame.event_class.to_numpy()[None, :]) * 2.0
    d = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(-1) + other)
    order = np.argsort(d, axis=1, kind="stable")
    reached = np.cumsum(frame.weight.to_numpy()[order], axis=1) >= k
    want = np.take_along_axis(d, order, axis=1)[np.arange(len(d)), reached.argmax(axis=1)]
    assert got.k_distance.to_numpy() == pytest.approx(want, abs=1e-9)
    assert got.weight.sum() == frame.weight.sum()


def test_clusters_of_log_vectors_at_auto_parameters(spark, logs):
    points = X.feature_vectors(X.vectors(X.signatures(X.clean(logs))))
    frame = points.toPandas()
    rows = int(frame.weight.sum())
    assert density_parameters(points, rows, DEFAULTS) == (DEFAULTS.eps, DEFAULTS.min_samples, False)
    eps, samples, derived = density_parameters(points, rows, DEFAULTS.with_(density="derived"))
    assert derived and samples == 10
    # brute-force k-distance over the expanded rows
    z = np.repeat(frame[X.FEATURES].to_numpy(), frame.weight, axis=0)
    d = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(-1))
    assert eps == pytest.approx(max(np.percentile(np.sort(d, axis=1)[:, samples - 1], 95), 0.1))


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(f"n{a:03}", f"n{b:03}") for a, b in rng.integers(0, 300, (220, 2)) if a != b]
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(300)], "id string")
    edges = spark.createDataFrame(pairs, "a string, b string").repartition(6)
    got = {r["id"]: r["root"] for r in connected_components(nodes, edges).collect()}
    want = {f"n{i:03}": f"n{i:03}" for i in range(300)}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(want[a], want[b])
            changed |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    assert got == want


def test_row_index_is_dense_and_ordered(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("t"), F.col("id").alias("n")).repartition(9)
    got = with_row_index(rows, "t", "n").orderBy("row_idx").toPandas()
    assert got.row_idx.tolist() == list(range(1000))
    assert got.sort_values(["t", "n"]).row_idx.tolist() == list(range(1000))


def test_hot_keys_and_null_keys_keep_every_row(spark):
    """One key owns a third of the rows, a third has no key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    left = spark.range(3000).select("id", key.alias("k"))
    facts = left.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = attach_by_key(left, facts.where("k <> 'k7'"), ["k"], F.col("id"), "n", hot_rows=500)
    want = left.join(facts.where("k <> 'k7'"), "k", "left").select("id", "k", "n", "top")
    assert got.count() == 3000
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("q", [0.0, 0.37, 0.95, 1.0])
def test_weighted_quantile(spark, q):
    rng = np.random.default_rng(5)
    values, weights = rng.random(200), rng.integers(1, 9, 200)
    rows = spark.createDataFrame(pd.DataFrame({"v": values, "w": weights}))
    got = weighted_quantile(rows, "v", "w", q).first()[0]
    assert got == pytest.approx(np.percentile(np.repeat(values, weights), q * 100))


# ------------------------------------------------------------------- forest
@pytest.fixture(scope="module")
def outlier_points(spark):
    frame = random_points(9, 400, 1.0)
    frame.loc[:4, "log_length"] = 25.0
    points = spark.createDataFrame(frame)
    return points.withColumns(X.one_hot())


def test_forest_finds_outliers_and_repeats(spark, outlier_points):
    params = DEFAULTS.with_(trees=60)
    first = I.fit_forest(outlier_points, params)
    again = I.fit_forest(outlier_points.repartition(7), params)
    pd.testing.assert_frame_equal(
        first.nodes.sort_values(["tree", "node"], ignore_index=True),
        again.nodes.sort_values(["tree", "node"], ignore_index=True),
    )
    scored = first.score(outlier_points).toPandas()
    assert scored.anomaly_score.between(0, 1).all()
    outside = scored.log_length > 20
    assert scored[outside].anomaly_score.min() > scored[~outside].anomaly_score.median()
    assert (scored[outside].anomaly_score > first.threshold).all()


def test_samples_follow_the_weights(spark, outlier_points):
    heavy = outlier_points.withColumn("weight", F.when(F.col("message_length") == 0, 10_000).otherwise(1).cast("long"))
    samples, size = I.draw_samples(heavy, DEFAULTS.with_(trees=20))
    assert size == 256 and samples.count() == 20 * 256
    at_outlier = F.col("x")[X.FEATURES.index("log_length")] == 25.0
    share = samples.agg(F.avg(at_outlier.cast("double"))).first()[0]
    assert 0.9 < share < 1.0


def test_contamination_sets_the_flagged_share(spark, outlier_points):
    forest = I.fit_forest(outlier_points, DEFAULTS.with_(trees=40, contamination=0.1))
    scored = I.scale_scores(forest.score(outlier_points), forest.threshold)
    flagged, total = scored.agg(F.sum(F.col("weight") * F.col("iforest_noise").cast("int")), F.sum("weight")).first()
    assert abs(flagged / total - 0.1) < 0.02


def test_forest_round_trip(spark, outlier_points, tmp_path):
    forest = I.fit_forest(outlier_points, DEFAULTS.with_(trees=10))
    forest.save(spark, str(tmp_path / "forest"))
    loaded = I.Forest.load(spark, str(tmp_path / "forest"))
    a = forest.score(outlier_points).orderBy("message_length").toPandas().anomaly_score
    b = loaded.score(outlier_points).orderBy("message_length").toPandas().anomaly_score
    assert (a == b).all()


def test_tree_depth_follows_the_paper():
    assert I.average_path(1) == 0 and I.average_path(2) == 1
    assert float(I.average_path(256)) == pytest.approx(10.2448, abs=1e-3)


def test_stored_splits_are_the_ones_used():
    """Between two adjacent doubles a drawn threshold can round up to the larger one."""
    from emberlog.operators.forest import _grow

    low = 1.0
    sample = np.array([[low], [np.nextafter(low, 2.0)]])
    for seed in range(50):
        root = _grow(sample, 8, np.random.default_rng(seed))[0]
        assert root[1] == 0 and root[2] == low
