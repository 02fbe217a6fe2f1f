"""Detectors, their parameters, evaluation against labels, and whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog import constants as K
from emberlog.functions import scoring
from emberlog.operators import evaluate, features as X, patterns, projection as P, tree_folds
from emberlog.operators.dbscan import dbscan, dbscan_noise
from emberlog.operators.forest import fit_forest, scale_scores
from emberlog.operators.neighbours import density_parameters as derive, k_distances
from emberlog.params import DEFAULTS
from emberlog.plans import runs
from emberlog.plans.analysis import analyze, score_unseen
from emberlog.session import cut_lineage, ensure_checkpoint_dir, store
from registry.base import scored_meter, scored_table, vector_table
from registry.catalogue import query
from registry.explore_queries import _RULES, _items
from registry.logs import logs_table
from registry.sql import _DISTANCE, density_ctes, from_clusters, from_events, from_flags, from_vectors

_KEY = "event_class, hour, message_length, tmpl_freq, svc_freq, burst"


@query("density_noise", from_flags(f"SELECT {_KEY}, weight, core, dbscan_noise AS noise FROM flags"))
def density_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core and noise vectors at the default radius."""
    return dbscan_noise(vector_table(spark, sf_dir), DEFAULTS.eps, DEFAULTS.min_samples)


@query(
    "density_noise_wide",
    from_vectors(f"SELECT {_KEY}, weight, core, dbscan_noise AS noise FROM flags", density_ctes(1.1, 25)),
)
def density_noise_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan_noise(vector_table(spark, sf_dir), 1.1, 25)


@query("density_clusters", from_clusters(f"SELECT {_KEY}, weight, core, dbscan_cluster FROM clustered"))
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(vector_table(spark, sf_dir), DEFAULTS.eps, DEFAULTS.min_samples).drop("first_row", "noise")


_DERIVED = f"""size AS (SELECT CAST(sum(weight) AS BIGINT) AS n FROM vec),
pick AS (SELECT n, greatest(4, least(10, greatest(4, n // 100))) AS k FROM size),
pairs AS (SELECT a.v, a.weight AS w, b.weight AS bw, sqrt({_DISTANCE} + CASE WHEN a.event_class = b.event_class THEN 0 ELSE 2 END) AS d
  FROM vec a, vec b),
ranked AS (SELECT v, w, d, sum(bw) OVER (PARTITION BY v ORDER BY d ROWS UNBOUNDED PRECEDING) AS reached FROM pairs),
kd AS (SELECT v, any_value(w) AS w, min(d) AS d FROM ranked, pick WHERE reached >= least(k, n) GROUP BY v),
rows_kd AS (SELECT d, unnest(range(w)) FROM kd)"""


@query(
    "density_parameters",
    from_vectors(
        "SELECT n AS rows, k AS min_samples, round(greatest((SELECT quantile_cont(d, 0.95) FROM rows_kd), 0.1), 6) AS eps FROM pick",
        _DERIVED,
    ),
)
def density_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius and neighbour count derived from the vectors."""
    points = vector_table(spark, sf_dir)
    rows = points.agg(F.sum("weight")).first()[0]
    eps, samples, _ = derive(points, rows, DEFAULTS.with_(density="derived"))
    return points.agg(F.sum("weight").alias("rows")).select(
        "rows", F.lit(samples).cast("long").alias("min_samples"), F.round(F.lit(eps), 6).alias("eps")
    )


@query(
    "neighbour_distances",
    from_vectors(f"SELECT {_KEY}, kd.w AS weight, round(kd.d, 6) AS k_distance FROM kd JOIN vec USING (v)", _DERIVED),
)
def neighbour_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every vector to its k-th nearest row."""
    points = vector_table(spark, sf_dir)
    rows = points.agg(F.sum("weight")).first()[0]
    samples = max(4, min(DEFAULTS.min_samples, max(4, rows // 100)))
    return k_distances(points, samples).withColumn("k_distance", F.round("k_distance", 6))


@query("isolation_forest")
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly score and flag of every distinct vector."""
    points = vector_table(spark, sf_dir)
    forest = fit_forest(points)
    scored = cut_lineage(forest.score(points))
    return scale_scores(scored, forest.threshold).select(
        *X.VECTOR_KEY, "weight", "anomaly_score", "iforest_noise", "model_prob"
    )


@query("analyzed_events")
def analyzed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run: both detectors fitted, every event scored."""
    return analyze(logs_table(spark, sf_dir)).events


@query("unseen_scores")
def unseen_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the logs, store the run, load it, and score the logs with it as if they were a new file."""
    logs = logs_table(spark, sf_dir)
    return score_unseen(_stored_run(spark, sf_dir).fitted, logs)


def _stored_run(spark: SparkSession, sf_dir: str):
    path = f"{ensure_checkpoint_dir(spark)}/runs/{uuid.uuid4().hex}"
    runs.save_run(analyze(logs_table(spark, sf_dir)), path)
    return runs.load_run(spark, path)


@query("stored_run_stages")
def stored_run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stage counts of a whole run, read from where the run is stored."""
    return _stored_run(spark, sf_dir).tables["stages"]


@query(
    "run_stage_counts",
    from_events(
        """SELECT count(*) AS input_rows, count(*) AS cleaned_rows, count(DISTINCT service) AS services, count(DISTINCT event_class) AS event_classes,
        count(DISTINCT CASE WHEN NOT dbscan_noise THEN dbscan_cluster END) AS dbscan_clusters, count_if(dbscan_noise) AS dbscan_noise,
        count_if(iforest_noise) AS isolation_forest_anomalies, count_if(dbscan_noise OR iforest_noise) AS ensemble_anomalies,
        CAST(17 AS BIGINT) AS model_features, (SELECT n FROM wins) AS apriori_windows, (SELECT count(*) FROM supp) AS itemsets,
        (SELECT count(*) FROM rules WHERE confidence >= 0.7 AND lift > 1.0) AS rules FROM ev""",
        _items(0.05),
        _RULES,
    ),
)
def run_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every count of a run's stages; those of the events were gathered while the event table was written."""
    events = scored_table(spark, sf_dir)
    windows = store(patterns.window_items(events))
    itemsets = store(patterns.frequent_itemsets(windows))
    counts = scored_meter(spark, sf_dir).read() | runs.pattern_counts(windows, itemsets, patterns.association_rules(itemsets))
    row = runs.stages_row(spark, counts | runs.cluster_count(patterns.cluster_summary(events)))
    return row.drop("auto_params", "detection_source", "detection_mode")


@query(
    "cluster_order",
    from_events(
        """SELECT row_number() OVER (ORDER BY size DESC, dbscan_cluster) - 1 AS position, dbscan_cluster, size
        FROM (SELECT dbscan_cluster, count(*) AS size FROM ev GROUP BY dbscan_cluster)"""
    ),
)
def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.ranked_clusters(scored_table(spark, sf_dir)).select("position", "dbscan_cluster", "size")


@query("feature_projection")
def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.projection(vector_table(spark, sf_dir), scored_table(spark, sf_dir), X.VECTOR_KEY)


_X17 = "list_value(" + ", ".join(f"z{i}" for i in range(6)) + ", " + ", ".join(
    f"CASE WHEN e.event_class = '{c}' THEN 1.0 ELSE 0.0 END::DOUBLE" for c in K.EVENT_CLASSES
) + ")"
_NAMES = "[" + ", ".join(f"'{n}'" for n in X.FEATURES) + "]"


@query(
    "feature_importance",
    from_events(
        f"""SELECT feature, round(avg(CASE WHEN status = 'ANOMALY' THEN abs((value - m) / s) END), 6) AS importance FROM long JOIN stats USING (feature) GROUP BY feature""",
        f"""wide AS (SELECT e.status, {_X17} AS x FROM ev e JOIN vec v ON e.event_class = v.event_class AND e.hour = v.hour
          AND e.message_length = v.message_length AND e.tmpl_freq = v.tmpl_freq AND e.svc_freq = v.svc_freq AND e.burst = v.burst),
        long AS MATERIALIZED (SELECT status, {_NAMES}[i + 1] AS feature, x[i + 1] AS value FROM (SELECT *, unnest(range(17)) AS i FROM wide)),
        stats AS (SELECT feature, avg(value) AS m, CASE WHEN max(value) = min(value) THEN 1.0 ELSE stddev_pop(value) END AS s FROM long GROUP BY feature)""",
    ),
)
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = runs.anomaly_points(scored_table(spark, sf_dir), vector_table(spark, sf_dir))
    return P.feature_importance(points).withColumn("importance", F.round("importance", 6))


# ------------------------------------------------------------- evaluation
_TRUTH = "CASE label WHEN 'anomaly' THEN 1 WHEN 'normal' THEN 0 END"
_COUNTS = f"""ans AS (SELECT {_TRUTH} AS t, CASE WHEN {{flag}} THEN 1 ELSE 0 END AS p, model_prob AS score FROM ev),
cnt AS (SELECT count(*) AS n, count_if(t = 1) AS positives, count_if(t = 0 AND p = 0) AS tn, count_if(t = 0 AND p = 1) AS fp,
  count_if(t = 1 AND p = 0) AS fn, count_if(t = 1 AND p = 1) AS tp FROM ans WHERE t IS NOT NULL)"""
_METRICS = """SELECT n, positives, tn, fp, fn, tp, round((tp + tn) / n, 9) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM cnt WHERE n >= 2 AND positives > 0 AND positives < n"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_table(spark, sf_dir).withColumn("truth", scoring.ground_truth("label"))


def _rounded(report: DataFrame) -> DataFrame:
    return report.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@query("ground_truth_metrics", from_events(_METRICS, _COUNTS.replace("{flag}", "status = 'ANOMALY'")))
def ground_truth_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble verdict against the supplied labels."""
    rows = _labelled(spark, sf_dir).withColumn("predicted", scoring.is_anomaly())
    return _rounded(evaluate.classification_report(rows, "truth", "predicted"))


@query("forest_only_metrics", from_events(_METRICS, _COUNTS.replace("{flag}", "iforest_noise")))
def forest_only_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.classification_report(_labelled(spark, sf_dir), "truth", "model_pred"))


@query(
    "metrics_by_service",
    from_events(
        """SELECT *, round((tp + tn) / n, 9) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS "precision",
        round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
        round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1
        FROM (SELECT service, count(*) AS n, count_if(t = 1) AS positives, count_if(t = 0 AND p = 0) AS tn, count_if(t = 0 AND p = 1) AS fp,
          count_if(t = 1 AND p = 0) AS fn, count_if(t = 1 AND p = 1) AS tp
          FROM (SELECT service, """ + _TRUTH + """ AS t, CASE WHEN status = 'ANOMALY' THEN 1 ELSE 0 END AS p FROM ev) WHERE t IS NOT NULL GROUP BY service)"""
    ),
)
def metrics_by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts against labels, service by service, also where all labels are of one class."""
    rows = _labelled(spark, sf_dir).withColumn("predicted", scoring.is_anomaly())
    return _rounded(evaluate.classification_report(rows, "truth", "predicted", both_classes=False, by=("service",)))


@query(
    "roc_auc",
    from_events(
        """SELECT round(sum(CASE WHEN t = 1 THEN below + same / 2 ELSE 0 END) / (count_if(t = 1) * count_if(t = 0)), 9) AS roc_auc FROM
        (SELECT t, (SELECT count(*) FROM ans x WHERE x.t = 0 AND x.score < a.score) AS below,
        (SELECT count(*) FROM ans x WHERE x.t = 0 AND x.score = a.score) AS same FROM ans a WHERE t IS NOT NULL)""",
        _COUNTS.replace("{flag}", "iforest_noise"),
    ),
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.roc_auc(_labelled(spark, sf_dir), "truth", "model_prob")
    return rows.withColumn("roc_auc", F.round("roc_auc", 9))


@query(
    "roc_curve",
    from_events(
        """SELECT COALESCE(CAST(score AS VARCHAR), 'start') AS threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM (
        SELECT CAST(score AS DOUBLE) AS score, fps / nn AS fpr, tps / pp AS tpr FROM (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn,
          lead(pos) OVER w AS np, lead(neg) OVER w AS ng, row_number() OVER w AS nth FROM (SELECT score, count_if(t = 1) AS pos, count_if(t = 0) AS neg FROM ans WHERE t IS NOT NULL GROUP BY score)
          WINDOW w AS (ORDER BY score DESC)) WHERE np IS NULL OR nth = 1 OR np <> pos OR ng <> neg
        UNION ALL SELECT NULL, 0, 0)""",
        _COUNTS.replace("{flag}", "iforest_noise"),
    ),
)
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.roc_curve(_labelled(spark, sf_dir), "truth", "model_prob")
    shown = F.when(F.col("threshold") == F.lit(float("inf")), F.lit("start")).otherwise(F.col("threshold").cast("string"))
    return rows.select(shown.alias("threshold"), F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(
    "temporal_split",
    from_events(
        "SELECT event_id, CASE WHEN row_idx < CAST(floor((SELECT count(*) FROM ev) * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM ev"
    ),
)
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = scored_table(spark, sf_dir)
    part = evaluate.temporal_part("row_idx", events.count(), DEFAULTS.test_size)
    return events.select("event_id", part.alias("part"))


def _tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.with_text_measures(scored_table(spark, sf_dir))
    return rows.withColumn("truth", scoring.is_anomaly().cast("int"))


@query(
    "evaluation_splits",
    from_events(
        """SELECT split, count_if(NOT test) AS train_n, count_if(test) AS test_n, count_if(NOT test AND t = 1) AS train_positives,
        count_if(test AND t = 1) AS test_positives FROM split_rows GROUP BY split""",
        """ranked AS MATERIALIZED (SELECT row_idx, CASE WHEN status = 'ANOMALY' THEN 1 ELSE 0 END AS t,
          row_number() OVER (PARTITION BY status = 'ANOMALY' ORDER BY md5('42:' || line_no), line_no) - 1 AS r FROM ev),
        class_n AS (SELECT count(*) AS n, count_if(t = 1) AS n1, count_if(t = 0) AS n0, (count(*) * 200000 + 999999) // 1000000 AS test FROM ranked),
        test_low AS (SELECT *, n0 * test // n AS l0, n1 * test // n AS l1, n1 * test % n > n0 * test % n AS up FROM class_n),
        test_n AS (SELECT n, l0 + CASE WHEN l0 + l1 < test AND NOT up THEN 1 ELSE 0 END AS t0, l1 + CASE WHEN l0 + l1 < test AND up THEN 1 ELSE 0 END AS t1,
          least(5, n0, n1) AS k FROM test_low),
        parts_of AS (SELECT t, r < CASE WHEN t = 1 THEN t1 ELSE t0 END AS held, row_idx >= CAST(floor(n * 0.8) AS BIGINT) AS late, r % k AS fold, k
          FROM ranked, test_n),
        split_rows AS (SELECT 'holdout' AS split, t, held AS test FROM parts_of UNION ALL SELECT 'temporal', t, late FROM parts_of
          UNION ALL SELECT 'fold ' || (f + 1), t, fold = f FROM parts_of, range(5) AS folds(f) WHERE f < k)""",
    ),
)
def evaluation_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the stratified hold-out, the temporal hold-out and the stratified folds."""
    rows = _tree_rows(spark, sf_dir)
    split = tree_folds.plan_split(rows, "truth")
    parted = tree_folds.with_parts(rows, "truth", "line_no", "row_idx", split)
    return tree_folds.part_counts(parted, "truth", split.folds)


@query("classifier_evaluation")
def classifier_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a decision tree reproduces the detector's verdict, per split; all trees are grown together."""
    return tree_folds.evaluate_trees(_tree_rows(spark, sf_dir), "truth", "line_no", "row_idx")


@query("classifier_folds")
def classifier_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of accuracy and F1 over the folds."""
    return tree_folds.fold_summary(classifier_evaluation(spark, sf_dir))
