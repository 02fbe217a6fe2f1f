"""Post-hoc evaluation against labels; labels never take part in detection."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from emberlog import constants as K
from emberlog.operators.ordering import running_total, with_row_index
from emberlog.params import DEFAULTS, Params


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def classification_report(
    rows: DataFrame, truth: str, predicted: str, both_classes: bool = True, by: tuple[str, ...] = ()
) -> DataFrame:
    """One row, or one per value of ``by``: counts, accuracy, precision, recall, F1 and the 2x2 counts.

    Rows without a label are left out; no row without labels or, unless ``both_classes`` is false, without both classes.
    """
    t, p = F.col(truth), F.col(predicted).cast("int")
    counted = rows.where(t.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(t == 1).alias("positives"),
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    wanted = "n >= 2 AND positives > 0 AND positives < n" if both_classes else "n > 0"
    return counted.where(wanted).withColumns(
        {
            "accuracy": _ratio(tp + F.col("tn"), F.col("n")),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def _by_score(rows: DataFrame, truth: str, score: str) -> DataFrame:
    return (
        rows.where(F.col(truth).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    )


def _score_bucket():
    return F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * 1024)


def roc_auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: area under the ROC curve by rank sum, exact for tied scores.

    Scores lie in [0, 1].  Equal scores are merged, and the running count is
    taken in score buckets, so no task orders all rows.
    """
    placed = running_total(_by_score(rows, truth, score), _score_bucket(), ["score"], "neg", "below")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return placed.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def roc_curve(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Points (threshold, fpr, tpr) by falling score, with the origin; straight runs keep their ends."""
    merged = _by_score(rows, truth, score)
    up = running_total(merged, _score_bucket(), ["score"], "pos", "pos_above", reverse=True)
    up = running_total(up, _score_bucket(), ["score"], "neg", "neg_above", reverse=True)
    placed = up.withColumns(
        {"tps": F.col("pos_above") + F.col("pos"), "fps": F.col("neg_above") + F.col("neg")}
    )
    # a point is dropped when it lies on the line through its neighbours' steps;
    # the neighbour is found by position, with an equi join
    ranked = running_total(
        placed.withColumn("one", F.lit(1)), _score_bucket(), ["score"], "one", "at", reverse=True
    )
    following = ranked.select(
        (F.col("at") - 1).alias("at"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg")
    )
    step = ranked.join(following, "at", "left")
    corner = (
        F.col("next_pos").isNull()
        | (F.col("at") == 0)
        | (F.col("pos") != F.col("next_pos"))
        | (F.col("neg") != F.col("next_neg"))
    )
    totals = merged.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("s")).scalar()
    kept = step.where(corner).select(
        F.col("score").alias("threshold"),
        (F.col("fps") / totals.getField("n")).alias("fpr"),
        (F.col("tps") / totals.getField("p")).alias("tpr"),
    )
    origin = merged.limit(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return kept.unionByName(origin)


# ------------------------------------------------------- supervised check
NUMERIC_TREE = (
    "hour", "message_length", "token_count", "digit_ratio",
    "log_template_freq", "log_service_freq", "log_burst",
)


def top_services(rows: DataFrame, limit: int) -> list[str]:
    """The most frequent services (a bounded list used as column names)."""
    counted = rows.groupBy("service").agg(F.count("*").alias("n"))
    return [r["service"] for r in counted.orderBy(F.col("n").desc(), "service").limit(limit).collect()]


def service_places(counted: DataFrame) -> DataFrame:
    """``counted(service, n)`` with ``service_index``, the place of every service: most frequent first, equal counts in text order."""
    return with_row_index(counted, F.col("n").desc(), "service", name="service_index")


def tree_matrix(rows: DataFrame, services: list[str]) -> DataFrame:
    """Seven numeric columns, eleven class flags and one flag per given service."""
    columns = {
        "log_template_freq": F.log1p(F.col("tmpl_freq").cast("double")),
        "log_service_freq": F.log1p(F.col("svc_freq").cast("double")),
        "log_burst": F.log1p(F.col("burst").cast("double")),
    }
    columns |= {"evt_" + c: (F.col("event_class") == c).cast("int") for c in K.EVENT_CLASSES}
    columns |= {"svc_" + s: (F.col("service") == s).cast("int") for s in services}
    return rows.withColumns(columns)


def tree_columns(services: list[str]) -> list[str]:
    return [*NUMERIC_TREE, *["evt_" + c for c in K.EVENT_CLASSES], *["svc_" + s for s in services]]


def _balanced(train: DataFrame, truth: str) -> DataFrame:
    facts = train.groupBy(truth).agg(F.count("*").alias("c")).collect()  # two rows
    total = sum(r["c"] for r in facts)
    weight = F.lit(1.0)
    for r in facts:
        weight = F.when(F.col(truth) == r[truth], F.lit(total / (len(facts) * r["c"]))).otherwise(weight)
    return train.withColumn("class_weight", weight)


def _fit_and_score(train: DataFrame, test: DataFrame, truth: str, columns, params: Params) -> DataFrame:
    """Scores of ``test``; all services of ``train`` are one category column, unseen ones its last value."""
    indexer = StringIndexer(inputCol="service", outputCol="service_index", handleInvalid="keep").fit(train)
    values = len(indexer.labels) + 1
    if values <= train.count():  # else every row has a service of its own, of which Spark makes no category
        columns = [*columns, "service_index"]
        train, test = indexer.transform(train), indexer.transform(test)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    tree = DecisionTreeClassifier(
        labelCol=truth, featuresCol="features", weightCol="class_weight",
        maxDepth=params.tree_max_depth, minInstancesPerNode=params.tree_min_leaf, seed=params.seed,
        maxBins=max(32, values),
    )
    model = tree.fit(assembler.transform(_balanced(train, truth)))
    scored = model.transform(assembler.transform(test))
    return scored.select(
        F.col(truth).alias("truth"),
        F.col("prediction").cast("int").alias("predicted"),
        F.round(vector_to_array("probability")[1], 9).alias("probability"),
    )


def _summary(scored: DataFrame, split: str) -> DataFrame:
    area = roc_auc(scored, "truth", "probability").scalar()
    return classification_report(scored, "truth", "predicted").select(
        F.lit(split).alias("split"), "n", "positives", "accuracy", "precision", "recall", "f1",
        area.alias("roc_auc"),
    )


def temporal_part(position: str, total: int, test_size: float):
    """``train`` for the earliest rows, ``test`` for the latest share."""
    cut = int(total * (1 - test_size))
    return F.when(F.col(position) < cut, F.lit("train")).otherwise(F.lit("test"))


def evaluate_tree(rows: DataFrame, truth: str, key: str, params: Params = DEFAULTS) -> DataFrame:
    """Decision-tree check: hash hold-out, temporal hold-out and hash folds, one row each.

    ``rows`` carries the tree matrix inputs, a 0/1 ``truth`` and a unique ``key``.
    The hold-outs and folds hash the key, so classes split in proportion and
    no global shuffle of rows is needed.
    """
    classes = {r[truth]: r["c"] for r in rows.groupBy(truth).agg(F.count("*").alias("c")).collect()}
    if set(classes) != {0, 1} or min(classes.values()) < 2:
        raise ValueError("both classes are needed, with at least two rows each")
    columns = tree_columns([])
    data = tree_matrix(rows, [])
    point = F.pmod(F.xxhash64(F.lit(params.seed), F.col(key)), F.lit(1_000_000)) / 1_000_000.0
    held = point < params.test_size
    results = [
        _summary(_fit_and_score(data.where(~held), data.where(held), truth, columns, params), "holdout")
    ]
    indexed = with_row_index(data, "timestamp", key, name="_at")
    total = sum(classes.values())
    part = temporal_part("_at", total, params.test_size)
    early, late = indexed.where(part == "train"), indexed.where(part == "test")
    both = lambda d: d.select(truth).distinct().count() == 2
    if both(early) and both(late):
        results.append(_summary(_fit_and_score(early, late, truth, columns, params), "temporal"))
    folds = min(5, min(classes.values()))
    for k in range(folds):
        fold = F.floor(point * folds) == k
        results.append(
            _summary(_fit_and_score(data.where(~fold), data.where(fold), truth, columns, params), f"fold {k + 1}")
        )
    table = results[0]
    for more in results[1:]:
        table = table.unionByName(more)
    return table
