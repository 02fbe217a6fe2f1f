"""Hold-outs and folds of the decision-tree check, all trees grown together.

Rows are binned once and counted per distinct binned row, so the trees see a
table of counts, not the rows.  A *model* is one train/test part: the
stratified hold-out, the temporal hold-out and each fold.  Every level of
all trees is one aggregate over (model, node, feature, bin), whose size depends
on the numbers of models, nodes, features and bins only.

Nodes are numbered like a heap: the root is 1, the children of ``i`` are
``2i`` and ``2i + 1``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog import constants as K
from emberlog.operators.evaluate import NUMERIC_TREE, temporal_part
from emberlog.operators.ordering import running_total
from emberlog.operators.skew import attach_by_key
from emberlog.params import DEFAULTS, Params
from emberlog.session import store

BINS = 64
HOLDOUT, TEMPORAL, FIRST_FOLD = 0, 1, 2
MAX_FOLDS = 5
_PREFIX = 3  # hex digits of the row hash that place a row in a bucket: 4096 a class


@dataclass(frozen=True)
class Split:
    """Numbers that fix the parts: rows per class, test rows per class, folds."""

    negatives: int
    positives: int
    test_negatives: int
    test_positives: int
    folds: int

    @property
    def total(self) -> int:
        return self.negatives + self.positives


def plan_split(rows: DataFrame, truth: str, params: Params = DEFAULTS) -> Split:
    """Class counts and the exact stratified test size of both classes.

    The test part holds ``ceil(total * test_size)`` rows, shared out in proportion; the row
    left over by rounding down goes to the class with the larger remainder, of equal ones to class 0.
    """
    counts = {r[truth]: r["c"] for r in rows.groupBy(truth).agg(F.count("*").alias("c")).collect()}  # two rows
    if set(counts) != {0, 1} or min(counts.values()) < 2:
        raise ValueError("both classes are needed, with at least two rows each")
    total = counts[0] + counts[1]
    share = round(params.test_size * 1_000_000)
    test = -(-total * share // 1_000_000)
    low = [counts[0] * test // total, counts[1] * test // total]
    if sum(low) < test:
        low[int(counts[1] * test % total > counts[0] * test % total)] += 1
    return Split(counts[0], counts[1], *low, min(MAX_FOLDS, min(counts.values())))


def row_hash(key: str, params: Params = DEFAULTS) -> Column:
    return F.md5(F.concat(F.lit(f"{params.seed}:"), F.col(key).cast("string")).cast("binary"))


def with_parts(
    rows: DataFrame, truth: str, key: str, position: str, split: Split, params: Params = DEFAULTS
) -> DataFrame:
    """Add ``held`` (stratified test row), ``late`` (temporal test row) and ``fold``.

    Rows of a class are ranked by the hash of their unique ``key``: the first are the test part, and
    the folds deal the ranks in turn, so class counts of the folds differ by one at most.  ``position`` is
    the dense place in time order.  Ranks are counted inside 4096 hash buckets a class.
    """
    hashed = rows.withColumns({"_h": row_hash(key, params), "_one": F.lit(1).cast("long")})
    bucket = F.col(truth).cast("long") * 16**_PREFIX + F.conv(F.substring("_h", 1, _PREFIX), 16, 10).cast("long")
    ranked = running_total(hashed, bucket, ["_h", key], "_one", "_rank")
    rank = F.col("_rank") - F.when(F.col(truth) == 1, F.lit(split.negatives)).otherwise(F.lit(0))
    test = F.when(F.col(truth) == 1, F.lit(split.test_positives)).otherwise(F.lit(split.test_negatives))
    return ranked.withColumns(
        {
            "held": rank < test,
            "late": temporal_part(position, split.total, params.test_size) == "test",
            "fold": (rank % split.folds).cast("int"),
        }
    ).drop("_h", "_one", "_rank")


def part_counts(parted: DataFrame, truth: str, folds: int) -> DataFrame:
    """One row per model: ``split train_n test_n train_positives test_positives``."""
    counted = parted.groupBy("held", "late", "fold", F.col(truth).alias("t")).agg(F.count("*").alias("n"))
    model, tested = _models(folds)
    long = counted.select("t", "n", "held", "late", "fold", F.explode(model).alias("model"))
    n, test = F.col("n"), tested
    total = lambda flag: F.coalesce(F.sum(F.when(flag, n)), F.lit(0))
    sums = long.groupBy("model").agg(
        total(~test).alias("train_n"),
        total(test).alias("test_n"),
        total(~test & (F.col("t") == 1)).alias("train_positives"),
        total(test & (F.col("t") == 1)).alias("test_positives"),
    )
    return sums.select(_name().alias("split"), *[c for c in sums.columns if c != "model"])


def _models(folds: int) -> tuple[Column, Column]:
    """The models as an array, and whether a row of (parts, ``model``) is in the test part."""
    model = F.col("model")
    tested = (
        F.when(model == HOLDOUT, F.col("held"))
        .when(model == TEMPORAL, F.col("late"))
        .otherwise(F.col("fold") == model - FIRST_FOLD)
    )
    return F.sequence(F.lit(0), F.lit(FIRST_FOLD + folds - 1)), tested


def _name() -> Column:
    fold = F.concat(F.lit("fold "), (F.col("model") - FIRST_FOLD + 1).cast("string"))
    return F.when(F.col("model") == HOLDOUT, "holdout").when(F.col("model") == TEMPORAL, "temporal").otherwise(fold)


# ------------------------------------------------------------------ binning
def _numeric(rows: DataFrame) -> DataFrame:
    """The seven numbers; a null counts as zero."""
    logs = {"log_template_freq": "tmpl_freq", "log_service_freq": "svc_freq", "log_burst": "burst"}
    return rows.withColumns(
        {name: F.coalesce(F.col(logs.get(name, name)).cast("double"), F.lit(0.0)) for name in NUMERIC_TREE}
    )


def _cuts(rows: DataFrame) -> list[list[float]]:
    """At most ``BINS - 1`` quantile cuts per number (bounded by features and bins)."""
    shares = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(c, shares, 100_000).alias(c) for c in NUMERIC_TREE]).first()
    return [sorted(set(found[c])) for c in NUMERIC_TREE]


def _bin(column: str, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda cut: cut < F.col(column)))


def binned(rows: DataFrame, truth: str) -> DataFrame:
    """Counts ``n`` per ``(bins, service, held, late, fold, t)``: 18 bins a row, classes as flags."""
    numeric = _numeric(rows)
    cuts = _cuts(numeric)
    flags = [(F.col("event_class") == c).cast("int") for c in K.EVENT_CLASSES]
    bins = F.array(
        *[_bin(c, cut) for c, cut in zip(NUMERIC_TREE, cuts)], *[F.coalesce(f, F.lit(0)) for f in flags]
    )
    service = F.coalesce("service", F.lit(""))
    return numeric.groupBy(
        bins.alias("bins"), service.alias("service"), "held", "late", "fold", F.col(truth).alias("t")
    ).agg(F.count("*").alias("n"))


def _with_services(counted: DataFrame, folds: int) -> DataFrame:
    """Add ``service_bins``: per model, the share of positives among its training rows of the service.

    Services are one ordered category, however many there are; a service that no training row of a model has
    gets the first bin.
    """
    model, tested = _models(folds)
    parts = counted.groupBy("service", "held", "late", "fold", "t").agg(F.sum("n").alias("n"), F.count("*").alias("_rows"))
    long = parts.select("*", F.explode(model).alias("model"))
    train = F.when(~tested, F.col("n"))
    shares = long.groupBy("service", "model").agg(
        (F.sum(F.when(F.col("t") == 1, train)) / F.sum(train)).alias("share"), F.sum("_rows").alias("_rows")
    )
    place = F.floor(F.coalesce("share", F.lit(0.0)) * (BINS - 1)).cast("int")
    facts = shares.groupBy("service").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("model", place.alias("bin")))), lambda s: s["bin"]).alias("service_bins"),
        F.max("_rows").alias("_rows"),
    )
    return attach_by_key(counted, store(facts), ["service"], F.struct("bins", "held", "late", "fold"), "_rows").drop("_rows")


# ------------------------------------------------------------------ growing
def _best_splits(rows: DataFrame, weights: DataFrame, min_leaf: int) -> DataFrame:
    """``(model, node, feature, cut)``: the split of each node that lowers the weighted Gini impurity most.

    Rows with ``bin <= cut`` go left.  Both sides keep ``min_leaf`` rows.  Ties go to the first feature and cut.
    """
    counts = (
        rows.select("model", "node", "n0", "n1", F.posexplode("bins").alias("feature", "bin"))
        .groupBy("model", "node", "feature", "bin")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .join(F.broadcast(weights), "model")  # one row a model
    )
    # a window holds the bins of one feature in one node, so BINS rows at most
    one = W.partitionBy("model", "node", "feature")
    below = one.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    summed = counts.withColumns(
        {
            "l0": F.sum("n0").over(below), "l1": F.sum("n1").over(below),
            "a0": F.sum("n0").over(one), "a1": F.sum("n1").over(one),
        }
    )
    w0, w1 = F.col("w0"), F.col("w1")

    def impurity(n0: Column, n1: Column) -> Column:
        """Gini impurity times weight, which is 2ab / (a + b)."""
        a, b = n0 * w0, n1 * w1
        return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(F.lit(0.0))

    r0, r1 = F.col("a0") - F.col("l0"), F.col("a1") - F.col("l1")
    gain = impurity(F.col("a0"), F.col("a1")) - impurity(F.col("l0"), F.col("l1")) - impurity(r0, r1)
    allowed = (F.col("l0") + F.col("l1") >= min_leaf) & (r0 + r1 >= min_leaf)
    graded = summed.withColumn("gain", F.round(gain, 9)).where(allowed & (F.col("gain") > 0))
    best = F.max_by(F.struct("feature", F.col("bin").alias("cut")), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return graded.groupBy("model", "node").agg(best.alias("s")).select("model", "node", "s.feature", "s.cut")


def grow(counted: DataFrame, folds: int, params: Params = DEFAULTS) -> DataFrame:
    """Rows ``(model, node, tested, n0, n1)`` summed per leaf, of all trees."""
    model, tested = _models(folds)
    long = counted.select("*", F.explode(model).alias("model")).select(
        "model",
        F.lit(1).alias("node"),
        tested.alias("tested"),
        F.concat("bins", F.array(F.element_at("service_bins", F.col("model") + 1))).alias("bins"),
        F.when(F.col("t") == 0, F.col("n")).otherwise(F.lit(0)).alias("n0"),
        F.when(F.col("t") == 1, F.col("n")).otherwise(F.lit(0)).alias("n1"),
    )
    rows = store(long.groupBy("model", "node", "tested", "bins").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    totals = rows.where(~F.col("tested")).groupBy("model").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
    both = (F.col("c0") > 0) & (F.col("c1") > 0)
    weigh = lambda c: ((F.col("c0") + F.col("c1")) / (2 * F.col(c)))
    weights = store(totals.where(both).select("model", weigh("c0").alias("w0"), weigh("c1").alias("w1")))
    rows = rows.join(F.broadcast(weights), "model", "left_semi")
    for depth in range(params.tree_max_depth):
        growing = rows.where(~F.col("tested") & (F.col("node") >= 2**depth))
        # at most models * 2**depth rows
        splits = store(_best_splits(growing, weights, params.tree_min_leaf))
        if splits.isEmpty():
            break
        right = (F.element_at("bins", F.col("feature") + 1) > F.col("cut")).cast("int")
        moved = rows.join(F.broadcast(splits), ["model", "node"], "left")
        moved = moved.withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + right))
        rows = store(moved.drop("feature", "cut"))
    leaves = rows.groupBy("model", "node", "tested").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return leaves.join(F.broadcast(weights), "model")


def _scored(leaves: DataFrame) -> DataFrame:
    """Test rows per leaf with the leaf's weighted share of positives in training."""
    a, b = F.col("n0") * F.col("w0"), F.col("n1") * F.col("w1")
    share = leaves.where(~F.col("tested")).select("model", "node", F.round(b / (a + b), 9).alias("p"))
    return leaves.where("tested").join(share, ["model", "node"]).select("model", "p", "n0", "n1")


def evaluate_trees(
    rows: DataFrame, truth: str, key: str, position: str, params: Params = DEFAULTS
) -> DataFrame:
    """One row per split: sizes of both parts, 2x2 counts, accuracy, precision, recall, F1 and ROC AUC.

    ``rows`` carries the tree's inputs, a 0/1 ``truth`` (rows without one are left out), a unique ``key``
    and the dense ``position`` in time order.  The temporal hold-out has no row if one of its parts lacks a class;
    another test part without one has no AUC.
    Raises ``ValueError`` unless both classes occur twice.
    """
    rows = rows.where(F.col(truth).isNotNull())
    split = plan_split(rows, truth, params)
    parted = store(
        with_parts(rows, truth, key, position, split, params).select(
            "hour", "message_length", "token_count", "digit_ratio", "tmpl_freq", "svc_freq", "burst", "event_class",
            "service", "held", "late", "fold", F.col(truth).alias("t"),
        )
    )
    counted = store(binned(parted, "t"))
    leaves = grow(_with_services(counted, split.folds), split.folds, params)
    by_score = store(_scored(leaves).groupBy("model", "p").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    # a window holds the leaves of one tree
    below = W.partitionBy("model").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    placed = by_score.withColumn("below", F.coalesce(F.sum("n0").over(below), F.lit(0)))
    guessed = F.col("p") > 0.5
    total = lambda n, flag: F.coalesce(F.sum(F.when(flag, F.col(n))), F.lit(0))
    sums = placed.groupBy("model").agg(
        total("n0", ~guessed).alias("tn"), total("n0", guessed).alias("fp"),
        total("n1", ~guessed).alias("fn"), total("n1", guessed).alias("tp"),
        F.sum(F.col("n1") * (F.col("below") + F.col("n0") / 2)).alias("_wins"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    both = (tp + fn > 0) & (tn + fp > 0)
    named = sums.where(both | (F.col("model") != TEMPORAL)).select(
        _name().alias("split"), "tn", "fp", "fn", "tp",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.when(both, F.col("_wins") / ((tp + fn) * (tn + fp))).alias("roc_auc"),
    )
    sizes = part_counts(parted, "t", split.folds)
    return sizes.join(named, "split")


def fold_summary(evaluation: DataFrame) -> DataFrame:
    """One row: ``folds`` and mean and population deviation of accuracy and F1 over them."""
    folds = evaluation.where(F.col("split").startswith("fold "))
    return folds.agg(
        F.count("*").alias("folds"),
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"),
    )
