"""Clean log rows and derive frequency features.

Everything the detectors need is a function of one small key, the
*signature* (template, service, event class, time window, hour, message length).
Counting signatures once gives every frequency and the distinct feature
vectors; events are joined to them a single time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberlog import constants as K
from emberlog.functions import text, timing
from emberlog.operators.meter import Meter
from emberlog.operators.ordering import event_id, with_row_index
from emberlog.operators.skew import attach_by_key
from emberlog.params import DEFAULTS, Params
from emberlog.session import store

SIGNATURE = ["template", "service", "event_class", "window_start", "hour", "message_length"]
VECTOR_KEY = ["event_class", "hour", "message_length", "tmpl_freq", "svc_freq", "burst"]
NUMERIC = ["hour_sin", "hour_cos", "log_length", "log_template_freq", "log_service_freq", "log_burst"]
ONE_HOT = ["evt_" + c for c in K.EVENT_CLASSES]
FEATURES = NUMERIC + ONE_HOT


def clean(logs: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Normalised service, class, source, account, template and time parts per row."""
    raw_type = F.col("raw_event_type") if "raw_event_type" in logs.columns else None
    filled = F.coalesce(F.col("message"), F.lit(""))
    staged = (
        logs.withColumns(
            {
                "service_raw": text.normalise_service_raw(F.coalesce("service", F.lit("unknown"))),
                "message": text.strip(filled),
            }
        )
        .withColumn("service", text.normalise_service("service_raw"))
        .withColumn("_lowered", F.lower("message"))
    )
    # through explode (of one element), so that a filter on the class runs on
    # the finished value instead of a pushed-down copy of all the rules
    classes = F.array(text.classify_event("_lowered", "service", raw_type))
    return (
        staged.select("*", F.explode(classes).alias("event_class"))
        .drop("_lowered")
        .withColumns(
            {
                "src_host": text.source_host("message"),
                "target_user": text.target_user("message"),
                "hour": F.hour("timestamp").cast("long"),
                "message_length": F.length("message").cast("long"),
                "template": text.message_template("message"),
                "window_start": timing.window_start("timestamp", params.window_minutes),
            }
        )
    )


def with_event_ids(logs: DataFrame, params: Params = DEFAULTS, meter: Meter | None = None) -> DataFrame:
    """Clean rows with their dense position in time order (input order breaks ties) and the id built on it.

    Raw rows are put in order; they are cleaned where the ordered table is
    written, so every pattern runs once a row.  A ``meter`` counts rows before and after cleaning in that pass.
    """
    watch = (lambda df, **metrics: df) if meter is None else meter.watch

    def cleaned(ordered: DataFrame) -> DataFrame:
        counted = watch(ordered, input_rows=F.count(F.lit(1)))
        return store(watch(clean(counted, params), cleaned_rows=F.count(F.lit(1))))

    indexed = with_row_index(logs, "timestamp", "line_no", keep=cleaned)
    return indexed.withColumn("event_id", event_id())


def signatures(cleaned: DataFrame) -> DataFrame:
    """Distinct signatures with their row count, first row and the three frequencies.

    The counted signatures are stored, since each frequency is summed from and joined to them.
    """
    order = F.struct("timestamp", "line_no")
    counted = store(
        cleaned.groupBy(*SIGNATURE).agg(F.count("*").alias("n"), F.min(order).alias("first_row"))
    )
    out = counted
    spread_by = F.struct("window_start", "message_length", "template")
    for keys, name in (
        (["template"], "tmpl_freq"),
        (["service"], "svc_freq"),
        (["service", "event_class", "window_start"], "burst"),
    ):
        totals = counted.groupBy(*keys).agg(F.sum("n").alias(name), F.count("*").alias("_rows"))
        out = attach_by_key(out, totals, keys, spread_by, "_rows").drop("_rows")
    return out


def attach(cleaned: DataFrame, facts: DataFrame) -> DataFrame:
    """Per-signature facts onto the rows: the one wide shuffle of the events."""
    return attach_by_key(
        cleaned, facts.drop("first_row"), SIGNATURE, F.col("line_no"), "n"
    ).drop("n")


def with_frequencies(cleaned: DataFrame) -> DataFrame:
    """Rows with ``tmpl_freq``, ``svc_freq`` and ``burst``."""
    return attach(cleaned, signatures(cleaned))


def with_text_measures(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "token_count": text.token_count("message").cast("long"),
            "digit_ratio": text.digit_ratio("message"),
        }
    )


def vectors(signature_table: DataFrame) -> DataFrame:
    """Weighted distinct feature vectors: an exact compaction of the rows."""
    return signature_table.groupBy(*VECTOR_KEY).agg(
        F.sum("n").alias("weight"), F.min("first_row").alias("first_row")
    )


def numeric_features() -> dict[str, Column]:
    """The six numeric features before scaling."""
    angle = F.lit(2.0) * F.pi() * F.col("hour") / F.lit(24.0)
    return {
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "log_length": F.log1p(F.col("message_length").cast("double")),
        "log_template_freq": F.log1p(F.col("tmpl_freq").cast("double")),
        "log_service_freq": F.log1p(F.col("svc_freq").cast("double")),
        "log_burst": F.log1p(F.col("burst").cast("double")),
    }


def one_hot() -> dict[str, Column]:
    return {
        "evt_" + name: (F.col("event_class") == name).cast("double") for name in K.EVENT_CLASSES
    }


def scaler_moments(points: DataFrame, weight: str = "weight") -> DataFrame:
    """One row: weighted mean and population deviation of each numeric feature.

    A constant feature gets deviation 1, so it scales to exactly 0.
    """
    w = F.col(weight).cast("double")
    moments = []
    for name, x in numeric_features().items():
        mean = F.sum(w * x) / F.sum(w)
        variance = F.sum(w * x * x) / F.sum(w) - mean * mean
        constant = (F.max(x) == F.min(x)) | (variance <= 0)
        moments += [
            F.when(constant, F.max(x)).otherwise(mean).alias(name + "_mean"),
            F.when(constant, F.lit(1.0)).otherwise(F.sqrt(variance)).alias(name + "_std"),
        ]
    return points.agg(*moments)


def fit_scaler(points: DataFrame, weight: str = "weight") -> dict[str, float]:
    """The moments as twelve numbers, so later plans carry plain literals."""
    return scaler_moments(points, weight).first().asDict()


def scale(points: DataFrame, moments: dict[str, float]) -> DataFrame:
    """Standardised numeric features."""
    return points.withColumns(
        {
            name: (x - F.lit(moments[name + "_mean"])) / F.lit(moments[name + "_std"])
            for name, x in numeric_features().items()
        }
    )


def feature_vectors(points: DataFrame, moments: dict[str, float] | None = None) -> DataFrame:
    """The 17 model features per distinct vector (fits the scaler unless given one)."""
    fitted = fit_scaler(points) if moments is None else moments
    return scale(points, fitted).withColumns(one_hot())
