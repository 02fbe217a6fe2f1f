"""Streams that are scored and watched per micro-batch; a batch that is run again overwrites itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.plans.analysis import Analysis, FittedRun, score_unseen


def _by_batch(stream: DataFrame, path: str, checkpoint: str, result) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            result(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def score_stream(logs: DataFrame, fitted: Analysis | FittedRun, path: str, checkpoint: str) -> StreamingQuery:
    """Score arriving logs with a run's forest and training scale, a folder ``batch_id=...`` per micro-batch.

    Each micro-batch is scored like a file of its own: frequencies and the density verdict are those of its rows,
    and event ids count from 1 in it, so a row is named by ``batch_id`` and ``event_id``.
    """
    return _by_batch(logs, path, checkpoint, lambda batch: score_unseen(fitted, batch, reuse_training_stats=True))


def alert_windows(scored: DataFrame, window_minutes: int, late: str = "10 minutes") -> DataFrame:
    """``(window, times)``: counted anomaly times of stretches twice as long as the interval, overlapping by half.

    The closed interval that ends in the second half of a stretch lies in the stretch, so each interval is
    whole in one.  Equal times are merged before, and state is dropped when the watermark passes.
    """
    anomalies = scored.where(F.col("status") == "ANOMALY").select("timestamp").withWatermark("timestamp", late)
    # a state row per microsecond with anomalies
    times = anomalies.groupBy(F.window("timestamp", "1 second"), F.unix_micros("timestamp").alias("t")).agg(F.count("*").alias("c"))
    moment = times.select(F.window_time("window").alias("moment"), "t", "c")
    stretch = F.window("moment", f"{2 * window_minutes} minutes", f"{window_minutes} minutes")
    return moment.groupBy(stretch.alias("window")).agg(F.collect_list(F.struct("t", "c")).alias("times"))


def alert_stream(
    scored: DataFrame, path: str, checkpoint: str, threshold: int, window_minutes: int, late: str = "10 minutes"
) -> StreamingQuery:
    """Write every closed interval that reaches the threshold: ``(start, end, anomalies)``, as ``alert_intervals``.

    ``scored`` carries ``timestamp`` and ``status``.  Intervals come out when the watermark has passed
    their stretch; rows later than ``late`` are left out.  Raises ``ValueError`` for invalid settings.
    """
    if threshold < 1 or window_minutes < 1:
        raise ValueError("threshold and window must be positive")
    width = window_minutes * 60_000_000

    def intervals(batch: DataFrame) -> DataFrame:
        times = batch.select("window", F.explode("times").alias("x")).select("window", "x.*")
        upto = W.partitionBy("window").orderBy("t").rangeBetween(-width, 0)
        counted = times.withColumns({"anomalies": F.sum("c").over(upto), "start": F.min("t").over(upto)})
        ended = counted.where(F.col("t") >= F.unix_micros("window.start") + width)
        return ended.where(F.col("anomalies") >= threshold).select(
            F.timestamp_micros("start").alias("start"), F.timestamp_micros("t").alias("end"), "anomalies"
        )

    return _by_batch(alert_windows(scored, window_minutes, late), path, checkpoint, intervals)
