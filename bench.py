"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query is run to the end into the ``noop`` sink.  ``scored_table`` is the
build of the event table that the triage queries then read.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = (
    "parse_classic_lines",
    "parse_report",
    "event_classes",
    "message_templates",
    "frequencies",
    "failing_sources",
    "density_noise",
    "density_clusters",
    "isolation_forest",
    "analyzed_events",
    "scored_table",
    "kpis",
    "triage_queue",
    "source_activity",
    "template_activity",
    "cluster_summary",
    "frequent_itemsets",
    "association_rules",
    "alert_intervals",
    "evidence",
    "event_summaries",
    "event_context",
    "roc_auc",
    "summary_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("emberlog-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from registry import load_catalogue
    from registry.base import scored_table

    runnable = {name: fn for name, (fn, _) in load_catalogue().items()}
    runnable["scored_table"] = scored_table
    wanted = [n for n in sys.argv[1:] if n in runnable] or HEADLINE

    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        runnable[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
