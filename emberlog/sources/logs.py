"""One reader for folders of log files: the ending of each file tells its format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.sources import csv_logs, text_logs

TABLES_FROM = 1 << 42  # line numbers of CSV files that stand beside text files
_TYPED = ("raw_event_type", "dbscan_cluster", "label")


def files(spark: SparkSession, path) -> DataFrame:
    """(path, filename, file_type, size_kb) of every file; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return found.select(
        "path", name.alias("filename"), F.when(ending == "csv", "csv").otherwise("text").alias("file_type"),
        F.round(F.col("length") / 1024, 2).alias("size_kb"),
    )


def read_logs(
    spark: SparkSession, path, mode: str = "per_row", assume_year: int = 1900, multi_line: bool = True, stable: bool = True
) -> DataFrame:
    """Canonical log rows of all files at ``path``; CSV files by their headers, all others as syslog text.

    ``stable`` numbers lines alike however files are split, at the price of a
    pass that counts them.  Line numbers of CSV files follow those of text
    files.  Columns that only CSV files have are null in the others.  CSV
    files must share one header.
    """
    listed = files(spark, path).select("path", "file_type").orderBy("path").collect()  # one row a file, as Spark's own listing
    texts = [r.path for r in listed if r.file_type == "text"]
    tables = [r.path for r in listed if r.file_type == "csv"]
    if not listed:
        raise ValueError(f"no files at {path}")
    out = None
    if texts:
        out = text_logs.read_text_logs(spark, texts, mode, assume_year, stable=stable)
    if tables:
        rows = csv_logs.read_csv_logs(spark, tables, mode, assume_year, multi_line=multi_line)
        rows = rows.select("line_no", "timestamp", "hostname", "service", "pid", "message", *[c for c in _TYPED if c in rows.columns])
        if out is not None:
            rows = rows.withColumn("line_no", F.col("line_no") + TABLES_FROM)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def source_report(spark: SparkSession, path) -> DataFrame:
    """One row per format: ``file_type``, ``files``, ``size_kb`` and the canonical ``columns`` it feeds."""
    listed = files(spark, path)
    tables = [r.path for r in listed.where("file_type = 'csv'").orderBy("path").limit(1).collect()]
    fed = sorted(csv_logs.map_headers(spark.read.option("header", True).option("multiLine", True).csv(tables).columns)) if tables else []
    columns = F.when(F.col("file_type") == "csv", F.array(*[F.lit(c) for c in fed]).cast("array<string>"))
    columns = columns.otherwise(F.array(*[F.lit(c) for c in sorted(text_logs.LOG_COLUMNS[1:])]))
    return listed.groupBy("file_type").agg(F.count("*").alias("files"), F.round(F.sum("size_kb"), 2).alias("size_kb")).withColumn("columns", columns)
