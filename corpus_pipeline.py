"""Five stages that clean a corpus: each reads the documents its predecessor kept.

``run(spark, sf_dir)`` applies them to ``documents``.  All but the last return the
columns of ``documents``; between two stages the rows are written as Parquet in the
shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlog.llm import decontamination, minhash_dedup, sentencepiece_codec, substring_dedup, toxicity
from emberlog.llm.common import stored
from emberlog.llm.queries import PIECE_BPE

#: SQL can't train classifiers or encode pieces; tests hold the stages against brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """``(id, th, doc)``: each document whole in one column beside its key, so that no column name can clash."""
    th = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.select(docs["doc_id"].alias("id"), th.alias("th"), F.struct("*").alias("doc"))


def _key(facts: DataFrame) -> Column:
    """The join of packed documents with ``facts(fact_id, fact_th, ...)``; null ids meet null ids."""
    return F.col("id").eqNullSafe(facts["fact_id"]) & (F.col("th") == facts["fact_th"])


def _facts(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(F.col("doc_id").alias("fact_id"), F.col("th").alias("fact_th"), *columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go.

    Every row is judged by its own text, repeated ones alike; a text that is null or empty stays.  Without
    documents nothing is learned and no row comes out.
    """
    if docs.isEmpty():
        return docs
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = "toxicity" + "_" * max(map(len, docs.columns))  # longer than any name, so none clashes
    scored = toxicity.toxicity(docs, chain, verdict)
    return scored.where(F.col(verdict)["toxic"] < toxicity.REJECT_FROM).drop(verdict)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest id, then the smallest hash of the text, then the smallest row.

    Documents without words are in no group and all stay.
    """
    verdicts = minhash_dedup.near_duplicates(docs, with_key=True)
    alike = _facts(verdicts, "chosen", "n_shingles").groupBy("fact_id", "fact_th").agg(
        F.bool_and("chosen").alias("chosen"), ((F.max("n_shingles") > 0) & (F.count("*") > 1)).alias("again")
    )
    marks = stored(alike.where("NOT chosen OR again"))
    found = _packed(docs)
    once = found.join(marks, _key(marks), "left_anti").select("doc.*")
    several = marks.where("chosen")  # rows alike in id and text, of which one stays
    first = found.join(several, _key(several), "left_semi").groupBy("id", "th").agg(F.min("doc").alias("doc"))
    return once.unionByName(first.select("doc.*"))


def _with_text(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``texts(fact_id, fact_th, new)``, and their lengths."""
    changed = _packed(docs).join(texts.hint("shuffle_hash"), _key(texts), "left")
    new = F.col("new")
    columns = {
        "text": lambda old: F.coalesce(new, old),
        "n_chars": lambda old: F.when(new.isNull(), old).otherwise(F.length(new).cast("long")),
    }
    fields = [(f.name, F.col("doc").getField(f.name)) for f in docs.schema]
    return changed.select(*[columns.get(name, lambda old: old)(old).alias(name) for name, old in fields])


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word spans that a document with a smaller id holds go; the words left are joined by a space.

    Texts that lose nothing stay as they are, null and empty ones too; no row goes.  Repeated rows lose the same.
    """
    cut = substring_dedup.drop_repeats(docs, with_key=True).where("n_removed > 0")
    return _with_text(docs, _facts(cut, F.col("kept").alias("new")).dropDuplicates(["fact_id", "fact_th"]))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, repeated rows all of them; texts without words stay."""
    leaks = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stored(_facts(leaks))
    return _packed(docs).join(gone, _key(gone), "left_anti").select("doc.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of every row, and digests of the ids and of the text decoded from them; a null text is empty."""
    return sentencepiece_codec.digests(sentencepiece_codec.round_trip(docs, PIECE_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_spans", drop_repeated_spans),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the rows of ``documents`` that all stages keep.

    Nulls, repeated rows, extra columns and empty tables are handled as each stage says; no documents give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

