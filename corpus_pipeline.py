"""A corpus pipeline: toxicity, line dedup, near-duplicates, mixing, BPE.

Each stage works on all documents that its predecessor kept.  The first four
return the columns of ``documents``: the first drops toxic documents, the second
deletes repeated runs of lines (and documents of which nothing is left), the
third keeps one document of each class of near-duplicates, the fourth repeats or drops
documents by their mixing rates.
The last one returns the token digests of what is left.

Null texts count as empty in every stage and are kept by the second; very long texts
are handled whole.  Rows that are equal in doc_id and text are near-duplicates of
each other, so one stays; a doc_id may be null or stand for several texts.  Mixing
gives rows of one doc_id one number of copies.  Empty tables give empty tables, and
the stages choose names for their own columns that the documents don't have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import op1_minhash, op2_toxicity, op5_mixing, op6_bpe, op10_lines
from loamgrid.llm.shared import free_name, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic; the classifier learns from ``labels``."""
    model = op2_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = free_name(docs, "_score"), free_name(docs, "_predicted")
    return op2_toxicity.toxicity(docs, model, score_name=score, predicted_name=predicted).where(F.col(predicted) == 0).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated line runs; those that lose all their lines go."""
    lines, removed = free_name(docs, "_n_lines"), free_name(docs, "_n_removed")
    out = op10_lines.line_dedup(docs, n_lines=lines, n_removed=removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.where((F.col(removed) < F.col(lines)) | (F.col(lines) == 0)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the row with the smallest doc_id, told apart by its text too."""
    key = free_name(docs, "_text_key")
    stays = op1_minhash.near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("_id"), "text_key")
    keyed = docs.withColumn(key, op1_minhash.text_key(F.col("text")))
    # a merge join, as both sides grow with the documents
    rows = keyed.join(stays.hint("merge"), keyed["doc_id"].eqNullSafe(stays["_id"]) & (keyed[key] == stays["text_key"]), "left_semi")
    return rows.dropDuplicates(["doc_id", key]).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their mixing rate says."""
    labelled = op5_mixing.labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "_copies")
    copies = op5_mixing.mix(docs, labelled).groupBy("doc_id").agg(F.max("copies").alias(name))
    rows = docs.join(copies, docs["doc_id"].eqNullSafe(copies["doc_id"])).where(F.col(name) > 0).drop(copies["doc_id"])
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)))).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return op6_bpe.bpe(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("bpe", bpe)]

#: The stages learn models and sample, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
