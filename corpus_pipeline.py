"""A training corpus in five stages: toxicity, line dedup, near-dedup, mixing to target weights, sampled pieces.

Each stage takes (spark, docs, folder of the tables), works on every row that the stage before it kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's documents. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barcheck.llm import op1_pieces, op4_minmax, op6_lines, op7_mixing, op10_toxicity
from barcheck.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic word reaches the cut go; the model is fitted on ``labels`` of the documents here."""
    return op10_toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share go; all documents stay, ``n_chars`` follows the text that is left."""
    out = op6_lines.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return op4_minmax.one_per_component(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of the sources takes it."""
    return op7_mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, piece_ids, n_pieces, decoded_sha256, lossless of every document of the mixture."""
    out = op1_pieces.encode_and_decode(docs.select("doc_id", "source", "text"), op1_pieces.load())
    return out.select("doc_id", "source", "piece_ids", F.size("piece_ids").alias("n_pieces"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: A trained classifier and sampled segmentations have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
