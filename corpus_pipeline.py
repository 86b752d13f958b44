"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import language, lines, mixing, packing, simhash
from tagloom.llm.common import cut, row_key

#: No SQL can express the language models and SimHash; tests compare the stages with brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), *row_key(F.col("doc_id"), F.col("text")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known.

    Null, empty and letterless texts have none and go. Null ids and repeated rows stay or go by their text. An empty table gives no rows.
    """
    out = language.identify(docs, declared_col="lang", host_col="source")
    gone = cut(out.where("not accepted").select("_k1", "_k2").distinct())
    return _keyed(docs).join(gone, ["_k1", "_k2"], "left_anti").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more share; a document of such lines only stays, empty.

    Null text becomes empty. Repeated rows count as one document and stay. An empty table gives no rows.
    """
    out = lines.dedup_lines(docs)
    return out.withColumn("row", out.row.withField("text", F.col("kept_text")).withField("n_chars", F.length("kept_text").cast("long"))).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more: the one with the smallest id, and of several rows with that id one by its text's hash.

    Texts without words, null ones too, are one group. Null ids come last. Of rows that repeat whole one stays. An empty table gives no rows.
    """
    out = cut(simhash.similar_documents(docs).select("doc_id", "root", "_k1", "_k2"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_k1"), F.col("_k2")))
    stay = out.groupBy("root").agg(least.alias("s"))
    stay = cut(stay.select("s._k1", "s._k2"))
    kept = _keyed(docs).join(stay.hint("merge"), ["_k1", "_k2"])  # most rows stay, so both sides are shuffled at every size
    if out.count() != out.select("_k1", "_k2").distinct().count():  # whole rows repeat
        kept = kept.groupBy("_k1", "_k2").agg(F.first("row").alias("row"))
    return kept.select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them.

    Null and empty texts have no words and aren't taken. Null sources are one source, null ids mix like others; rows of equal id, text and
    source share what they are given. An empty table gives no rows.
    """
    return mixing.take(docs).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes. Null and empty texts have a row without a bin; repeated rows are packed each. An empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
