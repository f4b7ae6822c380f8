"""A corpus pipeline of five operators: language ID, line deduplication, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns they are given. In every stage a null id is a value
like any other, rows that repeat are judged alike, other columns of whatever name pass through, long texts are read whole, ties
are broken by id and then by a hash of the row, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, langid, lines, mixing, simhash
from helixframe.llm.store import Store

#: A language that takes less of the posterior than this is rejected.
MIN_SCORE = 0.5
BUDGET = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, no letters) or with an unsure one go. Learns from documents whose id is not held out."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"), 4, 2)))
    marked = langid.predict(docs, model)
    return marked.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines go; so do documents that have nothing else. Null and empty texts stay."""
    return lines.dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one of smallest id (null last). Null and empty texts are copies of each other."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark passages are cut out of the rest. A null text stays."""
    return decontaminate.clean_documents(decontaminate.scan_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to target marginals (tempered shares of source, language and topic); equal rows are drawn alike, empty and
    null texts as their cell is."""
    return mixing.sample(docs, budget=BUDGET)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mixing", source_mixing)]

#: No SQL: language ID, MinHash and raking have none; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return docs
