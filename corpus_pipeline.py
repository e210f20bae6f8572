"""From raw documents to packed training sequences, in four stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wagerlens.llm import compression_rules, gam_quality, ngram_join, packing
from wagerlens.llm.common import table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return gam_quality.keep_good(docs, gam_quality.fit(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and compression bands keep."""
    return compression_rules.apply_rules(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links: the one with the smallest id."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of what is left: one row for each document piece."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("ngram_jaccard_join", near_copies), ("best_fit_packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
