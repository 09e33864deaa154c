"""The corpus pipeline: raw documents to packed training sequences, in four stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fadeline.llm import jaccard_join, packing, quality_classifier, quality_rules
from fadeline.llm._common import free_name, row_key, settle, short_reads, shrink_heaps, small_batches, without


def _begin(spark: SparkSession) -> None:
    """What each stage starts with: all run in the same executors, and one shouldn't have to live with what another has left there."""
    small_batches(spark)
    short_reads(spark)
    shrink_heaps(spark)


def _keep(docs: DataFrame, judge) -> DataFrame:
    """Rows of ``docs`` that ``judge(docs, row=...)`` keeps, each by its own verdict.

    A row is told from others by what it holds, its id (null or not), text and language; rows that agree in
    all of these are judged alike.
    """
    row = free_name(docs, "__row")
    named = docs.withColumn(row, row_key("doc_id", "text", "lang"))
    gone = settle(judge(named, row=row).filter("NOT kept").select(row).distinct())
    return without(named, row, gone).select(*docs.columns)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return _keep(docs, quality_classifier.classify)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return _keep(docs, quality_rules.judge)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; of each group the document with the smallest id stays, of several with that id one."""
    _begin(spark)
    return jaccard_join.keep_one(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    rows = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("ngram_jaccard_join", deduplicate), ("best_fit_packing", pack)]

#: The classifier's training and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
