"""Queries over the tables, one per operator, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadeline.llm._common import read


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fadeline.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fadeline.llm.bpe import encode

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded").select("doc_id", "ids", "decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fadeline.llm.packing import pack, pieces

    rows = pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: The rules of production, each with its verdict.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fadeline.llm.url_filter import judge

    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fadeline.llm.chat_format import format_conversations, parse, under_mask

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    out = format_conversations(rows.unionByName(probe)).withColumn("turns", parse(F.col("formatted"))).withColumn("loss", under_mask(F.col("formatted"), F.col("loss_spans")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fadeline.llm.html_extract import extract

    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_lines", "n_shared", "by_neighbours")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fadeline.llm.quality_rules import judge

    return judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fadeline.llm.embedding_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fadeline.llm.license_scan import scan

    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    out = scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text")
    return out.select(F.col("key").alias("doc_id"), "license", F.round("similarity", 6).alias("similarity"), "n_segments", "inherited_from")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fadeline.llm.quality_classifier import classify

    return classify(read(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("score", 6).alias("score"), "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name == "pipeline" or name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from fadeline.llm import oracles

    return oracles.oracle_sql()
