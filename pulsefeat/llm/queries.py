"""The queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefeat.llm import bpe_codec, centroids, embeddings, html_extract, language_id, lexical_search, minhash, mixing, quality, substring, token_count, url_filter, warc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.document_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    judged = url_filter.judge_urls(url_filter.demo_captures(pages), url_filter.demo_entries(pages))
    return judged.select("row.page_id", "host", "matched_pattern", "matched_action", "kept")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(read(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op12_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(read(spark, sf_dir, "documents"))


def op13_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"), k=8, rounds=10, dimension=64)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_bpe_round_trip, op3_substring_dedup, op4_quality_rules, op5_token_counts, op6_url_filter, op7_embedding_near_dedup, op8_html_extract, op9_minhash_near_dedup, op10_arc_to_warc, op11_lexical_search, op12_language_mixture, op13_exponion_clusters)}

ORACLES = {"op1_mix_sources": mixing.ORACLE_SQL, "op6_url_filter": url_filter.ORACLE_SQL, "op10_arc_to_warc": warc.ORACLE_SQL, "op11_lexical_search": lexical_search.ORACLE_SQL, "op13_exponion_clusters": centroids.oracle_sql()}
