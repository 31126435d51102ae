"""From raw documents to token ids: quality rules, near-dedup, substring dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the session's shared folder and reads them again,
so that a stage is computed once and a lost executor costs a re-read.

Defined edge cases, at every stage
  * null, empty and short texts: quality_rules rejects them (under 50 words); the other stages keep them as
    they are, without shingles, passages, words or ids
  * a null doc_id: the row is judged by quality_rules, linked with nothing, and draws its copies as the id
    "null"; repeated rows are rows of their own and all stay or go together, copies of a smaller id go
  * of rows that share an id but not a text, minhash_near_dedup removes only the copies among them
  * an empty table, or one without labels: no forest, base rules only; every stage gives an empty table for
    an empty one, with its columns
  * columns other than doc_id, text and source are carried, whatever their names; n_chars is renewed if there
    is one
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefeat.llm import bpe_codec, minhash, mixing, quality, substring
from pulsefeat.llm.storage import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in 80 % of their five-word shingles, the one of smallest id."""
    return minhash.deduplicate(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that repeat an earlier one."""
    cleaned = substring.remove_repeats(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's repetition rate has it."""
    return mixing.mix_sources(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source`` (those there are), ``ids, n_tokens, decoded_equal``: token ids of the mix,
    decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_codec.encode(docs, path, check="decoded_equal")
    return coded.select("doc_id", *[c for c in ("lang", "source") if c in docs.columns], "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_equal")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: SQL can express neither the forest nor sketches, compact windows or BPE; tests/llm/test_pipeline.py
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
