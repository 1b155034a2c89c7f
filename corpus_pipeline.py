"""Corpus pipeline: ``documents`` through five stages of ``pricewise.llm``.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over all rows that
its predecessor kept, written as Parquet and read again as the next one's input.
All stages but the last return the columns of ``documents``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewise.llm import bpe, decontaminate, jaccard, pii, quality
from pricewise.llm.common import materialise, table

#: Near-duplicates: word shingles and percent of the union.
SHINGLE_WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays;
    rows without words or id stay. Of rows with the same id and text one stays; rows
    with the same id and other texts are judged each by its own text."""
    groups = jaccard.cluster(docs, SHINGLE_WORDS, PERCENT, keyed=True)
    gone = groups.where("doc_id <> component_id").select("doc_id", F.col("text_key").alias("_text")).distinct()
    # dealt by id and text already, so the window needs no shuffle of its own
    same = Window.partitionBy("doc_id", "_text").orderBy("lang", "source", "n_chars")
    named = docs.where("doc_id IS NOT NULL").withColumn("_text", F.xxhash64("text"))
    return (named.join(gone, ["doc_id", "_text"], "left_anti")
            .withColumn("_rank", F.row_number().over(same)).where("_rank = 1").select(*docs.columns)
            .union(docs.where("doc_id IS NULL")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; ``n_chars`` follows."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token ids, decoded again to prove the round trip:
    ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]

#: The trained stages have no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
