"""Registered queries of the subpackage and their SQL: each applies one
operator, with production parameters, to its whole table."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, jaccard, licenses, pii, quality, repeats, substrings, token_counts, token_store, toxicity, whitening
from .common import materialise, table
from pricewise.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "tokens")
    token_store.write(_documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.checksums(spark, out)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_documents(spark, sf_dir)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).drop("text")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), RANKS)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(_documents(spark, sf_dir), size=4, percent=85)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    hist = materialise(token_counts.histogram(docs, RANKS, public_tokenizers.PATTERN), "lengths")  # texts are encoded once
    return token_counts.answers(hist, token_counts.LIMITS, token_counts.QUANTILES)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(_documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_store": op2_token_store,
    "op3_licenses": op3_licenses,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_token_counts": op9_token_counts,
    "op10_repeats": op10_repeats,
    "op11_substrings": op11_substrings,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}
ORACLES = {
    "op3_licenses": licenses.oracle(),
    "op8_ngram_jaccard": jaccard.oracle(),
    "op10_repeats": repeats.oracle(),
    "op11_substrings": substrings.oracle(),
    "op12_collocations": collocations.oracle(),
}
