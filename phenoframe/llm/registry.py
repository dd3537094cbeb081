"""The corpus queries: each operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from phenoframe.llm import bayes_minhash, bloom_lm, fingerprints, jaccard_groups, line_templates, merkle, mixing, oracle, prefix_free, prefix_trie, quality, sharding, token_counts, viterbi
from phenoframe.llm.text import conversations, documents


MODEL = "piece_bpe_32k.model"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.template_report(documents(spark, sf_dir))


def op3_bloom_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_documents(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(MODEL))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(documents(spark, sf_dir))


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.repeats_report(documents(spark, sf_dir))


def op7_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(MODEL)).drop("text")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(documents(spark, sf_dir))


def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.document_components(documents(spark, sf_dir))


def op11_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_minhash.near_duplicates(documents(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(conversations(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality_rules, op2_line_templates, op3_bloom_scores, op4_token_counts, op5_sharding, op6_repeated_spans,
             op7_piece_viterbi, op8_source_mixing, op9_fingerprints, op10_jaccard_components, op11_bayes_minhash,
             op12_conversation_trie, op13_merkle_manifest)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
