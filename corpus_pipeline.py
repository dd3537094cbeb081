"""From raw documents to an encoded training mixture.

Every stage works on all that its predecessor kept.  The first four return
the columns of ``documents``, with cleaned texts; the last one adds the
pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from phenoframe.llm import jaccard_groups, line_templates, mixing, quality, viterbi
from phenoframe.llm.registry import MODEL
from phenoframe.llm.stages import stored
from phenoframe.llm.text import documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that lose too much by that or fail the base rules."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, and documents of nothing else."""
    return line_templates.without_recurring_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_groups.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by probabilities raked to source, language and topic targets."""
    return mixing.sample(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded to pieces; every row says whether decoding gives its text back."""
    return viterbi.encode_documents(docs, public_tokenizers.path(MODEL))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
          ("source_mixing", source_mixing), ("piece_encoding", piece_encoding)]

#: SQL can express neither the piece search nor the shingle components at this scale; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
