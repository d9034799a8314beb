"""A training corpus from ``documents``: each stage works on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plateworks.llm import bpe, latent_decontam, patience_lines, rule_ledger, shingle_join
from plateworks.llm.registered import RANKS
from plateworks.llm.storage import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rule_ledger.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines aligned with an earlier document go; a document of which no word is left goes whole."""
    return patience_lines.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8) stays, that with the smallest doc_id."""
    return shingle_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return latent_decontam.filtered(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens of every text, with the digests of its ids and of the bytes they decode to."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.digests(bpe.decode(bpe.encode(docs.select("doc_id", "text"), ranks, pattern).drop("text"), ranks, pattern))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("token_ids", token_ids)]

#: Alignment, components and token ids can't be expressed in SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
