"""A training corpus from documents: quality, near duplicates, personal data, mixture, token ids.

Every stage takes the columns of documents, and any others, which all but the last hand on. Null and
empty texts fail the quality rules and go; in the later stages they are texts without words,
figures or tokens. Rows without an id stay in every stage; repeated rows count once after the near
duplicates. Texts are read whole. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from itemlake.llm import bpe, jaccard, mixing, pii, quality
from itemlake.plans.numbering import in_written_order
from itemlake.plans.scratch import materialise

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or score below the threshold go; equal texts share a verdict, null texts go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; rows without words or id all stay."""
    return jaccard.drop_near(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; rows without any, null texts too, are as before."""
    return pii.redact(docs, pii.train_tagger(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture of sources, which token_ids numbers; null is a source, null ids come last in theirs."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the row's position (0, 1, ...) in docs as the mixture left it, and the token ids (little-endian unsigned 32-bit).

    Null texts have no ids; every row gives one. Positions follow the order of docs (see in_written_order).
    """
    placed = in_written_order(docs.select("doc_id", "lang", "source", "text"), "position")
    return bpe.encode_documents(placed, RANKS, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "position"])


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: Minhash candidates, the tagger and BPE have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
