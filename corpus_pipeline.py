"""A training corpus from the documents table: quality, exact and near duplicates, mixture, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evalspark.llm.bpe import encode_decode
from evalspark.llm.common import WRITTEN, discard, read, table
from evalspark.llm.exact import dedup_documents
from evalspark.llm.jaccard import keep_one
from evalspark.llm.mixing import mix_documents
from evalspark.llm.quality_model import grades, keep_good, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labels, doesn't reject."""
    return keep_good(docs, train(docs, grades(read(spark, sf_dir, "labels"))))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of alike shingle sets."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and packed token ids of each document."""
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids")


STAGES = [("quality", quality), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: The classifier is trained, so SQL can't express the rows; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage wrote on its way goes when its result is written."""
    docs, mark = read(spark, sf_dir, "documents"), len(WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, mark, WRITTEN[-1])
    return STAGES[-1][1](spark, docs, sf_dir)
