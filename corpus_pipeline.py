"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, decontamination, jaccard_join, kneser_ney, pii
from docloom.llm.common import materialise, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier rejects.

    Each row is judged by itself, repeated ones and those without an id too.
    Texts that are null or empty, and languages without trusted documents,
    stay; a perplexity that equals the threshold stays.  All columns stay; an
    empty table stays empty.
    """
    return kneser_ney.fit(docs, read(spark, sf_dir, "labels")).keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document, that of lowest id, of each group of similar ones.

    Rows without an id or without words stay; repeated rows of one id become
    one.  All columns stay; an empty table stays empty.
    """
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those into which a benchmark item leaked.

    Rows without an id are judged by themselves, an id that repeats by all its
    texts.  Null and empty texts hold no item; a coverage that equals the
    threshold is a leak.  All columns stay; an empty table stays empty.
    """
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data and secrets replaced by their kind.

    Every row stays, null and empty texts as they are; n_chars is set anew.
    """
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of docs: one row for each, none for a null or empty text."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("bpe encoding and decoding", tokens),
]

#: Near duplicates, tiling, votes and perplexities are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k}")
    return docs
