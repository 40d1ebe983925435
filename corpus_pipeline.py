"""A training corpus from the documents table: filter, deduplicate, mix and pack.

Every stage works on all rows that the stage before it kept. Stages are written as Parquet and
read again, so an executor lost in one stage never reaches back into another. All but the last return the
columns of ``documents``; mixing decides the order of the rows in the files, and packing keeps to it: among pieces of equal
length the earlier one is placed first, and sequences are numbered by their earliest document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.llm import exact_dedup, mixing, ngram_join, packing, queries, toxicity
from sondeo.llm.common import save


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    return toxicity.drop_toxic(docs, queries.table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one stays."""
    return exact_dedup.drop_exact_copies(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return ngram_join.keep_one_per_component(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mixing schedule."""
    mixed = mixing.mix_sources(docs, queries.MIX_WEIGHTS, queries.MIX_OTHER)
    ordered = mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens, in the order of the stored rows."""
    path = queries.tokenizer_file("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, end_id=0, capacity=2048, place=packing.file_order(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# The classifier and the tokenizer cannot be written in SQL; tests/llm holds the rows of every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
