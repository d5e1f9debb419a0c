"""A training corpus from `documents`: toxic ones out, near-duplicates out, pseudonyms, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborline.llm import mixing, packing, pii, simhash, toxicity
from harborline.llm.common import small_batches, table
from harborline.session import configure, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents graded toxic by a model fitted on the labels; rows without a text or an id stay."""
    return toxicity.without_toxic(docs, table(small_batches(spark), sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, judged by rows: see `simhash.one_of_each_group`."""
    return simhash.one_of_each_group(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal values; NULL and empty texts and repeated rows stay as they are."""
    return pii.with_pseudonyms(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, documents of small sources up to twice; a NULL source is a source of its own."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places; NULL and empty texts are packed as a separator alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_neardup", drop_near_duplicates),
    ("pseudonyms", pseudonymise),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Fitted models, hashes and a packing search are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again. An empty table gives no rows."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
