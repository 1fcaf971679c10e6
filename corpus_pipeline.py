"""A training corpus from ``documents``: good, unique, scrubbed and packed.

Each stage gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, minhash, packing, pii, quality, storage
from millrace.llm.queries import GOOD_FROM, VOCABULARY, held_out

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    return quality.accepted(docs, model, GOOD_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, five-word shingles at 0.8."""
    return minhash.deduplicate(docs, words=5, percent=80)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced."""
    return pii.scrub(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("personal_data", hide_personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from ``documents``. What a stage stored, and what it read, is deleted once its output is
    written; what the last one needs goes at the end of the application. Runs have folders and tables of their own, so
    the result of one can be read after or beside another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = uuid.uuid4().hex
    folder = f"{storage.shared_root(spark)}/millrace/corpus-{number}"
    read = None
    for name, stage in STAGES[:-1]:
        with storage.scope(spark, f"{number}-{name}"):
            out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        storage.delete_at_end(spark, folder)
        storage.close(spark, f"{number}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        if read:
            storage.delete(spark, read)
        read = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
