"""The training-data pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes what its predecessor kept, written as Parquet and read again, and calls one
operator of ``ledgerline.llm``; all but the last return the columns of documents.

Defined results (the operators' docstrings say more): a null or letterless text, or one of no learned
language, goes in the first stage; a null id is an id like another; equal rows are near-duplicates, of which one stays, ties going to
the smallest id; a null source is a source of its own; a text of any length is worked on whole; an empty
table gives an empty one with the same columns; columns beside those of documents are kept, whatever
their names, but for ``shard`` and ``slot``, which the last stage sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontaminate, langid, mixing, sharding, simhash
from ledgerline.session import scratch_path
from ledgerline.sources.tables import read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go: null, without a letter, or of n-grams that its texts do not have."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go; the others stay as they are."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target weights: passes over a document are rows, a part of one has its text cut."""
    return mixing.mix_texts(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return sharding.shard(docs, whole_rows=True)


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", assign_shards)]

# Not expressible: the first stage is a trained model. Tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    base = scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
