"""Registered queries of the training-data operators: (spark, data_dir) -> DataFrame.

Each applies one operator to its whole table and derives the result's digest columns from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table
from . import ann, decontaminate, langid, licenses, mixing, ppm, quality, sharding, simhash, spelling, tokens, warc, whitening


def op1_warc_archive(spark: SparkSession, data_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(read_table(spark, data_dir, "pages"), path)
    return (warc.read_archive(spark, path)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op2_mix_sources(spark: SparkSession, data_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, data_dir, "documents")).drop("source")


def op3_consistent_hash_shards(spark: SparkSession, data_dir: str) -> DataFrame:
    return (sharding.shard(read_table(spark, data_dir, "documents"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def op4_decontaminate(spark: SparkSession, data_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, data_dir, "documents"), read_table(spark, data_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_identify_language(spark: SparkSession, data_dir: str) -> DataFrame:
    found = langid.predict(read_table(spark, data_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"),
                        F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))


def op6_score_language_model(spark: SparkSession, data_dir: str) -> DataFrame:
    return ppm.score_documents(read_table(spark, data_dir, "documents"))


def op7_scan_licenses(spark: SparkSession, data_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, data_dir, "documents"))


def op8_count_tokens(spark: SparkSession, data_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, data_dir, "documents"))


def op9_simhash_near_duplicates(spark: SparkSession, data_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, data_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_nearest_neighbours(spark: SparkSession, data_dir: str) -> DataFrame:
    return ann.search(read_table(spark, data_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_whiten_embeddings(spark: SparkSession, data_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, data_dir, "embeddings"))


def op12_group_spelling_variants(spark: SparkSession, data_dir: str) -> DataFrame:
    return spelling.group_variants(read_table(spark, data_dir, "documents"))


def op13_classify_quality(spark: SparkSession, data_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, data_dir, "documents"), read_table(spark, data_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_warc_archive, op2_mix_sources, op3_consistent_hash_shards, op4_decontaminate, op5_identify_language,
    op6_score_language_model, op7_scan_licenses, op8_count_tokens, op9_simhash_near_duplicates, op10_nearest_neighbours,
    op11_whiten_embeddings, op12_group_spelling_variants, op13_classify_quality)}
