"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelgrain.llm import decontaminate, embed_dedup, line_dedup, mixing, quality, secret_scan, sharding, simhash, token_counts, url_filter
from pelgrain.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_contract_columns(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), long_words=line_dedup.LONG)


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.as_text(mixing.mix_sources(table(spark, sf_dir, "documents")))


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_filter.captures_of(table(spark, sf_dir, "pages"))
    return url_filter.filter_captures(captures, url_filter.entries_of(captures))


def op8_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.with_contract_columns(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_manifest(table(spark, sf_dir, "documents"), 24)


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return decontaminate.with_contract_columns(found).withColumn("spans", spans)


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_embedding_grid_join,
            op2_simhash_bytes,
            op3_line_chunks,
            op4_importance_resampling,
            op5_source_mix,
            op6_separator_scan,
            op7_url_lists,
            op8_secret_battery,
            op9_rendezvous_shards,
            op10_fm_decontamination,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_grid_join": embed_dedup.ORACLE,
        "op2_simhash_bytes": simhash.ORACLE,
        "op3_line_chunks": line_dedup.ORACLE,
        "op5_source_mix": mixing.ORACLE,
        "op7_url_lists": url_filter.ORACLE,
        "op9_rendezvous_shards": sharding.ORACLE,
        "op10_fm_decontamination": decontaminate.ORACLE,
    }
