"""The corpus pipeline: quality, near-dedup, decontamination, source mix, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelgrain.llm import decontaminate, mixing, quality, sharding, simhash
from pelgrain.llm.common import staged, table, utf8_bytes

SHARDS = 24


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the labelled good documents; what it rejects goes."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup by SimHash and by five-word shingles of Jaccard 0.8; the least doc_id of each group stays."""
    return simhash.drop_near_duplicates(docs, similar=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks for: not at all, once, or up to three times."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the shard of each row, its shard if there were one more, and its size.

    These three, `shard`, `grown_shard` and `size`, take the place of columns of their names.
    """
    out = sharding.assign_shards(docs, [1.0] * SHARDS)
    out = sharding.assign_shards(out, [1.0] * (SHARDS + 1), column="grown_shard")
    return out.withColumn("size", utf8_bytes(F.col("text")) + 8)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
    ("shard", shard),
]

#: The hashed n-gram models, the fingerprints and the noise are beyond DuckDB's SQL; tests/llm compares with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
