"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_root: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, on a local master alone (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="pelgrain-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return f"file://{_own_root[0]}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    Cuts the lineage (a lost executor costs no more than the tasks it ran) and computes df once,
    which checkpoint() would do twice. The files stay for what reads them later; tables that only
    the next step needs are given back by `discard`.
    """
    path = f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    where = jvm.org.apache.hadoop.fs.Path(df._staged_at)
    where.getFileSystem(conf).delete(where, True)


def join_counted(rows: DataFrame, facts: DataFrame, on: list[str], n: str, total: int, parts: int = 1000) -> DataFrame:
    """rows joined to facts, one fact for each key; facts' column n counts the rows of its key, `total` all of them.

    Fewer than `parts` keys can have over that part of the rows each: those are broadcast, so that no
    hot key lands in one task. All others are joined by shuffle. Rows without a fact go.
    """
    hot = F.col(n) * parts > F.lit(total)
    rest = [c for c in facts.columns if c not in on]
    small = F.broadcast(facts.where(hot).select(*[F.col(c).alias(f"_hot_{c}") for c in on], F.struct(*rest).alias("_hot")))
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(f"_hot_{c}"))
    marked = rows.join(small, same, "left").select(*rows.columns, "_hot")
    found = marked.where("_hot is not null").select(*rows.columns, "_hot.*")
    return found.unionByName(marked.where("_hot is null").drop("_hot").join(facts.where(~hot), on))


def number_copies(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows, with rid (a stored monotonic id), and rn: 1, 2, ... among the rows of a key, in two steps, so that a hot key is spread."""
    part = rows.withColumn("_n_part", F.shiftright("rid", 33))
    counts = part.groupBy(*by, "_n_part").count()
    before = F.sum("count").over(W.partitionBy(*by).orderBy("_n_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*by, "_n_part", F.coalesce(before, F.lit(0)).alias("_n_off"))
    within = F.row_number().over(W.partitionBy(*by, "_n_part").orderBy("rid"))
    return part.withColumn("_n_in", within).join(offsets, [*by, "_n_part"]).withColumn("rn", F.col("_n_in") + F.col("_n_off")).drop("_n_part", "_n_in", "_n_off")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Bits of a key filter; fixed, so that its table has 2**17 rows at most whatever the keys.
FILTER_BITS = 23


def _filter_place(key: Column) -> tuple[Column, Column]:
    at = F.pmod(key, F.lit(1 << FILTER_BITS))
    return F.shiftright(at, 6), F.pmod(at, F.lit(64))


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits): a bitmap of hashed long keys, at most 2**17 rows of 16 bytes, so that it may always be broadcast."""
    word, bit = _filter_place(F.col(key))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    return staged(keys.select(word.alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "filter")


def may_have(df: DataFrame, key: Column, bitmap: DataFrame, column: str) -> DataFrame:
    """df with a boolean column: false where the key is certainly not in the filter. A full filter is always true."""
    word, bit = _filter_place(key)
    b = F.broadcast(bitmap.select(F.col("word").alias("_f_word"), F.col("bits").alias("_f_bits")))
    out = df.withColumns({"_f_at": word, "_f_bit": bit.cast("int")}).join(b, F.col("_f_at") == F.col("_f_word"), "left")
    hit = F.call_function("shiftrightunsigned", F.col("_f_bits"), F.col("_f_bit")).bitwiseAND(F.lit(1)) == 1
    return out.withColumn(column, F.coalesce(hit, F.lit(False))).drop("_f_at", "_f_bit", "_f_word", "_f_bits")
