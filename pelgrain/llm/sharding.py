"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pelgrain.llm.common import number_copies, staged, utf8_bytes
from pelgrain.llm.sql_hash import of_number

#: Numbering blocks of a shard; a fixed number, so the table of their counts is bounded.
BLOCKS = 1024


def _bid(key: Column, shard: int, weight: float) -> Column:
    """A shard's bid for a key: weight / -ln(u), u uniform in (0, 1) from the hash of key and shard."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.struct((F.lit(float(weight)) / -F.ln(u)).alias("bid"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest bid; shares follow the weights. A shard more takes keys only into itself.

    A null key hashes as a key of its own. Weights must be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    bids = [_bid(key, k, w) for k, w in enumerate(weights)]
    return (F.greatest(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", column: str = "shard") -> DataFrame:
    """docs with the shard of each row; one narrow step, no shuffle. A column of that name is replaced."""
    return docs.withColumn(column, rendezvous(F.col(key), weights))


def shard_manifest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row for each document: its shard, its place in it, and its shard when there is one more.

    Law `key`: doc_id and the number of shards alone decide. Slots count from 0 without gaps:
    rows are numbered within small hash blocks of a shard, and blocks are offset by a prefix sum
    over a table of shards x BLOCKS rows, so no task ever sorts a whole shard. A row that is copied
    very often holds one wide place in its block, and its copies are numbered where they were read.

    Null text: size 8, checksum 0. Null doc_id: a key of its own. Repeated rows: each gets a slot,
    in the same shard. Empty table: no rows. Other columns are ignored.
    """
    id_, text = F.col("doc_id"), F.col("text")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")
    rows = docs.select(
        id_, (utf8_bytes(text) + 8).alias("size"), crc.alias("text_crc32"),
        rendezvous(id_, [1.0] * shards).alias("shard"), rendezvous(id_, [1.0] * (shards + 1)).alias("grown_shard"),
    )
    block = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("slot")), F.lit(BLOCKS)).cast("int")
    rows = staged(rows.select("*", block.alias("block"), F.monotonically_increasing_id().alias("rid")), "op9")
    counts = rows.groupBy("shard", "block").count()
    before = F.sum("count").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("offset"))
    # rows with over a thousandth of all copies each stand for themselves in their block, as one place of that width
    one = ["shard", "block", "doc_id", "text_crc32", "size", "grown_shard"]
    many = staged(rows.groupBy(*one).agg(F.count("*").alias("width")).where(F.col("width") * 1000 > F.lit(rows.count())), "op9-many")
    same = [rows[c].eqNullSafe(many[c]) if c == "doc_id" else rows[c] == many[c] for c in one[:5]]
    single = rows.join(F.broadcast(many), same, "left_anti").select(*one, F.lit(1).cast("long").alias("width"))
    place = F.sum("width").over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0))
    placed = single.unionByName(many).withColumn("start", place - F.col("width")).join(offsets, ["shard", "block"]).withColumn("slot", F.col("offset") + F.col("start"))
    out = placed
    if many.limit(1).count():
        hot = placed.join(F.broadcast(many.select(*[F.col(c).alias(f"_{c}") for c in one[:5]])), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in one[:5]], "left_semi").select(*one, F.col("slot").alias("first"))
        hot = staged(hot, "op9-first")
        copies = rows.select("rid", *one).join(F.broadcast(hot.select(*[F.col(c).alias(f"_{c}") for c in one[:5]], "first")), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in one[:5]])
        numbered = number_copies(copies.select("rid", "first", *one), ["first", "shard"])
        kept = placed.join(F.broadcast(hot.select("shard", F.col("first").alias("slot"))), ["shard", "slot"], "left_anti")
        out = kept.select(*one, "slot").unionByName(numbered.select(*one, (F.col("first") + F.col("rn") - 1).alias("slot")))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _crc_table() -> list[int]:
    """Remainders of all bytes for the reflected CRC-32 polynomial."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _oracle(shards: int = 24) -> str:
    """DuckDB has neither XXH64 nor CRC-32; both are spelled out."""
    hashed = lambda source, value, size, seed, out: f"{out}_ AS ({of_number(source, value, size, seed, out)})"
    long = lambda c: f"CASE WHEN {c} < 0 THEN ({c}::HUGEINT + {1 << 64}::HUGEINT)::UHUGEINT ELSE {c}::UHUGEINT END"
    # a null value leaves the hash as it was
    known = lambda source, c, seed, out: hashed(source, f"coalesce({long(c)}, 0::UHUGEINT)", 8, seed, out)
    slot = int.from_bytes(b"slot", "little")
    return f"""
WITH s AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
         lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32 FROM documents),
{known("s", "doc_id", "42::UHUGEINT", "raw")},
kh_ AS (SELECT * EXCLUDE (raw), CASE WHEN doc_id IS NULL THEN 42::UHUGEINT ELSE raw END AS kh, row_number() OVER () AS r FROM raw_),
{known("kh_", "text_crc32", "kh", "c")},
{known("c_", "size", "c", "z")},
{hashed("z_", f"{slot}::UHUGEINT", 4, "z", "b")},
bid0 AS (SELECT r, kh, unnest(range({shards + 1})) AS k FROM kh_),
{hashed("bid0", "k::UHUGEINT", 4, "kh", "u")},
bid AS (SELECT r, k, 1.0::DOUBLE / -ln(((u >> 11)::DOUBLE + 0.5) / {float(1 << 53)!r}::DOUBLE) AS bid FROM u_),
best AS (SELECT r, CAST(arg_max(k, (bid, k)) FILTER (k < {shards}) AS INT) AS shard, CAST(arg_max(k, (bid, k)) AS INT) AS grown_shard FROM bid GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY b % {BLOCKS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM b_ JOIN best USING (r)
"""


ORACLE = _oracle()
