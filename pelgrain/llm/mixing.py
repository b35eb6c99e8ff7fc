"""Mixing sources to target weights with a hypergeometric splitting tree over blocks of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pelgrain.llm.common import discard, number_copies, staged, word_count

#: Blocks of a source are the first three hex digits of the document's order key.
BLOCK_DIGITS = 3
#: Tables of sources or of their blocks are broadcast up to this many rows, else joined by shuffle.
FEW = 200_000


def order_key(doc_id: Column, text: Column) -> Column:
    """A fixed random order of documents, by id and text; the same in any run and any engine that has MD5."""
    hashed = F.coalesce(F.md5(text.cast("binary")), F.lit(""))
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), hashed).cast("binary"))


def _block(key: str) -> Column:
    return F.substring(key, 1, BLOCK_DIGITS)


def targets(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """(source, source_size) -> + target.

    Weights go round the sources in code point order, null last. Targets share the total by weight,
    stop at three times their source's size, and the excess is shared again: the fixed point is
    min(3 * size, level * weight), and its level follows from prefix sums over sources in the order
    in which they reach their stop. One row for each source, so windows without partitions are small.
    """
    k = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(k - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * 3).alias("stop"), k.alias("k"))
    stops = W.orderBy(F.col("stop") / F.col("w"), "k")
    free = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("stop").over(stops.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).cast("double")
    s = s.select("*", F.row_number().over(stops).alias("at"), (free / F.sum("w").over(stops.rowsBetween(0, W.unboundedFollowing))).alias("level"))
    first = F.min(F.when(F.col("stop") > F.col("level") * F.col("w"), F.struct("at", "level"))).over(W.partitionBy())
    return s.select("source", "source_size", "w", first["level"].alias("lv"), "stop").select(
        "source", "source_size", F.coalesce(F.least(F.col("stop").cast("double"), F.col("lv") * F.col("w")), F.col("stop").cast("double")).alias("target")
    )


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def split_quotas(balls: DataFrame, shards: int, seed: int) -> DataFrame:
    """Blocks to be dealt (sk, block, pass) -> (sk, upto): how many of a source's blocks go to the shards up to each one.

    A tree over the shards: at each node the left half draws its even share of the node's blocks
    without replacement, whatever their source, so what it draws of the sources is one multivariate
    hypergeometric draw. The draw ranks the blocks by a hash of node level and block, in bins of the
    hash, so that no task sorts a whole node. Shards are as even as whole blocks allow; the
    sums by source are the quotas.
    """
    now, spent = balls.select("*", F.lit(0).alias("lo"), F.lit(shards).alias("hi")), None
    for level in range((shards - 1).bit_length()):
        now = staged(now, "op5-tree")
        if spent is not None:
            discard(spent)
        spent = now
        h = now.withColumn("h", _hash(F.lit("split"), F.lit(seed), F.lit(level), "sk", "block", "pass")).withColumn("bin", F.substring("h", 1, 3))
        bins = h.groupBy("lo", "bin").count()
        before = F.sum("count").over(W.partitionBy("lo").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
        bins = bins.select("lo", "bin", F.coalesce(before, F.lit(0)).alias("before"), F.sum("count").over(W.partitionBy("lo")).alias("n"))
        rank = F.row_number().over(W.partitionBy("lo", "bin").orderBy("h", "sk", "block", "pass")) + F.col("before")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = rank <= F.floor(F.col("n") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        ranked = h.withColumn("mid", mid).join(bins, ["lo", "bin"]).withColumn("left", left)
        now = ranked.select("sk", "block", "pass", F.when(F.col("left"), F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(F.col("left"), F.col("mid")).otherwise(F.col("hi")).alias("hi"))
    upto = [F.count(F.when(F.col("lo") <= k, 1)).alias(f"u{k}") for k in range(shards)]
    return now.groupBy("sk").agg(*upto).select("sk", F.array(*[F.col(f"u{k}") for k in range(shards)]).alias("upto"))


def _joined(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Broadcast facts while they are counted to be few; beyond that join by key (AQE splits a hot one)."""
    return rows.join(F.broadcast(facts) if facts.limit(FEW + 1).count() <= FEW else facts, on, how)


def plan_mix(rows: DataFrame, weights: Sequence[int], shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents (sk, source, size, key) -> what each source gives, and where its blocks go; two tables.

    Sources: sk, source_size, target, base (whole passes), cut, part, tied. In the last pass
    documents up to the key `cut` are taken; the rows with that key (`tied` of them, equal ones)
    share `part` words. The cut is found in two steps, block sums and then the one block it falls
    in, so no source is ever sorted as a whole.
    Blocks: sk, block, shards (of each pass). A block's place in its source's permuted sequence
    decides, cut at the quotas of the splitting tree, so shards get disjoint blocks.
    """
    sizes = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    n = F.col("source_size")
    base = F.when(n > 0, F.floor(F.col("target") / n)).otherwise(0)
    want = sizes.select(_source_key(), "source_size", "target", base.alias("base"), F.floor(F.col("target") - base * n + 0.5).alias("rest"))
    want = staged(want, "op5-want")
    words = rows.groupBy("sk", _block("key").alias("block")).agg(F.sum("size").alias("words")).where("words > 0")
    run = F.sum("words").over(W.partitionBy("sk").orderBy("block"))
    blocks = staged(words.select("sk", "block", (run - F.col("words")).alias("before"), run.alias("after")).join(want.select("sk", "base", "rest"), "sk"), "op5-blocks")
    cut = blocks.where("before < rest and rest <= after").select("sk", "block", (F.col("rest") - F.col("before")).alias("need"))
    inside = _joined(rows.withColumn("block", _block("key")), cut, ["sk", "block"]).groupBy("sk", "key", "need").agg(F.max("size").alias("size"), F.count("*").alias("tied"))
    run = F.sum(F.col("size") * F.col("tied")).over(W.partitionBy("sk").orderBy("key"))
    last = inside.select("sk", F.col("key").alias("cut"), "need", "tied", (F.col("size") * F.col("tied")).alias("here"), run.alias("after")).where("after >= need and after - here < need")
    last = last.select("sk", "cut", (F.col("need") - F.col("after") + F.col("here")).alias("part"), "tied")
    sources = staged(want.join(last, "sk", "left").select("sk", "source_size", "target", "base", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("tied", F.lit(0)).alias("tied")), "op5-sources")
    passes = (F.col("base") + (F.col("before") < F.col("rest")).cast("int")).cast("int")
    balls = staged(blocks.where(passes > 0).select("sk", "block", F.explode(F.sequence(F.lit(0), passes - 1)).alias("pass")), "op5-balls")
    place = F.row_number().over(W.partitionBy("sk").orderBy(_hash(F.lit("place"), F.lit(seed), "sk", "block", "pass"), "block", "pass")) - 1
    dealt = balls.withColumn("place", place).join(split_quotas(balls, shards, seed), "sk")
    dealt = dealt.select("sk", "block", "pass", F.size(F.filter("upto", lambda u: u <= F.col("place"))).alias("shard"))
    layout = dealt.groupBy("sk", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("s"))
    return sources, staged(layout.select("sk", "block", F.col("s.shard").alias("shards")), "op5-layout")


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("sk")


def _taken(size: str, key: str, rn: Column) -> Column:
    """Words that a document gives: whole passes, and in the last one those before the cut; equal rows at the cut share its part in turn."""
    s = F.col(size)
    here = F.greatest(F.lit(0), F.least(s, F.col("part") - (rn - 1) * s))
    return (F.col("base") * s + F.when(F.col(key) < F.col("cut"), s).when(F.col(key) == F.col("cut"), here).otherwise(0)).cast("long")


def _ties(sources: DataFrame) -> DataFrame | None:
    tied = sources.where("tied > 1").select("sk", F.col("cut").alias("key"))
    return tied if tied.limit(1).count() else None


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), shards: int = 16, seed: int = 42) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, shards (of each copy), order_key.

    A source's taken words are its target to the word: whole passes, then documents in a fixed
    random order, the last one in part. Shards hold disjoint permuted blocks of the splitting tree;
    the order in a shard is by a hash of order_key and pass. Null text has size 0 and gives nothing;
    a null source is a source, the last. Documents are ordered by id and text, so ids may repeat or
    be null. Repeated rows count each; where they are the cut, they give one after the other until
    the target is met. Other columns are ignored. Empty table: no rows.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("key"))
    rows = staged(rows.select("*", _source_key(), F.monotonically_increasing_id().alias("rid")), "op5")
    sources, layout = plan_mix(rows, weights, shards, seed)
    ties = _ties(sources)
    numbered = rows.withColumn("rn", F.lit(1).cast("long"))
    if ties is not None:
        equal = number_copies(_joined(rows, ties, ["sk", "key"]), ["sk", "key"]).select("rid", "rn")
        numbered = _joined(rows, staged(equal, "op5-ties"), ["rid"], "left").withColumn("rn", F.coalesce("rn", F.lit(1)))
    out = _joined(numbered, sources, ["sk"]).withColumn("taken", _taken("size", "key", F.col("rn"))).withColumn("block", _block("key"))
    out = _joined(out, layout, ["sk", "block"], "left")
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    dealt = F.when(copies > 0, F.slice("shards", 1, F.greatest(copies, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return out.select("doc_id", "size", "source_size", "target", "taken", dealt.alias("shards"), F.col("key").alias("order_key"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), shards: int = 16, seed: int = 42) -> DataFrame:
    """The mix itself, whole documents: each as often as its share of words rounds to; docs' columns only.

    Each copy lies in its shard of the splitting tree, locally shuffled by a hash of key and pass: one
    shuffle of the texts, by shard and the first digits of that hash, so that no shard is one task.
    """
    named = {c: f"_m_{k}" for k, c in enumerate(docs.columns)}
    wide = docs.select(F.col("source"), word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("key"), *[F.col(c).alias(x) for c, x in named.items()])
    wide = wide.withColumn("sk", _source_key())
    sources, layout = plan_mix(staged(wide.select("source", "size", "key", "sk"), "op5"), weights, shards, seed)
    ties = _ties(sources)
    numbered = wide.withColumn("rn", F.lit(1).cast("long"))
    if ties is not None:
        equal = staged(_joined(wide, ties, ["sk", "key"]).withColumn("rid", F.monotonically_increasing_id()), "op5-ties")
        rest = wide.join(F.broadcast(ties) if ties.limit(FEW + 1).count() <= FEW else ties, ["sk", "key"], "left_anti")
        numbered = rest.withColumn("rn", F.lit(1).cast("long")).unionByName(number_copies(equal, ["sk", "key"]).drop("rid"))
    out = _joined(numbered, sources, ["sk"]).withColumn("taken", _taken("size", "key", F.col("rn"))).withColumn("block", _block("key"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    # a last copy that is less than half taken is left out; one taken in part has its place all the same
    out = _joined(out.where(copies > 0), layout, ["sk", "block"]).select(*named.values(), "key", F.posexplode(F.slice("shards", 1, copies)).alias("pass", "shard"))
    out = out.withColumn("order", _hash("key", "pass"))
    return out.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order").select(*[F.col(x).alias(c) for c, x in named.items()])


def as_text(mixed: DataFrame) -> DataFrame:
    """mix_sources' result with the shards as text."""
    return mixed.withColumn("shards", F.array_join(F.col("shards").cast("array<string>"), ","))


def _oracle(shards: int = 16, seed: int = 42) -> str:
    levels, last = [], "balls"
    for k in range((shards - 1).bit_length()):
        source = "(SELECT *, 0 AS lo, %d AS hi FROM balls)" % shards if k == 0 else last
        ranked = f"SELECT *, (lo + hi) // 2 AS mid, count(*) OVER (PARTITION BY lo) AS n, row_number() OVER (PARTITION BY lo ORDER BY md5('split:{seed}:{k}:' || sk || ':' || block || ':' || pass), sk, block, pass) AS k FROM {source}"
        last = f"t{k}"
        levels.append(f"{last} AS (SELECT sk, block, pass, CASE WHEN k <= n * (mid - lo) // (hi - lo) THEN lo ELSE mid END AS lo, CASE WHEN k <= n * (mid - lo) // (hi - lo) THEN mid ELSE hi END AS hi FROM ({ranked}))")
    return f"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS sk, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS key FROM documents),
s AS (SELECT source, sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS k, 3 * source_size AS stop FROM s),
v AS (SELECT *, row_number() OVER o AS pos, CAST((sum(source_size) OVER ()) - coalesce(sum(stop) OVER (ORDER BY stop / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / (sum(w) OVER (ORDER BY stop / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM w WINDOW o AS (ORDER BY stop / w, k)),
l AS (SELECT arg_min(level, pos) FILTER (stop > level * w) AS lv FROM v),
t AS (SELECT source, sk, source_size, coalesce(least(CAST(stop AS DOUBLE), lv * w), CAST(stop AS DOUBLE)) AS target FROM v, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
r AS (SELECT *, floor(target - base * source_size + 0.5) AS rest FROM q),
c AS (SELECT d.doc_id, d.sk, d.size, d.key, d.key[1:{BLOCK_DIGITS}] AS block, r.source_size, r.target, r.base, r.rest, coalesce(sum(size) OVER (PARTITION BY d.sk ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN r ON r.sk = d.sk),
m AS (SELECT *, CAST(base * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c),
b AS (SELECT sk, block, min(before) AS before, any_value(base) AS base, any_value(rest) AS rest FROM c GROUP BY sk, block HAVING sum(size) > 0),
balls AS (SELECT sk, block, CAST(unnest(range(CAST(base + (before < rest)::INT AS BIGINT))) AS INT) AS pass FROM b),
{", ".join(levels)},
quota AS (SELECT sk, lo, sum(count(*)) OVER (PARTITION BY sk ORDER BY lo) AS upto FROM {last} GROUP BY sk, lo),
place AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY md5('place:{seed}:' || sk || ':' || block || ':' || pass), block, pass) - 1 AS place FROM balls),
dealt AS (SELECT p.sk, p.block, p.pass, min(quota.lo) AS shard FROM place p JOIN quota ON quota.sk = p.sk AND quota.upto > p.place GROUP BY ALL),
layout AS (SELECT sk, block, list(shard ORDER BY pass) AS shards FROM dealt GROUP BY sk, block)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN array_to_string(shards[1:CAST(ceil(taken / size) AS INT)], ',') ELSE '' END AS shards, key AS order_key
FROM m LEFT JOIN layout ON layout.sk = m.sk AND layout.block = m.block
"""


ORACLE = _oracle()
