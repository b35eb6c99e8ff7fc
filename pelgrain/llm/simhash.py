"""SimHash near-dedup: 64-bit fingerprints, linked through an inverted index on their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from pelgrain.llm import shingles
from pelgrain.llm.common import join_counted, staged
from pelgrain.llm.graph import components
from pelgrain.llm.sql_hash import of_text

SHINGLE = 3
MAX_BITS = 2
#: Fingerprints differing in at most MAX_BITS bits share at least this many of their 8 positional bytes.
LEAST_SHARED = 8 - MAX_BITS
#: The index posts a fingerprint's eight positional bytes in all sets of LEAST_SHARED positions, so that
#: every pair that can pass the count filter meets in a list, and a list has 2**16 fingerprints at most.
SETS = tuple(combinations(range(8), LEAST_SHARED))

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit k is 1 if set in over half of the hashes of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    last = min(shingle, len(words)) - 1
    starts, ends = (end - size)[: len(words) - last].tolist(), end[last:].tolist()
    seen = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 16):
        h = np.array([xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=True)], np.uint64)
        seen += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(seen * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; then the columns to keep."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp), *[b.column(c) for c in keep]], ["doc_id", "fp", *keep])

    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType()), *[docs.schema[c] for c in keep]])
    return docs.select("doc_id", "text", *[c for c in keep if c != "text"]).mapInArrow(batches, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(prints: DataFrame) -> DataFrame:
    """fp -> (g, key, fp): the lists it stands in, g the set of positions and key its bytes there."""
    fp = F.col("fp")
    masks = [_signed(sum(0xFF << (8 * i) for i in at)) for at in SETS]
    keys = F.array(*[F.struct(F.lit(g).alias("g"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key")) for g, m in enumerate(masks)])
    return prints.select("fp", F.inline(keys)).select("g", "key", "fp")


def tallies(lists: DataFrame) -> DataFrame:
    """Lists (g, key, fp) -> (u, v, shared): pairs that meet in lists, and at how many positions they were found to have the same byte.

    A list leaves two bytes free. Each member is put at itself and at the 16 values one of the free
    bits away; two members differ in at most two bits just if they share such a place. Pairing all
    of a place with its least member joins the same fingerprints as all their pairs would, and costs
    17 rows for a member, however many near copies a list holds.
    """
    flips = [[0, *[1 << (8 * i + b) for i in range(8) if i not in at for b in range(8)]] for at in SETS]
    flip = F.element_at(F.array(*[F.array(*[F.lit(_signed(x)).cast("long") for x in row]) for row in flips]), F.col("g") + 1)
    placed = lists.select("g", "fp", F.explode(flip).alias("flip")).select("g", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"))
    met = placed.select("g", F.col("fp").alias("u"), F.min("fp").over(W.partitionBy("g", "place")).alias("v")).where("u <> v")
    positions = F.element_at(F.array(*[F.lit(sum(1 << i for i in at)) for at in SETS]), F.col("g") + 1)
    return met.groupBy("u", "v").agg(F.bit_count(F.bit_or(positions)).alias("shared"))


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (u, v) that connect just those joined by steps of at most MAX_BITS bits.

    Inverted index on positional bytes, with a count filter: lists of fingerprints that agree in
    LEAST_SHARED positions, the shared bytes of each pair tallied over all lists it meets in, pairs
    that reach the least number kept and verified by their differing bits. Lists are parted by one
    shuffle and hold 2**16 fingerprints at most, as 16 bits are free in them.
    """
    own = W.partitionBy("g", "key")
    full = postings(prints).select("g", "fp", (F.min("fp").over(own) < F.max("fp").over(own)).alias("many")).where("many").drop("many")
    pairs = tallies(staged(full, "op2-lists")).where(F.col("shared") >= LEAST_SHARED)
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS).select("u", "v")


def _groups(rows: DataFrame, tag: str, more: DataFrame | None = None) -> DataFrame:
    """rows (doc_id, fp, ...) with component_id and root, the fingerprint that names the component; `more` are further links."""
    own = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.count("*").alias("n")), f"{tag}-own")
    pairs = links(own.select("fp")) if more is None else links(own.select("fp")).unionAll(more)
    comps = staged(own.select("fp", "lo").join(components(pairs, f"{tag}-cc").withColumnRenamed("node", "fp"), "fp"), f"{tag}-comps")
    least = comps.groupBy("root").agg(F.min("lo").alias("component_id"), F.count("*").alias("n"))
    linked = join_counted(comps, least, ["root"], "n", comps.count()).select("fp", "root", "component_id")
    labels = staged(own.join(linked, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "lo").alias("component_id")), f"{tag}-labels")
    return join_counted(rows, labels, ["fp"], "n", labels.agg(F.sum("n")).first()[0] or 0).drop("n")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): documents linked by fingerprints that differ in at most MAX_BITS bits.

    component_id is the least doc_id reachable. Equal fingerprints are one node, so copies never
    pair up. Null, empty or wordless texts have fingerprint 0, linked like any other. Repeated rows
    stay. A null doc_id gets its component's least other id, or null. Empty table: no rows.
    """
    return _groups(staged(fingerprints(docs, shingle), "op2"), "op2").select("doc_id", "fp", "component_id")


def with_contract_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similar(docs: DataFrame, shingle: int) -> DataFrame:
    wide = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    rows = staged(shingles.signatures(wide, partial(fingerprint, shingle=shingle)), "near")
    same = staged(rows.where("sig is not null").groupBy("sig").agg(F.min("fp").alias("at")), "near-same")
    pairs = shingles.similar_sets(rows, docs)
    pairs = pairs.join(same.toDF("u", "a"), "u").join(same.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    alike = rows.select("fp", "sig").distinct().join(same, "sig").where("fp <> at").select(F.col("fp").alias("u"), F.col("at").alias("v"))
    return _groups(rows.select("doc_id", "th", "fp"), "near", pairs.unionAll(alike))


def near_or_similar(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) as near_duplicates, where a Jaccard similarity of 0.8 of the sets of five-word shingles links as well.

    No radius of bits holds all such pairs: the fingerprint weighs repeats, and spreads. They are
    found by bands of minima and verified by their sets; see `shingles.similar_sets`.
    """
    return _similar(docs, shingle).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, broadcast_up_to: int = 500_000, similar: bool = False) -> DataFrame:
    """One row of each component stays, the one with the least (doc_id, hash of the text), null ids last; docs' columns only.

    Rows are told apart by (doc_id, hash of the text): other texts under the same doc_id are
    judged by themselves, and rows without a doc_id like any other. The rows to drop are broadcast
    if counted to be at most `broadcast_up_to`, else joined by shuffle. With `similar`, texts of
    Jaccard similarity 0.8 are linked too.
    """
    wide = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    rows = _similar(docs, shingle) if similar else _groups(staged(fingerprints(wide, shingle, keep=("th",)), "op2"), "op2")
    found = staged(rows.select(F.col("doc_id").alias("_d_id"), F.col("th").alias("_d_th"), "root"), "op2-found")
    row = F.struct(F.col("_d_id").isNull().alias("none"), "_d_id", "_d_th")
    keep = found.groupBy("root").agg(F.min(row).alias("k"), F.count("*").alias("n")).where("n > 1")
    many = staged(join_counted(found, keep, ["root"], "n", found.count()).select("_d_id", "_d_th", (F.col("_d_id").eqNullSafe(F.col("k._d_id")) & (F.col("_d_th") == F.col("k._d_th"))).alias("stays")), "op2-many")
    marked = docs.withColumn("_d_h", F.xxhash64("text"))
    same = lambda: marked["doc_id"].eqNullSafe(F.col("_d_id")) & (F.col("_d_h") == F.col("_d_th"))
    gone = many.where("not stays").select("_d_id", "_d_th").distinct()
    gone = F.broadcast(gone) if gone.count() <= broadcast_up_to else gone
    out = marked.join(gone, same(), "left_anti")
    twice = many.where("stays").groupBy("_d_id", "_d_th").count().where("count > 1").drop("count")
    if twice.limit(1).count():
        again = out.join(twice, same(), "left_semi").dropDuplicates(["doc_id", "_d_h"])
        out = out.join(twice, same(), "left_anti").unionAll(again)
    return out.select(*docs.columns)


def _oracle(shingle: int = SHINGLE, bits: int = MAX_BITS) -> str:
    tally = ", ".join(f"sum(n * CAST((h >> {k}) & 1 AS BIGINT)) AS s{k}" for k in range(64))
    fp = " + ".join(f"CASE WHEN 2 * s{k} > n THEN {1 << k}::UHUGEINT ELSE 0::UHUGEINT END" for k in range(64))
    return f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, greatest(1, len(w) - {shingle - 1}) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT r, array_to_string(w[i:i + {shingle - 1}], ' ') AS s, count(*) AS n FROM i GROUP BY ALL),
h AS (SELECT s, h::UBIGINT AS h FROM ({of_text("(SELECT DISTINCT s FROM s)", "s", 42, "h")})),
t AS (SELECT r, sum(n) AS n, {tally} FROM s JOIN h USING (s) GROUP BY r),
f AS (SELECT r, CAST({fp} AS UBIGINT) AS fp FROM t),
d AS (SELECT w.doc_id, coalesce(f.fp, 0::UBIGINT) AS fp FROM w LEFT JOIN f USING (r)),
p AS (SELECT fp, min(doc_id) AS lo FROM d GROUP BY fp),
l AS (SELECT a.fp AS u, b.fp AS v FROM p a JOIN p b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::HUGEINT) <= {bits}),
c(fp, m) AS (SELECT fp, lo FROM p UNION SELECT l.v, c.m FROM c JOIN l ON l.u = c.fp),
k AS (SELECT fp, min(m) AS component_id FROM c GROUP BY fp)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM d JOIN k USING (fp)
"""


ORACLE = _oracle()
