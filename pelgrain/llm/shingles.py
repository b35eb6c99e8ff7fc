"""Links between documents whose sets of word shingles have a Jaccard similarity of 0.8 or more: bands of minima, then the sets themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from xxhash import xxh64_intdigest

from pelgrain.llm.common import discard, join_counted, key_filter, may_have, staged
from pelgrain.llm.graph import components
from pelgrain.llm.words import lower_table, mix, runs, spaced_table, split_words, text_buffer

WORDS = 5
#: Sets with Jaccard 0.8 share a band of five minima with probability 0.8**5, and none of forty with 1.2e-7.
BANDS, ROWS = 40, 5
#: Of so many minima four bits are kept as a mark, 16 to a long. At Jaccard 0.8 the marks of two sets differ in
#: 96 places of 512 on average, and in more than MOST_UNLIKE with a probability of about 1e-7.
MARKED, MOST_UNLIKE = 512, 143
MARKS = MARKED // 16
#: Multipliers of the minima: odd numbers from a fixed generator.
ODD = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 31, MARKED, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Members of a list that all others are compared with, on average, before pairs are looked for.
CENTRES = 16
#: Bytes of text worked on at once.
CHUNK = 1 << 19
INSIDE, FOLD = spaced_table(), lower_table()


def hashes(buf: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, and the n + 1 offsets by text. A text of fewer words is one shingle, a wordless one has none."""
    w = split_words(buf, offsets, INSIDE, FOLD)
    n = np.diff(w.first)
    count = np.where(n > 0, np.maximum(n - (words - 1), 1), 0)
    start, end = runs(w.first[:-1], count), np.repeat(w.first[1:], count)
    h = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            at = start + k
            h = mix(h * np.uint64(3) + np.where(at < end, w.hash[np.minimum(at, len(w) - 1)], np.uint64(0)) + np.uint64(k))
    return h, np.concatenate([[0], np.cumsum(count)])


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A batch's rows in pieces of about CHUNK bytes: (first row, hashes, offsets)."""
    buf, offsets = text_buffer(b.column("text"))
    k = 0
    while k < b.num_rows:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK, side="right")) - 1)
        yield k, *hashes(buf[offsets[k] : offsets[stop]], offsets[k : stop + 1] - offsets[k])
        k = stop


def _sets(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int | None]]:
    """The set of shingles of each row, ascending, and its name: a hash of the set, None for the empty one."""
    for _, h, at in _pieces(b):
        for i in range(len(at) - 1):
            s = np.unique(h[at[i] : at[i + 1]])
            yield s, _name(s)


def _name(s: np.ndarray) -> int | None:
    """What a set of shingles goes by: a hash of it, None for the empty one."""
    x = xxh64_intdigest(s.tobytes(), 42)
    return None if not len(s) else x - (1 << 64) if x >> 63 else x


def band_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bands and marks, a row for each text that has shingles: minima of fixed permutations of its hashes, five to a key."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    starts = at[:-1][np.diff(at) > 0]
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(starts), 1))
    marks = np.zeros((len(starts), MARKS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(MARKED if len(starts) else 0):
            least = np.minimum.reduceat(x * ODD[k], starts).astype(np.uint64)
            marks[:, k // 16] |= (least & np.uint64(15)) << np.uint64(4 * (k % 16))
            if k < BANDS * ROWS:
                keys[:, k // ROWS] = mix(keys[:, k // ROWS] * np.uint64(3) + least)
    return keys, marks


def planes(marks: np.ndarray) -> np.ndarray:
    """Marks bit by bit: of every four longs of 16 marks, four longs that hold the lowest, next, next and highest bit of all 64."""
    ones = np.uint64(0x1111111111111111)
    out = np.zeros_like(marks)
    for k in range(MARKS):
        for bit in range(4):
            out[:, k // 4 * 4 + bit] |= ((marks[:, k] >> np.uint64(bit)) & ones) << np.uint64(k % 4)
    return out


def differing(a: Column, b: Column) -> Column:
    """Places at which the marks of two sets differ, from their planes. A quarter of the expression of `unlike`, which Spark's driver holds in many plans."""
    total = F.lit(0)
    for k in range(0, MARKS, 4):
        x = a[k].bitwiseXOR(b[k])
        for bit in range(1, 4):
            x = x.bitwiseOR(a[k + bit].bitwiseXOR(b[k + bit]))
        total = total + F.bit_count(x)
    return total


def unlike(a: Column, b: Column) -> Column:
    """Places at which the marks of two sets differ, from the marks as `band_keys` gives them: the plain form of `differing`."""
    total = F.lit(0)
    for k in range(MARKS):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def signatures(docs: DataFrame, fingerprint: Callable[[str | None], int] | None = None) -> DataFrame:
    """docs (any columns, text) -> the other columns, sig (name of the set), n (its size), keys (of its bands), marks (their planes); and fp, where a fingerprint of the text is asked for."""
    others = [c for c in docs.columns if c != "text"]
    made = [("sig", LongType()), ("n", IntegerType()), ("keys", ArrayType(LongType())), ("marks", ArrayType(LongType()))] + [("fp", LongType())] * bool(fingerprint)
    schema = StructType([*[docs.schema[c] for c in others], *[StructField(*x) for x in made]])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, h, at in _pieces(b):  # a piece at a time, so that little is held
                sets = [np.unique(h[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
                part = b.slice(lo, len(sets))
                some = np.diff(at) > 0
                keys, marks = band_keys(h, at)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * x.shape[1])]).astype(np.int32)), pa.array(x.ravel().view(np.int64))) for x in (keys, planes(marks))]
                out = [pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), *lists]
                if fingerprint:
                    out.append(pa.array(np.array([fingerprint(t.as_py()) for t in part.column("text")], np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], *out], schema.names)

    return docs.mapInArrow(batches, schema)


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of set names that have a Jaccard similarity of 0.8, by their whole sets (of 64-bit hashes); a staged table.

    Pairs whose marks (nodes: sig, marks) are too unlike are not looked at further.
    """
    marked = pairs.join(nodes.toDF("u", "mu"), "u").join(nodes.toDF("v", "mv"), "v")
    pairs = staged(marked.where(differing(F.col("mu"), F.col("mv")) <= MOST_UNLIKE).select("u", "v"), "near-pairs")
    names = staged(pairs.select(F.col("u").alias("sig")).unionAll(pairs.select("v")).distinct(), "near-names")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 200):
                found = [(sig, s.view(np.int64)) for s, sig in _sets(b.slice(lo, 200)) if sig is not None]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))], ["sig", "s"])

    # one text for each name is read again
    texts = rows.join(names, "sig", "left_semi").groupBy("sig").agg(F.min("th").alias("th")).select("th").distinct()
    some = may_have(docs.select("text", F.xxhash64("text").alias("th")), F.col("th"), key_filter(texts, "th"), "may").where("may")
    sets = staged(some.select("text").mapInArrow(batches, "sig long, s array<long>").join(names, "sig", "left_semi").dropDuplicates(["sig"]), "near-sets")
    # a set that many are compared with is broadcast: under a hundred can be in over a hundredth of the pairs
    total, often = pairs.count(), pairs.groupBy("u").agg(F.count("*").alias("c"))
    centres = sets.join(often, sets["sig"] == often["u"]).select("u", F.col("s").alias("a"), "c")
    both = join_counted(pairs.join(sets.toDF("v", "b"), "v"), centres, ["u"], "c", total, 100)
    common = F.size(F.array_intersect("a", "b"))
    out = staged(both.where(common * 9 >= (F.size("a") + F.size("b")) * 4).select("u", "v"), "near-found")
    for spent in (pairs, names, sets):
        discard(spent)
    return out


def _rooted(rows: DataFrame, known: DataFrame, on: str, root: str) -> DataFrame:
    """rows with the component (known: node, root) of the set named in column `on`."""
    found = known.select(F.col("node").alias(on), F.col("root").alias(root))
    return rows.join(found, on, "left").withColumn(root, F.coalesce(root, on))


def _open(named: DataFrame) -> DataFrame:
    """Lists (key, root, ...) with sets of several components."""
    parts = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return named.join(parts, "key", "left_semi")


def similar_sets(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (sig, keys, marks, th: xxhash64 of the text) of docs -> (u, v): names of sets that connect just those joined by steps of Jaccard 0.8.

    Sets that share a band meet in its list. A set's weight is the length of all its lists: what a
    group of near copies was made from shares more bands with each than they do among themselves.
    Each set is compared with the weightiest of its lists that it meets most often, then with the one
    most like it among some members of its lists, then with all that is in its lists; every time
    only sets that no chain of links has joined yet. A group of near copies so costs about its size.
    Pairs are told by their marks before they leave a list, each in one list only, so a list of texts
    that are only half alike gives hardly any, though it compares marks by the square of its length.
    All links are verified.
    """
    known = staged(rows.where("sig is not null").select("sig", "keys", "marks").dropDuplicates(["sig"]), "near-sets-of-keys")
    posts, nodes = known.select("sig", F.explode("keys").alias("key")), known.select("sig", "marks")
    sizes = staged(posts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "near-sizes")
    total = sizes.agg(F.sum("c")).first()[0] or 0
    shared = may_have(posts, F.col("key"), key_filter(sizes, "key"), "may").where("may").drop("may")
    lists = staged(join_counted(shared, sizes, ["key"], "c", total), "near-lists")
    weights = staged(lists.groupBy("sig").agg(F.sum("c").alias("w")), "near-weights")
    centres = lists.join(weights, "sig").groupBy("key", "c").agg(F.max(F.struct("w", "sig")).alias("f")).select("key", "c", F.col("f.sig").alias("u"))
    stars = join_counted(lists.drop("c"), centres, ["key"], "c", total).where("sig <> u").groupBy("u", F.col("sig").alias("v")).agg(F.count("*").alias("m"))
    best = staged(stars.groupBy("v").agg(F.max(F.struct("m", "u")).alias("b")).select(F.col("b.u").alias("u"), "v"), "near-stars")
    links = _verified(best, rows, docs, nodes)
    # lists of several components, with what tells their members
    named = _rooted(lists, staged(components(links, "near-cc"), "near-joined"), "sig", "root")
    open_ = staged(_open(staged(named, "near-named")).join(known, "sig"), "near-open")
    side = lambda d, n: d.select("key", F.col("sig").alias(n), F.col("root").alias(f"r{n}"), F.col("marks").alias(f"m{n}"), F.col("keys").alias(f"k{n}"))
    some = side(open_.where(F.pmod(F.xxhash64("sig"), F.col("c")) < CENTRES), "u")
    far = differing(F.col("mu"), F.col("mv"))
    near = side(open_, "v").join(some, "key").where("u <> v and ru <> rv").select("u", "v", far.alias("far")).where(F.col("far") <= MOST_UNLIKE)
    near = staged(near.groupBy("v").agg(F.min(F.struct("far", "u")).alias("b")).select(F.col("b.u").alias("u"), "v"), "near-some")
    links = links.unionAll(_verified(near, rows, docs, nodes))
    # all that is left, each pair in the first list that it meets in
    left = _open(staged(_rooted(open_.drop("root"), staged(components(links, "near-cc"), "near-joined"), "sig", "root"), "near-left"))
    a, b = side(left, "u"), side(left, "v")
    apart = (F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & (far <= MOST_UNLIKE) & (F.array_min(F.array_intersect("ku", "kv")) == a["key"])
    rest = a.join(b, [a["key"] == b["key"], apart]).select("u", "v")
    seen = best.unionAll(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = links.unionAll(_verified(rest.join(seen, ["u", "v"], "left_anti"), rows, docs, nodes))
    for spent in (known, sizes, lists, weights, best, open_, near):
        discard(spent)
    return links
