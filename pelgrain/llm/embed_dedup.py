"""Embedding near-dedup: an epsilon grid order join within labels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelgrain.llm.common import join_counted, staged
from pelgrain.llm.graph import components

COSINE = 0.93
#: Leading principal dimensions of the grid, and the directions they are looked for in.
DIMS = 6
DIRECTIONS = 128
#: Components of a sequence interval that is joined as a whole by one task; vectors it has at most.
COMPONENTS, CHUNK = 1 << 20, 1 << 14
#: Vectors of an interval that is not divided any more.
LEAF = 256
#: Slack of the distance tests, for rounding; pairs are decided by their cosine in double precision alone.
SLACK = 1e-6
#: Pairs of vectors that make the work of a task.
TASK_PAIRS = 1 << 26


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with 0 to dim."""
    off = np.asarray(col.offsets, np.int64)
    flat = np.asarray(col.values.slice(off[0], off[-1] - off[0]), np.float64)
    n = np.diff(off)
    if len(n) and (n == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(n), dim))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], n)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(classes: DataFrame, dim: int, keep: int) -> np.ndarray:
    """The leading principal directions of all unit vectors, from sums of products taken in each partition.

    Vectors of more than DIRECTIONS components are seen in as many fixed random directions, so the
    driver's sums have a fixed size. Any orthonormal directions are right for the grid.
    """
    basis = np.eye(dim) if dim <= DIRECTIONS else np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, DIRECTIONS)))[0]
    k = basis.shape[1]

    def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in it:
            x = _unit(_matrix(b.column("embedding"), dim)) @ basis
            total[:k] += x.T @ x
            total[k] += x.sum(axis=0)
        i, j = np.nonzero(np.arange(k + 1)[:, None] >= np.arange(k)[None, :])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    m, mean = np.zeros((k, k)), np.zeros(k)
    sums = classes.select("embedding").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    for r in sums.toLocalIterator():
        if r.i == k:
            mean[r.j] = r.s
        else:
            m[r.i, r.j] = m[r.j, r.i] = r.s
    n = max(np.trace(m), 1.0)  # about the number of vectors
    _, vectors = np.linalg.eigh(m / n - np.outer(mean / n, mean / n))
    return basis @ vectors[:, ::-1][:, :keep]


def _near(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
    return float((gap * gap).sum()) <= eps * eps


def _close(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a and b have the cosine: in single precision where that is certain, else in double."""
    g = a.astype(np.float32) @ b.astype(np.float32).T
    hit = g >= cosine
    i, j = np.nonzero(np.abs(g - np.float32(cosine)) < 1e-4)
    hit[i, j] = (a[i] * b[j]).sum(axis=1) >= cosine
    return hit


def join_intervals(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, same: bool, eps: float, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with the cosine, from two sequence intervals: halve the longer until leaves, skip distant halves.

    a, b: unit vectors; pa_, pb: their projections; same: the intervals are one, so i > j alone.
    """

    def go(i0: int, i1: int, j0: int, j1: int, diagonal: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        p, q = pa_[i0:i1], pb[j0:j1]
        if not diagonal and not _near(p.min(0), p.max(0), q.min(0), q.max(0), eps):
            return
        if max(i1 - i0, j1 - j0) <= LEAF:
            hit = _close(a[i0:i1], b[j0:j1], cosine)
            i, j = np.nonzero(np.tril(hit, -1) if diagonal else hit)
            if len(i):
                yield i + i0, j + j0
        elif diagonal:
            m = (i0 + i1) // 2
            yield from go(i0, m, i0, m, True)
            yield from go(m, i1, i0, m, False)
            yield from go(m, i1, m, i1, True)
        elif i1 - i0 >= j1 - j0:
            m = (i0 + i1) // 2
            yield from go(i0, m, j0, j1, False)
            yield from go(m, i1, j0, j1, False)
        else:
            m = (j0 + j1) // 2
            yield from go(i0, i1, j0, m, False)
            yield from go(i0, i1, m, j1, False)

    yield from go(0, len(a), 0, len(b), same)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes by the links i - j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


BLOCK = "label string, dim int, block long, size int, lo array<double>, hi array<double>, cids binary, mults binary, vectors binary"


def _pack(directions: np.ndarray, dim: int, room: int, kind: str):
    """Sorted vectors -> intervals of up to `room` vectors, one row each, with the box of their projections."""
    names = [x.split()[0] for x in BLOCK.split(", ")]
    types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())

    def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        x = _matrix(t.column("embedding").chunk(0), dim)
        p = _unit(x) @ directions
        cids = np.asarray(t.column("cid")).astype(np.int64)
        row = (t.column("label")[0].as_py(), t.column("dim")[0].as_py(), int(cids[0]), len(cids), p.min(0).tolist(), p.max(0).tolist(), cids.tobytes(), np.asarray(t.column("mult")).astype(np.int64).tobytes(), x.astype(kind).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, types, strict=True)], names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, group = [], 0, None
        for b in it:
            keys = list(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), strict=True))
            k = 0
            while k < b.num_rows:
                if held and (keys[k] != group or n == room):
                    yield out(held)
                    held, n = [], 0
                group, stop = keys[k], k
                while stop < min(k + room - n, b.num_rows) and keys[stop] == group:
                    stop += 1
                held.append(b.slice(k, stop - k))
                n += stop - k
                k = stop
        if held:
            yield out(held)

    return batches


def _project(directions: np.ndarray, eps: float, dim: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cells = np.floor(_unit(_matrix(b.column("embedding"), dim)) @ directions / eps).astype(np.int32)
            cols = [pa.array(cells[:, k]) for k in range(cells.shape[1])]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *[f"g{k}" for k in range(len(cols))]])

    return batches


def _gap(a: str, b: str) -> Column:
    """Squared distance of two boxes."""
    gaps = F.transform(F.arrays_zip(F.col(f"lo{a}").alias("a"), F.col(f"hi{a}").alias("b"), F.col(f"lo{b}").alias("c"), F.col(f"hi{b}").alias("d")), lambda z: F.greatest(F.lit(0.0), z["a"] - z["d"], z["c"] - z["b"]))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def chunk_pairs(chunks: DataFrame, eps: float) -> DataFrame:
    """Chunks (label, dim, chunk from 0, lo, hi) of each sequence -> (label, dim, a, b), a >= b: the pairs that may hold links.

    A recursive join of the sequence with itself: nodes are intervals of 2**level chunks with their
    boxes; pairs of nodes are halved level by level, and those whose boxes lie more than eps apart
    are dropped with all pairs below them. One equi join a level; nothing is collected.
    """
    top = chunks.agg(F.max("chunk")).first()[0] or 0
    levels = int(top).bit_length()
    dims = chunks.select(F.size("lo").alias("k")).first()
    if dims is None:
        return chunks.select("label", "dim", F.col("chunk").alias("a"), F.col("chunk").alias("b"))
    box = [f(F.col(c)[k]).alias(f"{c}{k}") for k in range(dims.k) for c, f in (("lo", F.min), ("hi", F.max))]

    def nodes(level: int) -> DataFrame:
        at = F.shiftright("chunk", level)
        g = chunks.groupBy("label", "dim", at.alias("k")).agg(*box)
        return g.select("label", "dim", "k", *[F.array(*[F.col(f"{c}{k}") for k in range(dims.k)]).alias(c) for c in ("lo", "hi")])

    pairs = chunks.select("label", "dim").distinct().select("label", "dim", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(levels - 1, -1, -1):
        n = staged(nodes(level), "op1-nodes")
        half = F.explode(F.array(*[F.struct((F.col("a") * 2 + i).alias("a"), (F.col("b") * 2 + j).alias("b")) for i in (0, 1) for j in (0, 1)]))
        pairs = pairs.select("label", "dim", half.alias("p")).select("label", "dim", "p.a", "p.b").where("a >= b")
        side = lambda s, n=n: n.select("label", "dim", F.col("k").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))
        pairs = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
        pairs = staged(pairs.where((F.col("a") == F.col("b")) | (_gap("_a", "_b") <= eps * eps)).select("label", "dim", "a", "b"), "op1-pairs")
    return pairs


FOUND = "u long, v long, n long"


def _join_chunks(eps: float, cosine: float, dim: int, directions: np.ndarray, kind: str):
    """Packed intervals sorted by (pair, side, place) -> for each vector of a pair with links: their number (n), and the least vector it is joined to (v)."""

    def joined(sides: tuple[list, list], same: bool) -> pa.RecordBatch | None:
        get = lambda s, k, t: np.concatenate([np.frombuffer(r[k], t) for r in s])
        ca, ma, a = get(sides[0], 0, np.int64), get(sides[0], 1, np.int64), _unit(get(sides[0], 2, kind).astype(np.float64).reshape(-1, dim))
        cb, mb, b = (ca, ma, a) if same else (get(sides[1], 0, np.int64), get(sides[1], 1, np.int64), _unit(get(sides[1], 2, kind).astype(np.float64).reshape(-1, dim)))
        shift = 0 if same else len(a)
        ids, mults = (ca, ma) if same else (np.concatenate([ca, cb]), np.concatenate([ma, mb]))
        n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        links: list[np.ndarray] = []
        held = 0

        def settle() -> None:
            nonlocal root, held
            if links:
                x, y = np.concatenate(links, axis=1)
                root = _forest(len(ids), np.concatenate([x, np.arange(len(ids))]), np.concatenate([y, root]))
                links.clear()
                held = 0

        for i, j in join_intervals(a, a @ directions, b, b @ directions, same, eps, cosine):
            j = j + shift
            lo, hi = int(min(i.min(), j.min())), int(max(i.max(), j.max())) + 1
            n[lo:hi] += np.bincount(i - lo, mults[j], hi - lo).astype(np.int64) + np.bincount(j - lo, mults[i], hi - lo).astype(np.int64)
            new = np.flatnonzero(root[i] != root[j])
            if len(new):
                links.append(np.stack([root[i[new]], root[j[new]]]))
                held += len(new)
                if held > 8 * len(ids):
                    settle()
        settle()
        some = np.flatnonzero(n)
        if len(some):
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(n[some])], ["u", "v", "n"])
        return None

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, same, sides = None, False, ([], [])
        for b in it:
            for k in range(b.num_rows):
                now = (b.column("label")[k].as_py(), b.column("dim")[k].as_py(), b.column("a")[k].as_py(), b.column("b")[k].as_py())
                if now != pair:
                    if sides[0] and (out := joined(sides, same)) is not None:
                        yield out
                    pair, same, sides = now, now[2] == now[3], ([], [])
                sides[b.column("side")[k].as_py()].append(tuple(b.column(c)[k].as_py() for c in ("cids", "mults", "vectors")))
        if sides[0] and (out := joined(sides, same)) is not None:
            yield out

    return batches


def _label_text(vectors: DataFrame) -> Column:
    """A label of any type as a text that is equal just where labels are."""
    kind, c = vectors.schema["label"].dataType, F.col("label")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0).cast(kind)).cast("string")  # no negative zero
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    return F.to_json(F.struct(c)) if isinstance(kind, (T.ArrayType, T.StructType)) else c.cast("string")


def _links(classes: DataFrame, dim: int, n: int, kind: str, cosine: float, room: int) -> DataFrame:
    """Classes (label, dim, embedding, mult, cid) -> (u, v, n) of FOUND."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    directions = principal(classes, dim, min(DIMS, dim))
    keep = directions.shape[1]
    cells = classes.select("label", "dim", "cid", "mult", "embedding").mapInArrow(_project(directions, eps, dim), "label string, dim int, cid long, mult long, embedding array<double>, " + ", ".join(f"g{k} int" for k in range(keep)))
    order = ["label", "dim", *[f"g{k}" for k in range(keep)], "cid"]
    grid = cells.repartitionByRange(*order).sortWithinPartitions(*order)
    small = max(1, room // 16)
    packed = staged(grid.mapInArrow(_pack(directions, dim, small, kind), BLOCK).withColumn("at", F.monotonically_increasing_id()), "op1-blocks")
    # chunks of a sequence: intervals in a row until `room` vectors; the window sees a row for each interval
    narrow = packed.select("label", "dim", "block", "at", "size", "lo", "hi")
    before = F.sum("size").over(W.partitionBy("label", "dim").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    member = staged(narrow.withColumn("chunk", F.floor(F.coalesce(before, F.lit(0)) / room).cast("long")), "op1-chunks")
    pairs = staged(chunk_pairs(member.select("label", "dim", "chunk", "lo", "hi"), eps), "op1-work")
    sizes = member.groupBy("label", "dim", "chunk").agg(F.sum("size").alias("n"))
    size = lambda s: sizes.select("label", "dim", F.col("chunk").alias(s), F.col("n").alias(f"n_{s}"))
    total = pairs.join(size("a"), ["label", "dim", "a"]).join(size("b"), ["label", "dim", "b"]).agg(F.count("*").alias("pairs"), F.sum(F.col("n_a") * F.col("n_b")).alias("work")).first()
    cores = classes.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(total.pairs, max(2 * cores, math.ceil((total.work or 0) / TASK_PAIRS))))
    place = member.select("block", "chunk")
    load = packed.select("label", "dim", "block", "at", "cids", "mults", "vectors").join(place, "block")
    sides = pairs.select("label", "dim", "a", "b", F.col("a").alias("chunk"), F.lit(0).alias("side")).unionAll(pairs.where("a <> b").select("label", "dim", "a", "b", F.col("b").alias("chunk"), F.lit(1).alias("side")))
    work = load.join(sides, ["label", "dim", "chunk"]).repartition(tasks, "label", "dim", "a", "b").sortWithinPartitions("label", "dim", "a", "b", "side", "at")
    work = work.select("label", "dim", "a", "b", "side", "cids", "mults", "vectors")
    return staged(work.mapInArrow(_join_chunks(eps, cosine, dim, directions, kind), FOUND), "op1-links")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, chunk: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors with a cosine of at least `cosine` within their label.

    Equal vectors of a label are one class with a count, so copies never pair up. Classes are sorted
    by grid cells (side epsilon, the distance of unit vectors at that cosine) on the leading
    principal dimensions of all vectors. A label's sequence is cut into chunks of up to `chunk`
    vectors and joined with itself recursively: pairs of intervals are halved down to chunks, then
    within the task of a pair of chunks, and those whose boxes are provably distant are skipped at
    every step. A pair of chunks returns a count and one link for each vector, never pairs, so a hot
    group costs arithmetic but no rows.

    Labels may be of any type that can be compared. Nothing links vectors that are null, empty,
    zero, of different length, with null or non-finite components, or with a null label: n_links 0,
    component_id their own vec_id. A null vec_id counts as a vector; its component has the least
    other id. Repeated rows link with each other. kept is vec_id = component_id. Other columns are
    ignored. Empty table: no rows.
    """
    element = getattr(vectors.schema["embedding"].dataType, "elementType", None)
    rows = vectors.select("vec_id", _label_text(vectors).alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # rows find their class again by 128 bits of hash, not by the vector
    keys = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding", "label").alias("h2")]
    groups = rows.where(ok).groupBy("label", "embedding").agg(F.count("*").alias("mult"), F.min("vec_id").alias("lo"))
    classes = staged(groups.select("label", F.size("embedding").alias("dim"), "embedding", "mult", "lo", *keys, F.monotonically_increasing_id().alias("cid")), "op1")
    known = classes.agg(F.max("dim").alias("dim"), F.count("*").alias("n"), F.sum("mult").alias("rows")).first()
    alone = lambda d: d.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not known.n:
        return alone(rows).withColumn("kept", F.col("vec_id").isNotNull())
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    found = _links(classes, known.dim, known.n, kind, cosine, chunk or max(256, min(CHUNK, COMPONENTS // known.dim)))
    linked = found.groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("n"))
    comps = components(found.select("u", "v"), "op1-cc").withColumnRenamed("node", "cid")
    member = staged(classes.select("cid", "lo").join(comps, "cid"), "op1-member")
    least = member.groupBy("root").agg(F.min("lo").alias("component_id"), F.count("*").alias("n"))
    label = join_counted(member, least, ["root"], "n", known.n).select("cid", "component_id")
    facts = classes.select("cid", "h1", "h2", "mult", "lo").join(linked, "cid", "left").join(label, "cid", "left")
    facts = staged(facts.select("h1", "h2", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "lo").alias("component_id")), "op1-facts")
    named = rows.select("vec_id", ok.alias("ok"), keys[0], keys[1])
    out = join_counted(named.where("ok").drop("ok"), facts, ["h1", "h2"], "mult", known.rows).select("vec_id", "n_links", "component_id").unionAll(alone(named.where("not ok")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.93 ELSE false END),
r(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.v, r.m FROM r JOIN l ON l.u = r.n),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n),
k AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.n = e.vec_id LEFT JOIN k ON k.u = e.vec_id
"""
