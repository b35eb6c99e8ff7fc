"""Token counts by a separator scan over flat, unindexed token files."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pelgrain.llm.common import staged

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: End-of-document identifier: the one the vocabulary leaves free.
EOD = 50256
#: Bytes of a block, whatever documents it cuts.
BLOCK = 1 << 20
#: Split pattern of this public vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}


def rank_file(vocab: str) -> bytes:
    """The rank file's bytes, read by the driver; executors get them with their tasks and need no file of their own."""
    with open(vocab, "rb") as f:
        return f.read()


def encoder(vocab: str, raw: bytes | None = None):
    """The tokenizer of a rank file (or its bytes), one for each worker."""
    if vocab not in _encoders:
        import tiktoken

        lines = (raw if raw is not None else rank_file(vocab)).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _encoders[vocab] = tiktoken.Encoding(os.path.basename(vocab), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocab]


FLAT = "file long, block long, tokens binary, ids array<long>"
_FLAT = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("ids", pa.list_(pa.int64()))])


def write_flat(docs: DataFrame, vocab: str = VOCAB, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """docs -> flat token files: uint16 identifiers in one stream for each partition, cut in blocks of `block` bytes.

    After each document stands `eod`, which ordinary text never gives. Rows without tokens are the
    manifest: doc_ids in the order of the stream, no lengths or places; their `block` counts its pieces.
    """

    raw = rank_file(vocab)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file, k, piece, rest = encoder(vocab, raw), TaskContext.get().partitionId(), 0, 0, bytearray()
        for b in it:
            for lo in range(0, b.num_rows, 1000):
                part, out = b.slice(lo, 1000), []
                for t in part.column("text"):
                    rest += np.array([*enc.encode_ordinary(t.as_py() or ""), eod], np.uint16).tobytes()
                    while len(rest) >= block:
                        out.append({"file": file, "block": k, "tokens": bytes(rest[:block]), "ids": None})
                        del rest[:block]
                        k += 1
                out.append({"file": file, "block": piece, "tokens": None, "ids": part.column("doc_id").to_pylist()})
                piece += 1
                yield pa.RecordBatch.from_pylist(out, schema=_FLAT)
        if rest:
            yield pa.RecordBatch.from_pylist([{"file": file, "block": k, "tokens": bytes(rest), "ids": None}], schema=_FLAT)

    return docs.select("doc_id", "text").mapInArrow(batches, FLAT)


def _open(path: str):
    """A file of any storage for reading at any place."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    system, inner = FileSystem.from_uri(path)
    return system.open_input_file(inner)


def read_flat(spark: SparkSession, path: str, block: int = BLOCK, task_bytes: int = 64 << 20) -> DataFrame:
    """Flat files of uint16 identifiers from storage, as blocks. `file` is a hash of the path.

    Only names and lengths are listed; tasks of about `task_bytes` then read their own ranges, so a
    file of any size is spread over all executors and none is ever held as a whole.
    """
    if block < 2 or block % 2:
        raise ValueError("a block must hold whole identifiers of 2 bytes")
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    total = files.agg(F.sum("length")).first()[0] or 0
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))).alias("block")
    pieces = files.select("path", F.xxhash64("path").alias("file"), start).repartition(max(1, min(100_000, -(-total // task_bytes))), "path", F.floor(F.col("block") * block / task_bytes)).sortWithinPartitions("path", "block")
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary())])

    def ranges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in it:
            for p, file, k in zip(*(b.column(c).to_pylist() for c in ("path", "file", "block")), strict=True):
                if p != name:
                    if f:
                        f.close()
                    name, f = p, _open(p)
                f.seek(k * block)
                yield pa.RecordBatch.from_pylist([{"file": file, "block": k, "tokens": f.read(block)}], schema=schema)
        if f:
            f.close()

    return pieces.mapInArrow(ranges, "file long, block long, tokens binary")


SCANNED = "file long, block long, seps long, head long, inner array<long>, tail long, ids array<long>"


def _scan(eod: int):
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("seps", pa.int64()), ("head", pa.int64()), ("inner", pa.list_(pa.int64())), ("tail", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            ids = b.column("ids").to_pylist() if "ids" in b.schema.names else [None] * b.num_rows
            for file, block, raw, mine in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("tokens"), ids, strict=True):
                if mine is not None:
                    out.append((file, block, 0, 0, None, 0, mine))
                    continue
                t = np.frombuffer(raw.as_py(), np.uint16)
                at = np.flatnonzero(t == eod)
                head = int(at[0]) if len(at) else len(t)
                tail = len(t) - int(at[-1]) - 1 if len(at) else 0
                out.append((file, block, len(at), head, (np.diff(at) - 1).tolist(), tail, None))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    return batches


def separator_scan(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """Blocks (file, block, tokens[, ids]) -> one row a block: separators, tokens before the first, between, after the last."""
    return blocks.mapInArrow(_scan(eod), SCANNED)


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) of every document, from the blocks' own counts.

    A prefix scan over a file's blocks gives the number of documents closed before a block, and the
    tokens left open since the last separator: those of the blocks after it. Tokens after a file's
    last separator are a document without an end and are counted as one.
    """
    whole = scanned.where("ids is null")
    b = whole.select("file", "block", "seps", "head", "tail")  # counts alone go through the windows
    w = W.partitionBy("file").orderBy("block")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("done", F.coalesce(F.sum("seps").over(before), F.lit(0))).withColumn("part", F.coalesce(F.count(F.when(F.col("seps") > 0, 1)).over(before), F.lit(0)))
    # a part: a block with a separator, its tail, and the blocks without one that follow it
    inside = W.partitionBy("file", "part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("tail_before", F.coalesce(F.max(F.when(F.col("seps") > 0, F.struct("block", "tail"))).over(before)["tail"], F.lit(0)))
    b = b.withColumn("open", F.col("tail_before") + F.coalesce(F.sum("head").over(inside), F.lit(0)))
    ended = whole.where("seps > 0").select("file", "block", "seps", "head", "inner").join(b.select("file", "block", "done", "open"), ["file", "block"])
    ended = ended.select("file", "done", F.explode(F.arrays_zip(F.concat(F.array(F.col("open") + F.col("head")), "inner").alias("n"), F.sequence(F.lit(0).cast("long"), F.col("seps") - 1).alias("k"))).alias("d"))
    ended = ended.select("file", (F.col("done") + F.col("d.k")).alias("ordinal"), F.col("d.n").alias("n_tokens"))
    last = b.groupBy("file").agg(F.max(F.struct("block", (F.col("done") + F.col("seps")).alias("ordinal"), F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("open") + F.col("head")).alias("n"))).alias("x"))
    return ended.unionAll(last.where("x.n > 0").select("file", "x.ordinal", "x.n"))


def count_tokens(docs: DataFrame, vocab: str = VOCAB, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens): tokens of each document, found again in the flat files written for them.

    Blocks stream from the writer to the scan; what is stored is their counts and the manifest.
    Null and empty texts have 0 tokens. Repeated rows count each. Other columns are ignored; an
    empty table gives no rows.
    """
    scanned = staged(separator_scan(write_flat(docs, vocab, eod, block), eod), "op6")
    w = W.partitionBy("file").orderBy("block")
    ids = scanned.where("ids is not null").select("file", "block", "ids", F.size("ids").alias("n"))
    first = ids.select("file", "block", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    ids = ids.join(first, ["file", "block"])
    manifest = ids.select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return manifest.join(stitch(scanned), ["file", "ordinal"]).select("doc_id", "n_tokens")
