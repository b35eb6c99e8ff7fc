"""Quality classifier by importance resampling with hashed n-gram models."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelgrain.llm.common import staged
from pelgrain.llm.words import mix, spaced_table, split_words, text_buffer

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 15
#: Labelled rows that the target model and the threshold are fitted on, the least by a hash of the id.
SAMPLE = 20_000
#: Scale of the Gumbel noise against the log of the importance weight: 1 draws documents by their weights.
TEMPERATURE = 1.0
#: Text bytes of a batch that are handled at once.
CHUNK = 1 << 19
INSIDE = spaced_table()


def _classes() -> np.ndarray:
    """Byte classes: 0 letters (and all above ASCII), 1 capitals, 2 digits, 3 the rest."""
    t = np.full(256, 3, np.uint8)
    t[97:123] = t[128:] = 0
    t[65:91], t[48:58] = 1, 2
    return t


CLASS = _classes()


def ngrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' n-grams, and the n + 1 offsets by text.

    Of each word: itself, its pair with the next one (a repeated word is one pair whatever the
    word), and the pair of their shapes. A shape tells which classes of bytes a word has, in steps
    of none, one and more, and its length up to 15.
    """
    w = split_words(buf, offsets, INSIDE, None)
    n = len(w)
    shape = np.minimum(w.end - w.start, 15).astype(np.uint64)
    cls = CLASS[buf]
    for c in range(4):
        run = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(cls == c, out=run[1:])
        shape = shape * np.uint64(3) + np.minimum(run[w.end] - run[w.start], 2).astype(np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    out = np.empty((n, 3), np.int64)
    follow = np.zeros(n, bool)
    follow[:-1] = text[1:] == text[:-1]
    nxt = np.minimum(np.arange(n) + 1, max(n - 1, 0))
    last = ~follow
    with np.errstate(over="ignore"):
        h2 = np.where(last, np.uint64(1), w.hash[nxt])
        pair = np.where(h2 == w.hash, np.uint64(77), mix(w.hash * np.uint64(3) + h2))
        s2 = np.where(last, np.uint64(0), shape[nxt] + np.uint64(1))
        for k, x in enumerate((w.hash, pair, mix(shape * np.uint64(1 << 20) + s2 + np.uint64(1 << 50)))):
            out[:, k] = (mix(x + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int64)
    return out.ravel(), w.first * 3


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A batch's rows in pieces of about CHUNK bytes: (first row, row after the last, buckets, offsets)."""
    buf, offsets = text_buffer(b.column("text"))
    k = 0
    while k < b.num_rows:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK, side="right")) - 1)
        yield k, stop, *ngrams(buf[offsets[k] : offsets[stop]], offsets[k : stop + 1] - offsets[k])
        k = stop


def _halves(known: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the good documents of the sample, in two halves by a hash of the id."""
    good = np.array(sorted(k for k, q in known.items() if q == 1), np.int64)
    side = (mix(good.view(np.uint64)) & np.uint64(1)).astype(bool)
    return good[~side], good[side]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[int, int]]:
    """Log ratios of target models to the raw model by bucket, and the labelled sample (doc_id -> quality).

    The raw model counts the n-grams of all documents; the target model those of the sample's good
    ones. Three ratios: of the whole sample, and of either half of its good ones, so that no
    document is judged by a model made from it. Each partition sends one vector for each model,
    summed by a shuffle on buckets.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = {r.doc_id: r.quality for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toLocalIterator()}
    halves = _halves(known)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, BUCKETS), np.int64)
        for b in it:
            ids = np.array(b.column("doc_id").fill_null(-(1 << 62)).cast(pa.int64()))
            mine = [np.isin(ids, h) for h in halves]
            for k, stop, grams, at in _pieces(b):
                sums[0] += np.bincount(grams, minlength=BUCKETS)
                for j, some in enumerate(mine):
                    if some[k:stop].any():
                        sums[1 + j] += np.bincount(grams[np.repeat(some[k:stop], np.diff(at))], minlength=BUCKETS)
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), *map(pa.array, sums)], ["bucket", "raw", "one", "two"])

    counts = docs.select("doc_id", "text").mapInArrow(count, "bucket int, raw long, one long, two long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "one", "two")])
    n = np.zeros((3, BUCKETS))
    for r in counts.toLocalIterator():
        n[:, r.bucket] = r.raw, r.one, r.two
    q = (n[0] + 1) / (n[0].sum() + BUCKETS)
    # thin buckets say nothing, nor does a model of no documents
    ratios = [np.log((t + BUCKETS * q) / (t.sum() + BUCKETS) / q) if t.any() else np.zeros(BUCKETS) for t in (n[1] + n[2], n[1], n[2])]
    return np.array(ratios), known


def score(docs: DataFrame, ratios: np.ndarray, known: dict[int, int]) -> DataFrame:
    """(doc_id, th, n_grams, log_weight): the importance weight of each document, in logs; th is a hash of the text.

    Good documents of the sample are judged by the half that they are not in.
    """
    halves = _halves(known)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            ids = np.array(b.column("doc_id").fill_null(-(1 << 62)).cast(pa.int64()))
            other = np.where(np.isin(ids, halves[0]), 2, np.where(np.isin(ids, halves[1]), 1, 0))
            for k, stop, grams, at in _pieces(b):
                n[k:stop] = np.diff(at)
                run = np.concatenate([[0.0], np.cumsum(ratios[0][grams])])
                weight[k:stop] = run[at[1:]] - run[at[:-1]]
                for i in np.flatnonzero(other[k:stop]).tolist():
                    weight[k + i] = ratios[other[k + i]][grams[at[i] : at[i + 1]]].sum()
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("th"), pa.array(n), pa.array(weight)], ["doc_id", "th", "n_grams", "log_weight"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(batches, "doc_id long, th long, n_grams long, log_weight double")


def threshold(pairs: list[tuple[float, int]]) -> float:
    """The log weight that parts good from bad: most correct labels, a lost good document counting double.

    It lies a tenth of the way from the bad weight below it to the good one above: what is unlike all
    that is known to be bad stays. -inf where no bad ones are known, so that all are kept.
    """
    if not any(q == 0 for _, q in pairs):
        return -math.inf
    s, q = np.array([x for x, _ in pairs]), np.array([y for _, y in pairs])
    order = np.argsort(s, kind="stable")
    s, q = s[order], q[order]
    cost = np.concatenate([[0], np.cumsum(2 * (q == 1))]) + np.concatenate([np.cumsum((q == 0)[::-1])[::-1], [0]])
    k = int(np.argmin(cost))
    return float(s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else s[k - 1] + (s[k] - s[k - 1]) / 10)


def gumbel(doc_id: Column) -> Column:
    """Standard Gumbel noise, fixed by the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit("gumbel")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(-F.ln(u))


def kth_largest(keys: DataFrame, k: int, few: int = 10_000) -> float | None:
    """The k-th largest key (double), exactly, by counts alone: 4096 bins of the range, then of the bin it falls in.

    When a bin holds `few` keys, or no double parts its ends from their neighbours (so at most 4096
    values are left), its values are counted on the driver. Nothing is sorted as a whole.
    """
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0 or not n:
        return None
    if k >= n:
        return lo
    while True:
        part, width = keys.where((F.col("key") >= lo) & (F.col("key") <= hi)), (hi - lo) / 4096
        if n <= few or lo + width <= lo:
            groups = part.groupBy(F.col("key").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("n"))
        else:
            groups = part.groupBy(F.least(F.floor((F.col("key") - lo) / width), F.lit(4095)).alias("bin")).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n"))
        for r in sorted(groups.collect(), key=lambda r: -r["a"]):
            if r["n"] >= k:
                lo, hi, n = r["a"], r["b"], r["n"]
                break
            k -= r["n"]
        if lo == hi:
            return lo


def resample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, temperature: float = TEMPERATURE, share: float | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept: documents drawn by importance, without replacement.

    log_weight is the log of target over raw probability of all n-grams of the text, and
    key = log_weight + temperature * Gumbel noise: the k largest keys are a draw without replacement
    by importance weights. k is `share` of the documents. Where no share is given, it is the share
    of documents whose weight is over the threshold that parts the labelled good from bad, so that
    what the draw leaves out is about as much as there is of bad text. Ties at the last key all stay.

    Null, empty and blank texts have no n-grams and a log weight of 0, as texts with no preference
    do; if no good or no bad labels are known and no share is given, all stay. Repeated rows get the
    same key. Other columns are ignored. Empty table: no rows.
    """
    return _drawn(docs, labels, sample, temperature, share).drop("th")


def _drawn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, temperature: float = TEMPERATURE, share: float | None = None) -> DataFrame:
    ratios, known = fit(docs, labels, sample)
    rows = staged(score(docs, ratios, known).withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id")) * temperature), "op4")
    if share is None:
        ids = rows.sparkSession.createDataFrame([(k, q) for k, q in known.items()], "doc_id long, quality int")
        pairs = [(r.log_weight, r.quality) for r in rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("log_weight").alias("log_weight")).toLocalIterator()]
        cut = threshold(pairs) if ratios[0].any() else -math.inf
        k = rows.where(F.col("log_weight") >= cut).count()
    else:
        k = math.floor(rows.count() * share + 0.5)
    last = kth_largest(rows, k)
    return rows.withColumn("kept", F.col("key") >= last if last is not None else F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, broadcast_up_to: int = 500_000) -> DataFrame:
    """docs without the rows that the resampling leaves out; docs' columns only.

    Rows are told apart by doc_id and a hash of the text. Rows without a doc_id stay.
    """
    gone = _drawn(docs, labels).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_q_id"), F.col("th").alias("_q_th")).distinct()
    gone = F.broadcast(gone) if gone.count() <= broadcast_up_to else gone
    return docs.join(gone, (docs["doc_id"] == F.col("_q_id")) & (F.xxhash64(docs["text"]) == F.col("_q_th")), "left_anti").select(*docs.columns)
