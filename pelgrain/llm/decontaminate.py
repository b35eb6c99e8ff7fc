"""Benchmark decontamination: an FM-index of each training shard, searched for the benchmark's phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelgrain.llm.common import staged, utf8_bytes
from pelgrain.llm.fm_index import FMIndex
from pelgrain.llm.words import alnum_table, lower_table, runs, split_words, text_buffer

WINDOW = 13
#: Text bytes of a training shard, one index each; a longer text is a shard by itself.
SHARD = 8 << 20
#: Benchmark bytes searched in one pass over the corpus, and so the most windows there are of it; a larger
#: benchmark takes more passes.
PHRASE_BLOCK = 16 << 20
INSIDE, FOLD = alnum_table(), lower_table()


class Phrases:
    """Windows of benchmark items: the items as one sequence of codes over the benchmark's own vocabulary, and where windows start.

    No window is held by itself: what travels is 4 bytes for each word and 12 for each window.
    """

    def __init__(self, ids: list[int | None], texts: pa.Array, window: int = WINDOW) -> None:
        buf, offsets = text_buffer(texts)
        w = split_words(buf, offsets, INSIDE, FOLD)
        self.vocab, one, code = np.unique(w.hash, return_index=True, return_inverse=True)
        self.codes = (code + 1).astype(np.int32)
        start, self.length = w.start[one], w.end[one] - w.start[one]
        self.bytes = FOLD[buf[runs(start, self.length)]]
        self.start = np.cumsum(self.length) - self.length
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.vocab & np.uint64((1 << 20) - 1)] = True
        n = np.diff(w.first)
        count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        self.first = runs(w.first[:-1], count).astype(np.int32)
        self.sizes = np.repeat(np.minimum(n, window), count).astype(np.int32)
        self.owner = np.repeat(np.arange(len(n)), count).astype(np.int32)
        self.ids = ids
        self.shortest = int(self.sizes.min(initial=window))

    def possible(self, present: np.ndarray) -> np.ndarray:
        """Windows all of whose words are present; a flag for each code."""
        missing = np.zeros(len(self.codes) + 1, np.int32)
        np.cumsum(~present[self.codes], out=missing[1:])
        return np.flatnonzero(missing[self.first + self.sizes] == missing[self.first])

    def encode(self, h: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Codes of words, 0 for those the benchmark has not, told by hash and then by their bytes."""
        code = np.zeros(len(h), np.int64)
        if not len(self.vocab):
            return code
        some = np.flatnonzero(self.maybe[h & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.vocab, h[some]), len(self.vocab) - 1)
        same = (self.vocab[at] == h[some]) & (self.length[at] == end[some] - start[some])
        code[some[same]] = at[same] + 1
        return code

    def differ(self, code: np.ndarray, buf: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Words whose bytes are not those of their code."""
        n = self.length[code - 1]
        unequal = FOLD[buf[runs(start, n)]] != self.bytes[runs(self.start[code - 1], n)]
        return np.add.reduceat(unequal, np.cumsum(n) - n) > 0 if len(n) else np.zeros(0, bool)


def scan_shard(buf: np.ndarray, offsets: np.ndarray, p: Phrases) -> tuple[np.ndarray, dict[int, list[list[int]]], dict[int, list[int]], object]:
    """Words of each text; by text, merged hit intervals of word numbers, and items found.

    The index holds the runs of consecutive benchmark words that are as long as the shortest phrase;
    all other words only part them, as no phrase can touch them.
    """
    w = split_words(buf, offsets, INSIDE, FOLD)
    n_words = np.diff(w.first)
    code = p.encode(w.hash, buf, w.start, w.end)
    text = np.repeat(np.arange(len(n_words)), n_words)

    def segments() -> tuple[np.ndarray, np.ndarray]:
        idx = np.flatnonzero(code)
        cut = np.flatnonzero((np.diff(idx) != 1) | (np.diff(text[idx]) != 0)) + 1
        heads = np.concatenate([[0], cut]) if len(idx) else cut
        return idx[heads], np.diff(np.concatenate([heads, [len(idx)]])) if len(idx) else heads

    head, size = segments()
    at = runs(head[size >= p.shortest], size[size >= p.shortest])
    wrong = at[p.differ(code[at], buf, w.start[at])]
    if len(wrong):
        code[wrong] = 0
        head, size = segments()
    head, size = head[size >= p.shortest], size[size >= p.shortest]
    hits: dict[int, list[list[int]]] = {}
    items: dict[int, list[int]] = {}
    if len(head) and len(p.first):
        word = runs(head, size + 1)
        t = np.where(np.isin(np.arange(len(word)), np.cumsum(size + 1) - 1), 0, code[np.minimum(word, len(code) - 1)])
        present = np.zeros(len(p.vocab) + 1, bool)
        present[t] = True
        windows = p.possible(present)
        phrase, place = FMIndex(t).find(p.codes, p.first[windows], p.sizes[windows])
        phrase, first = windows[phrase], word[place]
        mark = np.bincount(first, minlength=len(code) + 1) - np.bincount(first + p.sizes[phrase], minlength=len(code) + 1)
        hit = np.concatenate([[0], np.cumsum(mark)[:-1] > 0, [0]]).astype(np.int8)
        # runs end where texts do
        lo, hi = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            while a < b:
                d = int(text[a])
                e = min(b, int(w.first[d + 1]))
                hits.setdefault(d, []).append([a - int(w.first[d]), e - int(w.first[d])])
                a = e
        pair = np.unique(text[first] * np.int64(len(p.ids)) + p.owner[phrase])
        for d, k in zip((pair // len(p.ids)).tolist(), (pair % len(p.ids)).tolist(), strict=True):
            if p.ids[k] is not None:
                items.setdefault(d, []).append(p.ids[k])
    return n_words, hits, items, w


def merge(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


HIT = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", HIT), T.StructField("items", T.ArrayType(T.LongType())), T.StructField("spans", HIT)])
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("hits", _RUN), ("items", pa.list_(pa.int64())), ("spans", _RUN)])


def _scan(text: pa.Array, old: pa.Array | None, p: Phrases) -> pa.Array:
    buf, offsets = text_buffer(text)
    n_words, hits, items, w = scan_shard(buf, offsets, p)
    before = old.to_pylist() if old is not None else [None] * len(text)
    rows = []
    for k, was in enumerate(before):
        h, i = hits.get(k, []), sorted(set(items.get(k, [])))
        if was:
            h, i = merge([[x["start"], x["end"]] for x in was["hits"]], h), sorted({*was["items"], *i})
        spans = []
        for a, b in h:  # in code points
            f, raw = int(w.first[k]), buf[offsets[k] : offsets[k + 1]].tobytes()
            s, e = int(w.start[f + a] - offsets[k]), int(w.end[f + b - 1] - offsets[k])
            c = len(raw[:s].decode())
            spans.append((c, c + len(raw[s:e].decode())))
        rows.append((int(n_words[k]), [tuple(x) for x in h], i, spans))
    names = ("n_words", "hits", "items", "spans")
    return pa.array([{n: ([{"start": a, "end": b} for a, b in v] if n in ("hits", "spans") else v) for n, v in zip(names, r, strict=True)} for r in rows], _FOUND)


def _pass(df: DataFrame, p: Phrases, column: str, shard: int) -> DataFrame:
    schema = T.StructType([*[f for f in df.schema.fields if f.name != column], T.StructField(column, FOUND)])
    names = [f.name for f in schema.fields[:-1]]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            ends = np.cumsum(np.diff(text_buffer(whole.column("text"))[1]))
            k = 0
            while k < whole.num_rows:
                limit = (ends[k - 1] if k else 0) + shard
                stop = max(k + 1, int(np.searchsorted(ends, limit, side="right")))
                b = whole.slice(k, stop - k)
                found = _scan(b.column("text"), b.column(column) if column in b.schema.names else None, p)
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], found], [*names, column])
                k = stop

    return df.mapInArrow(batches, schema)


def _phrases(items: DataFrame, window: int) -> Phrases:
    t = items.select("item_id", "text").toArrow()
    return Phrases(t.column("item_id").to_pylist(), t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()), window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, column: str = "contamination", window: int = WINDOW, shard: int = SHARD, block: int = PHRASE_BLOCK) -> DataFrame:
    """docs with a struct: n_words, hits (merged intervals of word numbers), items, spans (the hits in code points).

    A window is `window` consecutive words of an item, or the whole of a shorter one. Windows are
    searched backwards through the wavelet ranks of each shard's index, those with a word the shard
    has not excepted; their positions come from sampled suffixes. Only the benchmark travels: its
    size is looked up first, and beyond `block` bytes it is searched in several passes, whose
    intervals are merged. All columns of docs pass through the workers; select few.

    Null or wordless texts: no words, no hits. Null or wordless items hold no window; an item
    without an id marks words but is not listed. Repeated items and rows count once and each.
    An empty benchmark hits nothing. A column named like the struct is replaced.
    """
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = b.agg(F.sum(utf8_bytes(F.col("text")))).first()[0] or 0
    parts = max(1, -(-total // block))
    out = docs.drop(column)
    for k in range(parts):
        mine = b if parts == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        out = _pass(out, _phrases(mine, window), column, shard)
    return out


def _contaminated(c: Column) -> Column:
    n_hit = F.aggregate(c["hits"], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return (n_hit > 0) & (n_hit * 20 >= c["n_words"])


def with_contract_columns(found: DataFrame, column: str = "contamination") -> DataFrame:
    c = F.col(column)
    n_hit = F.aggregate(c["hits"], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform(c["items"], lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        _contaminated(c).alias("contaminated"), c["spans"].alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_up_to: int = 500_000) -> DataFrame:
    """docs without those of which a twentieth of the words or more stand in benchmark windows; docs' columns only.

    Texts alone pass through the workers, with doc_id and a hash of the text to tell rows apart; the
    rows to drop are broadcast if counted to be few, else joined by shuffle.
    """
    found = find_contamination(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), benchmark)
    gone = found.where(_contaminated(F.col("contamination"))).select(F.col("doc_id").alias("_c_id"), F.col("th").alias("_c_th")).distinct()
    gone = staged(gone, "op10-gone")
    gone = F.broadcast(gone) if gone.count() <= broadcast_up_to else gone
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_c_id")) & (F.xxhash64(docs["text"]) == F.col("_c_th")), "left_anti").select(*docs.columns)


ORACLE = """
WITH t AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
low AS (SELECT side, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+|[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS parts FROM t),
part AS (SELECT side, r, id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM low),
put AS (SELECT *, CAST(sum(length(p)) OVER (PARTITION BY side, r ORDER BY i) AS BIGINT) AS fin FROM part),
word AS (SELECT side, r, id, p, fin - length(p) AS start, fin, row_number() OVER (PARTITION BY side, r ORDER BY i) AS n FROM put WHERE regexp_matches(p, '^[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]')),
ahead AS (SELECT *, list(p) OVER (PARTITION BY side, r ORDER BY n ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS w, count(*) OVER (PARTITION BY side, r) AS total FROM word),
win AS (SELECT DISTINCT id AS item, w, len(w) AS size FROM ahead WHERE side = 'b' AND (len(w) = 13 OR (n = 1 AND total < 13))),
occ AS (SELECT a.r, a.n, win.item, win.size FROM ahead a JOIN win ON a.p = win.w[1] AND a.w[1:win.size] = win.w WHERE a.side = 'd'),
hit AS (SELECT DISTINCT r, unnest(range(n, n + size)) AS n FROM occ),
isle AS (SELECT h.r, word.start, word.fin, h.n - row_number() OVER (PARTITION BY h.r ORDER BY h.n) AS g FROM hit h JOIN word ON word.side = 'd' AND word.r = h.r AND word.n = h.n),
span AS (SELECT r, count(*) AS n, min(start) AS a, max(fin) AS b FROM isle GROUP BY r, g),
spans AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_hit, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM span GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item AS VARCHAR) AS item FROM occ WHERE item IS NOT NULL) GROUP BY r),
words AS (SELECT r, count(*) AS n_words FROM word WHERE side = 'd' GROUP BY r)
SELECT low.id AS doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= n_words, false) AS contaminated, coalesce(spans, '') AS spans
FROM low LEFT JOIN words USING (r) LEFT JOIN spans USING (r) LEFT JOIN items USING (r) WHERE low.side = 'd'
"""
