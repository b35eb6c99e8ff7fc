"""Line dedup on content-defined chunks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelgrain.llm.common import WORD, join_counted, key_filter, may_have, staged

#: Of the rolling hashes, one in so many may set a boundary.
DIVISOR = 2
#: Words over which a line is a passage by itself, for the registered query; the operator has this off.
LONG = 50
#: Stands for the line before the first one.
START = 12345


def _chunks(docs: DataFrame, divisor: int, long_words: int | None) -> DataFrame:
    """docs -> doc_id, th (hash of the text), lines, big, ends: the last line of each chunk, from 1.

    The rolling hash of a line and its predecessor, over line hashes, may set a boundary after the
    line. It does where that of the line before does not, so that no chunk has one line alone, and
    not before the last line. Boundaries depend on three lines and the next, so text inserted
    elsewhere doesn't shift them. A line of more than long_words words is a chunk of its own; the
    lines between two of those are chunked like a text.
    """
    code = lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long")
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines")).where("lines is not null")
    if long_words is None:
        big = F.transform("lines", lambda x: F.lit(False))
    else:  # a word and its space are two characters at least
        big = F.transform("lines", lambda x: F.when(F.length(x) > 2 * long_words, F.regexp_count(x, F.lit(WORD)) > long_words).otherwise(False))
    d = d.withColumn("h", F.transform("lines", code)).withColumn("big", big)
    n = F.size("lines")
    at = lambda a, i: F.element_at(F.col(a), F.greatest(F.lit(1), F.least(i, n)))
    first = lambda i: (i == 1) | at("big", i - 1)
    last = lambda i: (i == n) | at("big", i + 1)
    rolling = F.transform("h", lambda h, k: (F.when(first(k + 1), F.lit(START)).otherwise(at("h", k)) * 31 + h * 17) % 1_000_003 % divisor == 0)
    d = d.withColumn("may", rolling)
    inner = lambda i: ~first(i) & at("may", i) & ~at("may", i - 1) & ~last(i + 1)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: at("big", i) | last(i) | inner(i))
    return d.withColumn("ends", ends)


def _pieces(chunks: DataFrame) -> DataFrame:
    """Chunks that count: doc_id, th, start, n, ch and len (the key of its text), piece."""
    e = F.col("ends")
    start = lambda k: F.when(k == 0, 1).otherwise(F.element_at(e, F.greatest(k, F.lit(1))) + 1)
    parts = F.transform(e, lambda x, k: F.struct(start(k).alias("start"), (x - start(k) + 1).alias("n"), F.array_join(F.slice("lines", start(k), x - start(k) + 1), "\n").alias("piece"), F.element_at(F.col("big"), x).alias("big")))
    p = chunks.select("doc_id", "th", F.explode(F.filter(parts, lambda p: (p["n"] > 1) | p["big"])).alias("p")).select("doc_id", "th", "p.start", "p.n", "p.piece")
    return p.select("doc_id", "th", "start", "n", _key(F.col("piece")).alias("ch"), F.length("piece").alias("len"), "piece")


def _key(piece: Column) -> Column:
    return F.xxhash64(piece)


def _occurrence() -> Column:
    """What orders occurrences: document id (null first), hash of the text, line."""
    return F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "th", "start", "doc_id")


def _late(marks: DataFrame, many: DataFrame, on: list[str], total: int) -> DataFrame:
    """Occurrences other than the first one."""
    both = join_counted(marks, many, on, "c", total)
    same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th")) & (F.col("start") == F.col("f.start"))
    return both.where(~same).select(F.col("doc_id").alias("o"), F.col("th").alias("oh"), "start", "n")


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, long_words: int | None = None) -> DataFrame:
    """doc_id, text without chunks that occur earlier, n_lines, n_removed (lines).

    Chunks of two lines and more count, whatever their length; with `long_words` also single lines
    of more words. A chunk's first occurrence, by (doc_id, hash of the text, line), stays.
    Occurrences are found by hash on narrow rows. The texts of chunks that may repeat are then
    compared byte by byte: the least and the greatest text of a hash must be one and the same, for
    which each task sends two texts at most, however hot the chunk. Should a hash stand for several
    texts, those are grouped by the texts themselves.

    A single line is never a chunk, nor is a document of one line. Null text: null, 0 lines. Empty
    text: one empty line. Rows equal in doc_id and text count as one document and get one result
    each. Other columns are ignored. Empty table: no rows.
    """
    found = _chunks(docs, divisor, long_words)
    marks = staged(_pieces(found).drop("piece"), "op3")
    many = marks.groupBy("ch", "len").agg(F.count("*").alias("c"), F.min(_occurrence()).alias("f")).where("c > 1")
    many = staged(many, "op3-many")
    # a second scan, of which only chunks that may repeat are compared
    texts = may_have(_pieces(found), F.col("ch"), key_filter(many, "ch"), "may").where("may")
    unlike = texts.groupBy("ch", "len").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).where("a <> b").select("ch", "len", F.lit(True).alias("unlike"))
    unlike = staged(unlike, "op3-unlike")
    total = marks.count()
    if unlike.limit(1).count():
        pieces = staged(texts.drop("may").join(unlike, ["ch", "len"]).drop("unlike"), "op3-texts")
        told = pieces.groupBy("ch", "len", "piece").agg(F.count("*").alias("c"), F.min(_occurrence()).alias("f")).where("c > 1")
        late = _late(marks, many.join(unlike, ["ch", "len"], "left_anti"), ["ch", "len"], total).unionAll(_late(pieces, told, ["ch", "len", "piece"], total))
    else:
        late = _late(marks, many, ["ch", "len"], total)
    late = staged(late.distinct(), "op3-late")
    gone = late.groupBy("o", "oh").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    # documents that lose nothing are never shuffled
    marked = may_have(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), F.col("th"), key_filter(late, "oh"), "may")
    n_lines = F.greatest(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines")
    whole = marked.where("not may").select("doc_id", "text", n_lines, F.lit(0).cast("long").alias("n_removed"))
    out = marked.where("may").join(gone, F.col("doc_id").eqNullSafe(F.col("o")) & (F.col("th") == F.col("oh")), "left")
    out = out.select("doc_id", "text", F.split("text", "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<struct<start:int,n:int>>")).alias("gone"))
    out = out.withColumn("drop", F.flatten(F.transform("gone", lambda g: F.sequence(g["start"], g["start"] + g["n"] - 1))))
    left = F.transform(F.array_except(F.sequence(F.lit(1), F.size("lines")), F.col("drop")), lambda i: F.element_at("lines", i))
    kept = F.when(F.size("drop") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return whole.unionAll(out.select("doc_id", kept.alias("text"), F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_removed")))


ORACLE = f"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || md5(line)[1:7] AS BIGINT) AS h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > {LONG} AS big FROM l),
b AS (SELECT *, coalesce(lag(big) OVER w, true) AS head, coalesce(lead(big) OVER w, true) AS tail, lag(h) OVER w AS p FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT *, (CASE WHEN head THEN {START} ELSE p END * 31 + h * 17) % 1000003 % {DIVISOR} = 0 AS may FROM b),
e AS (SELECT *, (big OR tail OR (NOT head AND may AND NOT lag(may) OVER w AND NOT lead(tail) OVER w))::INT AS e FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(e) OVER (PARTITION BY doc_id ORDER BY i) - e AS g FROM e),
c AS (SELECT doc_id, g, count(*) AS n, bool_or(big) AS big, string_agg(line, chr(10) ORDER BY i) AS piece FROM g GROUP BY doc_id, g),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY piece ORDER BY doc_id, g) AS rn FROM c WHERE n > 1 OR big),
k AS (SELECT g.doc_id, g.i, g.line, coalesce(r.rn, 1) = 1 AS keep FROM g LEFT JOIN r ON r.doc_id = g.doc_id AND r.g = g.g),
o AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (keep) AS t, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_removed FROM k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN o.n_removed = 0 THEN d.text ELSE coalesce(o.t, '') END AS text, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id
"""
