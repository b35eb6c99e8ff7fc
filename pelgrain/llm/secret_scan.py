"""Secret scan: fixed patterns, and a battery of randomness tests for what they do not name."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelgrain.llm.common import staged

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Tokens of a run: '=' only ends them, as padding at the end of the run. Where a token has symbols of both
#: base64 alphabets, its parts without the one pair and those without the other are tested.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")
PARTS = (re.compile(r"[A-Za-z0-9+/]{20,}=*"), re.compile(r"[A-Za-z0-9_-]{20,}=*"))
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Encodings, narrowest first: name and alphabet in the order of its values.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", DIGITS + LOWER[:6]),
    ("HEX", DIGITS + UPPER[:6]),
    ("base32", UPPER + "234567"),
    ("lower36", DIGITS + LOWER),
    ("upper36", DIGITS + UPPER),
    ("alnum62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("url64", UPPER + LOWER + DIGITS + "-_"),
)
def _values(alphabet: str) -> np.ndarray:
    """Values of an alphabet's symbols by byte."""
    out = np.zeros(256, np.uint8)
    out[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))
    return out


VALUES = [_values(a) for _, a in ENCODINGS]
SETS = [frozenset(a) for _, a in ENCODINGS]
#: Level at which a token's randomness is rejected, and the false-discovery rate among tokens.
LEVEL, FDR = 0.01, 0.01
#: Tokens compete in bands of length, each with its own control.
BANDS = (20, 28, 40, 64, 128)
#: Symbols of a token that are multiplied at once.
CHUNK = 1 << 20
#: p-values are counted in bins of 10**(-k / BINS).
BINS, LEAST_P = 20, 300


def _upper(z: float) -> float:
    """P(Z >= z) of a standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[int, int, float, float] | None:
    """(encoding, length, chi-squared of uniformity, p): how well a token passes for random; None for mere digits.

    p is the least of three p-values, times three: symbol counts against a uniform alphabet, runs
    above and below the middle of the alphabet, and the correlation of neighbours.
    """
    token = token.rstrip("=")
    seen = set(token)
    enc = next((k for k, s in enumerate(SETS) if seen <= s), None)
    if enc is None or len(token) < 20 or seen <= set(DIGITS):
        return None
    size, n = len(ENCODINGS[enc][1]), len(token)
    v = VALUES[enc][np.frombuffer(token.encode(), np.uint8)]  # a byte for each symbol, however long the token
    counts = np.bincount(v, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    ps = [_upper((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))]
    high = v >= size / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        ps.append(2 * _upper(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        ps.append(0.0)
    # sums of whole numbers: n times the variance and the covariance of neighbours
    sum_, squares = int((counts * np.arange(size)).sum()), int((counts * np.arange(size) ** 2).sum())
    pairs = ((v[k : min(k + CHUNK, n - 1)], v[k + 1 : k + CHUNK + 1]) for k in range(0, n - 1, CHUNK))
    next_ = sum(int(np.dot(x.astype(np.int64), y.astype(np.int64))) for x, y in pairs)
    spread = squares - sum_ * sum_ / n
    if spread > 0:
        m = sum_ / n
        along = next_ - m * (2 * sum_ - int(v[0]) - int(v[-1])) + (n - 1) * m * m
        ps.append(2 * _upper(abs(along / spread + 1 / n) * math.sqrt(n)))
    else:
        ps.append(0.0)
    return enc, n, chi, min(1.0, 3 * min(ps))


def tokens_of(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of the tokens of a run, in order."""
    out = []
    for m in TOKEN.finditer(text, a, b):
        t = m.group()
        if ("+" in t or "/" in t) and ("-" in t or "_" in t):
            out += sorted({x.span() for p in PARTS for x in p.finditer(text, *m.span())})
        else:
            out.append(m.span())
    return out


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, float, float]]]:
    """Base spans (start, kind, end) in order, and tokens (start, end, encoding, length, chi-squared, p) that touch none.

    Runs of the wide alphabet hold every match of access and hex, so those are looked for there.
    """
    low = text.lower()
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if any(x in low for x in NAMES) else []
    found = [m.span() for m in RUN.finditer(text)]
    for a, b in found:
        base += [(m.start(), k, m.end()) for k, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text, a, b)]
    base.sort()
    tokens, starts, reach = [], [x for x, *_ in base], [0, *accumulate((y for *_, y in base), max)]
    for run in found:
        for a, b in tokens_of(text, *run):
            if reach[bisect_left(starts, b)] <= a and (t := battery(text[a:b])):
                tokens.append((a, b, *t))
    return base, tokens


SCANNED = "doc_id long, base array<struct<start:int,kind:int,end:int>>, tokens array<struct<start:int,end:int,enc:int,n:int,chi:double,p:double>>, bytes array<long>"
_BASE = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end")]))
_TOKENS = pa.list_(pa.struct([*[(n, pa.int32()) for n in ("start", "end", "enc", "n")], ("chi", pa.float64()), ("p", pa.float64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("base", _BASE), ("tokens", _TOKENS), ("bytes", pa.list_(pa.int64()))])


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(256, np.int64)
    for batch in it:
        for lo in range(0, batch.num_rows, 1000):
            b = batch.slice(lo, 1000)
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = t.as_py() or ""
                counts += np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
                base, tokens = scan_text(text)
                rows.append({
                    "doc_id": i, "base": [dict(zip(("start", "kind", "end"), x, strict=True)) for x in base],
                    "tokens": [dict(zip(("start", "end", "enc", "n", "chi", "p"), x, strict=True)) for x in tokens], "bytes": None,
                })
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
    # one more row: the partition's byte counts
    yield pa.RecordBatch.from_pylist([{"doc_id": None, "base": None, "tokens": None, "bytes": counts.tolist()}], schema=_SCHEMA)


def _natural(rows: DataFrame) -> list[tuple[float, float, float]]:
    """By encoding: alphabet size, sum of q (1 - q), sum of (q - 1/A)**2, q the share of each symbol in the corpus."""
    total = rows.where("bytes is not null").select(F.posexplode("bytes").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n"))
    counts = np.zeros(256)
    for r in total.collect():
        counts[r.b] = r.n
    out = []
    for _, alphabet in ENCODINGS:
        c = counts[[ord(x) for x in alphabet]] + 1
        q = c / c.sum()
        out.append((float(len(alphabet)), float((q * (1 - q)).sum()), float(((q - 1 / len(alphabet)) ** 2).sum())))
    return out


def _null_exponent(t: Column, natural: list[tuple[float, float, float]]) -> Column:
    """Bin of a token's p-value if it were ordinary text: how seldom text of that length looks as uniform.

    The statistic of n symbols drawn with the corpus's shares has mean A (s + n k) and variance
    about 2 (A - 1 + 2 A n k). A normal tail bound, exp(-z**2 / 2), keeps the p-value from below.
    """
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in natural]), t["enc"] + 1)
    size, s, k = pick(0), pick(1), pick(2)
    z = (size * (s + t["n"] * k) - t["chi"]) / F.sqrt((size - 1 + size * k * t["n"] * 2) * 2)
    return F.when(z > 0, F.least(F.floor(z * z / 2 / math.log(10) * BINS), F.lit(LEAST_P * BINS))).otherwise(0).cast("int")


def _band(n: Column) -> Column:
    out = F.lit(0)
    for b in BANDS[1:]:
        out = out + (n >= b).cast("int")
    return out


def _cuts(tokens: DataFrame) -> list[int]:
    """Benjamini-Hochberg by band: the least bin from which tokens are discoveries. Counts by bin are all it takes."""
    cuts = [LEAST_P * BINS + 1] * len(BANDS)
    bins: dict[int, list[tuple[int, int]]] = {}
    for r in tokens.groupBy("band", "bin").agg(F.count("*").alias("n")).toLocalIterator():
        bins.setdefault(r.band, []).append((r.bin, r.n))
    for band, found in bins.items():
        m, rank = sum(n for _, n in found), 0
        for b, n in sorted(found, reverse=True):
            rank += n
            if 10 ** (-b / BINS) <= FDR * rank / m:
                cuts[band] = b
    return cuts


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (start, kind, end, name, base), in code points, end exclusive, by start and kind.

    Base kinds are the fixed patterns. A token of 20 or more symbols of base64 alphabets (a run, or
    its parts at '=' and, if it mixes both alphabets, at the symbols of either) that touches no
    base span is `random` if its battery does not reject randomness at LEVEL, and if it is a
    discovery against ordinary text at rate FDR within its band of length. Symbol shares and the
    control cover all documents; the driver sees byte counts and bins of p-values alone.

    Null text is empty. Rows repeat as they come; other columns are ignored; an empty table gives
    no rows. Whole texts are scanned.
    """
    rows = staged(docs.select("doc_id", "text").mapInArrow(_scan, SCANNED), "op8")
    natural = _natural(rows)
    docs_ = rows.where("bytes is null")
    marked = docs_.withColumn("tokens", F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["p"].alias("p"), _band(t["n"]).alias("band"), _null_exponent(t, natural).alias("bin"))))
    cuts = _cuts(marked.select(F.explode("tokens").alias("t")).select("t.band", "t.bin"))
    cut = F.array(*[F.lit(c) for c in cuts])
    span = lambda start, kind, end: F.struct(start.alias("start"), kind.cast("int").alias("kind"), end.alias("end"))
    more = F.transform(F.filter("tokens", lambda t: (t["p"] > LEVEL) & (t["bin"] >= F.element_at(cut, t["band"] + 1))), lambda t: span(t["start"], F.lit(3), t["end"]))
    both = F.array_sort(F.concat(F.transform("base", lambda b: span(b["start"], b["kind"], b["end"])), more))
    names = F.array(*[F.lit(k) for k in KINDS])
    return marked.select("doc_id", F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("name"), (s["kind"] < 3).alias("base"))).alias("spans"))


def with_contract_columns(found: DataFrame) -> DataFrame:
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
