"""Sharding, mixing, line dedup and URL lists on small fixtures, against brute force."""

import hashlib
import math
import random
import re
import zlib
from datetime import date

import pytest
from xxhash import xxh64

from pelgrain.llm import line_dedup, mixing, sharding, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bid(key, shard):
    seed = xxh64((key & (1 << 64) - 1).to_bytes(8, "little"), 42).intdigest()
    h = xxh64(shard.to_bytes(4, "little"), seed).intdigest()
    return 1 / -math.log(((h >> 11) + 0.5) / (1 << 53))


def docs(spark, rows, extra=("size", "shard", "lines", "text_crc32", "gone")):
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)


def test_shards_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-(1 << 40), 1 << 40), "t" * (k % 50) + "é", "s") for k in range(400)] + [(7, None, None), (7, None, None), (8, "", ""), (9, "x" * 300_000, "s")]
    got = sharding.shard_manifest(docs(spark, rows), 24).collect()
    want = sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", max(range(24), key=lambda s: bid(i, s)), max(range(25), key=lambda s: bid(i, s))) for i, t, _ in rows)
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 24) for r in got)


def test_shards_of_nulls_and_of_nothing(spark):
    d = docs(spark, [(None, "a", "s"), (None, None, "s"), (1, "b", None)])
    got = sharding.shard_manifest(d, 3).collect()
    assert len(got) == 3 and len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.shard_manifest(d.limit(0), 3).count() == 0


def test_shards_of_rows_copied_very_often(spark):
    """A third of all rows are one row, another tenth one without an id: slots stay without gaps, in any partitioning."""
    rows = [(7, "hot", "s")] * 400 + [(None, None, "s")] * 120 + [(k, f"t{k}", "s") for k in range(700)] + [(5, "t5", "s")]
    seen = []
    for parts in (1, 5):
        got = sharding.shard_manifest(docs(spark, rows).repartition(parts), 24).collect()
        assert len(got) == len(rows)
        for s in range(24):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        seen.append(sorted(tuple(str(v) for v in r) for r in got))
    assert seen[0] == seen[1]


def test_weights_are_followed(spark):
    n = spark.range(20_000).withColumnRenamed("id", "doc_id")
    got = {r.shard: r["count"] for r in sharding.assign_shards(n, [1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    assert [got[k] / 20_000 for k in range(3)] == pytest.approx([1 / 8, 2 / 8, 5 / 8], abs=0.02)
    with pytest.raises(ValueError):
        sharding.rendezvous(n["doc_id"], [1.0, 0.0])


def targets(sizes):
    """The rule, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        free -= over
    return target


def mix_key(i, t):
    return hashlib.md5(f"mix:{'' if i is None else i}:{'' if t is None else hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()


def plain_mix(rows, shards=16, seed=42):
    """rows (id, text, source) -> by source its target, and for each row (id, size, taken, shards of its copies, key)."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = {}
    for (_, _, s), n in zip(rows, size):
        total[s] = total.get(s, 0) + n
    want = targets(total)
    out, balls = [], []
    for s in total:
        base = math.floor(want[s] / total[s]) if total[s] else 0
        rest = math.floor(want[s] - base * total[s] + 0.5)
        sk, passes = "n" if s is None else f"s{s}", {}
        for key, i, n in sorted(((mix_key(i, t), i, n) for (i, t, x), n in zip(rows, size) if x == s), key=lambda r: r[0]):
            part = min(rest, n)
            rest -= part
            out.append((i, n, base * n + part, sk, key))
            if n:
                passes[key[:3]] = max(passes.get(key[:3], 0), base + (part > 0))
        balls += [(sk, block, e) for block, k in passes.items() for e in range(k)]
    h = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    quota = {}

    def split(lo, hi, mine, level):
        if hi - lo == 1:
            for sk, _, _ in mine:
                quota.setdefault(sk, [0] * shards)[lo] += 1
            return
        mid = (lo + hi) // 2
        mine = sorted(mine, key=lambda b: (h("split", seed, level, *b), b))
        take = len(mine) * (mid - lo) // (hi - lo)
        split(lo, mid, mine[:take], level + 1)
        split(mid, hi, mine[take:], level + 1)

    split(0, shards, balls, 0)
    shard = {}
    for sk, q in quota.items():
        order = sorted((b for b in balls if b[0] == sk), key=lambda b: h("place", seed, *b))
        shard |= dict(zip(order, [k for k, n in enumerate(q) for _ in range(n)], strict=True))
    return want, [(i, n, taken, [shard[sk, key[:3], e] for e in range(math.ceil(taken / n) if n else 0)], key) for i, n, taken, sk, key in out]


def test_mix_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice((0, 3, 40, 900)))), rng.choice(["a", "b", "B", "ä", None, "big", "big", "big"])) for k in range(500)] + [(900, None, "a"), (901, " \n", "none"), (902, "x y", "tiny")]
    d = docs(spark, rows)
    want, plain = plain_mix(rows)
    order = lambda r: str(r[0])
    got = [(r.doc_id, r["size"], r.taken, r.shards, r.order_key) for r in mixing.mix_sources(d).collect()]
    assert sorted(got, key=order) == sorted(plain, key=order)
    assert {s for r in got for s in r[3]} == set(range(16)) and max(len(r[3]) for r in got) == 3
    assert sorted(((r.doc_id, r["size"], r.taken, r.shards, r.order_key) for r in mixing.mix_sources(d.repartition(7)).collect()), key=order) == sorted(got, key=order)
    source = {i: s for i, _, s in rows}
    assert all(r.target == pytest.approx(want[source[r.doc_id]]) for r in mixing.mix_sources(d).collect())
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == {i: n for i, size, taken, *_ in plain if size and (n := math.floor(taken / size + 0.5))}


def test_shards_of_the_mix_are_the_trees(spark):
    """Shards hold as many blocks as whole numbers allow, and each source's quota of them follows the tree alone."""
    rng = random.Random(3)
    rows = [(k, "w " * 5, rng.choice("aab")) for k in range(3000)]
    d = docs(spark, rows)
    for shards in (1, 3, 16):
        got = mixing.mix_sources(d, shards=shards).collect()
        want = {i: s for i, _, _, s, _ in plain_mix(rows, shards)[1]}
        assert {r.doc_id: r.shards for r in got} == want
        blocks = {(rows[r.doc_id][2], r.order_key[:3], e, s) for r in got for e, s in enumerate(r.shards)}
        n = [sum(b[3] == k for b in blocks) for k in range(shards)]
        assert max(n) - min(n) <= 2
    other = {r.doc_id: r.shards for r in mixing.mix_sources(d, seed=7).collect()}
    assert other != want


@pytest.mark.parametrize("case", ["no ids", "one id", "equal rows", "ids that repeat"])
def test_mix_meets_its_target_whatever_the_ids(spark, case):
    rng = random.Random(5)
    text = lambda k: " ".join(rng.choices("abcdefgh", k=rng.randint(1, 30)))
    rows = {
        "no ids": [(None, text(k), "ab"[k % 2]) for k in range(200)],
        "one id": [(7, text(k), "ab"[k % 2]) for k in range(200)],
        "equal rows": [(1, "a b c d e f g", "a")] * 150 + [(k, text(k), "b") for k in range(10, 60)],
        "ids that repeat": [(k % 5, text(k), "abc"[k % 3]) for k in range(200)] * 2,
    }[case]
    d = docs(spark, rows)
    want, plain = plain_mix(rows)
    seen = []
    for parts in (1, 3, 7):
        got = mixing.mix_sources(d.repartition(parts)).collect()
        seen.append(sorted((str(r.doc_id), r["size"], r.taken, r.shards, r.order_key) for r in got))
    assert seen[0] == seen[1] == seen[2] == sorted((str(r[0]), *r[1:]) for r in plain)
    assert sum(r[2] for r in seen[0]) == sum(math.floor(t + 0.5) for t in want.values())
    for s, t in want.items():
        mine = [r for r in rows if r[2] == s]
        assert sum(r[2] for r in seen[0] if (r[0], r[4]) in {(str(i), mix_key(i, x)) for i, x, _ in mine}) >= math.floor(t + 0.5)
    whole = sorted(str(r.text) for r in mixing.mixed_documents(d).collect())
    text_of = {mix_key(i, x): str(x) for i, x, _ in rows}
    assert whole == sorted(t for _, n, taken, _, key in plain for t in [text_of[key]] * (math.floor(taken / n + 0.5) if n else 0))


def test_mix_of_one_source_and_of_nothing(spark):
    d = docs(spark, [(1, "a b c", "s"), (2, "d", "s"), (2, "d", "s"), (None, "e f", "s")])
    assert [(r["size"], r.taken) for r in mixing.mix_sources(d).orderBy("size", "doc_id").collect()] == [(1, 1), (1, 1), (2, 2), (3, 3)]
    assert mixing.mix_sources(d.limit(0)).count() == 0
    assert mixing.mixed_documents(d.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_sources(docs(spark, [(1, None, None), (2, "", "q")])).collect()] == [0, 0]


def test_mix_is_laid_out_by_shard_and_order(spark):
    rng = random.Random(13)
    d = docs(spark, [(k, "w " * rng.randint(1, 40), rng.choice("abc")) for k in range(300)])
    at = {r.doc_id: r for r in mixing.mix_sources(d).collect()}
    rows = [r.doc_id for r in mixing.mixed_documents(d).collect()]
    copies = {i: rows.count(i) for i in set(rows)}
    places = [(s, hashlib.md5(f"{at[i].order_key}:{e}".encode()).hexdigest(), i) for i, n in copies.items() for e, s in enumerate(at[i].shards[:n])]
    assert [p[2] for p in sorted(places)] == rows and len({p[0] for p in places}) == 16


def chunked(text, long_words):
    """Lines, and the chunks as lists of line numbers, with whether each counts."""
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    big = [long_words is not None and len(WORD.findall(x)) > long_words for x in lines]
    out, i = [], 0
    while i < len(lines):
        if big[i]:
            out.append(([i], True))
            i += 1
            continue
        j = i
        while j < len(lines) and not big[j]:
            j += 1
        may = [((h[k - 1] if k > i else 12345) * 31 + h[k] * 17) % 1_000_003 % 2 == 0 for k in range(i, j)]
        cur = []
        for k in range(i, j):
            cur.append(k)
            if k == j - 1 or (k > i and may[k - i] and not may[k - i - 1] and k < j - 2):
                out.append((cur, len(cur) > 1))
                cur = []
        i = j
    return lines, out


def plain_lines(rows, long_words):
    seen, want = set(), {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        if t is None:
            want[i] = (None, 0, 0)
            continue
        lines, parts = chunked(t, long_words)
        gone = set()
        for p, counts in parts:
            piece = "\n".join(lines[k] for k in p)
            if counts:
                if piece in seen:
                    gone |= set(p)
                seen.add(piece)
        want[i] = (t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return want


def line_rows():
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.choice((1, 4, 9, 60))))
    shared = [[line() for _ in range(8)] for _ in range(3)] + [[line() + " end" * 55]]
    rows = [(k, "\n".join([line() for _ in range(rng.randint(0, 5))] + rng.choice(shared) + [line() for _ in range(rng.randint(0, 5))]), "s") for k in range(60)]
    return rows + [(100, None, "s"), (101, "", "s"), (102, "\n\n\n", "s"), (103, rows[5][1], "s"), (104, rows[5][1], None), (105, "x\n" * 40_000, "s"), *[(200 + k, "a\nb\nc", "s") for k in range(5)]]


@pytest.mark.parametrize("long_words", [None, 50])
def test_line_chunks_equal_brute_force(spark, long_words):
    rows = line_rows()
    want = plain_lines(rows, long_words)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs(spark, rows), long_words=long_words).collect()}
    assert got == want and sum(n for *_, n in want.values()) > 100
    assert want[202] == ("", 3, 3) and (long_words or want[104][0] == "")
    assert line_dedup.dedup_lines(docs(spark, rows).limit(0)).count() == 0


def test_line_chunks_are_told_by_their_bytes(spark, monkeypatch):
    """With a key that says nothing, the texts decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "_key", lambda piece: F.length(piece).cast("long") % 2)
    rows = [r for r in line_rows() if r[0] != 105]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs(spark, rows), long_words=50).collect()}
    assert got == plain_lines(rows, 50)


def test_line_chunks_resist_shifts(spark):
    """A line put in front moves no boundary but the first ones; a hot passage goes from all documents but one."""
    rng = random.Random(6)
    passage = [f"{k} {rng.random()}" for k in range(40)]
    rows = [(k, "\n".join([f"own {k} {j}" for j in range(k % 7)] + passage), "s") for k in range(300)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[0] == 0 and all(n >= 34 for i, n in got.items() if i)


def test_line_chunks_of_repeated_rows_and_null_ids(spark):
    t = "\n".join(f"a line of some length number {k}" for k in range(12))
    got = line_dedup.dedup_lines(docs(spark, [(1, t, "s"), (1, t, "s"), (2, t, "s"), (None, "q", "s"), (None, "q", "s")])).collect()
    by = {i: [(r.text, r.n_removed) for r in got if r.doc_id == i] for i in (1, 2, None)}
    assert len(got) == 5 and all(n == 0 for _, n in by[1] + by[None]) and by[2][0][1] == 12


def test_url_lists_equal_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.b.c", "b.c", "x.b.c", "q.org", "deep.er.a.b.c", ""]
    day = lambda: rng.randint(100, 130)
    entries = [(rng.choice(["a.b.c", "b.c", "q.org", "c"]), day(), rng.choice(["add", "remove", "nonsense"]), rng.choice(["ads", "spam", None])) for _ in range(60)] + [(None, 5, "add", "x"), ("b.c", None, "add", "x")]
    caps = [(k, rng.choice(hosts), rng.choice([None, *[day() for _ in range(9)]])) for k in range(300)] + [(5, "b.c", 110), (5, "b.c", 110)]
    e = spark.createDataFrame(entries, "domain string, day int, action string, category string")
    c = spark.createDataFrame([(*x, "z") for x in caps], "page_id long, host string, day int, domain string").drop("domain")
    state = {}
    for d, when, action, cat in entries:
        if d is not None and when is not None and action in ("add", "remove"):
            days = state.setdefault((d, cat or ""), {})
            days[when] = max(days.get(when, ""), action)
    want = []
    for i, h, when in caps:
        live = []
        if when is not None and h:
            parts = h.split(".")
            for k in range(len(parts)):
                for (d, cat), days in state.items():
                    before = [x for x in days if x <= when]
                    if d == ".".join(parts[k:]) and before and days[max(before)] == "add":
                        live.append((-len(d), d, cat))
        best = min(live, default=(0, None, None))
        want.append((i, h, when, len(live), best[1], best[2], bool(live)))
    got = [tuple(r) for r in url_filter.filter_captures(c, e).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[-1] for w in want)
    assert url_filter.filter_captures(c.limit(0), e).count() == 0
    assert not any(r.blocked for r in url_filter.filter_captures(c, e.limit(0)).collect())


def test_url_lists_know_hosts_of_many_labels(spark):
    host = ".".join(f"l{k}" for k in range(12)) + ".example.org"
    parent = host.split(".", 3)[3]
    c = spark.createDataFrame([(1, host, 10), (2, "x." + host, 10), (3, "y" + parent, 10)], "page_id long, host string, day int")
    e = spark.createDataFrame([(host, 5, "add", "ads"), (parent, 5, "add", "spam"), ("example.org", 5, "add", "all")], "domain string, day int, action string, category string")
    got = {r.page_id: (r.n_active, r.domain, r.category) for r in url_filter.filter_captures(c, e).collect()}
    assert got == {1: (3, host, "ads"), 2: (3, host, "ads"), 3: (1, "example.org", "all")}


def test_hosts_and_capture_days(spark):
    urls = ["HTTPS://User:pw@WWW.Example.org.:8080/a?b#c", "http://a.b", "ftp://x.y/z", "no url", "", None, "http://[::1]/"]
    p = spark.createDataFrame([(k, u, "<p>", 3) for k, u in enumerate(urls)] + [(None, "http://a.b", "", 1)], "page_id long, url string, html string, day int")
    got = {r.page_id: (r.host, r.day) for r in url_filter.captures_of(p).collect()}
    first = (date(2024, 1, 1) - date(1970, 1, 1)).days
    assert got[0] == ("www.example.org", first) and got[1] == ("a.b", first + 1) and got[2][0] == "x.y" and got[3][0] == got[4][0] == got[5][0] == "" and got[None] == ("a.b", None)
    assert url_filter.entries_of(url_filter.captures_of(p)).columns == ["domain", "category", "day", "action"]
