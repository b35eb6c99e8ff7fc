"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from pelgrain.llm import decontaminate as D
from pelgrain.llm.fm_index import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, contamination string, n_words long, spans string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    owners = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[k : k + window]), set()).update(() if i is None else (i,))
    sizes = sorted({len(x) for x in owners})
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in owners:
                    hit |= set(range(k, k + n))
                    found |= owners[x]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, "x", 1, None) for x in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = D.with_contract_columns(D.find_contamination(d, b, **options)).collect()
    return sorted((tuple(r)[:6] for r in rows), key=str), rows


def test_suffix_order_is_the_order_of_suffixes():
    rng = np.random.default_rng(1)
    for high in (2, 3, 50, 5000):
        t = rng.integers(0, high, 400)
        t[-1] = 0
        ends = [int(np.flatnonzero(t[i:] == 0)[0]) + i for i in range(400)]
        assert suffix_order(t).tolist() == sorted(range(400), key=lambda i: (t[i : ends[i]].tolist() + [-1], i))


@pytest.mark.parametrize("high", [3, 60])
def test_index_finds_every_occurrence(high):
    rng = np.random.default_rng(high)
    t = rng.integers(0, high, 3000)
    t[-1] = 0
    codes = rng.integers(1, high + 1, 60).astype(np.int32)
    start, size = rng.integers(0, 56, 40), rng.integers(1, 5, 40)
    got = sorted(zip(*(x.tolist() for x in FMIndex(t, sample=7).find(codes, start, size)), strict=True))
    want = [(k, i) for k, (a, n) in enumerate(zip(start, size, strict=True)) for i in range(len(t)) if codes[a : a + n].tolist() == t[i : i + n].tolist()]
    assert got == sorted(want)


def test_random_corpus_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = ["the", "of", "Is", "ünd", "b2", "naïve", "q"]
    sent = lambda n, v=vocab: " ".join(rng.choice(v) + rng.choice(["", ".", ",\n"]) for _ in range(n))
    items = [(k, sent(rng.randint(0, 30))) for k in range(30)] + [(7, "extra words here"), (None, "orphan item"), (40, None), (41, "...")]
    docs = [(k, sent(rng.randint(0, 200)) + (rng.choice(items)[1] or "") + sent(20, vocab + list("xyz"))) for k in range(60)]
    docs += [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1]), (None, items[4][1]), (903, "orphan item " + "z " * 30)]
    want = brute(docs, items)
    assert run(spark, docs, items)[0] == want
    assert run(spark, docs, items, shard=300)[0] == want
    assert run(spark, docs, items, block=400)[0] == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_spans_are_code_points_of_the_hits(spark):
    item = " ".join(f"wörd{i}" for i in range(13))
    text = "é head, " + item + "! tail"
    rows = run(spark, [(1, text)], [(5, item)])[1]
    (s,) = rows[0]["spans"]
    assert text[s["start"] : s["end"]] == item


def test_empty_tables_and_filter(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s")], "doc_id long, text string, _contamination string")
    assert D.decontaminate(docs, none).count() == 2
    assert D.decontaminate(docs.limit(0), none).count() == 0
    item = spark.createDataFrame([(1, "B! c")], "item_id long, text string")
    more = docs.unionByName(spark.createDataFrame([(1, "q", "a column of that name stays"), (None, "b c", "s"), (None, "x", "t")], docs.schema))
    kept = D.decontaminate(more, item)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(2, None, "s"), (1, "q", "a column of that name stays"), (None, "x", "t")], key=str)


def test_windows_travel_as_arrays():
    """A megabyte of benchmark text stays a few megabytes, and takes little to make."""
    import pickle
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(7)
    texts = pa.array([" ".join(rng.choices([f"w{k}" for k in range(20_000)], k=60)) for _ in range(3000)])
    tracemalloc.start()
    p = D.Phrases(list(range(3000)), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = texts.nbytes
    assert len(p.first) == 3000 * 48 and peak < 60 * size and len(pickle.dumps(p)) < 6 * size


def test_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    text = ("filler text " * 200_000) + item + (" w1" * 50_000)
    assert run(spark, [(1, text)], [(3, item)])[0] == brute([(1, text)], [(3, item)])
