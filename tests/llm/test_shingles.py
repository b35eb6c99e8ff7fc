"""Near copies by five-word shingles against brute force."""

import random

import numpy as np
import pyarrow as pa

from test_simhash import WORD, plain, roots

import corpus_pipeline as P
from pelgrain.llm import shingles as S
from pelgrain.llm import simhash


def plain_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def corpus():
    rng = random.Random(21)
    word = lambda: rng.choice("ka Lo mi né po ru".split()) + rng.choice("ra se ti vo na".split())
    docs, k = [], 0
    line = " ".join(word() for _ in range(12))
    for _ in range(14):
        base = [word() for _ in range(rng.choice((4, 9, 60, 300)))]
        for changes in (0, 0, 1, 2, 4, 8, 16):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(len(w))] = word() + "x"
            docs.append((k, " ".join(w) + ("\n" + line if changes % 3 == 0 else "")))
            k += 1
    base = [word() for _ in range(100)]
    for _ in range(60):  # one large group, some of whose members are not similar to each other
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(100)] = word() + "y"
        docs.append((k, " ".join(w)))
        k += 1
    return docs + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one")]


def test_similar_texts_are_linked_and_verified(spark):
    docs = corpus()
    fp, sets = {i: plain(t) for i, t in docs}, {i: plain_set(t) for i, t in docs}
    bits = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2
    want = roots(sorted(fp), lambda a, b: bits(a, b) or similar(sets[a], sets[b]))
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, sig string")
    got = {r.doc_id: r.component_id for r in simhash.near_or_similar(df).collect()}
    assert got == want
    kept = P.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert len(set(want.values())) < len(set(roots(sorted(fp), bits).values()))
    assert simhash.near_or_similar(df.limit(0)).count() == 0


def test_links_are_similar_and_connect_all(spark):
    docs = corpus()
    sets = {i: plain_set(t) for i, t in docs}
    want = roots([i for i, _ in docs], lambda a, b: similar(sets[a], sets[b]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = simhash.staged(S.signatures(df.selectExpr("doc_id", "text", "xxhash64(text) as th")), "test")
    names = {r.doc_id: r.sig for r in rows.collect()}
    first = {}
    for i, s in names.items():
        first.setdefault(s, i)
    links = [(first[r.u], first[r.v]) for r in S.similar_sets(rows, df).collect()]
    assert all(similar(sets[a], sets[b]) for a, b in links)
    linked = {frozenset(x) for x in links} | {frozenset((i, first[s])) for i, s in names.items() if s is not None}
    assert roots([i for i, _ in docs], lambda a, b: frozenset((a, b)) in linked) == want


def test_bands_and_marks_meet_at_the_stated_similarity(spark):
    """Pairs of Jaccard 0.8 share about 13 bands of 40 and never none; unlike ones hardly any."""
    rng = np.random.default_rng(5)
    for n, changed, least, most, unlike in ((450, 50, 10, 17, 96), (450, 450, 0, 0.5, 480)):  # 400 of 500 in common; none
        met, far = [], []
        for _ in range(150):
            x = rng.integers(0, 1 << 63, n + changed).astype(np.uint64)
            h = np.concatenate([x[:n], x[changed:]])
            (a, b), (p, q) = S.band_keys(h, np.array([0, n, 2 * n]))
            met.append(int((a == b).sum()))
            far.append(sum(((int(x) ^ int(y)) >> 4 * k & 15) > 0 for x, y in zip(p, q) for k in range(16)))
        assert least <= np.mean(met) <= most and (min(met) > 0 or not least)
        assert abs(np.mean(far) - unlike) < 4 and (max(far) <= S.MOST_UNLIKE) == bool(least)
    df = spark.createDataFrame([([int(x) for x in p.view(np.int64)], [int(x) for x in q.view(np.int64)])], "p array<long>, q array<long>")
    assert df.select(S.unlike(df["p"], df["q"])).first()[0] == far[-1]


def test_planes_tell_the_same_differences_in_a_smaller_expression(spark):
    rng = np.random.default_rng(9)
    p = rng.integers(0, 1 << 63, (40, S.MARKS)).astype(np.uint64)
    q = np.where(rng.random(p.shape) < 0.5, p, p ^ (np.uint64(1) << rng.integers(0, 64, p.shape).astype(np.uint64)))
    as_lists = lambda x: x.view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(*map(as_lists, (p, q, S.planes(p), S.planes(q))), strict=True)), "p array<long>, q array<long>, a array<long>, b array<long>")
    rows = df.select(S.unlike(df["p"], df["q"]).alias("u"), S.differing(df["a"], df["b"]).alias("d")).collect()
    assert [r.u for r in rows] == [r.d for r in rows] and len({r.u for r in rows}) > 5
    size = lambda c: len(c._jc.toString())
    assert size(S.differing(df["a"], df["b"])) * 3 < size(S.unlike(df["p"], df["q"]))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    (_, marks) = S.band_keys(*S.hashes(*S.text_buffer(pa.array(["a b c d e f"]))))
    got = {r.doc_id: r.marks for r in S.signatures(docs).collect()}
    assert got == {1: as_lists(S.planes(marks))[0], 2: []}
