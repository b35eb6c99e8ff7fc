"""SimHash fingerprints, links and components against brute force."""

import random
import re

from xxhash import xxh64_intdigest

from pelgrain.llm import simhash as S
from pelgrain.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_contracts():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "One", "one two", "A b\x0bc\x1cd", "ÄÖ ß   x  y z"] + [" ".join(rng.choices("ab cd Ef ğh İ".split(), k=n)) for n in range(1, 200, 7)]
    assert [S.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def near(rng, base, n):
    x = base
    for _ in range(n):
        x ^= 1 << rng.randrange(64)
    return x


def test_links_connect_what_brute_force_does(spark):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for b in list(prints)[:10]:
        prints |= {near(rng, b, rng.randint(1, 5)) for _ in range(8)}
    hot = rng.getrandbits(64)
    prints |= {near(rng, hot, rng.randint(0, 4)) for _ in range(150)}  # one hot group
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    got = {r.node: r.root for r in components(S.links(df)).collect()}
    want = roots(sorted(map(signed, prints)), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {n: got.get(n, n) for n in want} == want
    assert len(set(want.values())) > 20


def test_tallies_count_shared_positional_bytes(spark):
    base = 0x1122334455667788
    prints = {"one bit": base ^ 1, "two bits of a byte": base ^ 3 << 8, "two bytes": base ^ 1 << 16 ^ 1 << 60, "three bits": base ^ 7 << 24, "three bytes": base ^ 1 << 32 ^ 1 << 40 ^ 1 << 48}
    for what, x in prints.items():
        lists = S.postings(spark.createDataFrame([(base,), (x,)], "fp long"))
        assert lists.count() == 2 * len(S.SETS) == 56
        met = lists.groupBy("g", "key").count().where("count = 2").count()
        same = sum(base >> 8 * i & 255 == x >> 8 * i & 255 for i in range(8))
        assert met == {7: 7, 6: 1, 5: 0}[same], what
        got = [tuple(r) for r in S.tallies(lists.join(lists.groupBy("g", "key").count().where("count = 2"), ["g", "key"])).collect()]
        assert got == ([(max(base, x), min(base, x), same)] if (base ^ x).bit_count() <= 2 else []), what


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 180)] + [(0, i) for i in range(1, 50)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 0 for i in range(50)}, 299: 299, 300: 299}


def test_documents_equal_brute_force_and_edge_cases(spark):
    rng = random.Random(4)
    base = " ".join(rng.choices([f"w{i}" for i in range(400)], k=900))
    docs = [(k, base if k % 3 else base.replace("w7 ", "v7 ", 1)) for k in range(10, 30)] + [(k, " ".join(rng.choices("abcdefgh", k=30))) for k in range(30, 50)]
    docs += [(2, None), (3, ""), (4, "  "), (5, "x"), (5, "x"), (None, "x"), (6, base + " end" * 20_000)]
    df = spark.createDataFrame([(*d, "p", 1) for d in docs], "doc_id long, text string, fp string, component_id int")
    got = S.with_contract_columns(S.near_duplicates(df)).collect()
    fp = {d: plain(t) for d, t in docs if d is not None}
    want = roots(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == sorted((d, f"{fp[d]:016x}", want[d]) for d, _ in docs if d is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [5]
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b, c = ("".join(f" {x}{k}" for k in range(50)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, b), (3, c), (None, a), (None, "q"), (None, "q")]
    kept = S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a), (2, b), (3, c), (None, "q")], key=str)
