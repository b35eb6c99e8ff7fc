"""The corpus pipeline against a brute-force version of its stages."""

import math
import random

import pytest
from test_decontaminate import brute
from test_models import plain_resample
from test_native import bid, plain_mix
from test_simhash import plain, roots

import corpus_pipeline as P


def junk(rng):
    return " ".join([rng.choice("abc def ghi jkl".split()).upper() + "!!"] * rng.randint(20, 60))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = [a + b for a in "ka lo mi ne po ru".split() for b in "ra se ti vo na".split()]
    prose = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ".", ","]) for _ in range(n))
    items = [(k, prose(24)) for k in range(6)]
    docs = []
    for k in range(160):
        kind = k % 8
        t = junk(rng) if kind == 0 else docs[k - 5][1] if kind == 5 else prose(30) + " " + items[k % 6][1] + " " + prose(20) if kind == 6 else prose(rng.randint(40, 400))
        docs.append((k, t, "en", f"src{k % 4}" if k % 9 else None, len(t)))
    docs += [(300, None, None, "src1", None), (301, "", "en", "src2", 0), (302, docs[1][1] + " end.", "en", "src0", 5)]
    labels = [(k, int(k % 8 != 0), 0) for k in range(160) if k % 8 in (0, 1, 2, 3)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, labels, items


def expected(docs, labels, items):
    """doc_id -> copies, stage by stage."""
    text, source = {d[0]: d[1] for d in docs}, {d[0]: d[3] for d in docs}
    good = [i for i, *_, kept in plain_resample([(d[0], d[1]) for d in docs], [(x[0], x[1]) for x in labels]) if kept]
    yield sorted(good)
    fp = {i: plain(text[i]) for i in good}
    root = roots(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    single = [i for i in good if root[i] == i]
    yield sorted(single)
    clean = [r[0] for r in brute([(i, text[i]) for i in single], items) if not r[5]]
    yield sorted(clean)
    mixed = plain_mix([(i, text[i], source[i]) for i in clean])[1]
    copies = [i for i, n, taken, *_ in mixed for _ in range(math.floor(taken / n + 0.5) if n else 0)]
    yield sorted(copies)


def test_stages_equal_brute_force(spark, sf):
    d, docs, labels, items = sf
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns = now.columns
    for (name, stage), want in zip(P.STAGES[:-1], expected(docs, labels, items), strict=True):
        now = P.staged(stage(spark, now, d), "test")
        assert now.columns == columns and sorted(r.doc_id for r in now.select("doc_id").collect()) == want, name
    out = P.run(spark, d).collect()
    assert sorted(r.doc_id for r in out) == want and len(want) > 50
    assert all(r.shard == max(range(24), key=lambda s: bid(r.doc_id, s)) and r.size == len((r.text or "").encode()) + 8 for r in out)


def test_stages_of_nothing(spark, sf):
    none = spark.read.parquet(f"{sf[0]}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, sf[0]).count() == 0


def test_stages_with_nulls_repeated_ids_and_clashing_names(spark, tmp_path):
    """Documents without an id, several of one id, copies, and columns named like the stages' own."""
    rng = random.Random(31)
    vocab = [a + b for a in "ka lo mi ne po ru".split() for b in "ra se ti vo na".split()]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = prose(20)
    texts = [prose(rng.randint(60, 120)) for _ in range(40)]
    rows = [(None if k % 5 == 0 else k % 7, t) for k, t in enumerate(texts)] + [(90, texts[1]), (None, texts[2]), (91, prose(30) + " " + item), (92, junk(rng)), (None, None), (93, ""), (94, texts[3]), (94, texts[3])]
    named = ("size", "shard", "grown_shard", "th", "fp", "sig", "key", "root", "rn", "taken", "block", "contamination", "_contamination", "kept", "sk", "rid", "pass", "order")
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "s" if k % 3 else None, *[f"{c}{k}" for c in named]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in named)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(92, 0, 0), *[(k, 1, 0) for k in (1, 2, 3, 90)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns, left = now.columns, []
    for _, stage in P.STAGES[:3]:
        now = P.staged(stage(spark, now, d), "test")
        assert now.columns == columns
        left.append(sorted(str(r.text) for r in now.collect()))
        assert all(r[c][: len(c)] == c for r in now.collect() for c in named)
    every = sorted(str(t) for _, t in rows)
    assert left[0] == sorted(str(t) for i, t in rows if i != 92)  # the junk alone goes
    clean = sorted({*texts, rows[42][1], ""})  # one of each text; null and empty are one to the prints, the one with an id stays
    assert left[1] == clean and set(left[1]) <= set(every)
    assert left[2] == sorted(set(clean) - {rows[42][1]})
    out = P.run(spark, d)
    assert out.where("text is not null").count() > 30 and {"shard", "grown_shard", "size"} <= set(out.columns) and len(out.columns) == len(columns)
