"""Quality resampling, secret scan, token counts and embeddings, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from xxhash import xxh64

from pelgrain.llm import embed_dedup, quality, secret_scan, token_counts

M = (1 << 64) - 1
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")


def mix(h):
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & M
    h ^= h >> 29
    h = h * 0xD6E8FEB86659FD93 & M
    return h ^ h >> 32


def plain_ngrams(text):
    words = SPACED.findall((text or "").encode())
    h = [mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(w)) & M) for w in words]

    def shape(w):
        n = [0, 0, 0, 0]
        for b in w:
            n[0 if 97 <= b < 123 or b > 127 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3] += 1
        s = min(len(w), 15)
        for c in n:
            s = s * 3 + min(c, 2)
        return s

    s = [shape(w) for w in words]
    out = []
    for i in range(len(words)):
        h2, s2 = (1, 0) if i + 1 == len(words) else (h[i + 1], s[i + 1] + 1)
        pair = 77 if h2 == h[i] else mix((h[i] * 3 + h2) & M)
        for k, x in enumerate((h[i], pair, mix((s[i] * (1 << 20) + s2 + (1 << 50)) & M))):
            out.append(mix((x + k) & M) % quality.BUCKETS)
    return out


def plain_resample(docs, labels):
    """docs: (id, text); labels: (id, quality). -> id -> (n, log weight, key), the ids kept."""
    grams = [(i, plain_ngrams(t)) for i, t in docs]
    known = {}
    for i, q in labels:
        if i is not None and q is not None:
            known[i] = min(q, known.get(i, q))
    raw, target = np.zeros(quality.BUCKETS), np.zeros((2, quality.BUCKETS))
    half = lambda i: mix(i & M) & 1
    for i, g in grams:
        np.add.at(raw, g, 1)
        if known.get(i) == 1:
            np.add.at(target[half(i)], g, 1)
    q = (raw + 1) / (raw.sum() + quality.BUCKETS)
    ratio = lambda t: np.log((t + quality.BUCKETS * q) / (t.sum() + quality.BUCKETS) / q) if t.any() else np.zeros(quality.BUCKETS)
    whole, halves = ratio(target.sum(axis=0)), [ratio(t) for t in target]
    rows = []
    for i, g in grams:
        mine = halves[1 - half(i)] if known.get(i) == 1 else whole
        w = float(sum(mine[x] for x in g))
        h = xxh64(((-1 if i is None else i) & M).to_bytes(8, "little"), 42).intdigest()
        u = ((xxh64(b"gumbel", h).intdigest() >> 11) + 0.5) / (1 << 53)
        rows.append((i, len(g), w, w - math.log(-math.log(u))))
    score = {}
    for i, _, w, _ in rows:
        if i in known:
            score[i] = min(w, score.get(i, w))
    cut = quality.threshold([(w, known[i]) for i, w in score.items()]) if whole.any() else -math.inf
    k = sum(w >= cut for _, _, w, _ in rows)
    keys = sorted((r[3] for r in rows), reverse=True)
    last = keys[k - 1] if k else math.inf
    return [(*r, r[3] >= last) for r in rows]


def corpus(rng, n=120):
    good = "the of and in rivers mountains people water stone little garden".split()
    out, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        t = " ".join([rng.choice(good).upper() + "!!" for _ in range(40)] if bad and i % 2 else [rng.choice(good)] * 50 if bad else [rng.choice(good) + rng.choice(["", "", ".", ","]) for _ in range(60)])
        out.append((i, t))
        if i % 3:
            labels.append((i, int(not bad)))
    return out, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, "k", 0.5) for d in docs], "doc_id long, text string, kept string, score double"), spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int")


def test_resampling_equals_brute_force_and_tells_junk(spark):
    docs, labels = corpus(random.Random(1))
    docs += [(500, None), (501, ""), (502, " \n"), (7, docs[7][1]), (None, docs[8][1]), (503, "garden " * 30_000)]
    labels += [(None, 1), (3, None), (4, 1), (4, 0), (99_999, 1)]
    d, lab = frames(spark, docs, labels)
    got = [(r.doc_id, r.n_grams, r.log_weight, r.key, r.kept) for r in quality.resample(d, lab).collect()]
    want = plain_resample(docs, labels)
    order = lambda x: (str(x[0]), x[1])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:2] == b[:2] and a[2:4] == pytest.approx(b[2:4], rel=1e-6, abs=1e-6) and a[4] == b[4]
    held = [(r[0] % 5 != 0) == r[4] for r in got if r[0] is not None and r[0] < 120 and r[0] % 3 == 0]
    assert sum(held) / len(held) >= 0.95
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r[4] or r[0] is None for r in got)


def test_resampling_draws_by_weight(spark):
    """Documents without preference are drawn by the noise alone; weights decide where they differ by much."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=6))) for i in range(400)] + [(1000 + i, " ".join(["!!"] * 60)) for i in range(60)]
    d, lab = frames(spark, docs, [(i, int(i < 1000)) for i, _ in docs[::3]])
    rows = quality.resample(d, lab, share=0.5).collect()
    kept = {r.doc_id for r in rows if r.kept}
    assert len(kept) == 230 and max(kept) < 1000
    plain = {r.doc_id for r in sorted(rows, key=lambda r: -r.log_weight)[:230]}
    assert 20 < len(kept - plain) < 200
    same = quality.resample(d, lab, share=0.5, temperature=1e-9).where("kept").collect()
    assert {r.doc_id for r in same} == plain


def test_rows_that_share_an_id_are_scored_by_their_texts(spark):
    docs, labels = corpus(random.Random(4))
    d, lab = frames(spark, docs + [(5, docs[1][1]), (1, docs[5][1])], labels)
    kept = [tuple(r)[:2] for r in quality.keep_good(d, lab).where("doc_id in (1, 5)").collect()]
    assert sorted(kept) == sorted([(1, docs[1][1]), (5, docs[1][1])])


def test_resampling_without_labels_or_rows(spark):
    d, lab = frames(spark, corpus(random.Random(2), 20)[0], [])
    assert all(r.kept for r in quality.resample(d, lab).collect())
    assert quality.resample(d.limit(0), lab).count() == 0
    d, lab = frames(spark, corpus(random.Random(2), 20)[0], [(1, 1), (2, 1)])
    assert all(r.kept for r in quality.resample(d, lab).collect())


def test_selection_is_exact(spark):
    rng = random.Random(9)
    keys = [rng.choice([rng.gauss(0, 1), 0.25, 1e9 + rng.random(), -1e-300]) for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    ranked = sorted(keys, reverse=True)
    for k in (1, 7, 1500, 2400, 3000, 5000):
        assert quality.kth_largest(df, k, few=20) == ranked[min(k, 3000) - 1]
    assert quality.kth_largest(df, 0) is None and quality.kth_largest(df.limit(0), 3) is None


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    bits = ["password", "Passwd", "SECRET", "toKen", "api_key", "APIKEY", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "AKIA", "deadbeef" * 3, "ABCDEF0123456789", "é", "abc", "x.y=z/", "\n", "token = ", "0" * 23, "AKIAAKIA"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(3000)] + ["password: token = abcdefgh", "token=secret=abcdefgh", ""]
    for t in texts:
        assert secret_scan.scan_text(t)[0] == plain_base(t), t
    assert sum(len(plain_base(t)) for t in texts) > 500


def test_secrets_of_whole_documents(spark):
    rng = random.Random(6)
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "the re on an er in ti en or ha st".split()
    docs = [(k, " ".join("".join(rng.choices(syllables, k=rng.randint(2, 14))) for _ in range(80))) for k in range(80)]
    secret = {k: "".join(rng.choices(wide, k=44)) for k in range(0, 80, 4)}
    docs = [(k, t + " é " + secret[k] + "." if k in secret else t) for k, t in docs]
    docs += [(200, None), (201, ""), (202, 'Token: "abcdef123456"'), (202, 'Token: "abcdef123456"'), (None, "api_key=" + "a" * 30), (203, "word " * 200_000 + "AKIA" + "Z9" * 10)]
    d = spark.createDataFrame([(*x, "s", 3) for x in docs], "doc_id long, text string, spans string, n_hex int")
    got = secret_scan.with_contract_columns(secret_scan.find_secrets(d)).collect()
    assert len(got) == len(docs)
    by = {i: t for i, t in docs}
    for r in got:
        base = plain_base(by[r.doc_id] or "")
        said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        found = [s for s in r.spans.split(",") if s.startswith("random:")]
        if r.doc_id in secret:
            (s,) = found
            a, b = map(int, s.split(":")[1:])
            assert by[r.doc_id][a:b] == secret[r.doc_id]
        else:
            assert not found, by[r.doc_id][:200]
    assert secret_scan.find_secrets(d.limit(0)).count() == 0


ALPHABETS = ["0-9a-f", "0-9A-F", "A-Z2-7", "0-9a-z", "0-9A-Z", "A-Za-z0-9", "A-Za-z0-9+/", "A-Za-z0-9_-"]


def alphabet(k):
    """Symbols in the order of their values."""
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [digits + lower[:6], digits + upper[:6], upper + "234567", digits + lower, digits + upper, upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_"][k]


def plain_tokens(text):
    out = []
    for run in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        for piece in re.finditer("[^=]+", run[0]):
            a, b = run.start() + piece.start(), run.start() + piece.end()
            if not text[b : run.end()].strip("="):
                b = run.end()
            if len(piece[0]) >= 20:
                both = re.search("[+/]", piece[0]) and re.search("[_-]", piece[0])
                parts = ["[A-Za-z0-9+/]{20,}=*", "[A-Za-z0-9_-]{20,}=*"] if both else [".*"]
                out += sorted({(a + m.start(), a + m.end()) for p in parts for m in re.finditer(p, text[a:b]) if m[0]})
    return out


def plain_battery(token):
    token = token.rstrip("=")
    enc = next((k for k, a in enumerate(ALPHABETS) if re.fullmatch(f"[{a}]*", token)), None)
    if enc is None or len(token) < 20 or token.isdigit():
        return None
    symbols, n = alphabet(enc), len(token)
    v, size = [symbols.index(c) for c in token], len(symbols)
    upper = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi = sum((v.count(k) - n / size) ** 2 for k in range(size)) * size / n
    ps = [upper((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))]
    high = [x >= size / 2 for x in v]
    a, b = sum(high), n - sum(high)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    if a and b:
        mean = 1 + 2 * a * b / n
        var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        ps.append(2 * upper(abs(runs - mean) / math.sqrt(var)) if var > 1e-12 else 1.0)
    else:
        ps.append(0.0)
    m = sum(v) / n
    spread = sum((x - m) ** 2 for x in v)
    ps.append(2 * upper(abs(sum((x - m) * (y - m) for x, y in zip(v, v[1:])) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0)
    return enc, n, chi, min(1.0, 3 * min(ps))


def plain_random(texts):
    """Spans of kind random in each text: the battery, the null model of ordinary text, and the control by band of length."""
    counts = [1.0] * 256
    for t in texts:
        for c in (t or "").encode():
            counts[c] += 1
    shares = []
    for k in range(8):
        c = [counts[ord(x)] for x in alphabet(k)]
        shares.append([x / sum(c) for x in c])
    tokens = []
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        for a, b in plain_tokens(t or ""):
            if not any(x < b and a < y for x, _, y in base) and (f := plain_battery(t[a:b])):
                enc, n, chi, p = f
                q, size = shares[enc], len(shares[enc])
                far = sum((x - 1 / size) ** 2 for x in q)
                z = (size * (sum(x * (1 - x) for x in q) + n * far) - chi) / math.sqrt(2 * (size - 1 + 2 * size * n * far))
                level = min(math.floor(z * z / 2 / math.log(10) * 20), 6000) if z > 0 else 0
                tokens.append((i, a, b, sum(n >= x for x in (20, 28, 40, 64, 128)), level, p))
    out = [[] for _ in texts]
    for band in range(1, 6):
        mine = sorted((t for t in tokens if t[3] == band), key=lambda t: -t[4])
        last = max((k for k in range(len(mine)) if 10 ** (-mine[k][4] / 20) <= 0.01 * (k + 1) / len(mine)), default=-1)
        for i, a, b, _, level, p in mine:
            if last >= 0 and level >= mine[last][4] and p > 0.01:
                out[i].append((a, b))
    return [sorted(x) for x in out], len(tokens)


def wordy(rng, n):
    """Long tokens of ordinary text: identifiers, paths, joined words, numbers in names."""
    words = "the response manager of content river mountain data config reader page index value number people garden stone token_ count item list".split()
    make = [
        lambda: "".join(w.capitalize() for w in rng.choices(words, k=rng.randint(4, 9))),
        lambda: "/".join(rng.choices(words, k=rng.randint(4, 12))),
        lambda: "-".join(rng.choices(words, k=rng.randint(4, 12))),
        lambda: "_".join(rng.choices(words, k=rng.randint(4, 9))) + str(rng.randint(0, 99)),
        lambda: "".join(rng.choices(words, k=rng.randint(5, 20))),
        lambda: "".join(rng.choices(words, k=5)) + "=" + "".join(rng.choices(words, k=5)),
    ]
    return [rng.choice(make)() for _ in range(n)]


def test_battery_equals_brute_force():
    rng = random.Random(14)
    tokens = wordy(rng, 300) + ["".join(rng.choices(alphabet(k), k=rng.randint(18, 200))) + "=" * rng.randint(0, 2) for k in range(8) for _ in range(40)] + ["a" * 40, "ab" * 30, "9" * 25, "Z" * 19 + "1", "ABCDEFGH" * 5]
    for t in tokens:
        want, got = plain_battery(t), secret_scan.battery(t)
        assert (want is None) == (got is None), t
        if want:
            assert got[:2] == want[:2] and got[2] == pytest.approx(want[2], rel=1e-9) and got[3] == pytest.approx(want[3], rel=1e-6, abs=1e-12), t
    old = secret_scan.CHUNK
    try:
        secret_scan.CHUNK = 7
        for t in tokens[:50] + tokens[300:350]:
            assert secret_scan.battery(t) == pytest.approx(plain_battery(t), rel=1e-6) if plain_battery(t) else secret_scan.battery(t) is None
    finally:
        secret_scan.CHUNK = old
    assert secret_scan.battery("".join(rng.choices(alphabet(6), k=3_000_000)))[1] == 3_000_000


def test_random_spans_equal_brute_force(spark):
    rng = random.Random(15)
    texts = [" ".join(wordy(rng, rng.randint(0, 12))) for _ in range(150)]
    for k in range(0, 150, 6):
        secret = "".join(rng.choices(alphabet(rng.choice((2, 4, 5, 6, 7))), k=rng.choice((24, 32, 44, 90, 150))))
        texts[k] += rng.choice((" ", "?sig=", " x: ", "=")) + secret + rng.choice(("", "=", "==", ". token=abcdef12"))
    texts += [None, "", "é " + texts[0]]
    want, n = plain_random(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.name == "random"] for r in secret_scan.find_secrets(df.repartition(3)).collect()}
    assert got == dict(enumerate(want)) and n > 500 and sum(map(len, want)) >= 10


def test_false_discoveries_in_ordinary_text(spark):
    """Tokens of words alone, and the same with their words shuffled: at most the stated rate passes for random."""
    rng = random.Random(16)
    tokens = wordy(rng, 6000)
    rng.shuffle(tokens)
    df = spark.createDataFrame([(k, " ".join(tokens[k * 10 : k * 10 + 10])) for k in range(600)], "doc_id long, text string")
    n = sum(s.name == "random" for r in secret_scan.find_secrets(df).collect() for s in r.spans)
    assert n <= secret_scan.FDR * len(tokens), n


def test_runs_are_parted_into_tokens():
    rng = random.Random(12)
    plus, url = "".join(rng.choices("ABCDEFabcdef0123456789+/", k=38)) + "+/", "".join(rng.choices("GHIJKLghijkl0123456789-_", k=38)) + "-_"
    for text, want in (
        (f"AWS_SECRET_ACCESS_KEY={plus}", [plus]),
        (f"https://a.b/?sig={url}==&x", [url + "=="]),
        (f"FOO_KEY={plus}=BAR={url}", [plus, url]),
        (f"my-{plus}", [plus]),
        (f"a/{url}=", [url + "="]),
        (f"AKIA{'Z' * 16}={plus}", [plus]),
        (f"{plus}{'=' * 3}", [plus + "==="]),
        (f"token={plus}", []),
    ):
        got = [text[a:b] for a, b, *_ in secret_scan.scan_text(text)[1]]
        assert set(want) <= set(got) and (want or not got), text


def test_battery_rejects_patterns_and_accepts_noise():
    rng = random.Random(7)
    noise = ["".join(rng.choices("0123456789ABCDEF", k=40)) for _ in range(400)]
    assert sum(secret_scan.battery(t)[3] > secret_scan.LEVEL for t in noise) >= 380
    for t in ("ABCD1234" * 6, "ABABABABABABABABABABABAB12", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1Z", "thereonanerintienorhastthere"):
        assert secret_scan.battery(t)[3] < secret_scan.LEVEL
    assert secret_scan.battery("1" * 30) is None and secret_scan.battery("ab") is None


def test_token_counts_equal_the_tokenizer(spark):
    rng = random.Random(8)
    enc = token_counts.encoder(token_counts.VOCAB)
    texts = [" ".join(rng.choices("Hello wörld <|endoftext|> 123 \n\t x ñandú".split(" "), k=rng.randint(0, 60))) for _ in range(150)] + [None, "", "a", "  ", "long " * 100_000]
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(3, "twice", 1), (3, "twice", 1), (None, "no id", 1)], "doc_id long, text string, n_tokens int")
    want = sorted((r.doc_id if r.doc_id is not None else -1, len(enc.encode_ordinary(r.text or ""))) for r in d.collect())
    for parts, block in ((1, 1 << 20), (3, 64), (2, 2)):
        got = token_counts.count_tokens((d if block > 2 else d.where("doc_id < 40")).repartition(parts), block=block).collect()
        some = want if block > 2 else [w for w in want if 0 <= w[0] < 40]
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got) == some
    assert token_counts.count_tokens(d.limit(0)).count() == 0


def test_flat_files_on_storage(spark, tmp_path):
    rng = random.Random(9)
    want = {}
    for name in "ab":
        lengths = [rng.choice((0, 1, 5, 400)) for _ in range(60)] + [7] * (name == "b")
        ids = []
        for k, n in enumerate(lengths):
            ids += [rng.randrange(50_000) for _ in range(n)] + ([] if name == "b" and k == 60 else [token_counts.EOD])
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, np.uint16).tobytes())
        want[name] = lengths
    for block in (2, 64, 1 << 20):
        b = token_counts.read_flat(spark, f"file://{tmp_path}/*.bin", block)
        rows = token_counts.stitch(token_counts.separator_scan(b)).collect()
        files = {}
        for r in sorted(rows, key=lambda r: r.ordinal):
            files.setdefault(r.file, []).append(r.n_tokens)
        assert sorted(files.values()) == sorted(want.values())


def roots(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked[i][j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(10)
    rows, k = [], 0
    for label in (0, 1, None):
        mids = rng.normal(size=(12, 16))
        for m in mids:
            for s in (0.0, 0.0, 0.05, 0.1, 0.15, 0.3):
                rows.append((1000 - k, [float(np.float32(x)) for x in m + s * rng.normal(size=16)], label))
                k += 1
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, [None, *[1.0] * 15], 0), (2005, [float("inf")] * 16, 0), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0), (2008, rows[0][1], 1), (2009, [1e-30, 0.0], 0)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, label int, n_links int, cid string")

    def good(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def link(a, b):
        if a[2] is None or a[2] != b[2] or not good(a[1]) or not good(b[1]) or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
        return float(x @ y / math.sqrt(x @ x) / math.sqrt(y @ y)) >= 0.93

    rows.sort(key=lambda r: r[0])
    linked = [[i != j and link(a, b) for j, b in enumerate(rows)] for i, a in enumerate(rows)]
    root = roots(len(rows), linked)
    want = [(r[0], sum(linked[i]), rows[root[i]][0], root[i] == i) for i, r in enumerate(rows)]
    assert sum(w[1] > 0 for w in want) > 60
    old = embed_dedup.LEAF
    try:
        for chunk, embed_dedup.LEAF in ((None, old), (16, 4)):
            got = sorted(tuple(r) for r in embed_dedup.near_duplicates(df, chunk=chunk).collect())
            assert got == want
    finally:
        embed_dedup.LEAF = old
    # labels of other types: equal just where they were
    for kind in ("string", "long", "double", "date"):
        made = {"string": "concat('label ', label)", "long": "label + 5000000000", "double": "label * 0.25 * (case when vec_id % 2 = 0 then -1 else 1 end) * (case when label = 0 then 1 else (case when vec_id % 2 = 0 then -1 else 1 end) end)", "date": "date_add(date '2020-01-01', label)"}[kind]
        assert sorted(tuple(r) for r in embed_dedup.near_duplicates(df.selectExpr("vec_id", "embedding", f"{made} as label"), chunk=64).collect()) == want, kind


def test_embeddings_pairs_of_chunks(spark):
    """The recursive join keeps every pair of chunks that lie within epsilon, and drops others."""
    rng = random.Random(12)
    boxes = []
    for label, n in (("a", 13), ("b", 1), ("c", 8)):
        at = sorted(rng.uniform(0, 6) for _ in range(2 * n))
        boxes += [(label, 2, k, [at[2 * k], rng.uniform(0, 1)], [at[2 * k + 1], 1.0]) for k in range(n)]
    df = spark.createDataFrame(boxes, "label string, dim int, chunk long, lo array<double>, hi array<double>")
    got = sorted((r.label, r.a, r.b) for r in embed_dedup.chunk_pairs(df, 0.4).collect())
    want = sorted((x[0], x[2], y[2]) for x in boxes for y in boxes if x[0] == y[0] and x[2] >= y[2] and sum(max(0, p - s, r - q) ** 2 for p, q, r, s in zip(x[3], x[4], y[3], y[4])) <= 0.16)
    assert got == want and len(want) < sum(n * (n + 1) // 2 for n in (13, 1, 8))


def test_embeddings_of_a_common_vector(spark):
    """A vector in most rows, and labels of one vector each."""
    df = spark.sql("select id as vec_id, if(id % 3 < 2, array(1d, 2d, 3d), array(cast(id as double), 1d, -5d)) as embedding, if(id % 3 < 2, 'x', concat('l', id)) as label from range(600)")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {i: (399, 0, i == 0) if i % 3 < 2 else (0, i, True) for i in range(600)}


def test_embeddings_none_or_nothing(spark):
    df = spark.createDataFrame([(1, None, 0), (None, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted((tuple(r) for r in embed_dedup.near_duplicates(df).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, False)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    one = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], df.schema)
    assert sorted((tuple(r) for r in embed_dedup.near_duplicates(one).collect()), key=str) == [(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False)]
