"""The hash in SQL against its library."""

import duckdb
import xxhash

from pelgrain.llm import sql_hash


def test_texts_of_all_lengths():
    con = duckdb.connect()
    texts = ["aé漢z"[k % 4] * (k // 3) + "xyz %d" % k for k in range(200)] + ["", "a"]
    con.execute("CREATE TABLE t AS SELECT unnest(?::VARCHAR[]) AS s", [texts])
    for seed in (0, 42):
        got = dict(con.execute(f"SELECT s, h FROM ({sql_hash.of_text('t', 's', seed, 'h')})").fetchall())
        assert {k: int(v) for k, v in got.items()} == {t: xxhash.xxh64_intdigest(t.encode(), seed) for t in texts}


def test_numbers():
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest([0, 1, 77, 4294967295])::UHUGEINT AS v")
    for size in (4, 8):
        got = con.execute(f"SELECT v, h FROM ({sql_hash.of_number('t', 'v', size, sql_hash.num(42), 'h')})").fetchall()
        assert len(got) == 4 and all(int(h) == xxhash.xxh64_intdigest(int(v).to_bytes(size, "little"), 42) for v, h in got)
