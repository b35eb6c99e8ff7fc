"""XXH64 spelled out in DuckDB SQL, in 128-bit integers, for the oracles of operators that hash with it."""

from __future__ import annotations

#: The hash's primes (fixed values).
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def num(x: int) -> str:
    return f"{x % (1 << 64)}::UHUGEINT"


def cut(x: str) -> str:
    """x mod 2**64."""
    return f"(({x}) & {num(-1)})"


def times(x: str, p: int) -> str:
    return cut(f"({x}) * {num(p)}")


def turned(x: str, n: int) -> str:
    """x rotated left by n bits."""
    return cut(f"(({x}) << {n}) | (({x}) >> {64 - n})")


def finished(source: str, h: str, out: str) -> str:
    """A query that adds `out`, the avalanche of column h, to a subquery."""
    a = f"SELECT *, {times(f'xor({h}, {h} >> 33)', P2)} AS h2_ FROM ({source})"
    b = f"SELECT *, {times('xor(h2_, h2_ >> 29)', P3)} AS h3_ FROM ({a})"
    return f"SELECT * EXCLUDE (h2_, h3_), xor(h3_, h3_ >> 32) AS {out} FROM ({b})"


def of_number(source: str, value: str, size: int, seed: str, out: str) -> str:
    """A query that adds `out`, the hash of value (UHUGEINT, of 8 or 4 bytes) after seed, to table `source`."""
    turn, mul, add = {8: (27, P1, P4), 4: (23, P2, P3)}[size]
    k = f"SELECT *, {times(value, P2 if size == 8 else P1)} AS k0_ FROM {source}"
    k = f"SELECT *, {times(turned('k0_', 31), P1) if size == 8 else 'k0_'} AS k1_ FROM ({k})"
    h = f"SELECT *, xor({cut(f'{seed} + {num(P5 + size)}')}, k1_) AS h0_ FROM ({k})"
    h = f"SELECT *, {cut(f'{times(turned("h0_", turn), mul)} + {num(add)}')} AS h1_ FROM ({h})"
    return f"SELECT * EXCLUDE (k0_, k1_, h0_, h1_) FROM ({finished(h, 'h1_', out)})"


def of_text(source: str, text: str, seed: int, out: str) -> str:
    """A query that adds `out`, the hash of the UTF-8 bytes of a text column, to table `source`."""
    hexed = lambda a, b: f"('0x' || array_to_string(list_reverse(b_[{a}:{b}]), ''))::UHUGEINT"  # noqa: E731  little-endian
    s = f"SELECT *, regexp_extract_all(hex(encode({text})), '..') AS b_, strlen({text}) AS n_ FROM {source}"
    s = f"SELECT *, list_transform(range(0, n_ // 8), lambda i: {hexed('8 * i + 1', '8 * i + 8')}) AS w_ FROM ({s})"
    step = times(turned(cut(f"a + {times('x', P2)}"), 31), P1)
    starts = (seed + P1 + P2, seed + P2, seed, seed - P1)
    lanes = [f"list_reduce(list_prepend({num(v)}, w_[{k + 1}:4 * (n_ // 32):4]), lambda a, x: {step}) AS v{k + 1}_" for k, v in enumerate(starts)]
    s = f"SELECT *, {', '.join(lanes)} FROM ({s})"
    s = f"SELECT *, {cut(' + '.join(turned(f'v{k}_', n) for k, n in ((1, 1), (2, 7), (3, 12), (4, 18))))} AS m0_ FROM ({s})"
    for k in range(1, 5):
        s = f"SELECT *, {cut(f'{times(f"xor(m{k - 1}_, {times(turned(times(f"v{k}_", P2), 31), P1)})", P1)} + {num(P4)}')} AS m{k}_ FROM ({s})"
    s = f"SELECT *, {cut(f'CASE WHEN n_ >= 32 THEN m4_ ELSE {num(seed + P5)} END + n_::UHUGEINT')} AS g0_ FROM ({s})"
    rest = f"list_transform(w_[4 * (n_ // 32) + 1:], lambda x: {times(turned(times('x', P2), 31), P1)})"
    s = f"SELECT *, list_reduce(list_prepend(g0_, {rest}), lambda a, x: {cut(f'{times(turned("xor(a, x)", 27), P1)} + {num(P4)}')}) AS g1_ FROM ({s})"
    four = times(hexed("8 * (n_ // 8) + 1", "8 * (n_ // 8) + 4"), P1)
    s = f"SELECT *, CASE WHEN n_ % 8 >= 4 THEN xor(g1_, {four}) END AS f_ FROM ({s})"
    s = f"SELECT *, coalesce({cut(f'{times(turned("f_", 23), P2)} + {num(P3)}')}, g1_) AS g2_ FROM ({s})"
    last = f"list_transform(b_[4 * (n_ // 4) + 1:], lambda x: {times("('0x' || x)::UHUGEINT", P5)})"
    s = f"SELECT *, list_reduce(list_prepend(g2_, {last}), lambda a, x: {times(turned('xor(a, x)', 11), P1)}) AS g3_ FROM ({s})"
    return f"SELECT * EXCLUDE (b_, n_, w_, v1_, v2_, v3_, v4_, m0_, m1_, m2_, m3_, m4_, g0_, g1_, f_, g2_, g3_) FROM ({finished(s, 'g3_', out)})"
