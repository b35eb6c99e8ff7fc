"""Colour arithmetic: luma, saturation, CIELAB, hex, alpha."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sRGB transfer function, D65 white, sRGB <-> XYZ matrices, CIELAB constants.
XN, YN, ZN = 0.95047, 1.0, 1.08883
DELTA = 6.0 / 29.0
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))


def half_up(x: Column, k: int = 1) -> Column:
    """floor(x * k + 0.5) as a long; the same in any engine, unlike round(x, d)."""
    return F.floor(x * k + 0.5).cast("long")


def linear_light(v: int) -> float:
    x = v / 255.0
    return x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4


def _gamma(c: Column) -> Column:
    """A literal table of 256 values: an array lookup inside generated code."""
    return F.element_at(F.array(*[F.lit(linear_light(v)) for v in range(256)]), c.cast("int") + 1)


def _lab_f(t: Column) -> Column:
    return F.when(t > DELTA**3, F.power(t, F.lit(1.0 / 3.0))).otherwise(t / (3.0 * DELTA * DELTA) + 4.0 / 29.0)


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct<l, a, b> of an sRGB colour (D65)."""
    lin = [_gamma(c) for c in (r, g, b)]
    x, y, z = (sum((m * c for m, c in zip(row[1:], lin[1:], strict=True)), row[0] * lin[0]) for row in TO_XYZ)
    fx, fy, fz = _lab_f(x / XN), _lab_f(y / YN), _lab_f(z / ZN)
    return F.struct((fy * 116.0 - 16.0).alias("l"), ((fx - fy) * 500.0).alias("a"), ((fy - fz) * 200.0).alias("b"))


def lab_of(rgb: tuple[int, int, int]) -> tuple[float, float, float]:
    """CIELAB of one colour, on the driver."""
    lin = [linear_light(v) for v in rgb]
    t = [sum(m * v for m, v in zip(row, lin, strict=True)) / n for row, n in zip(TO_XYZ, (XN, YN, ZN), strict=True)]
    x, y, z = (v ** (1 / 3) if v > DELTA**3 else v / (3 * DELTA * DELTA) + 4 / 29 for v in t)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def with_lab(df: DataFrame, rgb: tuple[str, str, str] = ("r", "g", "b"), names: tuple[str, str, str] = ("_l", "_a", "_b")) -> DataFrame:
    """df with the three Lab columns, in steps: each step's columns are used several times by the next.

    As one expression the steps would be copied into each other, hundreds of lookups in all; the
    optimizer leaves costly columns that are used more than once where they are.
    """
    out = df.withColumns({f"_lin{k}": _gamma(F.col(c)) for k, c in enumerate(rgb)})
    lin = [F.col(f"_lin{k}") for k in range(3)]
    out = out.withColumns({f"_t{k}": sum((m * c for m, c in zip(row[1:], lin[1:], strict=True)), row[0] * lin[0]) / n for k, (row, n) in enumerate(zip(TO_XYZ, (XN, YN, ZN), strict=True))})
    out = out.withColumns({f"_f{k}": _lab_f(F.col(f"_t{k}")) for k in range(3)})
    x, y, z = (F.col(f"_f{k}") for k in range(3))
    return out.withColumns(dict(zip(names, (y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0), strict=True))).drop(*[f"_{s}{k}" for s in ("lin", "t", "f") for k in range(3)])


def lab_distance_sq(p: Column, q: Column) -> Column:
    d = [p[c] - q[c] for c in ("l", "a", "b")]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def lab_to_srgb(p: Column) -> Column:
    """struct<r, g, b>; half a step is added before rounding, so values lean upwards, as in the reference semantics."""
    fy = (p["l"] + 16.0) / 116.0
    fx, fz = p["a"] / 500.0 + fy, fy - p["b"] / 200.0
    inv = lambda t: F.when(t > DELTA, t * t * t).otherwise((t - 4.0 / 29.0) * (3.0 * DELTA * DELTA))
    xyz = [inv(t) * n for t, n in ((fx, XN), (fy, YN), (fz, ZN))]

    def channel(row: tuple[float, ...]) -> Column:
        v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), xyz[0] * row[0] + xyz[1] * row[1] + xyz[2] * row[2]))
        c = F.when(v <= 0.0031308, v * 12.92).otherwise(F.power(v, F.lit(1 / 2.4)) * 1.055 - 0.055)
        return F.least(F.lit(255), half_up(c * 255.0 + 0.5)).cast("int")

    return F.struct(*[channel(row).alias(c) for row, c in zip(FROM_XYZ, "rgb", strict=True)])


def luma601(r: Column, g: Column, b: Column) -> Column:
    return r * F.lit(0.299) + g * F.lit(0.587) + b * F.lit(0.114)


def luma709(r: Column, g: Column, b: Column) -> Column:
    return r * F.lit(0.2126) + g * F.lit(0.7152) + b * F.lit(0.0722)


def catmull_rom(x: Column) -> Column:
    """Weight of a sample at distance x."""
    d = F.abs(x)
    near = d * d * d * 1.5 - d * d * 2.5 + 1
    far = d * d * d * -0.5 + d * d * 2.5 - d * 4 + 2
    return F.when(d < 1, near).when(d < 2, far).otherwise(0.0)


def saturation(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def composite(src: Column, bg: Column | int, alpha: Column) -> Column:
    """A channel over a matte colour: exact at both ends of alpha."""
    bg = F.lit(bg) if isinstance(bg, int) else bg
    a = alpha / F.lit(255.0)
    return F.when(alpha == 255, src).when(alpha == 0, bg).otherwise(F.floor(src * a + bg * (F.lit(1.0) - a) + 0.5)).cast("int")


def parse_hex(s: Column) -> Column:
    """#rgb, #rrggbb or rrggbb -> struct<r, g, b>; null where it is neither."""
    h = F.lower(F.regexp_replace(F.trim(s), "^#", ""))
    wide = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    part = lambda i: F.conv(F.substring(wide, i, 2), 16, 10).cast("int")
    return F.when(h.rlike("^([0-9a-f]{3}|[0-9a-f]{6})$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def format_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)]))


def with_blend(df: DataFrame, c: str, a: str, b: str, name: str) -> DataFrame:
    """df with a flag: struct column c mixes a and b, the channels agreeing on a share in (0.01, 0.99) within 15 steps.

    In steps, so that no expression holds copies of the one before.
    """
    v = lambda s, k: F.col(f"{s}.{k}").cast("double")
    out = df.withColumns({f"_s{k}": F.when(F.abs(v(a, k) - v(b, k)) > 1, (v(c, k) - v(b, k)) / (v(a, k) - v(b, k))).otherwise(F.lit(-1.0)) for k in "rgb"})
    ok = {k: (F.col(f"_s{k}") >= -0.2) & (F.col(f"_s{k}") <= 1.2) for k in "rgb"}
    plus = lambda xs: xs[0] + xs[1] + xs[2]
    out = out.withColumns({"_n": plus([ok[k].cast("int") for k in "rgb"]), "_sum": plus([F.when(ok[k], F.col(f"_s{k}")).otherwise(0.0) for k in "rgb"])})
    out = out.withColumn("_mean", F.try_divide("_sum", "_n"))
    m = F.col("_mean")
    off = F.greatest(*[F.abs(v(c, k) - (m * v(a, k) + (F.lit(1.0) - m) * v(b, k))) for k in "rgb"])
    flag = F.coalesce((F.col("_n") >= 2) & (m > 0.01) & (m < 0.99) & (off < 15.0), F.lit(False))
    return out.withColumn(name, flag).drop("_sr", "_sg", "_sb", "_n", "_sum", "_mean")
