"""Histograms and statistics of an image's colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pelgrain.functions import color as C
from pelgrain.operators.pixels import ALPHA_MIN, SAT_MIN, VALUE_MAX, rgb

RGB = ["r", "g", "b"]


def distinct_colours(pixels: DataFrame) -> DataFrame:
    """image_id, n_colours; exact. Two aggregations, so no set of colours is held by one task."""
    return pixels.select("image_id", *RGB).distinct().groupBy("image_id").agg(F.count("*").alias("n_colours"))


def exact_histogram(pixels: DataFrame) -> DataFrame:
    """Colours with their count, first position, and rank by first appearance in scan order."""
    h = pixels.groupBy("image_id", *RGB).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    return h.withColumn("scan_rank", F.row_number().over(W.partitionBy("image_id").orderBy("first_idx")))


def exact_clusters(pixels: DataFrame, most: int) -> DataFrame:
    """The histogram of images with at most `most` colours; others give nothing."""
    h = exact_histogram(pixels)
    return h.withColumn("k", F.count("*").over(W.partitionBy("image_id"))).where(F.col("k") <= most).drop("k")


def colours_above_floor(pixels: DataFrame, floor: float = 0.01) -> DataFrame:
    """image_id, n_colours: colours of at least ceil(floor * pixels) pixels."""
    h = pixels.groupBy("image_id", *RGB).agg(F.count("*").alias("n"))
    h = h.withColumn("least", F.ceil(F.sum("n").over(W.partitionBy("image_id")) * F.lit(floor)))
    return h.groupBy("image_id").agg(F.count(F.when(F.col("n") >= F.col("least"), 1)).alias("n_colours"))


def otsu(values: DataFrame, value: str, default: int) -> DataFrame:
    """image_id, threshold: the value that parts the histogram with the largest variance between classes.

    The least of equal ones; `default` for fewer than two samples or values. The variance
    w0 w1 (m0 - m1)^2 is (s0 n - s w0)^2 / (w0 w1): integers up to one division.
    """
    h = values.groupBy("image_id", F.col(value).alias("t")).agg(F.count("*").alias("c"))
    run, all_ = W.partitionBy("image_id").orderBy("t"), W.partitionBy("image_id")
    h = h.select("image_id", "t", F.sum("c").over(run).alias("w0"), F.sum(F.col("c") * F.col("t")).over(run).alias("s0"), F.sum("c").over(all_).alias("n"), F.sum(F.col("c") * F.col("t")).over(all_).alias("s"))
    diff = (F.col("s0") * F.col("n") - F.col("s") * F.col("w0")).cast("double")
    parts = h.where("w0 < n").select("image_id", "t", (diff * diff / (F.col("w0") * (F.col("n") - F.col("w0"))).cast("double")).alias("var"))
    best = parts.groupBy("image_id").agg(F.max(F.struct("var", (-F.col("t")).alias("nt"))).alias("m"))
    return values.select("image_id").distinct().join(best, "image_id", "left").select("image_id", F.coalesce(-F.col("m.nt"), F.lit(default)).cast("int").alias("threshold"))


def otsu_luma(pixels: DataFrame) -> DataFrame:
    return otsu(pixels.select("image_id", F.floor(C.luma601(*rgb())).cast("int").alias("l")), "l", 127)


def auto_sat_threshold(pixels: DataFrame) -> DataFrame:
    """Otsu on the saturation of pixels that can be ink; images without any get the default."""
    ok = (F.col("a") >= ALPHA_MIN) & (F.greatest(*rgb()) <= VALUE_MAX)
    found = otsu(pixels.where(ok).select("image_id", C.saturation(*rgb()).alias("s")), "s", SAT_MIN)
    return pixels.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.coalesce("threshold", F.lit(SAT_MIN)).alias("threshold"))


def alpha_profile(pixels: DataFrame) -> DataFrame:
    """image_id, has_alpha, flat_alpha: some transparency, of at most two values between 0 and 255."""
    a = F.col("a")
    some = F.bool_or(a != 255)
    n = F.count_distinct(F.when((a > 0) & (a < 255), a))
    return pixels.groupBy("image_id").agg(some.alias("has_alpha"), (some & (n <= 2)).alias("flat_alpha"))


def detect_background(pixels: DataFrame) -> DataFrame:
    """image_id, corner, r, g, b: the first corner with which two later ones agree (squared Lab distance under 5)."""
    size = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    at = F.when(F.col("x") == 0, 0).when(F.col("x") == F.col("mx"), 1) + F.when(F.col("y") == 0, 0).when(F.col("y") == F.col("my"), 2)
    four = pixels.join(size, "image_id").withColumn("corner", at).where("corner is not null").select("image_id", "corner", *RGB, C.lab(*rgb()).alias("lab"))
    one = four.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("corner", "lab", *RGB))).alias("c"))
    at = lambda i: F.col("c")[i]
    agree = lambda i: sum((F.when(C.lab_distance_sq(at(i)["lab"], at(j)["lab"]) < 5.0, 1).otherwise(0) for j in range(i + 1, 4)), F.lit(0))
    pick = F.when(F.size("c") == 4, F.when(agree(0) >= 2, 0).when(agree(1) >= 2, 1))
    return one.select("image_id", F.get("c", pick).alias("b")).where("b is not null").select("image_id", "b.corner", "b.r", "b.g", "b.b")


def kth(df: DataFrame, value: Column, at: Column, name: str) -> DataFrame:
    """image_id and the value at a place (from 0, a function of the count n) of the sorted values: no interpolation."""
    w = W.partitionBy("image_id")
    r = df.select("image_id", value.alias("_v")).where("_v is not null")
    r = r.select("image_id", "_v", (F.row_number().over(w.orderBy("_v")) - 1).alias("_k"), F.count("*").over(w).alias("n"))
    return r.where(F.col("_k") == at).select("image_id", F.col("_v").alias(name), "n")


def border_median(pixels: DataFrame, lum: str, width: int = 2, least: int = 16, default: float = 255.0) -> DataFrame:
    """image_id, background: the lower median of a border of two pixels; fewer than 16 samples: white."""
    size = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    edge = (F.col("x") < width) | (F.col("y") < width) | (F.col("x") > F.col("mx") - width) | (F.col("y") > F.col("my") - width)
    mid = kth(pixels.join(size, "image_id").where(edge), F.col(lum), F.floor((F.col("n") - 1) / 2), "m").where(F.col("n") >= least)
    return pixels.select("image_id").distinct().join(mid, "image_id", "left").select("image_id", F.coalesce(F.col("m").cast("double"), F.lit(default)).alias("background"))


def luma_analysis(pixels: DataFrame, lum: str, d_min: float = 40.0) -> DataFrame:
    """image_id, background, dark_on_light, ink_ref: the distance at a tenth of the sorted distances over d_min, or 0."""
    bg = border_median(pixels, lum)
    far = pixels.join(bg, "image_id").withColumn("d", F.abs(F.col(lum) - F.col("background"))).where(F.col("d") > d_min)
    ref = kth(far, F.col("d"), F.floor((F.col("n") - 1) * F.lit(0.10) + 0.5), "ink_ref")
    return bg.join(ref, "image_id", "left").select("image_id", "background", (F.col("background") >= 128).alias("dark_on_light"), F.coalesce("ink_ref", F.lit(0.0)).alias("ink_ref"))


def dominant_colour(pixels: DataFrame, core: int = 150) -> DataFrame:
    """Mean colour of the pixels that are saturated enough."""
    some = pixels.where(C.saturation(*rgb()) >= core)
    return some.groupBy("image_id").agg(*[C.half_up(F.avg(c)).cast("int").alias(c) for c in RGB])


def dominant_ink(covered: DataFrame) -> DataFrame:
    """Lower median of each channel where coverage is at least a half. covered: pixels with `coverage`."""
    some = covered.where("coverage >= 0.5")
    parts = [kth(some, F.col(c), F.floor((F.col("n") - 1) / 2), c).drop("n") for c in RGB]
    return parts[0].join(parts[1], "image_id").join(parts[2], "image_id")


def duotone(pixels: DataFrame, off: float = 15.0, most: float = 0.02) -> DataFrame:
    """image_id, n_off, is_duotone: few pixels lie far from the segment between ink and paper in Lab."""
    p = pixels.join(otsu_luma(pixels), "image_id").withColumn("dark", C.luma601(*rgb()) <= F.col("threshold"))
    mean = lambda dark, c: C.half_up(F.avg(F.when(F.col("dark") == dark, F.col(c)))).cast("int").alias(f"{c}{int(dark)}")
    ends = p.groupBy("image_id").agg(*[mean(d, c) for d in (True, False) for c in RGB]).where("r1 is not null and r0 is not null")
    ends = ends.select("image_id", C.lab(*[F.col(f"{c}1") for c in RGB]).alias("p"), C.lab(*[F.col(f"{c}0") for c in RGB]).alias("q"))
    dot = lambda u, v: sum((u[c] * v[c] for c in "ab"), u["l"] * v["l"])
    sub = lambda u, v: {c: u[c] - v[c] for c in "lab"}
    lab_, a, b = F.col("lab"), F.col("p"), F.col("q")
    ab = sub(b, a)
    length = dot(ab, ab)
    t = F.when(length > 1e-12, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(sub(lab_, a), ab) / length))).otherwise(0.0)
    d = {c: lab_[c] - (a[c] + t * ab[c]) for c in "lab"}
    far = p.withColumn("lab", C.lab(*rgb())).join(ends, "image_id").withColumn("far", dot(d, d) > off * off)
    n = F.count(F.when(F.col("far"), 1))
    return far.groupBy("image_id").agg(n.alias("n_off"), (n <= F.count("*") * F.lit(most)).alias("is_duotone"))


def within_cluster_error(clustered: DataFrame) -> DataFrame:
    """Sum of squared Lab distances to cluster means. clustered: pixels with `cluster`."""
    p = clustered.select("image_id", "cluster", C.lab(*rgb()).alias("lab"))
    mid = p.groupBy("image_id", "cluster").agg(F.struct(*[F.avg(f"lab.{c}").alias(c) for c in "lab"]).alias("mid"))
    return p.join(mid, ["image_id", "cluster"]).groupBy("image_id").agg(F.sum(C.lab_distance_sq(F.col("lab"), F.col("mid"))).alias("error"))


def palette_nearest(pixels: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """pixels with `layer`: the palette colour nearest in Lab, the first of equal ones. The palette is a literal."""
    labs = [C.lab_of(p) for p in palette]
    own = C.with_lab(pixels)
    d = lambda q: sum(((F.col(f"_{c}") - q["lab".index(c)]) * (F.col(f"_{c}") - q["lab".index(c)]) for c in "ab"), (F.col("_l") - q[0]) * (F.col("_l") - q[0]))
    near = F.least(*[F.struct(d(q).alias("d"), F.lit(k).alias("k")) for k, q in enumerate(labs)]) if len(palette) > 1 else F.struct(F.lit(0).alias("k"))
    return own.select(*pixels.columns, near["k"].alias("layer"))
