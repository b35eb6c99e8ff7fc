"""Profiles, runs with gaps, lattices, and rows of text or icons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def project(masked: DataFrame, axis: str) -> DataFrame:
    """image_id, pos, n: ink in each column (axis x) or row (axis y); positions without ink have 0."""
    return masked.groupBy("image_id", F.col(axis).alias("pos")).agg(F.count(F.when(F.col("ink"), 1)).alias("n"))


def find_bands(profile: DataFrame, value: str, min_run: int = 10, min_gap: int = 4, min_profile: int = 2, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, start, end (half open): runs of positions with enough ink, parted by gaps of min_gap, of min_run positions.

    Gaps and islands: only inked positions are windowed.
    """
    inked = profile.where(F.col(value) >= min_profile).select(*keys, "pos")
    w = W.partitionBy(*keys).orderBy("pos")
    fresh = F.when(F.col("pos") - F.lag("pos").over(w) - 1 >= min_gap, 1).otherwise(0)
    runs = inked.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(w))
    out = runs.groupBy(*keys, "_g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("_g")
    return out.where(F.col("end") - F.col("start") >= min_run)


def upper_median(df: DataFrame, value: Column, keys: list[str], name: str) -> DataFrame:
    """The value at place n / 2 of the sorted ones."""
    w = W.partitionBy(*keys)
    r = df.select(*keys, value.alias("_v")).select(*keys, "_v", (F.row_number().over(w.orderBy("_v")) - 1).alias("_k"), F.count("*").over(w).alias("_n"))
    return r.where(F.col("_k") == F.floor(F.col("_n") / 2)).select(*keys, F.col("_v").alias(name))


def both_projections(masked: DataFrame) -> DataFrame:
    """image_id, axis, pos, n: ink of columns (x) and rows (y) from one pass; positions without ink are left out."""
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("pos")) for a in "xy"])).alias("p")
    return masked.where("ink").select("image_id", at).groupBy("image_id", "p.axis", "p.pos").agg(F.count("*").alias("n"))


def refined_bands(profile: DataFrame, min_run: int, min_gap: int, min_profile: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Bands; where there are two or more, again with a quarter of their median length as the least run."""
    w = W.partitionBy(*keys)
    size = F.col("end") - F.col("start")
    b = find_bands(profile, "n", min_run, min_gap, min_profile, keys).withColumns({"_k": F.row_number().over(w.orderBy(size)) - 1, "_n": F.count("*").over(w)})
    b = b.withColumn("_m", F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2), size)).over(w))
    return b.where((F.col("_n") < 2) | (size >= F.greatest(F.floor(F.col("_m") / 4), F.lit(min_run)))).select(*keys, "start", "end")


def width_uniformity(bands: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, n, uniformity: 1 - spread / median of band widths; the spread is the range under four bands, then the quartiles'."""
    w = W.partitionBy(*keys)
    width = F.col("end") - F.col("start")
    r = bands.select(*keys, width.alias("v")).select(*keys, "v", (F.row_number().over(w.orderBy("v")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    at = lambda place: F.max(F.when(F.col("k") == place, F.col("v")))
    n = F.col("n")
    s = r.groupBy(*keys, "n").agg(at(F.floor(n / 2)).alias("m"), at(F.lit(0)).alias("lo"), at(n - 1).alias("hi"), at(F.floor(n / 4)).alias("q1"), at(F.floor(n * 3 / 4)).alias("q3"))
    spread = F.when(n < 4, F.col("hi") - F.col("lo")).otherwise(F.col("q3") - F.col("q1"))
    u = F.when(n < 2, 1.0).when(F.col("m") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.try_divide(spread, F.col("m")))))
    return s.select(*keys, "n", u.alias("uniformity"))


def cell_ink(masked: DataFrame, cols: DataFrame, rows: DataFrame) -> DataFrame:
    """image_id, col, row (start of each band), n: ink of every cell of the lattice."""
    c, r = cols.select("image_id", F.col("start").alias("col"), "end"), rows.select("image_id", F.col("start").alias("row"), "end")
    cells = c.select("image_id", "col").join(r.select("image_id", "row"), "image_id")
    # bands do not overlap: a pixel finds its column and its row by position, not by comparing it with every cell
    at = lambda b, name, axis: b.select("image_id", name, F.explode(F.sequence(F.col(name), F.col("end") - 1)).alias(axis))
    ink = masked.where("ink").select("image_id", "x", "y")
    hit = ink.join(at(c, "col", "x"), ["image_id", "x"]).join(at(r, "row", "y"), ["image_id", "y"]).groupBy("image_id", "col", "row").agg(F.count("*").alias("n"))
    return cells.join(hit, ["image_id", "col", "row"], "left").select("image_id", "col", "row", F.coalesce("n", F.lit(0)).alias("n"))


def score_lattice(masked: DataFrame, bands: DataFrame) -> DataFrame:
    """image_id, n_cols, n_rows, score: the least of cell occupancy and band uniformity; 0 for a single cell.

    bands: image_id, axis, start, end. A cell is filled from a tenth of the median cell on.
    """
    cells = cell_ink(masked, bands.where("axis = 'x'"), bands.where("axis = 'y'"))
    w = W.partitionBy("image_id")
    c = cells.withColumns({"_k": F.row_number().over(w.orderBy("n")) - 1, "_t": F.count("*").over(w)})
    c = c.withColumn("_m", F.max(F.when(F.col("_k") == F.floor(F.col("_t") / 2), F.col("n"))).over(w))
    occ = c.groupBy("image_id").agg((F.count(F.when(F.col("n") >= F.greatest(F.floor(F.col("_m") / 10), F.lit(1)), 1)) / F.count("*")).alias("occ"))
    on = lambda a, c: F.max(F.when(F.col("axis") == a, F.col(c)))
    u = width_uniformity(bands, ("image_id", "axis")).groupBy("image_id").agg(on("x", "n").alias("n_cols"), on("y", "n").alias("n_rows"), F.min("uniformity").alias("u"))
    score = F.when((F.col("n_cols") == 1) & (F.col("n_rows") == 1), 0.0).otherwise(F.least("occ", "u"))
    return occ.join(u, "image_id").select("image_id", "n_cols", "n_rows", score.alias("score"))


def infer_lattice(masked: DataFrame, min_run: int = 10, min_gap: int = 4, min_profile: int = 2, confidence: float = 0.75) -> DataFrame:
    """image_id, n_cols, n_rows, score, is_lattice. Images without bands on an axis have no row."""
    bands = refined_bands(both_projections(masked), min_run, min_gap, min_profile, ("image_id", "axis"))
    return score_lattice(masked, bands).withColumn("is_lattice", F.col("score") >= confidence)


def classify_rows(masked: DataFrame, min_run: int = 3, min_gap: int = 3, min_profile: int = 2, ratio: float = 1.8, outside: float = 0.05) -> DataFrame:
    """image_id, start, end, kind: row bands as icon or text.

    Heights are parted where the mean of the tall ones is most above that of the short ones; short
    rows with over 5 % of their ink outside the columns of the tall ones are text.
    """
    bands = find_bands(project(masked, "y"), "n", min_run, min_gap, min_profile).withColumn("h", F.col("end") - F.col("start"))
    w = W.partitionBy("image_id").orderBy("h", "start")
    all_ = W.partitionBy("image_id")
    s = bands.select("image_id", "h", F.row_number().over(w).alias("k"), F.count("*").over(all_).alias("n"), F.sum("h").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("low"), F.sum("h").over(all_).alias("sum"))
    r = ((F.col("sum") - F.col("low")) / (F.col("n") - F.col("k"))) / (F.col("low") / F.col("k"))
    best = s.where("k < n and n >= 3").select("image_id", "h", "k", r.alias("r")).groupBy("image_id").agg(F.max(F.struct("r", (-F.col("k")).alias("k"), "h")).alias("b"))
    best = best.where(F.col("b.r") >= ratio).select("image_id", F.col("b.h").alias("short"))
    cut = bands.join(best, "image_id")
    ink = masked.where("ink").select("image_id", "x", "y")
    tall = cut.where("h > short").select("image_id", "start", "end")
    cols = find_bands(project(ink.join(tall, "image_id").where("start <= y and y < end").select("image_id", "x", F.lit(True).alias("ink")), "x"), "n", min_run, min_gap, min_profile)
    cols = cols.select("image_id", F.col("start").alias("cs"), F.col("end").alias("ce"))
    has = cols.select("image_id").distinct()
    short = cut.join(has, "image_id").where("h <= short").select("image_id", "start", "end")
    seen = short.join(ink, "image_id").where("start <= y and y < end").join(cols, (F.col("x") >= F.col("cs")) & (F.col("x") < F.col("ce")) & (cols["image_id"] == short["image_id"]), "left").select(short["image_id"], "start", "cs")
    text = seen.groupBy("image_id", "start").agg(F.count("*").alias("t"), F.count(F.when(F.col("cs").isNull(), 1)).alias("o")).where(F.col("o") / F.col("t") > outside).select("image_id", "start", F.lit(True).alias("is_text"))
    return bands.join(text, ["image_id", "start"], "left").select("image_id", "start", "end", F.when(F.col("is_text"), "text").otherwise("icon").alias("kind"))


def strip_text_rows(masked: DataFrame, rows: DataFrame) -> DataFrame:
    """masked with the ink of text rows removed: an anti join by row."""
    y = rows.where("kind = 'text'").select("image_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("y"), F.lit(True).alias("_t"))
    return masked.join(y, ["image_id", "y"], "left").withColumn("ink", F.col("ink") & F.col("_t").isNull()).drop("_t")


def label_below(icons: DataFrame, labels: DataFrame) -> DataFrame:
    """image_id, start, end, label_start: the nearest label that starts after a band, within 1.5 times its height."""
    lab = labels.select("image_id", F.col("start").alias("ls"))
    ok = (F.col("ls") >= F.col("end")) & ((F.col("ls") - F.col("end")) * 2 <= (F.col("end") - F.col("start")) * 3)
    near = icons.join(lab, "image_id").where(ok).groupBy("image_id", "start", "end").agg(F.min("ls").alias("label_start"))
    return icons.join(near, ["image_id", "start", "end"], "left").select("image_id", "start", "end", "label_start")


def unify_widths(widths: DataFrame, tol: float, quantum: float, keys: list[str], order: str) -> DataFrame:
    """widths (keys, order, width) with `unified`: chains of near values take their median, in steps of the quantum."""
    w = W.partitionBy(*keys).orderBy("width", order)
    prev = F.lag("width").over(w)
    big = F.greatest(prev, F.col("width"))
    far = F.when(prev.isNull() | (F.when(big <= 0, F.when(prev == F.col("width"), 0.0).otherwise(float("inf"))).otherwise(F.abs(F.col("width") - prev) / big) > tol), 1).otherwise(0)
    c = widths.withColumn("_f", far).withColumn("_c", F.sum("_f").over(w))
    g = W.partitionBy(*keys, "_c")
    c = c.withColumns({"_k": F.row_number().over(g.orderBy("width", order)) - 1, "_n": F.count("*").over(g)})
    mid = lambda place: F.max(F.when(F.col("_k") == place, F.col("width"))).over(g)
    median = (mid(F.floor((F.col("_n") - 1) / 2)) + mid(F.floor(F.col("_n") / 2))) / 2.0
    return c.withColumn("unified", F.floor(median / quantum + 0.5) * quantum if quantum > 0 else median).drop("_f", "_c", "_k", "_n")


def sheet_widths(widths: DataFrame, keys: list[str]) -> DataFrame:
    """widths with `width_unified`: those within a fifth of the sheet's upper median, other than it, take it."""
    mid = upper_median(widths.where("width > 0"), F.col("width"), keys, "_m")
    near = F.col("width").between(F.col("_m") * 0.8, F.col("_m") * 1.2) & (F.col("width") > 0) & (F.col("width") != F.col("_m"))
    return widths.join(mid, keys, "left").withColumn("width_unified", F.when(near, F.col("_m"))).drop("_m")
