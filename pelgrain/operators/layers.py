"""Layer stacks and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pelgrain.functions import color as C


def stacked(coverage: DataFrame) -> DataFrame:
    """coverage (image_id, idx, z_order, cov): each layer also covers what any layer above it covers."""
    w = W.partitionBy("image_id", "idx").orderBy(F.col("z_order").desc())
    return coverage.withColumn("cov", F.max("cov").over(w))


def paint_order(layered: DataFrame) -> DataFrame:
    """image_id, layer, z_order: layers by first appearance in scan order."""
    f = layered.groupBy("image_id", "layer").agg(F.min("idx").alias("first_idx"))
    return f.withColumn("z_order", F.row_number().over(W.partitionBy("image_id").orderBy("first_idx")) - 1)


def background_policy(layers: DataFrame, background: DataFrame, policy: str = "drop") -> DataFrame:
    """layers (image_id, z_order, r, g, b) without the one nearest the background, if within Lab 10; the first of equal ones.

    `keep` leaves all; `rect` also returns `rect`, true for images whose background was found.
    """
    if policy == "keep":
        return layers
    bg = background.select("image_id", C.lab(F.col("r"), F.col("g"), F.col("b")).alias("_bg"))
    d = layers.join(bg, "image_id", "left").withColumn("_d", C.lab_distance_sq(C.lab(F.col("r"), F.col("g"), F.col("b")), F.col("_bg")))
    first = F.row_number().over(W.partitionBy("image_id").orderBy(F.col("_d").asc_nulls_last(), "z_order"))
    d = d.withColumn("_gone", F.coalesce((first == 1) & (F.col("_d") <= 100.0), F.lit(False)))
    if policy == "rect":
        d = d.withColumn("rect", F.bool_or("_gone").over(W.partitionBy("image_id")))
    return d.where("not _gone").drop("_bg", "_d", "_gone")


def mask_overlap(layers: DataFrame, masks: DataFrame, least: float = 0.6) -> DataFrame:
    """image_id, layer, mask_idx, num, den: for each layer the mask that covers most of it, if at least 0.6 of it.

    layers (image_id, layer, idx, cov), masks (image_id, mask_idx, idx, cov). The overlap is the sum
    of the lesser coverages; ties go to the first mask.
    """
    den = layers.groupBy("image_id", "layer").agg(F.sum(F.col("cov").cast("long")).alias("den")).where("den > 0")
    both = layers.join(masks.select("image_id", "mask_idx", "idx", F.col("cov").alias("m")), ["image_id", "idx"])
    num = both.groupBy("image_id", "layer", "mask_idx").agg(F.sum(F.least("cov", "m").cast("long")).alias("num"))
    r = num.join(den, ["image_id", "layer"]).where(F.col("num") >= F.col("den") * F.lit(least))
    rank = F.row_number().over(W.partitionBy("image_id", "layer").orderBy(F.col("num").desc(), "mask_idx"))
    return r.withColumn("_k", rank).where("_k = 1").drop("_k")


def mask_iou(masks: DataFrame, level: int = 128) -> DataFrame:
    """image_id, a, b, inter, uni: foreground overlaps of all mask pairs of an image; pairs without any have 0.

    masks (image_id, mask_idx, idx, cov). Sizes are counted once; the join is on foreground pixels.
    """
    on = masks.where(F.col("cov") >= level).select("image_id", "mask_idx", "idx")
    ids = masks.select("image_id", "mask_idx").distinct()
    n = ids.join(on.groupBy("image_id", "mask_idx").agg(F.count("*").alias("n")), ["image_id", "mask_idx"], "left").select("image_id", "mask_idx", F.coalesce("n", F.lit(0)).alias("n"))
    pairs = n.toDF("image_id", "a", "na").join(n.toDF("image_id", "b", "nb"), "image_id").where("a < b")
    hit = on.toDF("image_id", "a", "idx").join(on.toDF("image_id", "b", "idx"), ["image_id", "idx"]).where("a < b").groupBy("image_id", "a", "b").agg(F.count("*").alias("inter"))
    out = pairs.join(hit, ["image_id", "a", "b"], "left").withColumn("inter", F.coalesce("inter", F.lit(0)))
    return out.select("image_id", "a", "b", "inter", (F.col("na") + F.col("nb") - F.col("inter")).alias("uni"))


def stability(logits: DataFrame) -> DataFrame:
    """image_id, score: values over 1 against values over -1; nothing over -1 is 1, no values at all 0."""
    low, high = F.count(F.when(F.col("v") > -1, 1)), F.count(F.when(F.col("v") > 1, 1))
    return logits.groupBy("image_id").agg(F.when(F.count("v") == 0, 0.0).when(low == 0, 1.0).otherwise(high / low).alias("score"))


def grid_points(spark, n: int) -> DataFrame:
    """An n x n grid of points in the unit square, row by row."""
    return spark.range(n * n).select(((F.col("id") % n + 0.5) / n).alias("x"), ((F.floor(F.col("id") / n) + 0.5) / n).alias("y"))
