"""Per-pixel projections and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelgrain.functions import color as C

#: Chroma ink: alpha at least, saturation at least, brightest channel at most (fixed values).
ALPHA_MIN, SAT_MIN, VALUE_MAX = 10, 90, 250
#: Share of ink that makes a mask usable (fixed values).
USABLE = (0.001, 0.30)


def rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def matte(pixels: DataFrame, bg: tuple[int, int, int]) -> DataFrame:
    """Composite over a colour; the result is opaque."""
    return pixels.withColumns({c: C.composite(F.col(c), v, F.col("a")) for c, v in zip("rgb", bg, strict=True)} | {"a": F.lit(255)})


def threshold_alpha(pixels: DataFrame, t: int) -> DataFrame:
    return pixels.withColumn("a", F.when(F.col("a") >= t, 255).otherwise(0))


def apply_alpha_mode(pixels: DataFrame, mode: str, value: tuple[int, int, int] | int | None = None) -> DataFrame:
    if mode == "keep":
        return pixels
    if mode == "matte":
        return matte(pixels, value)
    if mode == "threshold":
        return threshold_alpha(pixels, value)
    raise ValueError(f"unknown alpha mode {mode}")


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The part of each image inside the rectangle, re-indexed; what lies outside the image is cut off."""
    inside = pixels.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    width = F.lit(w) if "width" not in pixels.columns else F.least(F.lit(w), F.col("width") - x)
    return inside.withColumns({"x": F.col("x") - x, "y": F.col("y") - y}).withColumn("idx", F.col("y") * width + F.col("x"))


def chroma_ink(alpha_min: int = ALPHA_MIN, sat_min: int = SAT_MIN, value_max: int = VALUE_MAX) -> Column:
    r, g, b = rgb()
    return (F.col("a") >= alpha_min) & (C.saturation(r, g, b) >= sat_min) & (F.greatest(r, g, b) <= value_max)


def ink_coverage(sat_ref: Column | int, alpha_min: int = ALPHA_MIN) -> Column:
    ref = F.lit(sat_ref) if isinstance(sat_ref, int) else sat_ref
    share = C.saturation(*rgb()).cast("float") / ref.cast("float")
    return F.when((F.col("a") < alpha_min) | (ref == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).cast("float")


def luma_coverage(lum: Column, background: Column, ink_ref: Column) -> Column:
    """Distance from the background against the reference contrast, in 0..1; ink where over 0.5."""
    return F.when(ink_ref <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.abs(lum - background) / ink_ref))


def mask_usable(masked: DataFrame, ink: str = "ink") -> DataFrame:
    """image_id, fraction of ink, usable."""
    share = F.avg(F.col(ink).cast("int"))
    return masked.groupBy("image_id").agg(share.alias("fraction"), share.between(*USABLE).alias("usable"))
