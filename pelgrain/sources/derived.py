"""Rasters derived from ordinary tables, so that queries have images to work on.

Each has the columns of `pixels`: image_id, idx, x, y and channels. Values are integers, the same
in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clamp(x: Column, lo: int = 0, hi: int = 255) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images: v grey, and channels r, g, b, a shifted copies of it."""
    grey = F.transform("embedding", lambda e: clamp(F.floor(e.cast("double") * F.lit(240.0) + F.lit(128.5))).cast("int"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), grey.alias("vs"))
    at = lambda k: F.element_at("vs", (F.col("idx") + k) % 64 + 1)
    return e.select("image_id", "vs", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("idx")).select(
        "image_id", "idx", (F.col("idx") % 8).alias("x"), F.floor(F.col("idx") / 8).cast("int").alias("y"),
        at(0).alias("v"), at(0).alias("r"), at(21).alias("g"), at(42).alias("b"), at(11).alias("a"),
    )


def posterised(pixels: DataFrame, step: int = 64) -> DataFrame:
    """Channels in steps, so that colours repeat."""
    down = {c: (F.floor(F.col(c) / step) * step).cast("int") for c in ("r", "g", "b")}
    return pixels.withColumns(down)


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type: 24 hours across, the days of a month down, grey 40 for each event; cells without events are 0."""
    e = table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("x"), (F.dayofmonth("ts") - 1).alias("y"))
    n = e.groupBy("event_type", "x", "y").agg(F.count("*").alias("n"))
    grid = e.select("event_type").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(30))))
    v = clamp(F.coalesce("n", F.lit(0)) * 40).cast("int").alias("v")
    return grid.join(n, ["event_type", "x", "y"], "left").select(F.col("event_type").alias("image_id"), (F.col("y") * 24 + F.col("x")).alias("idx"), "x", "y", v)


def dens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by flag and status: quantity across (50), discount down (11), grey 3 for each item; larger values count at the rim."""
    li = table(spark, sf_dir, "lineitem")
    li = li.select(F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("image_id"), clamp(F.col("l_quantity").cast("int") - 1, 0, 49).alias("x"), clamp(F.floor(F.col("l_discount") * 100 + 0.5).cast("int"), 0, 10).alias("y"))
    n = li.groupBy("image_id", "x", "y").agg(F.count("*").alias("n"))
    grid = li.select("image_id").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(49)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(10))))
    v = clamp(F.coalesce("n", F.lit(0)) * 3).cast("int").alias("v")
    return grid.join(n, ["image_id", "x", "y"], "left").select("image_id", (F.col("y") * 50 + F.col("x")).alias("idx"), "x", "y", v)


def line_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as profiles: position k holds the length of line k."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("image_id", "pos", F.length("line").alias("v"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box for each order, on its customer's sheet: quantities across, prices (thousands) down."""
    price = F.floor(F.col("l_extendedprice") / 1000).cast("int")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_quantity").cast("int").alias("x1"), F.min(price).alias("y1"), (F.max("l_quantity").cast("int") + 1).alias("x2"), (F.max(price) + 1).alias("y2")
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("box_id"), F.col("o_custkey").alias("image_id"))
    b = o.join(li, F.col("box_id") == F.col("l_orderkey"))
    return b.select("image_id", "box_id", "x1", "y1", "x2", "y2", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("long").alias("area"))


def outlines(spark: SparkSession, sf_dir: str, points: int = 24) -> DataFrame:
    """Closed outlines of the boxes: (shape_id, k, x, y). By turns the box itself, an ellipse in it, a circle; every fifth is dented."""
    b = boxes(spark, sf_dir).select("box_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    side, f, t = F.floor(F.col("k") * 4 / points), F.col("k") % (points // 4) / (points / 4), F.col("k") * F.lit(6.283185307179586 / points)
    rx, ry = F.when(F.col("box_id") % 3 == 1, w / 2).otherwise(F.least(w, h) / 2), F.when(F.col("box_id") % 3 == 1, h / 2).otherwise(F.least(w, h) / 2)
    box_x = F.when(side == 0, F.col("x1") + f * w).when(side == 1, F.col("x2")).when(side == 2, F.col("x2") - f * w).otherwise(F.col("x1"))
    box_y = F.when(side == 0, F.col("y1")).when(side == 1, F.col("y1") + f * h).when(side == 2, F.col("y2")).otherwise(F.col("y2") - f * h)
    own = F.col("box_id") % 3 == 0
    dent = F.when((F.col("box_id") % 5 == 4) & (F.col("k") < 4), 2.7182).otherwise(0.0)
    x = F.when(own, box_x).otherwise(F.col("x1") + w / 2 + rx * F.cos(t)) + dent
    y = F.when(own, box_y).otherwise(F.col("y1") + h / 2 + ry * F.sin(t))
    return b.select(F.col("box_id").alias("shape_id"), "k", x.alias("x"), y.alias("y"))


# The same rasters in DuckDB's SQL.
EMB_SQL = """emb AS (
  SELECT image_id, i AS idx, i % 8 AS x, i // 8 AS y, vs[i + 1] AS v, vs[i + 1] AS r, vs[(i + 21) % 64 + 1] AS g, vs[(i + 42) % 64 + 1] AS b, vs[(i + 11) % 64 + 1] AS a
  FROM (SELECT vec_id AS image_id, [CAST(greatest(0, least(255, floor(CAST(e AS DOUBLE) * 240e0 + 128.5e0))) AS INT) for e in embedding] AS vs FROM embeddings) q,
       (SELECT CAST(range AS INT) AS i FROM range(64)) s)"""
POST_SQL = EMB_SQL + ", post AS (SELECT * REPLACE (r // 64 * 64 AS r, g // 64 * 64 AS g, b // 64 * 64 AS b) FROM emb)"
HEAT_SQL = """he AS (SELECT event_type, CAST(hour(ts) AS INT) AS x, CAST(day(ts) - 1 AS INT) AS y FROM events),
hn AS (SELECT event_type, x, y, count(*) AS n FROM he GROUP BY ALL),
heat AS (SELECT g.event_type AS image_id, g.y * 24 + g.x AS idx, g.x, g.y, CAST(greatest(0, least(255, coalesce(n, 0) * 40)) AS INT) AS v
  FROM (SELECT event_type, CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y FROM (SELECT DISTINCT event_type FROM he) t, range(24) a, range(31) b) g
  LEFT JOIN hn ON hn.event_type = g.event_type AND hn.x = g.x AND hn.y = g.y)"""
DENS_SQL = """dl AS (SELECT l_returnflag || '-' || l_linestatus AS image_id, greatest(0, least(49, CAST(l_quantity AS INT) - 1)) AS x, greatest(0, least(10, CAST(floor(l_discount * 100 + 0.5e0) AS INT))) AS y FROM lineitem),
dn AS (SELECT image_id, x, y, count(*) AS n FROM dl GROUP BY ALL),
dens AS (SELECT g.image_id, g.y * 50 + g.x AS idx, g.x, g.y, CAST(greatest(0, least(255, coalesce(n, 0) * 3)) AS INT) AS v
  FROM (SELECT image_id, CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y FROM (SELECT DISTINCT image_id FROM dl) t, range(50) a, range(11) b) g
  LEFT JOIN dn ON dn.image_id = g.image_id AND dn.x = g.x AND dn.y = g.y)"""
ROWS_SQL = """rows AS (SELECT doc_id AS image_id, CAST(unnest(range(len(l))) AS INT) AS pos, length(unnest(l)) AS v FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) q)"""
BOXES_SQL = """boxes AS (SELECT o_custkey AS image_id, o_orderkey AS box_id, x1, y1, x2, y2, CAST((x2 - x1) * (y2 - y1) AS BIGINT) AS area FROM orders JOIN (
  SELECT l_orderkey, CAST(min(l_quantity) AS INT) AS x1, min(CAST(floor(l_extendedprice / 1000) AS INT)) AS y1, CAST(max(l_quantity) AS INT) + 1 AS x2, max(CAST(floor(l_extendedprice / 1000) AS INT)) + 1 AS y2
  FROM lineitem GROUP BY 1) q ON l_orderkey = o_orderkey)"""
OUTLINES_SQL = BOXES_SQL + """, proc AS (SELECT box_id AS shape_id, k,
  CASE WHEN box_id % 3 = 0 THEN CASE k // 6 WHEN 0 THEN x1 + (k % 6)/6e0*w WHEN 1 THEN x2::DOUBLE WHEN 2 THEN x2 - (k % 6)/6e0*w ELSE x1::DOUBLE END ELSE x1 + w/2 + rx*cos(k*(6.283185307179586e0/24)) END + CASE WHEN box_id % 5 = 4 AND k < 4 THEN 2.7182e0 ELSE 0e0 END AS x,
  CASE WHEN box_id % 3 = 0 THEN CASE k // 6 WHEN 0 THEN y1::DOUBLE WHEN 1 THEN y1 + (k % 6)/6e0*h WHEN 2 THEN y2::DOUBLE ELSE y2 - (k % 6)/6e0*h END ELSE y1 + h/2 + ry*sin(k*(6.283185307179586e0/24)) END AS y
  FROM (SELECT *, CASE WHEN box_id % 3 = 1 THEN w/2 ELSE least(w, h)/2 END AS rx, CASE WHEN box_id % 3 = 1 THEN h/2 ELSE least(w, h)/2 END AS ry FROM (SELECT *, (x2 - x1)::DOUBLE AS w, (y2 - y1)::DOUBLE AS h FROM boxes) z) z, (SELECT CAST(range AS INT) AS k FROM range(24)) q)"""


def packed(pixels: DataFrame, width: int, height: int, channels: tuple[str, str, str] = ("r", "g", "b"), alpha: str | None = None, factor: int = 1) -> DataFrame:
    """Pixel rows -> packed images: image_id, width, height, rgba. One group for each image.

    Each pixel becomes a block of factor x factor: of its row when it is packed, of its column when rows are joined.
    """
    px = [F.col(c).cast("int") for c in channels] + [F.col(alpha).cast("int") if alpha else F.lit(255)]
    four = F.concat(*[F.lpad(F.hex(c.cast("long")), 2, "0") for c in px])
    rows = pixels.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.repeat(four, F.lit(factor)).alias("p")))).alias("ps"))
    whole = F.array_join(F.col("ps.p"), "")
    if factor > 1:
        whole = F.regexp_replace(whole, f"(.{{{8 * width * factor}}})", "$1" * factor)
    return rows.select(F.col("image_id").cast("string").alias("image_id"), F.lit(width * factor).alias("width"), F.lit(height * factor).alias("height"), F.unhex(whole).alias("rgba"))


def drawn(spark: SparkSession, n: int = 12, size: int = 64) -> DataFrame:
    """Packed images from formulas: discs, rings, boxes and crosses on white, by turns."""
    i = spark.range(n).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("idx"))
    x, y = F.col("idx") % size, F.floor(F.col("idx") / size).cast("int")
    r, mid = size * 0.25 + F.col("image_id") % 5, (size - 1) / 2
    d = F.sqrt((x - mid) * (x - mid) + (y - mid) * (y - mid))
    ax, ay = F.abs(x - mid), F.abs(y - mid)
    soft = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v + 0.5))
    cover = F.when(F.col("image_id") % 4 == 0, soft(r - d)).when(F.col("image_id") % 4 == 1, soft(F.least(r - d, d - r / 2))).when(F.col("image_id") % 4 == 2, soft(F.least(r - ax, r - ay))).otherwise(soft(F.greatest(F.least(r - ax, F.lit(4.0) - ay), F.least(r - ay, F.lit(4.0) - ax))))
    c = {n: F.floor(F.lit(255.0) * (1 - cover) + v * cover + 0.5).cast("int") for n, v in zip("rgb", (200, 40, 60), strict=True)}
    return packed(i.withColumns(c), size, size)


def sheets(spark: SparkSession, n: int = 2, cells: int = 3, pitch: int = 40) -> DataFrame:
    """Packed contact sheets: a grid of red rings and bars on white."""
    size = cells * pitch
    i = spark.range(n).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("idx"))
    x, y = F.col("idx") % size, F.floor(F.col("idx") / size).cast("int")
    u, v = x % pitch - pitch / 2 + 0.5, y % pitch - pitch / 2 + 0.5
    odd = (F.floor(x / pitch) + F.floor(y / pitch) + F.col("image_id")) % 2 == 1
    d = F.sqrt(u * u + v * v)
    on = F.when(odd, (F.abs(d - 10) <= 2)).otherwise(((F.abs(u) <= 12) & (F.abs(v) <= 2)) | ((F.abs(v) <= 12) & (F.abs(u) <= 2)))
    return packed(i.withColumns({"r": F.when(on, 210).otherwise(255), "g": F.when(on, 30).otherwise(255), "b": F.when(on, 50).otherwise(255)}), size, size)
