"""Queries on outlines, options, text and kernels of single steps, each with its DuckDB oracle beside it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from pelgrain import options as O
from pelgrain.functions import color as C
from pelgrain.functions import text as T
from pelgrain.operators import colours as H
from pelgrain.operators import fit as G
from pelgrain.operators import neighbourhood as N
from pelgrain.operators import pixels as P
from pelgrain.operators import shapes as S
from pelgrain.plans.queries import _A, _B, _EDGE, _L, PALETTE, _blend_sql, _box_sql, _lab_sql, _otsu_sql, _PAL, SAT, _solve_sql, _spread, LUMA, query
from pelgrain.sources import derived as D
from pelgrain.sources import images as I


def quarter(c, name: str):
    """Thousandths, rounded away from whole and half ones, where engines differ in the last bit."""
    return F.floor(c * 1000 + 0.25).alias(name)


def quarter_sql(c: str, name: str) -> str:
    return f"CAST(floor(({c})*1000 + 0.25e0) AS BIGINT) AS {name}"


# Shapes of tables.


@query(f"""WITH {D.OUTLINES_SQL}, b AS (SELECT shape_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM proc GROUP BY 1 HAVING max(x) - min(x) >= 1e-10 AND max(y) - min(y) >= 1e-10),
e AS (SELECT shape_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM proc WINDOW w AS (PARTITION BY shape_id ORDER BY k)),
f AS (SELECT b.shape_id, x0, y0, x1, y1, abs(sum(x*ny - nx*y)/2) AS area, max(least(abs(x - x0), abs(x - x1), abs(y - y0), abs(y - y1))) AS far FROM e JOIN b ON b.shape_id = e.shape_id GROUP BY ALL)
SELECT shape_id, {quarter_sql("x0", "x_milli")}, {quarter_sql("y0", "y_milli")}, {quarter_sql("x1 - x0", "width_milli")}, {quarter_sql("y1 - y0", "height_milli")},
 area >= (x1 - x0)*(y1 - y0)*0.93e0 AND far <= greatest(0.5e0, least(x1 - x0, y1 - y0)*0.15e0) AS accepted FROM f""")
def q71_rect_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rect_fit(D.outlines(spark, sf_dir)).select("shape_id", *[quarter(F.col(c), f"{c}_milli") for c in ("x", "y", "width", "height")], "accepted")


def _plain_solve() -> str:
    return _solve_sql().replace("CAST(floor(", "").replace("*1000 + 0.5e0) AS BIGINT) AS c", " AS c").replace("_milli", "")


_RECOGNISED = f"""cs AS (SELECT shape_id, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(y*y) AS syy, sum(x*y) AS sxy, -sum(x*x+y*y) AS v0, -sum(x*(x*x+y*y)) AS v1, -sum(y*(x*x+y*y)) AS v2 FROM proc GROUP BY 1),
cf AS (SELECT shape_id, {_plain_solve()} FROM cs),
cg AS (SELECT shape_id, -c1/2 AS cx, -c2/2 AS cy, sqrt(c1*c1/4 + c2*c2/4 - c0) AS r FROM cf WHERE c1*c1/4 + c2*c2/4 - c0 > 0),
ca AS (SELECT cg.shape_id, max(abs(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) - r)) <= least(greatest(0.5e0, 0.01e0*any_value(r)), 0.05e0*any_value(r)) AS ok FROM proc JOIN cg ON cg.shape_id = proc.shape_id GROUP BY 1),
es AS (SELECT shape_id, avg(x) AS cx, avg(y) AS cy, (max(x) - min(x))/2 AS rx, (max(y) - min(y))/2 AS ry, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM proc GROUP BY 1),
ed AS (SELECT es.*, x, y, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) AS d FROM proc JOIN es ON es.shape_id = proc.shape_id WHERE rx >= 1e-10 AND ry >= 1e-10),
ee AS (SELECT shape_id, max(abs(d - rx*ry/sqrt(pow(rx*(CASE WHEN d > 0 THEN (y-cy)/d ELSE 0e0 END), 2) + pow(ry*(CASE WHEN d > 0 THEN (x-cx)/d ELSE 1e0 END), 2)))) <= least(greatest(0.5e0, any_value(least(rx, ry))*0.01e0), any_value(least(rx, ry))*0.05e0) AS ok,
  max(least(abs(x - x0), abs(x - x1), abs(y - y0), abs(y - y1))) <= greatest(0.5e0, any_value(least(x1 - x0, y1 - y0))*0.15e0) AS near, any_value((x1 - x0)*(y1 - y0)) AS box FROM ed GROUP BY 1),
ar AS (SELECT shape_id, abs(sum(x*ny - nx*y)/2) AS area FROM (SELECT shape_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM proc WINDOW w AS (PARTITION BY shape_id ORDER BY k)) z GROUP BY 1),
kinds AS (SELECT s.shape_id, CASE WHEN ca.ok THEN 'circle' WHEN ee.ok THEN 'ellipse' WHEN ee.near AND ar.area >= box*0.93e0 THEN 'rect' END AS kind FROM (SELECT DISTINCT shape_id FROM proc) s LEFT JOIN ca ON ca.shape_id = s.shape_id LEFT JOIN ee ON ee.shape_id = s.shape_id LEFT JOIN ar ON ar.shape_id = s.shape_id)"""


@query(f"WITH {D.OUTLINES_SQL}, {_RECOGNISED} SELECT * FROM kinds")
def q72_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.recognise(D.outlines(spark, sf_dir))


@query(f"""WITH {D.OUTLINES_SQL}, m AS (SELECT shape_id, avg(x) AS axis FROM proc GROUP BY 1),
l AS (SELECT p.shape_id, p.k FROM proc p JOIN m ON m.shape_id = p.shape_id JOIN proc q ON q.shape_id = p.shape_id GROUP BY ALL HAVING min(sqrt((q.x - (2*axis - p.x))*(q.x - (2*axis - p.x)) + (q.y - p.y)*(q.y - p.y))) > 1)
SELECT shape_id, {quarter_sql("axis", "axis_milli")} FROM m WHERE shape_id NOT IN (SELECT shape_id FROM l)""")
def q73_mirror_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mirror_axes(D.outlines(spark, sf_dir)).select("shape_id", quarter(F.col("axis"), "axis_milli"))


_EDGES = "edges AS (SELECT shape_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM proc WINDOW w AS (PARTITION BY shape_id ORDER BY k))"


def _edges(outlines: DataFrame) -> DataFrame:
    w = W.partitionBy("shape_id").orderBy("k")
    all_ = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = [F.coalesce(F.lead(c).over(w), F.first(c).over(all_)).alias(f"{c}2") for c in "xy"]
    return outlines.select("shape_id", F.col("x").alias("x1"), F.col("y").alias("y1"), *nxt)


_PROBES = ((0.5, 0.513), (0.131, 0.172), (1.2, 0.51), (0.503, -0.1), (0.071, 0.957), (0.9, 0.11))


@query(f"""WITH {D.OUTLINES_SQL}, {_EDGES}, pts AS (SELECT box_id AS shape_id, point_id, x1 + fx*(x2 - x1) AS x, y1 + fy*(y2 - y1) AS y FROM boxes, (VALUES {", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in enumerate(_PROBES))}) v(point_id, fx, fy))
SELECT p.shape_id, p.point_id, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1)*(y - y1)/(y2 - y1) + x1) % 2 = 1 AS inside FROM pts p JOIN edges e ON e.shape_id = p.shape_id GROUP BY ALL""")
def q74_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = F.explode(F.array(*[F.struct(F.lit(k).alias("point_id"), F.lit(a).alias("fx"), F.lit(b).alias("fy")) for k, (a, b) in enumerate(_PROBES)])).alias("p")
    at = lambda c: (F.col(f"{c}1") + F.col(f"p.f{c}") * (F.col(f"{c}2") - F.col(f"{c}1"))).alias(c)
    points = D.boxes(spark, sf_dir).select("*", probes).select(F.col("box_id").alias("shape_id"), "p.point_id", at("x"), at("y"))
    return G.point_in_polygon(points, _edges(D.outlines(spark, sf_dir)))


@query(f"""WITH {D.OUTLINES_SQL}, e AS (SELECT shape_id, k, x - coalesce(lag(x) OVER w, last_value(x) OVER a) AS ax, y - coalesce(lag(y) OVER w, last_value(y) OVER a) AS ay, coalesce(lead(x) OVER w, first_value(x) OVER a) - x AS bx, coalesce(lead(y) OVER w, first_value(y) OVER a) - y AS by_
  FROM proc WINDOW w AS (PARTITION BY shape_id ORDER BY k), a AS (PARTITION BY shape_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT shape_id, count(*) FILTER (abs(atan2(ax*by_ - ay*bx, ax*bx + ay*by_))/pi() >= 0.3e0/1.34e0) AS n_corners FROM e GROUP BY 1""")
def q75_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.corners(D.outlines(spark, sf_dir), 0.3)
    return c.groupBy("shape_id").agg(F.count(F.when(F.col("corner"), 1)).alias("n_corners"))


@query(f"""WITH s AS (SELECT l_orderkey AS shape_id, avg(x) AS px, avg(y) AS py, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(y, y) AS d FROM (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE)/1000e0 AS y FROM lineitem) l GROUP BY 1 HAVING count(*) >= 3)
SELECT shape_id, {", ".join(quarter_sql(c, f"{n}_milli") for c, n in (("px", "px"), ("py", "py"), ("cos(atan2(b*2, a - d)/2)", "dx"), ("sin(atan2(b*2, a - d)/2)", "dy")))} FROM s""")
def q76_line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("shape_id"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000.0).alias("y"))
    some = li.withColumn("n", F.count("*").over(W.partitionBy("shape_id"))).where("n >= 3")
    return G.line_fit(some).select("shape_id", *[quarter(F.col(c), f"{c}_milli") for c in ("px", "py", "dx", "dy")])


_SEGMENTS = "seg AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_tax AS DOUBLE)*100e0 AS y1, CAST(l_extendedprice AS DOUBLE)/5000e0 AS x2, CAST(l_discount AS DOUBLE)*300e0 AS y2 FROM lineitem)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    li = D.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", d("l_quantity").alias("x1"), (d("l_tax") * 100.0).alias("y1"), (d("l_extendedprice") / 5000.0).alias("x2"), (d("l_discount") * 300.0).alias("y2"))


def _off_sql(s: float) -> str:
    r = f"((angle - {s!r}::DOUBLE + 90e0) % 180e0)"
    return f"((CASE WHEN {r} < 0 THEN ({r} + 180e0) % 180e0 ELSE {r} END) - 90e0)"


_SNAPS = (0.0, 45.0, 90.0, 135.0)


@query(f"""WITH {_SEGMENTS}, a AS (SELECT *, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS size, degrees(atan2(y2 - y1, x2 - x1)) AS angle FROM seg),
o AS (SELECT *, list_min([{", ".join(f"struct_pack(a := abs({_off_sql(s)}), k := {k}, d := {_off_sql(s)})" for k, s in enumerate(_SNAPS))}]) AS t FROM a),
r AS (SELECT *, size >= 1e-12 AND t.a <= 6 AS snapped, radians(angle - t.d) AS th FROM o)
SELECT l_orderkey, l_linenumber, snapped, {", ".join(quarter_sql(f"CASE WHEN snapped THEN ({c}1 + {c}2)/2 {sign} size/2*{f}(th) ELSE {c}{k} END", f"{c}{k}_milli") for c, f in (("x", "cos"), ("y", "sin")) for k, sign in ((1, "-"), (2, "+")))} FROM r""")
def q77_snapped_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.snapped_angles(_segments(spark, sf_dir), _SNAPS)
    return s.select("l_orderkey", "l_linenumber", "snapped", *[quarter(F.col(c), f"{c}_milli") for c in ("x1", "x2", "y1", "y2")])


@query(f"""WITH {_SEGMENTS}, g AS (SELECT l_orderkey, l_linenumber, x2 AS x, y1 + x1/7e0 AS y, floor(x2/0.5e0 + 0.5e0)*0.5e0 AS gx, floor((y1 + x1/7e0)/0.5e0 + 0.5e0)*0.5e0 AS gy FROM seg)
SELECT l_orderkey, l_linenumber, {", ".join(quarter_sql(f"CASE WHEN abs(x - gx) <= 0.2e0 AND abs(y - gy) <= 0.2e0 THEN g{c} ELSE {c} END", f"{c}_milli") for c in "xy")} FROM g""")
def q78_gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _segments(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("x2").alias("x"), (F.col("y1") + F.col("x1") / 7.0).alias("y"))
    return G.gridded(p, 0.5, 0.2).select("l_orderkey", "l_linenumber", *[quarter(F.col(c), f"{c}_milli") for c in "xy"])


@query(f"""WITH {D.BOXES_SQL}, ends AS (SELECT image_id, box_id*2 AS end_id, x1 AS x, y1 AS y FROM boxes UNION ALL SELECT image_id, box_id*2 + 1, x2, y2 FROM boxes)
SELECT p.image_id, p.end_id AS a, q.end_id AS b FROM ends p JOIN ends q ON p.image_id = q.image_id AND p.end_id < q.end_id AND (p.x - q.x)*(p.x - q.x) + (p.y - q.y)*(p.y - q.y) <= 9""")
def q79_weld_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.boxes(spark, sf_dir)
    end = lambda k: b.select("image_id", (F.col("box_id") * 2 + k - 1).alias("end_id"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    return G.weld_pairs(end(1).unionAll(end(2)), 3.0)


@query("""WITH e AS (SELECT l_orderkey AS image_id, unnest([CAST(l_linenumber AS BIGINT) % 4, CAST(l_partkey AS BIGINT) % 7]) AS n FROM lineitem), d AS (SELECT image_id, n, count(*) AS d FROM e GROUP BY ALL)
SELECT image_id, count(*) FILTER (d % 2 = 1) AS n_odd FROM d GROUP BY 1""")
def q80_odd_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = D.table(spark, sf_dir, "lineitem")
    return G.odd_nodes(li.select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber").cast("long") % 4).alias("from"), (F.col("l_partkey").cast("long") % 7).alias("to")))


@query(f"WITH {D.EMB_SQL} SELECT image_id, x // 4 + y // 4 * 2 AS component, max(v/16e0)*2 AS width, count(*) AS n FROM emb WHERE v > 100 GROUP BY ALL")
def q81_component_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = (F.floor(F.col("x") / 4) + F.floor(F.col("y") / 4) * 2).cast("int")
    return G.component_widths(D.emb(spark, sf_dir).where("v > 100").select("image_id", part.alias("component"), (F.col("v") / 16.0).alias("dist")))


@query(f"""WITH {D.BOXES_SQL}, p AS (SELECT box_id, ['circle', 'ellipse', 'rect'][CAST(box_id % 3 AS INT) + 1] AS kind, (x2 - x1)/2e0 AS rx, CASE WHEN box_id % 3 = 0 THEN (x2 - x1)/2e0 ELSE (y2 - y1)/2e0 END AS ry, CAST(x2 - x1 AS DOUBLE) AS w, CAST(y2 - y1 AS DOUBLE) AS h FROM boxes)
SELECT box_id, kind, {quarter_sql("CASE WHEN kind = 'rect' THEN (w + h)*2 - rx*(8 - 2*3.141592653589793e0) ELSE (rx + ry)*3.141592653589793e0*(1 + 3*pow((rx - ry)/(rx + ry), 2)/(10 + sqrt(4 - 3*pow((rx - ry)/(rx + ry), 2)))) END", "length_milli")} FROM p""")
def q82_outline_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    third = F.col("box_id") % 3
    kind = F.when(third == 0, "circle").when(third == 1, "ellipse").otherwise("rect")
    rx = w / 2.0
    ry = F.when(third == 0, rx).otherwise(h / 2.0)
    return D.boxes(spark, sf_dir).select("box_id", kind.alias("kind"), quarter(G.primitive_length(kind, rx, ry, w.cast("double"), h.cast("double")), "length_milli"))


def _coord_sql(v: str, precision: int) -> str:
    k = 10**precision
    whole = f"CAST(floor(abs({v})*{k} + 0.5e0) AS BIGINT)"
    return f"((CASE WHEN {v} < 0 AND {whole} > 0 THEN '-' ELSE '' END) || ({whole} // {k}) || '.' || lpad(({whole} % {k})::VARCHAR, {precision}, '0'))"


_PATH = (("M", ("x1/8e0", "y1 - 60e0")), ("L", ("x2/8e0", "y1/3e0")), ("C", ("x1 + 0.125e0", "y1/7e0", "-x2/6e0", "y2/9e0", "x2 + 0e0", "y2 + 0e0")), ("Z", ()))


def _path_sql(precision: int) -> str:
    return " || ' ' || ".join(" || ' ' || ".join([f"'{op}'", *[_coord_sql(f"({c})", precision) for c in cs]]) for op, cs in _PATH)


def _canonical_sql() -> str:
    parts = [f"'{op}'" + "".join(f" || {_coord_sql(f'({c})', 3)} || ','" for c in cs) for op, cs in _PATH]
    return " || ".join(parts) + " || '|path|' || printf('%02x%02x%02x', x1, y1 % 256, x2)"


@query(f"WITH {D.BOXES_SQL} SELECT box_id, {_path_sql(2)} AS d, 's-' || sha256({_canonical_sql()})[1:8] AS id FROM boxes")
def q83_path_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = F.array(*[F.struct(F.lit(op).alias("op"), F.array(*[F.expr(c.replace("e0", "D")) for c in cs]).cast("array<double>").alias("c")) for op, cs in _PATH])
    fill = F.struct(F.col("x1").alias("r"), (F.col("y1") % 256).alias("g"), F.col("x2").alias("b"))
    return D.boxes(spark, sf_dir).select("box_id", T.path_data(segments).alias("d"), T.stable_id(segments, fill).alias("id"))


_NODES_SQL = "nodes AS (SELECT * FROM (VALUES " + ", ".join(f"({(k + (n + 1) / 2) / 8!r}::DOUBLE, {w / 2 / 8!r}::DOUBLE)" for n, w in G.GAUSS for k in range(8)) + ") v(t, w))"


def _at_sql(c: str) -> str:
    return f"({c}0*(1-t)*(1-t)*(1-t) + {c}1*3*(1-t)*(1-t)*t + {c}2*3*(1-t)*t*t + {c}3*t*t*t)"


def _slope_sql(c: str) -> str:
    return f"(({c}1-{c}0)*3*(1-t)*(1-t) + ({c}2-{c}1)*6*(1-t)*t + ({c}3-{c}2)*3*t*t)"


_ARCS = "arcs AS (SELECT shape_id, k, " + ", ".join(f"lag({c}, {3 - j}) OVER w AS {c}{j}" if j < 3 else f"{c} AS {c}3" for c in "xy" for j in range(4)) + " FROM proc WINDOW w AS (PARTITION BY shape_id ORDER BY k))"


@query(f"""WITH {D.OUTLINES_SQL}, {_NODES_SQL}, {_ARCS}, c AS (SELECT * FROM arcs WHERE k % 3 = 0 AND k > 0),
g AS (SELECT shape_id, sum(w*({_at_sql("x")}*{_slope_sql("y")} - {_at_sql("y")}*{_slope_sql("x")}))/2 AS area, sum(w*sqrt({_slope_sql("x")}*{_slope_sql("x")} + {_slope_sql("y")}*{_slope_sql("y")})) AS length FROM c, nodes GROUP BY 1)
SELECT shape_id, {quarter_sql("area", "area_milli")}, {quarter_sql("length", "length_milli")} FROM g""")
def q84_cubic_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("shape_id").orderBy("k")
    arcs = D.outlines(spark, sf_dir).select("shape_id", "k", *[(F.lag(c, 3 - j).over(w) if j < 3 else F.col(c)).alias(f"{c}{j}") for c in "xy" for j in range(4)])
    g = G.cubic_geometry(arcs.where("k % 3 = 0 and k > 0"))
    return g.select("shape_id", quarter(F.col("area"), "area_milli"), quarter(F.col("length"), "length_milli"))


@query(f"""WITH {D.OUTLINES_SQL}, {_EDGES}, v AS (SELECT p.shape_id, p.k, p.x, p.y, b.image_id FROM proc p JOIN boxes b ON b.box_id = p.shape_id),
bb AS (SELECT shape_id, any_value(image_id) AS image_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS n FROM v GROUP BY 1),
ar AS (SELECT shape_id, abs(sum(x1*y2 - x2*y1)/2) AS area FROM edges GROUP BY 1),
pr AS (SELECT a.shape_id AS outer_id, b.shape_id, b.n FROM bb a JOIN bb b ON a.image_id = b.image_id AND a.shape_id <> b.shape_id AND b.x1 >= a.x1 - 1e-9 AND b.y1 >= a.y1 - 1e-9 AND b.x2 <= a.x2 + 1e-9 AND b.y2 <= a.y2 + 1e-9
  JOIN ar c ON c.shape_id = a.shape_id JOIN ar d ON d.shape_id = b.shape_id AND d.area < 0.98e0*c.area),
pt AS (SELECT pr.outer_id, pr.shape_id, any_value(pr.n) AS n, v.k, count(*) FILTER ((e.y1 > v.y) <> (e.y2 > v.y) AND v.x < (e.x2 - e.x1)*(v.y - e.y1)/(e.y2 - e.y1) + e.x1) % 2 AS c FROM pr JOIN v ON v.shape_id = pr.shape_id JOIN edges e ON e.shape_id = pr.outer_id GROUP BY pr.outer_id, pr.shape_id, v.k),
h AS (SELECT outer_id, shape_id FROM pt GROUP BY ALL HAVING sum(c) = any_value(n))
SELECT bb.image_id, bb.shape_id, count(h.outer_id) AS depth FROM bb LEFT JOIN h ON h.shape_id = bb.shape_id GROUP BY ALL""")
def q85_outline_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.outlines(spark, sf_dir).join(D.boxes(spark, sf_dir).select(F.col("box_id").alias("shape_id"), "image_id"), "shape_id")
    return S.outline_depth(o)


# Options and texts.


@query("""WITH s AS (SELECT p_partkey, CAST(p_size AS INT)*60 AS w, CAST(p_partkey % 13 + 1 AS INT)*150 AS h FROM part), f AS (SELECT *, least(1e0, 1024e0/greatest(w, h)) AS f FROM s)
SELECT p_partkey, f AS factor, 0.7e0*f AS tolerance, CASE WHEN f = 1 THEN 20 ELSE CAST(greatest(1, floor(20*f*f + 0.5e0)) AS INT) END AS turdsize FROM f""")
def q86_scaled_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = O.downscale_factor(F.col("p_size").cast("int") * 60, (F.col("p_partkey") % 13 + 1).cast("int") * 150, 1024)
    p = D.table(spark, sf_dir, "part").select("p_partkey", f.alias("factor"))
    return p.select("p_partkey", "factor", O.scaled_geometry(F.col("factor"), F.lit(0.7), F.lit(20)).alias("g")).select("p_partkey", "factor", "g.tolerance", "g.turdsize")


@query("""SELECT page_id, page_id % 3 = 0 AS jpeg, strlen(html) + 3 > 600 AS too_large, CASE WHEN strlen(html) + 3 > 600 THEN CAST(strlen(html) + 3 AS BIGINT) END AS value, CASE WHEN strlen(html) + 3 > 600 THEN 'input-bytes' END AS kind, page_id % 5 = 0 AS broken FROM pages""")
def q87_input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("FFD8FF"))).otherwise(F.unhex(F.lit("89504E")))
    coded = F.base64(F.concat(head, F.encode("html", "utf-8")))
    text = F.concat(F.when(F.col("page_id") % 2 == 0, "data:image/png;base64,").otherwise(""), coded)
    p = D.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(text, r"\s", "").alias("b"), F.when(F.col("page_id") % 5 == 0, F.concat(text, F.lit("!?"))).alias("bad"))
    good = I.read_base64(p, "b", "page_id").select(F.col("image_id").alias("page_id"), I.is_jpeg(F.col("content")).alias("jpeg"), I.limit_error(F.col("content"), O.Options(max_input_bytes=600)).alias("e"))
    bad = I.read_base64(p, "bad", "page_id").select(F.col("image_id").alias("page_id"), F.col("content").isNull().alias("none"))
    return good.join(bad, "page_id").select("page_id", "jpeg", F.col("e").isNotNull().alias("too_large"), "e.value", "e.kind", (F.col("none") & (F.col("page_id") % 5 == 0)).alias("broken"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 97 AS DOUBLE)/4 + 0.1e0 AS x, CAST(o_totalprice AS DOUBLE) AS area, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS z FROM orders)
SELECT o_custkey AS image_id, CAST(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS version, count(*) AS n_nodes, CAST(count(*)*7 AS BIGINT) AS n_bytes, 's-' || min(o_orderkey) AS first_id, CAST(floor(max(area)*10 + 0.25e0) AS BIGINT) AS most,
 '### SVG inspection' || chr(10) || chr(10) || '- **Schema version**: ' || CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END || chr(10) || '- **Nodes**: ' || count(*) || chr(10) || '- **Paths**: ' || count(*) || chr(10) || '- **Bytes**: ' || count(*)*7 || chr(10) || chr(10)
 || '| Node | Group | Shape | Paint | Box | Centroid | Area | Length | Draw order |' || chr(10) || '|---|---|---|---|---|---|---|---|---|' || chr(10)
 || string_agg(printf('| `s-%d` | g-%d | %s | %s | (%.2f, 0.00, %.2f, 2.00) | (1.00, 2.00) | 3.00 | 4.00 | %d |', o_orderkey, o_orderkey % 5, CASE WHEN o_orderkey % 3 = 0 THEN 'rect' ELSE 'path (open)' END, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE printf('rgb(%d, %d, 7)', o_orderkey % 256, z) END, x, x + 1, z) || chr(10), '' ORDER BY o_orderkey) AS report
FROM n GROUP BY o_custkey""")
def q88_sidecar_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders").withColumn("z", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    k, x = F.col("o_orderkey"), F.col("o_orderkey") % 97 / 4.0 + 0.1
    node = F.struct(
        k.alias("at"), F.concat(F.lit("s-"), k).alias("id"), F.struct(x.alias("x_min"), F.lit(0.0).alias("y_min"), (x + 1).alias("x_max"), F.lit(2.0).alias("y_max")).alias("bbox"), F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).alias("centroid"),
        F.lit(3.0).alias("area"), F.when(k % 4 != 0, F.struct((k % 256).alias("r"), F.col("z").alias("g"), F.lit(7).alias("b"))).alias("fill"), F.concat(F.lit("g-"), k % 5).alias("group"), F.col("z").alias("z_order"), F.col("z").alias("suggested_draw_order"),
        F.when(k % 3 == 0, "rect").otherwise("path").alias("shape"), (k % 3 == 0).alias("closed"), F.lit(4.0).alias("path_length"),
    )
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.max(F.col("o_totalprice").cast("double")).alias("most"), F.count("*").alias("n"))
    meta = F.to_json(F.struct(F.when(F.col("o_custkey") % 2 == 0, 1).alias("schema_version"), "nodes", F.struct(F.col("n").alias("node_count"), F.col("n").alias("path_count"), (F.col("n") * 7).alias("byte_count")).alias("stats")))
    m = I.read_sidecar(g.select(F.col("o_custkey").alias("image_id"), meta.alias("meta_json"), "most"))
    return m.select("image_id", F.col("meta.schema_version").alias("version"), F.size("meta.nodes").cast("long").alias("n_nodes"), F.col("meta.stats.byte_count").alias("n_bytes"), F.col("meta.nodes")[0]["id"].alias("first_id"), F.floor(F.col("most") * 10 + 0.25).alias("most"), T.markdown_report(F.col("meta")).alias("report"))


_SVG = '<svg viewBox="0 0 9 9"><g id="a{0}"><path id="p{0}" fill="#{1}" d="M 0 0"/><g id="b{0}"><rect id="r{0}" fill="none"/></g><circle id="c{0}"/></g><ellipse fill="red"/><g><path id="q{0}"/></g></svg>'


@query("""WITH p AS (SELECT p_partkey AS image_id, printf('%06d', p_partkey % 1000000) AS f FROM part)
SELECT image_id, 2 AS pos, 'path' AS name, 'p' || image_id AS id, '#' || f AS fill, 'a' || image_id AS "group" FROM p UNION ALL SELECT image_id, 4, 'rect', 'r' || image_id, 'none', 'b' || image_id FROM p
UNION ALL SELECT image_id, 6, 'circle', 'c' || image_id, NULL, 'a' || image_id FROM p UNION ALL SELECT image_id, 8, 'ellipse', NULL, 'red', NULL FROM p UNION ALL SELECT image_id, 10, 'path', 'q' || image_id, NULL, NULL FROM p""")
def q89_parse_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    svg = F.format_string(_SVG.replace("%", "%%").replace("{0}", "%1$d").replace("{1}", "%2$06d"), F.col("p_partkey"), F.col("p_partkey") % 1000000)
    return T.parse_shapes(D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), svg.alias("svg")))


# Colours and classes.


def _rgb_sql(l: str, a: str, b: str) -> list[str]:
    inv = lambda t: f"(CASE WHEN {t} > {C.DELTA!r}::DOUBLE THEN {t}*{t}*{t} ELSE ({t} - {4.0 / 29.0!r}::DOUBLE)*{3.0 * C.DELTA * C.DELTA!r}::DOUBLE END)"
    fy = f"(({l} + 16e0)/116e0)"
    xyz = [f"({inv(t)}*{n!r}::DOUBLE)" for t, n in ((f"({a}/500e0 + {fy})", C.XN), (fy, C.YN), (f"({fy} - {b}/200e0)", C.ZN))]
    out = []
    for row in C.FROM_XYZ:
        v = f"least(1e0, greatest(0e0, {' + '.join(f'{x}*{m!r}::DOUBLE' for x, m in zip(xyz, row, strict=True))}))"
        out.append(f"CAST(least(255, floor((CASE WHEN {v} <= 0.0031308e0 THEN {v}*12.92e0 ELSE pow({v}, {1 / 2.4!r}::DOUBLE)*1.055e0 - 0.055e0 END)*255e0 + 1e0)) AS INT)")
    return out


@query(f"WITH {D.EMB_SQL}, e AS (SELECT image_id, idx, {_L} + 0.37e0 AS l, {_A}/2 AS a_, {_B} - 1.3e0 AS b_ FROM emb) SELECT image_id, idx, " + ", ".join(f"{e} AS {c}" for e, c in zip(_rgb_sql("l", "a_", "b_"), "rgb", strict=True)) + " FROM e")
def q90_lab_to_srgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.with_lab(D.emb(spark, sf_dir)).select("image_id", "idx", F.struct((F.col("_l") + 0.37).alias("l"), (F.col("_a") / 2).alias("a"), (F.col("_b") - 1.3).alias("b")).alias("p"))
    return p.select("image_id", "idx", C.lab_to_srgb(F.col("p")).alias("c")).select("image_id", "idx", "c.*")


@query(f"""WITH {D.HEAT_SQL}, k AS (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM heat WHERE {_EDGE}),
m AS (SELECT image_id, CAST(v AS DOUBLE) AS background FROM k WHERE k = (n-1)//2),
d AS (SELECT h.image_id, abs(h.v - background) AS d FROM heat h JOIN m ON m.image_id = h.image_id WHERE abs(h.v - background) > 40),
r AS (SELECT image_id, d, row_number() OVER (PARTITION BY image_id ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM d),
f AS (SELECT m.image_id, background, coalesce(r.d, 0e0) AS ref FROM m LEFT JOIN r ON r.image_id = m.image_id AND r.k = floor((n-1)*0.1e0 + 0.5e0)),
c AS (SELECT h.image_id, idx, CASE WHEN ref <= 0 THEN 0e0 ELSE least(1e0, abs(v - background)/ref) END AS c FROM heat h JOIN f ON f.image_id = h.image_id)
SELECT image_id, idx, {quarter_sql("c", "coverage_milli")}, c > 0.5e0 AS ink FROM c""")
def q91_luma_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = D.heat(spark, sf_dir)
    c = P.luma_coverage(F.col("v").cast("double"), F.col("background"), F.col("ink_ref"))
    return h.join(H.luma_analysis(h, "v"), "image_id").select("image_id", "idx", quarter(c, "coverage_milli"), (c > 0.5).alias("ink"))


_CLASSED = D.EMB_SQL + ", post AS (SELECT * REPLACE (r // 64 * 64 AS r, g // 64 * 64 AS g, b // 64 * 64 AS b, CASE WHEN image_id % 2 = 0 THEN 255 ELSE a END AS a) FROM emb), luma AS (SELECT *, CAST(floor((r*0.299e0 + g*0.587e0 + b*0.114e0)*1000 + 0.5e0) AS BIGINT) AS lu FROM post)"


@query(f"""WITH {_CLASSED}, {_blend_sql()}, {_box_sql("luma", 1, "lu", "image_id, idx, x, y, lu")},
li AS (SELECT image_id, count(*) FILTER (lu*n < s - 10000*n)*4 < count(*) AS line_art FROM bz GROUP BY 1),
h AS (SELECT image_id, r, g, b, count(*) AS n FROM post GROUP BY ALL), hh AS (SELECT image_id, count(*) AS n_colours, count(*) FILTER (n >= 1) AS above FROM h GROUP BY 1),
al AS (SELECT image_id, bool_or(a <> 255) AS has_alpha, bool_or(a <> 255) AND count(DISTINCT a) FILTER (a > 0 AND a < 255) <= 2 AS flat_alpha FROM post GROUP BY 1),
f AS (SELECT hh.image_id, n_colours BETWEEN 3 AND 64 AND NOT has_alpha AND NOT coalesce(y.aa, false) AS pixel_art, line_art, flat_alpha, above FROM hh JOIN al ON al.image_id = hh.image_id JOIN li ON li.image_id = hh.image_id LEFT JOIN y ON y.image_id = hh.image_id)
SELECT image_id, CASE WHEN pixel_art THEN 'pixel-art' WHEN line_art THEN 'line-art' WHEN flat_alpha OR above <= 32 THEN 'icon' ELSE 'photo' END AS mode FROM f""")
def q92_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.posterised(D.emb(spark, sf_dir)).withColumn("a", F.when(F.col("image_id") % 2 == 0, 255).otherwise(F.col("a")))
    return N.classify(p)


@query(f"""WITH {_otsu_sql(D.EMB_SQL, LUMA, "emb", "true", 127).split("WITH ", 1)[1].replace("SELECT i.image_id", ", th AS (SELECT i.image_id", 1) + ")"},
p AS (SELECT emb.*, (r*0.299e0 + g*0.587e0 + b*0.114e0) <= threshold AS dark FROM emb JOIN th ON th.image_id = emb.image_id),
e AS (SELECT image_id, {", ".join(f"CAST(floor(avg({c}) FILTER ({'' if d else 'NOT '}dark) + 0.5e0) AS INT) AS {c}{int(d)}" for d in (True, False) for c in "rgb")} FROM p GROUP BY 1),
z AS (SELECT image_id, {", ".join(f"{x} AS {n}1" for x, n in zip(_lab_sql("r1", "g1", "b1"), ("l", "a", "b"), strict=True))}, {", ".join(f"{x} AS {n}0" for x, n in zip(_lab_sql("r0", "g0", "b0"), ("l", "a", "b"), strict=True))} FROM e WHERE r1 IS NOT NULL AND r0 IS NOT NULL),
q AS (SELECT image_id, {_L} AS l, {_A} AS a_, {_B} AS b_ FROM p),
u AS (SELECT q.image_id, q.l - z.l1 AS dl, q.a_ - z.a1 AS da, q.b_ - z.b1 AS db, z.l0 - z.l1 AS vl, z.a0 - z.a1 AS va, z.b0 - z.b1 AS vb FROM q JOIN z ON z.image_id = q.image_id),
t AS (SELECT *, CASE WHEN vl*vl + va*va + vb*vb > 1e-12 THEN least(1e0, greatest(0e0, (dl*vl + da*va + db*vb)/(vl*vl + va*va + vb*vb))) ELSE 0e0 END AS t FROM u)
SELECT image_id, count(*) FILTER ((dl - t*vl)*(dl - t*vl) + (da - t*va)*(da - t*va) + (db - t*vb)*(db - t*vb) > 225) AS n_off, count(*) FILTER ((dl - t*vl)*(dl - t*vl) + (da - t*va)*(da - t*va) + (db - t*vb)*(db - t*vb) > 225) <= count(*)*0.02e0 AS is_duotone FROM t GROUP BY 1""")
def q93_duotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.duotone(D.emb(spark, sf_dir))


@query(f"WITH {D.EMB_SQL}, h AS (SELECT image_id, r // 128 * 128 AS r, g // 128 * 128 AS g, b // 128 * 128 AS b, count(*) AS n, min(idx) AS first_idx FROM emb GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY first_idx) AS INT) AS scan_rank, count(*) OVER (PARTITION BY image_id) AS k FROM h) SELECT * EXCLUDE (k) FROM k WHERE k <= 7")
def q94_exact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.exact_clusters(D.posterised(D.emb(spark, sf_dir), 128), 7)


# Kernels of one step, on packed images.


def _kernel(spark: SparkSession, sf_dir: str, fields: str, one, step: int = 1) -> DataFrame:
    """One row for each (key..., value) that `one` gives of an 8 x 8 image's array (8, 8, 4), r, g, b, a."""
    from pelgrain.plans.convert import _rows, unpack

    p = D.emb(spark, sf_dir)
    images = _spread(D.packed(D.posterised(p, step) if step > 1 else p, 8, 8, alpha="a"))
    schema = T_._parse_datatype_string("image_id string, " + fields)
    names = schema.names

    def rows(r: dict) -> list[dict]:
        return [dict(zip(names, (r["image_id"], *x), strict=True)) for x in one(unpack(r["width"], r["height"], r["rgba"]))]

    return _rows(images, schema, rows).withColumn("image_id", F.col("image_id").cast("long"))


@query(f"WITH {D.EMB_SQL} SELECT image_id, idx, r, g, b, a, 8 AS width, false AS was_jpeg FROM emb")
def q95_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.kernels import png

    files = _kernel(spark, sf_dir, "content binary", lambda px: [(png.encode_png(px),)])
    images = I.decode(files.select(F.col("image_id").cast("string").alias("image_id"), "content")).where("error is null")
    px = I.pixels(images).join(images.select("image_id", "width", "was_jpeg"), "image_id")
    return px.select(F.col("image_id").cast("long").alias("image_id"), "idx", *[F.col(c).cast("int").alias(c) for c in "rgba"], "width", "was_jpeg")


def _components(name: str, source: str, near: str) -> str:
    """name (image_id, idx, root): connected cells of source by the recursive closure."""
    return f"""{name}l AS (SELECT a.image_id, a.idx, b.idx AS other FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND {near}),
{name}c AS (SELECT image_id, idx, idx AS root FROM {source} UNION SELECT l.image_id, l.other, c.root FROM {name}c c JOIN {name}l l ON l.image_id = c.image_id AND l.idx = c.idx),
{name} AS (SELECT image_id, idx, min(root) AS root FROM {name}c GROUP BY ALL)"""


_EIGHT, _FOUR = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1", "abs(a.x - b.x) + abs(a.y - b.y) <= 1"


@query(f"WITH RECURSIVE {D.EMB_SQL}, ink AS (SELECT image_id, idx, x, y FROM emb WHERE v > 127), {_components('rg', 'ink', _FOUR)} SELECT image_id, idx, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INT) AS region FROM rg")
def q96_regions_by_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.regions(D.emb(spark, sf_dir), F.col("v") > 127, 8, eight=False)


@query(f"""WITH RECURSIVE {D.EMB_SQL}, ink AS (SELECT image_id, idx, x, y FROM emb WHERE v > 127), paper AS (SELECT image_id, idx, x, y FROM emb WHERE v <= 127),
{_components("f", "ink", _EIGHT)}, {_components("b", "paper", _FOUR)},
small AS (SELECT image_id, root, 0 AS v FROM f GROUP BY ALL HAVING count(*) < 4 UNION ALL SELECT b.image_id, b.root, 255 FROM b JOIN paper p ON p.image_id = b.image_id AND p.idx = b.idx GROUP BY ALL HAVING count(*) < 4 AND count(*) FILTER (x IN (0, 7) OR y IN (0, 7)) = 0),
r AS (SELECT * FROM f UNION ALL SELECT * FROM b)
SELECT e.image_id, e.idx, coalesce(s.v, e.v) AS v FROM emb e JOIN r ON r.image_id = e.image_id AND r.idx = e.idx LEFT JOIN small s ON s.image_id = r.image_id AND s.root = r.root AND (s.v = 0) = (e.v > 127)""")
def q97_despeckle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.kernels.raster import despeckle

    return _kernel(spark, sf_dir, "idx int, v int", lambda px: [(k, int(v)) for k, v in enumerate(despeckle(px[..., 0], 4)[1:-1, 1:-1].ravel())])


#: Edges of a cell that a contour joins, so that ink lies to the right: by corner state, and the two saddles by the cell's mean.
_TURNS = {1: "T>L", 2: "R>T", 4: "B>R", 8: "L>B", 14: "L>T", 13: "T>R", 11: "R>B", 7: "B>L", 3: "R>L", 12: "L>R", 6: "B>T", 9: "T>B"}
_VERTICES = f"""i AS (SELECT DISTINCT image_id FROM emb), g AS (SELECT image_id, CAST(a.range AS INT) - 1 AS x, CAST(b.range AS INT) - 1 AS y FROM i, range(10) a, range(10) b),
p AS (SELECT g.*, coalesce(v, 0) AS v FROM g LEFT JOIN emb ON emb.image_id = g.image_id AND emb.x = g.x AND emb.y = g.y),
c AS (SELECT image_id, x, y, v AS tl, lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS tr, lead(v) OVER (PARTITION BY image_id, x ORDER BY y) AS bl FROM p),
c4 AS (SELECT *, lead(tr) OVER (PARTITION BY image_id, x ORDER BY y) AS br FROM c),
s AS (SELECT *, tl + tr + bl + br AS t, (tl > 127)::INT + 2*(tr > 127)::INT + 4*(br > 127)::INT + 8*(bl > 127)::INT AS s FROM c4 WHERE tr IS NOT NULL AND bl IS NOT NULL AND br IS NOT NULL),
u AS (SELECT *, unnest(CASE {" ".join(f"WHEN s = {k} THEN ['{v}']" for k, v in _TURNS.items())} WHEN s = 5 THEN CASE WHEN t <= 510 THEN ['T>R', 'B>L'] ELSE ['T>L', 'B>R'] END WHEN s = 10 THEN CASE WHEN t <= 510 THEN ['L>T', 'R>B'] ELSE ['R>T', 'L>B'] END ELSE [] END) AS e FROM s),
ends AS (SELECT image_id, {", ".join(f"CASE e[{k}] WHEN 'T' THEN {t} WHEN 'B' THEN {b} WHEN 'L' THEN {l} ELSE {r} END AS {n}" for k, m in ((1, "1"), (3, "2")) for n, t, b, l, r in ((f"x{m}", "x + (127.5e0 - tl)/(tr - tl)", "x + (127.5e0 - bl)/(br - bl)", "x::DOUBLE", "x + 1e0"), (f"y{m}", "y::DOUBLE", "y + 1e0", "y + (127.5e0 - tl)/(bl - tl)", "y + (127.5e0 - tr)/(br - tr)"), (f"n{m}", "(y + 1)*1000 + x + 1", "(y + 2)*1000 + x + 1", "(y + 1)*1000 + x + 501", "(y + 1)*1000 + x + 502")))} FROM u)"""


@query(f"""WITH RECURSIVE {D.EMB_SQL}, {_VERTICES}, lk AS (SELECT image_id, n1 AS a, n2 AS b FROM ends UNION SELECT image_id, n2, n1 FROM ends),
r AS (SELECT image_id, a AS n, a AS root FROM lk UNION SELECT lk.image_id, lk.b, r.root FROM r JOIN lk ON lk.image_id = r.image_id AND lk.a = r.n),
k AS (SELECT image_id, count(DISTINCT m) AS n_contours FROM (SELECT image_id, n, min(root) AS m FROM r GROUP BY ALL) z GROUP BY 1)
SELECT e.image_id, any_value(n_contours) AS n_contours, count(*) AS n_points, CAST(floor(sum(x1*y2 - x2*y1)/2*1000 + 0.25e0) AS BIGINT) AS area_milli FROM ends e JOIN k ON k.image_id = e.image_id GROUP BY e.image_id""")
def q98_contour_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.kernels.raster import contours

    c = _kernel(spark, sf_dir, "depth int, n long, area double", lambda px: [(k["depth"], len(k["points"]), float(k["area"])) for k in contours(px[..., 0])])
    signed = F.sum(F.when(F.col("depth") % 2 == 0, F.col("area")).otherwise(-F.col("area")))
    return c.groupBy("image_id").agg(F.count("*").alias("n_contours"), F.sum("n").alias("n_points"), quarter(signed, "area_milli"))


@query(f"""WITH {D.EMB_SQL}, {_PAL}, e AS (SELECT image_id, idx, {_L} AS l, {_A} AS a_, {_B} AS b_ FROM emb WHERE a > 0),
d AS (SELECT p.image_id, p.idx, q.k, row_number() OVER (PARTITION BY p.image_id, p.idx ORDER BY (p.l-q.l)*(p.l-q.l) + (p.a_-q.a)*(p.a_-q.a) + (p.b_-q.b_)*(p.b_-q.b_), q.k) AS rn FROM e p, pal q),
n AS (SELECT image_id, k, count(*) AS n_pixels, min(idx) AS f FROM d WHERE rn = 1 GROUP BY ALL)
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY f) - 1 AS INT) AS z_order, CAST(k AS INT) AS colour, n_pixels FROM n""")
def q99_palette_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.kernels.quant import quantize

    at = {c: k for k, c in enumerate(PALETTE)}

    def layers(px: np.ndarray) -> list[tuple]:
        some = [x for x in quantize(px, "icon", tuple(PALETTE), "cutout") if x.mask.any()]
        return [(z, at[x.color], int((x.mask > 0).sum())) for z, x in enumerate(some)]

    return _kernel(spark, sf_dir, "z_order int, colour int, n_pixels long", layers)


def _axis_sql(n: int, m: int, name: str) -> str:
    at = f"greatest(0e0, least({n - 1}e0, (k + 0.5e0)*{n}/{m} - 0.5e0))"
    return f"{name} AS (SELECT k, CAST(floor({at}) AS INT) AS lo, CAST(least(floor({at}) + 1, {n - 1}) AS INT) AS hi, {at} - floor({at}) AS f FROM (SELECT CAST(range AS INT) AS k FROM range({m})) z)"


@query(f"""WITH {D.EMB_SQL}, {_axis_sql(8, 12, "ax")}, {_axis_sql(8, 20, "ay")},
vr AS (SELECT p.image_id, p.x, ay.k AS y, """ + ", ".join(f"p.{c}*(1 - ay.f) + q.{c}*ay.f AS {c}" for c in "rgb") + """ FROM emb p JOIN ay ON ay.lo = p.y JOIN emb q ON q.image_id = p.image_id AND q.x = p.x AND q.y = ay.hi)
SELECT p.image_id, ax.k AS x, p.y, """ + ", ".join(f"CAST(greatest(0, least(255, floor(p.{c}*(1 - ax.f) + q.{c}*ax.f + 0.5e0))) AS INT) AS {c}" for c in "rgb") + " FROM vr p JOIN ax ON ax.lo = p.x JOIN vr q ON q.image_id = p.image_id AND q.y = p.y AND q.x = ax.hi")
def q100_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.kernels.masks import resize_bilinear

    return _kernel(spark, sf_dir, "x int, y int, r int, g int, b int", lambda px: [(x, y, *map(int, c)) for y, row in enumerate(resize_bilinear(px[..., :3], 12, 20)) for x, c in enumerate(row)])


@query(f"WITH {D.EMB_SQL}, k AS (SELECT CAST(range AS INT) AS k, least(7, CAST(floor((range + 0.5e0)*8/20) AS INT)) AS s, least(7, CAST(floor((range + 0.5e0)*8/13) AS INT)) AS t FROM range(20)) SELECT image_id, a.k AS x, b.k AS y, v FROM emb JOIN k a ON a.s = emb.x JOIN k b ON b.t = emb.y AND b.k < 13")
def q101_mask_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.kernels.masks import upsample

    return _kernel(spark, sf_dir, "x int, y int, v int", lambda px: [(x, y, int(v)) for y, row in enumerate(upsample(px[..., 0], 20, 13)) for x, v in enumerate(row)])


def _bilateral_sql(source: str, along: str, across: str, out: str) -> str:
    w = f"exp(-(q.{along} - p.{along})*(q.{along} - p.{along})/2e0)*exp(-((q.r-p.r)*(q.r-p.r) + (q.g-p.g)*(q.g-p.g) + (q.b-p.b)*(q.b-p.b))/800e0)"
    cols = ", ".join(f"CAST(greatest(0, least(255, floor(sum(q.{c}*{w})/sum({w}) + 0.5e0))) AS INT) AS {c}" for c in "rgb")
    return f"{out} AS (SELECT p.image_id, p.idx, p.x, p.y, {cols} FROM {source} p JOIN {source} q ON p.image_id = q.image_id AND p.{across} = q.{across} AND abs(p.{along} - q.{along}) <= 2 GROUP BY p.image_id, p.idx, p.x, p.y)"


@query(f"WITH {D.EMB_SQL}, {_bilateral_sql('emb', 'x', 'y', 'b1')}, {_bilateral_sql('b1', 'y', 'x', 'b2')} SELECT image_id, idx, r, g, b FROM b2")
def q102_bilateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.kernels.resample import bilateral

    return _kernel(spark, sf_dir, "idx int, r int, g int, b int", lambda px: [(k, *map(int, c[:3])) for k, c in enumerate(bilateral(px).reshape(-1, 4))])


@query(f"""WITH {D.EMB_SQL}, lu AS (SELECT *, CASE WHEN a < 10 THEN 255e0 ELSE r*0.299e0 + g*0.587e0 + b*0.114e0 END AS l FROM emb),
m AS (SELECT image_id, y, x, avg(q.l) AS mean, avg(q.l*q.l) AS sq FROM (SELECT image_id AS i, x AS qx, y AS qy, l FROM lu) q JOIN lu ON lu.image_id = q.i AND abs(qx - x) <= 2 AND abs(qy - y) <= 2 GROUP BY ALL)
SELECT lu.image_id, lu.idx, l < mean*(1 + 0.5e0*(sqrt(greatest(0e0, sq - mean*mean))/128e0 - 1)) AND a >= 10 AS ink FROM lu JOIN m ON m.image_id = lu.image_id AND m.x = lu.x AND m.y = lu.y""")
def q103_stroke_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.kernels.strokes import binarise

    return _kernel(spark, sf_dir, "idx int, ink boolean", lambda px: [(k, bool(v)) for k, v in enumerate(binarise(px, 5, 0.5).ravel())])


@query("""SELECT l_orderkey, l_linenumber, CAST(floor((CASE WHEN x < 1 THEN x*x*x*1.5e0 - x*x*2.5e0 + 1 WHEN x < 2 THEN x*x*x*(-0.5e0) + x*x*2.5e0 - x*4 + 2 ELSE 0e0 END)*100000 + 0.25e0) AS BIGINT) AS weight FROM (SELECT l_orderkey, l_linenumber, abs(CAST(l_quantity AS DOUBLE)/20 - 1.3e0) AS x FROM lineitem) z""")
def q104_catmull_rom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(C.catmull_rom(F.col("l_quantity").cast("double") / 20 - 1.3) * 100000 + 0.25).alias("weight"))


@query(f"""WITH RECURSIVE {D.BOXES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, box_id) AS k FROM boxes),
g AS (SELECT DISTINCT image_id, 0::BIGINT AS k, []::STRUCT(box_id BIGINT, x1 INT, y1 INT, x2 INT, y2 INT, area BIGINT)[] AS kept FROM o
 UNION ALL SELECT o.image_id, o.k, CASE WHEN len(list_filter(g.kept, lambda b: greatest(0, least(b.x2, o.x2) - greatest(b.x1, o.x1))::BIGINT*greatest(0, least(b.y2, o.y2) - greatest(b.y1, o.y1))*10 >= 3*(b.area + o.area - greatest(0, least(b.x2, o.x2) - greatest(b.x1, o.x1))::BIGINT*greatest(0, least(b.y2, o.y2) - greatest(b.y1, o.y1))))) = 0
   THEN list_append(g.kept, struct_pack(box_id := o.box_id, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2, area := o.area)) ELSE g.kept END FROM g JOIN o ON o.image_id = g.image_id AND o.k = g.k + 1),
l AS (SELECT image_id, arg_max(kept, k) AS kept FROM g GROUP BY 1)
SELECT image_id, unnest(list_transform(kept, lambda b: b.box_id)) AS box_id FROM l""")
def q105_greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nms(D.boxes(spark, sf_dir), 0.3).select("image_id", "box_id")


@query(f"""WITH RECURSIVE {D.EMB_SQL}, ink AS (SELECT image_id, idx, x, y FROM emb WHERE v > 127), paper AS (SELECT image_id, idx, x, y FROM emb WHERE v <= 127),
{_components("f", "ink", _EIGHT)}, {_components("b", "paper", _FOUR)},
n AS (SELECT image_id, count(DISTINCT root) AS n FROM f GROUP BY 1), h AS (SELECT image_id, count(*) AS n FROM (SELECT b.image_id, b.root FROM b JOIN paper p ON p.image_id = b.image_id AND p.idx = b.idx GROUP BY ALL HAVING count(*) FILTER (x IN (0, 7) OR y IN (0, 7)) = 0) z GROUP BY 1)
SELECT n.image_id, n.n AS n_outer, coalesce(h.n, 0) AS n_holes FROM n LEFT JOIN h ON h.image_id = n.image_id""")
def q106_contour_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At full coverage ink joins over corners and paper over edges, so contours of even depth are regions of ink and the others holes."""
    from pelgrain.kernels.raster import contours

    c = _kernel(spark, sf_dir, "depth int", lambda px: [(k["depth"],) for k in contours(np.where(px[..., 0] > 127, 255, 0))])
    return c.groupBy("image_id").agg(F.count(F.when(F.col("depth") % 2 == 0, 1)).alias("n_outer"), F.count(F.when(F.col("depth") % 2 == 1, 1)).alias("n_holes"))


_CUBE = tuple((r, g, b) for r in (0, 128) for g in (0, 128) for b in (0, 128))


@query(f"""WITH RECURSIVE {D.EMB_SQL}, cube AS (SELECT image_id, idx, x, y, r // 128 * 4 + g // 128 * 2 + b // 128 AS colour FROM emb),
{_components("f", "cube", f"{_EIGHT} AND a.colour = b.colour")},
n AS (SELECT f.image_id, count(DISTINCT root) AS n, count(DISTINCT colour) AS k FROM f JOIN cube ON cube.image_id = f.image_id AND cube.idx = f.idx GROUP BY 1)
SELECT image_id, n AS n_nodes, n AS n_shapes, k AS n_fills, n AS n_ids, true AS ok FROM n""")
def q107_convert_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a palette and cut-out layers, every region of a colour is one shape of the document, with an id of its own.

    Pixels are drawn three wide: a region that is one pixel thin may have no area once it is fitted.
    """
    from pelgrain.plans import convert as V

    images = _spread(D.packed(D.posterised(D.emb(spark, sf_dir), 128), 8, 8, factor=3))
    r = V.convert(images, {"mode": "icon", "colors": [f"#{r:02x}{g:02x}{b:02x}" for r, g, b in _CUBE], "layering": "cutout", "turdsize": 1})
    m = I.read_sidecar(r)
    shapes = F.regexp_count("svg", F.lit("<(path|circle|ellipse|rect)[ >]")).cast("long")
    nodes = F.col("meta.nodes")
    n = lambda c: F.size(F.array_distinct(c)).cast("long")
    return m.select(F.col("image_id").cast("long").alias("image_id"), F.col("meta.stats.node_count").alias("n_nodes"), shapes.alias("n_shapes"), n(F.transform(nodes, lambda x: x["fill"])).alias("n_fills"), n(F.transform(nodes, lambda x: x["id"])).alias("n_ids"), F.col("error").isNull().alias("ok"))


@query(f"""WITH RECURSIVE sp AS (SELECT s.range AS image_id, CAST(i.range AS INT) AS idx, CAST(i.range % 120 AS INT) AS x, CAST(i.range // 120 AS INT) AS y FROM range(2) s, range(14400) i),
so AS (SELECT *, x % 40 - 19.5e0 AS u, y % 40 - 19.5e0 AS v FROM sp),
emb AS (SELECT image_id, idx, x, y FROM so WHERE CASE WHEN (x // 40 + y // 40 + image_id) % 2 = 1 THEN abs(sqrt(u*u + v*v) - 10) <= 2 ELSE (abs(u) <= 12 AND abs(v) <= 2) OR (abs(v) <= 12 AND abs(u) <= 2) END),
p AS (SELECT image_id, 'x' AS axis, x AS pos, count(*) AS n FROM emb GROUP BY ALL UNION ALL SELECT image_id, 'y', y, count(*) FROM emb GROUP BY ALL),
f AS (SELECT image_id, axis, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT *, sum(f) OVER (PARTITION BY image_id, axis ORDER BY pos) AS g FROM (SELECT image_id, axis, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY image_id, axis ORDER BY pos) - 1 >= 4 THEN 1 ELSE 0 END AS f FROM p WHERE n >= 2) a) b GROUP BY image_id, axis, g HAVING max(pos) + 1 - min(pos) >= 10),
w AS (SELECT *, e - s AS h, row_number() OVER (PARTITION BY image_id, axis ORDER BY e - s) - 1 AS k, count(*) OVER (PARTITION BY image_id, axis) AS n FROM f),
m AS (SELECT image_id, axis, max(h) FILTER (k = n // 2) AS m, max(h) FILTER (k = 0) AS lo, max(h) FILTER (k = n - 1) AS hi, max(n) AS n FROM w GROUP BY ALL),
g AS (SELECT f.* FROM f JOIN m ON m.image_id = f.image_id AND m.axis = f.axis WHERE m.n < 2 OR f.e - f.s >= greatest(m.m // 4, 10)),
c AS (SELECT a.image_id, a.s AS x1, a.e AS x2, b.s AS y1, b.e AS y2, (SELECT count(*) FROM emb WHERE emb.image_id = a.image_id AND x >= a.s AND x < a.e AND y >= b.s AND y < b.e) AS n FROM g a JOIN g b ON a.image_id = b.image_id AND a.axis = 'x' AND b.axis = 'y'),
cm AS (SELECT image_id, greatest(max(n) FILTER (k = t // 2) // 10, 1) AS floor FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS t FROM c) z GROUP BY 1),
{_components("r", "emb", _EIGHT)},
bx AS (SELECT r.image_id, root, min(x) AS x1, max(x) + 1 AS x2, min(y) AS y1, max(y) + 1 AS y2 FROM r JOIN emb ON emb.image_id = r.image_id AND emb.idx = r.idx GROUP BY ALL HAVING count(*) >= 12),
ov AS (SELECT bx.image_id, root, count(c.x1) AS n FROM bx LEFT JOIN c ON c.image_id = bx.image_id AND greatest(0, least(bx.x2, c.x2) - greatest(bx.x1, c.x1))*greatest(0, least(bx.y2, c.y2) - greatest(bx.y1, c.y1))*4 >= (bx.x2 - bx.x1)*(bx.y2 - bx.y1) GROUP BY ALL)
SELECT c.image_id, 'chroma' AS segmentation, (SELECT count(*) FROM g WHERE g.image_id = c.image_id AND axis = 'x') AS n_cols, (SELECT count(*) FROM g WHERE g.image_id = c.image_id AND axis = 'y') AS n_rows, count(*) FILTER (n >= 12) AS n_icons,
 (SELECT count(*) FROM ov WHERE ov.image_id = c.image_id AND ov.n = 0) AS n_orphans, (SELECT count(*) FROM ov WHERE ov.image_id = c.image_id AND ov.n > 1) AS n_straddling,
 CAST(floor(least(count(*) FILTER (n >= least_ink)/count(*)::DOUBLE, (SELECT min(greatest(0e0, least(1e0, 1 - (hi - lo)/m::DOUBLE))) FROM m WHERE m.image_id = c.image_id))*1000 + 0.5e0) AS BIGINT) AS score_milli
FROM (SELECT c.*, cm.floor AS least_ink FROM c JOIN cm ON cm.image_id = c.image_id) c GROUP BY c.image_id""")
def q108_sheet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.plans import sheet as V

    n = [F.col(c).cast("long").alias(c) for c in ("n_cols", "n_rows", "n_icons", "n_orphans", "n_straddling")]
    return V.sheet_report(_spread(D.sheets(spark))).select(F.col("image_id").cast("long").alias("image_id"), "segmentation", *n, F.floor(F.col("score") * 1000 + 0.5).alias("score_milli"))


def _gradient_sql() -> str:
    dot = lambda a, b: " + ".join(f"{a}{k}*{b}{k}" for k in "rgb")
    off = " + ".join(f"pow({k} - (m{k} + bx{k}*(x - mx) + by{k}*(y - my)), 2)" for k in "rgb")
    paint = lambda t, n: ", ".join(f"CAST(floor(least(255e0, greatest(0e0, m{k} + (bx{k}*dx + by{k}*dy)*{t})) + 0.5e0) AS INT) AS {n}_{k}" for k in "rgb")
    return f"""smp AS (SELECT image_id, x, y, r, g, b FROM emb WHERE {SAT} >= 60),
s1 AS (SELECT image_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, {", ".join(f"avg({k}) AS m{k}, covar_pop(x, {k}) AS cx{k}, covar_pop(y, {k}) AS cy{k}" for k in "rgb")} FROM smp GROUP BY 1 HAVING count(*) >= 30),
s2 AS (SELECT *, {", ".join(f"(yy*cx{k} - xy*cy{k})/(xx*yy - xy*xy) AS bx{k}, (xx*cy{k} - xy*cx{k})/(xx*yy - xy*xy) AS by{k}" for k in "rgb")} FROM s1 WHERE xx*yy - xy*xy > 1e-9),
s3 AS (SELECT *, {dot("bx", "bx")} AS e_, {dot("bx", "by")} AS f_, {dot("by", "by")} AS g_ FROM s2),
s4 AS (SELECT *, (e_ + g_ + sqrt((e_ - g_)*(e_ - g_) + f_*f_*4))/2 AS top FROM s3), s5 AS (SELECT *, f_ AS vx, top - e_ AS vy FROM s4 WHERE top >= 1e-9),
s6 AS (SELECT *, vx*CASE WHEN vx + vy < 0 THEN -1 ELSE 1 END/sqrt(vx*vx + vy*vy) AS dx, vy*CASE WHEN vx + vy < 0 THEN -1 ELSE 1 END/sqrt(vx*vx + vy*vy) AS dy FROM s5),
s7 AS (SELECT image_id, quantile_cont((x - mx)*dx + (y - my)*dy, 0.05) AS t0, quantile_cont((x - mx)*dx + (y - my)*dy, 0.95) AS t1, sqrt(avg({off})) AS residual FROM smp JOIN s6 USING (image_id) GROUP BY 1)
SELECT image_id, n, {", ".join(quarter_sql(f"m{c} + d{c}*t{k}", f"{c}{k + 1}_milli") for k in (0, 1) for c in "xy")}, {paint("t0", "start")}, {paint("t1", "end")}, {quarter_sql("residual", "residual_milli")} FROM s6 JOIN s7 USING (image_id) WHERE residual <= 110"""


@query(f"WITH {D.EMB_SQL}, {_gradient_sql()}")
def q109_ink_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.ink_gradient(D.emb(spark, sf_dir).where(C.saturation(*P.rgb()) >= 60).select("image_id", "x", "y", "r", "g", "b"), most=110.0)
    return g.select("image_id", "n", *[quarter(F.col(c), f"{c}_milli") for c in ("x1", "y1", "x2", "y2", "residual")], *[F.col(f"{e}.{k}").alias(f"{e}_{k}") for e in ("start", "end") for k in "rgb"])


@query(f"""WITH RECURSIVE {D.EMB_SQL}, raw AS (SELECT image_id, idx, x, y FROM emb WHERE v > 170),
ink AS (SELECT DISTINCT e.image_id, e.idx, e.x, e.y FROM emb e JOIN raw r ON r.image_id = e.image_id AND abs(r.x - e.x) <= 1 AND abs(r.y - e.y) <= 1), {_components("f", "ink", _EIGHT)},
b AS (SELECT f.image_id, root, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, count(*) AS n FROM f JOIN raw ON raw.image_id = f.image_id AND raw.idx = f.idx GROUP BY ALL HAVING count(*) >= 2)
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, y2, x2, root) AS INT) AS cluster, x1, y1, x2, y2, n FROM b""")
def q110_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.find_clusters(D.emb(spark, sf_dir).withColumn("ink", F.col("v") > 170), 8, 1, 2)
