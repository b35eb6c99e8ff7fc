"""Queries on derived rasters: one for each operator that SQL can express, with its DuckDB oracle beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pelgrain import options as O
from pelgrain.functions import color as C
from pelgrain.functions import text as T
from pelgrain.operators import bands as B
from pelgrain.operators import colours as H
from pelgrain.operators import fit as G
from pelgrain.operators import layers as L
from pelgrain.operators import neighbourhood as N
from pelgrain.operators import pixels as P
from pelgrain.operators import shapes as S
from pelgrain.sources import derived as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PALETTE = [(0, 0, 0), (255, 255, 255), (220, 40, 40), (40, 180, 60), (50, 80, 210), (240, 200, 40)]


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def milli(c, name: str):
    return C.half_up(c, 1000).alias(name)


# CIELAB in SQL, for a table with r, g, b.
def _lab_sql(r: str = "r", g: str = "g", b: str = "b") -> tuple[str, str, str]:
    lin = lambda c: f"(CASE WHEN {c}/255e0 <= 0.04045e0 THEN {c}/255e0/12.92e0 ELSE pow(({c}/255e0+0.055e0)/1.055e0, 2.4e0) END)"
    f = lambda t: f"(CASE WHEN {t} > {C.DELTA**3!r} THEN pow({t}, 1e0/3e0) ELSE {t}/{3 * C.DELTA * C.DELTA!r} + {4.0 / 29.0!r} END)"
    xyz = [f"(({m[0]!r}::DOUBLE*{lin(r)} + {m[1]!r}::DOUBLE*{lin(g)} + {m[2]!r}::DOUBLE*{lin(b)})/{n!r}::DOUBLE)" for m, n in zip(C.TO_XYZ, (C.XN, C.YN, C.ZN), strict=True)]
    x, y, z = map(f, xyz)
    return f"(116e0*{y} - 16e0)", f"(500e0*({x} - {y}))", f"(200e0*({y} - {z}))"


LAB_MACRO = "(SELECT {l} AS l, {a} AS a, {b} AS b)"
LUMA = "CAST(floor(0.299e0*r + 0.587e0*g + 0.114e0*b) AS INT)"
SAT = "(greatest(r,g,b) - least(r,g,b))"


@query(f"WITH {D.EMB_SQL} SELECT image_id, idx, " + ", ".join(f"CAST(CASE WHEN a=255 THEN {c} WHEN a=0 THEN {v} ELSE floor({c}*(a/255e0) + {v}*(1e0-a/255e0) + 0.5e0) END AS INT) AS {c}" for c, v in zip("rgb", (250, 240, 10), strict=True)) + ", 255 AS a FROM emb")
def q01_alpha_matte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.matte(D.emb(spark, sf_dir), (250, 240, 10)).select("image_id", "idx", "r", "g", "b", "a")


@query(f"WITH {D.EMB_SQL} SELECT image_id, idx, r, g, b, CASE WHEN a >= 128 THEN 255 ELSE 0 END AS a FROM emb")
def q02_alpha_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.apply_alpha_mode(D.emb(spark, sf_dir), "threshold", 128).select("image_id", "idx", "r", "g", "b", "a")


_L, _A, _B = _lab_sql()


@query(f"WITH {D.EMB_SQL} SELECT image_id, idx, " + ", ".join(f"CAST(floor({e}*1000 + 0.5e0) AS BIGINT) AS {n}" for e, n in zip((_L, _A, _B), ("l_milli", "a_milli", "b_milli"), strict=True)) + " FROM emb")
def q03_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.with_lab(D.emb(spark, sf_dir))
    return p.select("image_id", "idx", *[milli(F.col(f"_{c}"), f"{c}_milli") for c in "lab"])


@query(f"WITH {D.EMB_SQL} SELECT image_id, idx, {SAT} AS sat, (a >= 10 AND {SAT} >= 90 AND greatest(r,g,b) <= 250) AS ink FROM emb")
def q04_chroma_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.emb(spark, sf_dir).select("image_id", "idx", C.saturation(*P.rgb()).alias("sat"), P.chroma_ink().alias("ink"))


@query(f"WITH {D.EMB_SQL} SELECT image_id, idx, CAST(floor(CAST(CASE WHEN a < 10 THEN 0 ELSE least(1, {SAT}::FLOAT/120::FLOAT) END AS FLOAT)::DOUBLE*1000 + 0.5e0) AS BIGINT) AS coverage_milli FROM emb")
def q05_ink_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.emb(spark, sf_dir).select("image_id", "idx", milli(P.ink_coverage(120).cast("double"), "coverage_milli"))


@query(f"WITH {D.POST_SQL} SELECT image_id, count(DISTINCT (r, g, b)) AS n_colours FROM post GROUP BY 1")
def q06_distinct_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.distinct_colours(D.posterised(D.emb(spark, sf_dir)))


@query(f"WITH {D.POST_SQL}, h AS (SELECT image_id, count(*) AS n FROM post GROUP BY image_id, r, g, b) SELECT image_id, count(*) FILTER (n >= ceil(64*0.05e0)) AS n_colours FROM h GROUP BY 1")
def q07_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.colours_above_floor(D.posterised(D.emb(spark, sf_dir)), 0.05)


@query(f"WITH {D.POST_SQL}, h AS (SELECT image_id, r, g, b, count(*) AS n, min(idx) AS first_idx FROM post GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY first_idx) AS INT) AS scan_rank FROM h")
def q08_exact_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.exact_histogram(D.posterised(D.emb(spark, sf_dir)))


def _otsu_sql(raster: str, value: str, source: str, where: str, default: int) -> str:
    return f"""WITH {raster}, h AS (SELECT image_id, {value} AS t, count(*) AS c FROM {source} WHERE {where} GROUP BY ALL),
w AS (SELECT image_id, t, sum(c) OVER p AS w0, sum(c*t) OVER p AS s0, sum(c) OVER (PARTITION BY image_id) AS n, sum(c*t) OVER (PARTITION BY image_id) AS s FROM h WINDOW p AS (PARTITION BY image_id ORDER BY t)),
v AS (SELECT image_id, t, CAST(s0*n - s*w0 AS DOUBLE)*CAST(s0*n - s*w0 AS DOUBLE)/CAST(w0*(n-w0) AS DOUBLE) AS var FROM w WHERE w0 < n),
k AS (SELECT image_id, t, row_number() OVER (PARTITION BY image_id ORDER BY var DESC, t) AS k FROM v)
SELECT i.image_id, coalesce(k.t, {default}) AS threshold FROM (SELECT DISTINCT image_id FROM {source}) i LEFT JOIN k ON k.image_id = i.image_id AND k.k = 1"""


@query(_otsu_sql(D.EMB_SQL, LUMA, "emb", "true", 127))
def q09_otsu_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.otsu_luma(D.emb(spark, sf_dir))


@query(_otsu_sql(D.EMB_SQL, SAT, "emb", "a >= 10 AND greatest(r,g,b) <= 250", 90))
def q10_otsu_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.auto_sat_threshold(D.emb(spark, sf_dir))


_DIST = "((p.l-q.l)*(p.l-q.l) + (p.a-q.a)*(p.a-q.a) + (p.b_-q.b_)*(p.b_-q.b_))"


@query(f"""WITH {D.POST_SQL}, c AS (SELECT image_id, CASE idx WHEN 0 THEN 0 WHEN 7 THEN 1 WHEN 56 THEN 2 ELSE 3 END AS corner, r, g, b, {_L} AS l, {_A} AS a, {_B} AS b_ FROM (SELECT image_id, idx, r//128*128 AS r, g//128*128 AS g, b//128*128 AS b FROM post WHERE idx IN (0,7,56,63)) z),
n AS (SELECT p.image_id, p.corner, count(*) AS n FROM c p JOIN c q ON p.image_id = q.image_id AND q.corner > p.corner AND {_DIST} < 5e0 GROUP BY ALL),
m AS (SELECT image_id, min(corner) AS corner FROM n WHERE n >= 2 GROUP BY 1)
SELECT c.image_id, c.corner, c.r, c.g, c.b FROM c JOIN m ON m.image_id = c.image_id AND m.corner = c.corner""")
def q11_background_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.detect_background(D.posterised(D.posterised(D.emb(spark, sf_dir)), 128))


_EDGE = "x < 2 OR y < 2 OR x > 21 OR y > 28"


@query(f"WITH {D.HEAT_SQL}, k AS (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM heat WHERE {_EDGE}) SELECT image_id, CAST(min(v) AS DOUBLE) AS background FROM k WHERE k = (n-1)//2 GROUP BY 1")
def q12_border_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.border_median(D.heat(spark, sf_dir), "v")


@query(f"""WITH {D.HEAT_SQL}, k AS (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM heat WHERE {_EDGE}),
m AS (SELECT image_id, CAST(v AS DOUBLE) AS background FROM k WHERE k = (n-1)//2),
d AS (SELECT h.image_id, abs(h.v - background) AS d FROM heat h JOIN m ON m.image_id = h.image_id WHERE abs(h.v - background) > 40),
r AS (SELECT image_id, d, row_number() OVER (PARTITION BY image_id ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM d)
SELECT m.image_id, background, background >= 128 AS dark_on_light, coalesce(r.d, 0e0) AS ink_ref FROM m LEFT JOIN r ON r.image_id = m.image_id AND r.k = floor((n-1)*0.1e0 + 0.5e0)""")
def q13_luma_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.luma_analysis(D.heat(spark, sf_dir), "v")


@query(f"""WITH {D.DENS_SQL}, s AS (SELECT image_id, x, y, abs(lead(v) OVER (PARTITION BY image_id, y ORDER BY x) - v) AS dx, abs(lead(v) OVER (PARTITION BY image_id, x ORDER BY y) - v) AS dy FROM dens),
u AS (SELECT image_id, (x+1)%8=0 AS e, dx AS d FROM s WHERE dx IS NOT NULL UNION ALL SELECT image_id, (y+1)%8=0, dy FROM s WHERE dy IS NOT NULL),
m AS (SELECT image_id, CAST(sum(d) FILTER (e) AS DOUBLE)/count(*) FILTER (e) AS be, CAST(sum(d) FILTER (NOT e) AS DOUBLE)/count(*) FILTER (NOT e) AS bi FROM u GROUP BY 1)
SELECT image_id, CAST(floor((CASE WHEN bi < 1e-5 THEN CASE WHEN be > 1e-5 THEN 0e0 ELSE 100e0 END WHEN be <= bi THEN 100e0 ELSE 100e0/(be/bi) END)*1000 + 0.5e0) AS BIGINT) AS quality_milli FROM m""")
def q14_block_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.jpeg_quality(D.dens(spark, sf_dir), ["v"]).select("image_id", milli(F.col("quality"), "quality_milli"))


@query(f"WITH {D.EMB_SQL} SELECT image_id, 'x' AS axis, x AS pos, count(*) FILTER (v < 110) AS n FROM emb GROUP BY ALL UNION ALL SELECT image_id, 'y', y, count(*) FILTER (v < 110) FROM emb GROUP BY ALL")
def q15_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.emb(spark, sf_dir).withColumn("ink", F.col("v") < 110)
    return B.project(m, "x").select("image_id", F.lit("x").alias("axis"), "pos", "n").unionAll(B.project(m, "y").select("image_id", F.lit("y").alias("axis"), "pos", "n"))


def _bands_sql(source: str, where: str, keys: str, run: int, gap: int) -> str:
    return f"(SELECT {keys}, min(pos) AS s, max(pos)+1 AS e FROM (SELECT *, sum(f) OVER (PARTITION BY {keys} ORDER BY pos) AS g FROM (SELECT {keys}, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY {keys} ORDER BY pos) - 1 >= {gap} THEN 1 ELSE 0 END AS f FROM {source} WHERE {where}) a) b GROUP BY {keys}, g HAVING max(pos)+1-min(pos) >= {run})"


@query(f"""WITH {D.EMB_SQL}, p AS (SELECT image_id, 'x' AS axis, x AS pos, count(*) FILTER (v < 110) AS n FROM emb GROUP BY ALL UNION ALL SELECT image_id, 'y', y, count(*) FILTER (v < 110) FROM emb GROUP BY ALL),
f AS {_bands_sql("p", "n >= 3", "image_id, axis", 1, 1)},
w AS (SELECT *, e-s AS h, row_number() OVER (PARTITION BY image_id, axis ORDER BY e-s) - 1 AS k, count(*) OVER (PARTITION BY image_id, axis) AS n FROM f),
d AS (SELECT image_id, axis, max(h) FILTER (k = n//2) AS m, max(n) AS n FROM w GROUP BY ALL),
g AS (SELECT f.* FROM f JOIN d ON d.image_id = f.image_id AND d.axis = f.axis WHERE d.n < 2 OR f.e - f.s >= greatest(d.m//4, 1)),
c AS (SELECT a.image_id, a.s AS cs, b.s AS rs, (SELECT count(*) FROM emb WHERE emb.image_id = a.image_id AND v < 110 AND x >= a.s AND x < a.e AND y >= b.s AND y < b.e) AS n FROM g a JOIN g b ON a.image_id = b.image_id AND a.axis = 'x' AND b.axis = 'y'),
cm AS (SELECT image_id, greatest(max(n) FILTER (k = t//2)//10, 1) AS floor FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS t FROM c) z GROUP BY 1),
occ AS (SELECT c.image_id, CAST(count(*) FILTER (n >= floor) AS DOUBLE)/count(*) AS occ FROM c JOIN cm ON cm.image_id = c.image_id GROUP BY 1),
u AS (SELECT image_id, axis, n, CASE WHEN n < 2 THEN 1e0 WHEN m = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, 1e0 - CAST(CASE WHEN n < 4 THEN hi-lo ELSE q3-q1 END AS DOUBLE)/m)) END AS uni FROM (
  SELECT image_id, axis, n, max(h) FILTER (k = n//2) AS m, max(h) FILTER (k = 0) AS lo, max(h) FILTER (k = n-1) AS hi, max(h) FILTER (k = n//4) AS q1, max(h) FILTER (k = 3*n//4) AS q3
  FROM (SELECT image_id, axis, e-s AS h, row_number() OVER (PARTITION BY image_id, axis ORDER BY e-s) - 1 AS k, count(*) OVER (PARTITION BY image_id, axis) AS n FROM g) z GROUP BY ALL) y)
SELECT occ.image_id, a.n AS n_cols, b.n AS n_rows, CAST(floor((CASE WHEN a.n = 1 AND b.n = 1 THEN 0e0 ELSE least(occ, a.uni, b.uni) END)*1000 + 0.5e0) AS BIGINT) AS score_milli
FROM occ JOIN u a ON a.image_id = occ.image_id AND a.axis = 'x' JOIN u b ON b.image_id = occ.image_id AND b.axis = 'y'""")
def q16_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.emb(spark, sf_dir).withColumn("ink", F.col("v") < 110)
    return B.infer_lattice(m, 1, 1, 3).select("image_id", "n_cols", "n_rows", milli(F.col("score"), "score_milli"))


_PAL = "pal AS (SELECT k, " + ", ".join(f"{e} AS {n}" for e, n in zip((_L, _A, _B), ("l", "a", "b_"), strict=True)) + " FROM (VALUES " + ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate(PALETTE)) + ") t(k, r, g, b))"


@query(f"""WITH {D.EMB_SQL}, {_PAL}, e AS (SELECT image_id, idx, {_L} AS l, {_A} AS a, {_B} AS b_ FROM emb),
d AS (SELECT p.image_id, p.idx, q.k, row_number() OVER (PARTITION BY p.image_id, p.idx ORDER BY {_DIST}, q.k) AS rn FROM e p, pal q)
SELECT image_id, idx, k AS layer FROM d WHERE rn = 1""")
def q17_palette_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.palette_nearest(D.emb(spark, sf_dir), PALETTE).select("image_id", "idx", "layer")


_LAYERS = "ly AS (SELECT image_id, r, g, b, row_number() OVER (PARTITION BY image_id ORDER BY min(idx)) - 1 AS z_order FROM (SELECT image_id, idx, r//128*128 AS r, g//128*128 AS g, b//128*128 AS b FROM emb) t GROUP BY image_id, r, g, b)"


@query(f"""WITH {D.EMB_SQL}, {_LAYERS}, p AS (SELECT *, {_L} AS l, {_A} AS a, {_B} AS b_ FROM ly),
q AS (SELECT image_id, {_L} AS l, {_A} AS a, {_B} AS b_ FROM (SELECT image_id, r, g, b FROM emb WHERE idx = 0) c),
d AS (SELECT p.*, {_DIST} AS d, row_number() OVER (PARTITION BY p.image_id ORDER BY {_DIST}, p.z_order) AS k FROM p JOIN q ON q.image_id = p.image_id)
SELECT image_id, CAST(z_order AS INT) AS z_order, r, g, b FROM d WHERE NOT (k = 1 AND d <= 100)""")
def q18_background_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.emb(spark, sf_dir)
    h = H.exact_histogram(D.posterised(p, 128))
    layers = h.select("image_id", (F.col("scan_rank") - 1).alias("z_order"), "r", "g", "b")
    return L.background_policy(layers, p.where("idx = 0").select("image_id", "r", "g", "b"), "drop")


def _box_sql(source: str, half: int, value: str, cols: str) -> str:
    return f"""bx AS (SELECT {cols}, sum({value}) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS s1, sum({value}*{value}) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS q1,
 count(*) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS n1 FROM {source}),
bz AS (SELECT {cols}, CAST(sum(s1) OVER w AS BIGINT) AS s, CAST(sum(q1) OVER w AS BIGINT) AS q, CAST(sum(n1) OVER w AS BIGINT) AS n FROM bx WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING))"""


@query(f"WITH {D.EMB_SQL}, {_box_sql('emb', 2, 'v', 'image_id, idx, x, y, v')} SELECT image_id, idx, v < (s/n)*(1e0 + 0.2e0*(sqrt(greatest(0e0, q/n - (s/n)*(s/n)))/128e0 - 1e0)) AS ink FROM bz")
def q19_sauvola(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.sauvola_ink(D.emb(spark, sf_dir), "v", 2).select("image_id", "idx", "ink")


@query(f"WITH {D.EMB_SQL}, {_box_sql('emb', 1, 'v', 'image_id, idx, x, y, v')} SELECT image_id, count(*) FILTER (v*n < s - 10*n) AS n_ink, count(*) AS n_pixels, count(*) FILTER (v*n < s - 10*n)*4 < count(*) AS line_art FROM bz GROUP BY 1")
def q20_adaptive_ink_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.ink_ratio(N.adaptive_ink(D.emb(spark, sf_dir), "v", 1))


def _blend_sql() -> str:
    share = lambda c: f"CASE WHEN abs(a.{c}-b.{c}) > 1 THEN CAST(c.{c}-b.{c} AS DOUBLE)/(a.{c}-b.{c}) ELSE -1e0 END AS s{c}"
    ok = lambda c: f"(s{c} >= -0.2e0 AND s{c} <= 1.2e0)"
    n = " + ".join(f"CAST({ok(c)} AS INT)" for c in "rgb")
    total = " + ".join(f"CASE WHEN {ok(c)} THEN s{c} ELSE 0e0 END" for c in "rgb")
    dev = ", ".join(f"abs(c{c} - (m*a{c} + (1e0-m)*b{c}))" for c in "rgb")
    cols = ", ".join(f"c.{c} AS c{c}, a.{c} AS a{c}, b.{c} AS b{c}, {share(c)}" for c in "rgb")
    return f"""nb AS (SELECT DISTINCT p.image_id, p.idx, q.r, q.g, q.b FROM post p JOIN post q ON p.image_id = q.image_id AND abs(p.x-q.x) <= 1 AND abs(p.y-q.y) <= 1 AND (p.r, p.g, p.b) <> (q.r, q.g, q.b)),
t AS (SELECT c.image_id, {cols} FROM post c JOIN nb a ON a.image_id = c.image_id AND a.idx = c.idx JOIN nb b ON b.image_id = c.image_id AND b.idx = c.idx AND (a.r, a.g, a.b) < (b.r, b.g, b.b)),
s AS (SELECT *, {n} AS n, ({total})/nullif({n}, 0) AS m FROM t),
y AS (SELECT image_id, bool_or(n >= 2 AND m > 0.01e0 AND m < 0.99e0 AND greatest({dev}) < 15e0) AS aa FROM s GROUP BY 1)"""


@query(f"WITH {D.POST_SQL}, {_blend_sql()} SELECT i.image_id, coalesce(aa, false) AS anti_aliased FROM (SELECT DISTINCT image_id FROM post) i LEFT JOIN y ON y.image_id = i.image_id")
def q21_anti_aliasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.has_anti_aliasing(D.posterised(D.emb(spark, sf_dir)))


@query(f"WITH {D.EMB_SQL}, z AS (SELECT image_id, CASE WHEN a % 8 > 0 THEN 255 ELSE a END AS a FROM emb) SELECT image_id, bool_or(a <> 255) AS has_alpha, bool_or(a <> 255) AND count(DISTINCT a) FILTER (a > 0 AND a < 255) <= 2 AS flat_alpha FROM z GROUP BY 1")
def q22_flat_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.alpha_profile(D.emb(spark, sf_dir).withColumn("a", F.when(F.col("a") % 8 > 0, 255).otherwise(F.col("a"))))


_COV = "cov AS (SELECT image_id, idx, CAST(z.range AS INT) AS z_order, CASE z.range WHEN 0 THEN r WHEN 1 THEN g WHEN 2 THEN b ELSE a END AS cov FROM emb, range(4) z)"


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.emb(spark, sf_dir).select("image_id", "idx", F.posexplode(F.array("r", "g", "b", "a")).alias("z_order", "cov"))


@query(f"WITH {D.EMB_SQL}, {_COV} SELECT image_id, idx, z_order, max(cov) OVER (PARTITION BY image_id, idx ORDER BY z_order DESC) AS cov FROM cov")
def q23_stacked_layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stacked(_coverage(spark, sf_dir))


@query(f"WITH {D.EMB_SQL}, f AS (SELECT image_id, v//32 AS layer, min(idx) AS first_idx FROM emb GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY first_idx) - 1 AS INT) AS z_order FROM f")
def q24_paint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.paint_order(D.emb(spark, sf_dir).withColumn("layer", F.floor(F.col("v") / 32).cast("int")))


@query("WITH p AS (SELECT p_partkey, p_brand, 's-' || lower(p_name[1:6]) AS id FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, id ORDER BY p_partkey) AS k FROM p) SELECT p_partkey, p_brand, id, CASE WHEN k = 1 THEN id ELSE id || '-' || k END AS unique_id FROM k")
def q25_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.lit("s-"), F.lower(F.substring("p_name", 1, 6))).alias("id"))
    return S.dedupe_ids(p, ["p_brand"], "id", "p_partkey")


_IN = "p.image_id = q.image_id AND p.box_id <> q.box_id AND p.x1 >= q.x1 AND p.x2 <= q.x2 AND p.y1 >= q.y1 AND p.y2 <= q.y2"
_DEPTH = f"dp AS (SELECT p.image_id, p.box_id, any_value(p.area) AS area, count(q.box_id) AS depth FROM boxes p LEFT JOIN boxes q ON {_IN} AND p.area*100 < q.area*98 GROUP BY ALL)"


@query(f"WITH {D.BOXES_SQL}, {_DEPTH} SELECT image_id, box_id, depth, CAST(row_number() OVER (PARTITION BY image_id ORDER BY depth, area DESC, box_id) - 1 AS INT) AS draw_order FROM dp")
def q26_draw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.draw_order(S.containment_depth(D.boxes(spark, sf_dir))).select("image_id", "box_id", "depth", "draw_order")


@query(f"WITH {D.ROWS_SQL} SELECT image_id, s AS start, e AS \"end\" FROM {_bands_sql('rows', 'v >= 60', 'image_id', 2, 1)} z")
def q27_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.find_bands(D.line_profiles(spark, sf_dir), "v", 2, 1, 60)


_ROWKIND = f"""yp AS (SELECT image_id, y AS pos, count(*) AS n FROM emb WHERE v < 120 GROUP BY ALL),
yb AS (SELECT *, e-s AS h FROM {_bands_sql("yp", "n >= 2", "image_id", 1, 1)} z),
ys AS (SELECT image_id, h, row_number() OVER w AS k, count(*) OVER (PARTITION BY image_id) AS n, sum(h) OVER w AS low, sum(h) OVER (PARTITION BY image_id) AS tot FROM yb WINDOW w AS (PARTITION BY image_id ORDER BY h, s)),
yr AS (SELECT image_id, h, k, (CAST(tot-low AS DOUBLE)/(n-k))/(CAST(low AS DOUBLE)/k) AS r FROM ys WHERE k < n AND n >= 3),
yk AS (SELECT image_id, h AS short FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY r DESC, k) AS o FROM yr) z WHERE o = 1 AND r >= 1.8e0),
yt AS (SELECT yb.*, short FROM yb JOIN yk ON yk.image_id = yb.image_id),
xp AS (SELECT emb.image_id, x AS pos, count(*) AS n FROM emb JOIN yt ON yt.image_id = emb.image_id AND h > short AND y >= s AND y < e WHERE v < 120 GROUP BY ALL),
xb AS {_bands_sql("xp", "n >= 2", "image_id", 1, 1)},
sn AS (SELECT t.image_id, t.s, count(*) AS t, count(*) FILTER (NOT EXISTS (SELECT 1 FROM xb WHERE xb.image_id = t.image_id AND x >= xb.s AND x < xb.e)) AS o FROM yt t JOIN emb ON emb.image_id = t.image_id AND y >= t.s AND y < t.e AND v < 120
  WHERE h <= short AND EXISTS (SELECT 1 FROM xb WHERE xb.image_id = t.image_id) GROUP BY ALL),
rk AS (SELECT yb.image_id, yb.s AS start, yb.e AS "end", CASE WHEN CAST(o AS DOUBLE)/t > 0.05e0 THEN 'text' ELSE 'icon' END AS kind FROM yb LEFT JOIN sn ON sn.image_id = yb.image_id AND sn.s = yb.s)"""


def _row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.classify_rows(D.emb(spark, sf_dir).withColumn("ink", F.col("v") < 120), 1, 1, 2)


@query(f"WITH {D.EMB_SQL}, {_ROWKIND} SELECT * FROM rk")
def q28_row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_kinds(spark, sf_dir)


@query(f"WITH {D.EMB_SQL} SELECT p.image_id, p.idx, bool_or(q.v < 90) AS ink FROM emb p JOIN emb q ON p.image_id = q.image_id AND abs(p.x-q.x) <= 1 AND abs(p.y-q.y) <= 1 GROUP BY ALL")
def q29_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.dilate(D.emb(spark, sf_dir).select("image_id", "idx", "x", "y", (F.col("v") < 90).alias("ink")), 1).select("image_id", "idx", "ink")


def _deblock_sql(source: str, along: str, across: str, most: int) -> str:
    w = f"(PARTITION BY image_id, {across} ORDER BY {along})"
    return f"SELECT image_id, idx, x, y, CASE WHEN ({along} % 8 = 0 OR ({along}+1) % 8 = 0) AND {along} > 0 AND {along} < {most} THEN CAST(floor((lag(v) OVER {w} + 2*v + lead(v) OVER {w} + 2)/4) AS INT) ELSE v END AS v FROM {source}"


@query(f"WITH {D.HEAT_SQL}, d1 AS ({_deblock_sql('heat', 'x', 'y', 23)}) SELECT image_id, idx, v FROM ({_deblock_sql('d1', 'y', 'x', 30)}) z")
def q30_deblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.deblock(D.heat(spark, sf_dir), ["v"]).select("image_id", "idx", "v")


@query(f"""WITH {D.BOXES_SQL}, c AS (SELECT p.image_id, p.box_id, q.box_id AS parent_id, row_number() OVER (PARTITION BY p.image_id, p.box_id ORDER BY q.area, q.box_id) AS k FROM boxes p JOIN boxes q ON {_IN} AND (q.area > p.area OR (q.area = p.area AND q.box_id < p.box_id)))
SELECT b.image_id, b.box_id, c.parent_id FROM boxes b LEFT JOIN c ON c.image_id = b.image_id AND c.box_id = b.box_id AND c.k = 1""")
def q31_containment_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.containment_parent(D.boxes(spark, sf_dir))


@query(f"WITH {D.BOXES_SQL}, {_DEPTH} SELECT dp.image_id, dp.box_id, depth, max(q.box_id) AS last_container FROM dp JOIN boxes p ON p.box_id = dp.box_id LEFT JOIN boxes q ON {_IN} AND p.area*100 < q.area*98 AND q.area < 2500*0.9e0 GROUP BY ALL")
def q32_containment_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.boxes(spark, sf_dir)
    last = S.last_painted_container(b, F.lit(2500)).withColumnRenamed("parent_id", "last_container")
    return S.containment_depth(b).join(last, ["image_id", "box_id"]).select("image_id", "box_id", "depth", "last_container")


_MASKS = "mk AS (SELECT image_id, CAST(m.range AS INT) AS mask_idx, idx, CASE m.range WHEN 0 THEN CASE WHEN x < 4 THEN 255 ELSE 0 END WHEN 1 THEN CASE WHEN y < 5 THEN 255 ELSE 60 END ELSE v END AS cov FROM emb, range(3) m)"


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.array(F.when(F.col("x") < 4, 255).otherwise(0), F.when(F.col("y") < 5, 255).otherwise(60), F.col("v"))
    return D.emb(spark, sf_dir).select("image_id", "idx", F.posexplode(half).alias("mask_idx", "cov"))


@query(f"""WITH {D.EMB_SQL}, {_COV}, {_MASKS}, d AS (SELECT image_id, z_order, CAST(sum(cov) AS BIGINT) AS den FROM cov GROUP BY ALL HAVING sum(cov) > 0),
n AS (SELECT c.image_id, c.z_order, mask_idx, CAST(sum(least(c.cov, m.cov)) AS BIGINT) AS num FROM cov c JOIN mk m ON m.image_id = c.image_id AND m.idx = c.idx GROUP BY ALL),
k AS (SELECT n.image_id, n.z_order AS layer, mask_idx, num, den, row_number() OVER (PARTITION BY n.image_id, n.z_order ORDER BY num DESC, mask_idx) AS k FROM n JOIN d ON d.image_id = n.image_id AND d.z_order = n.z_order WHERE num >= den*0.6e0)
SELECT image_id, layer, mask_idx, num, den FROM k WHERE k = 1""")
def q33_mask_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.mask_overlap(_coverage(spark, sf_dir).withColumnRenamed("z_order", "layer"), _masks(spark, sf_dir))


@query(f"""WITH {D.EMB_SQL}, {_MASKS} SELECT p.image_id, p.mask_idx AS a, q.mask_idx AS b, count(*) FILTER (p.cov >= 128 AND q.cov >= 128) AS inter, count(*) FILTER (p.cov >= 128 OR q.cov >= 128) AS uni
FROM mk p JOIN mk q ON p.image_id = q.image_id AND p.idx = q.idx AND p.mask_idx < q.mask_idx GROUP BY ALL""")
def q34_mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.mask_iou(_masks(spark, sf_dir))


_CELLS = "cells AS (SELECT DISTINCT image_id, CAST(c.range*3 + r.range AS INT) AS cell_id, CAST(c.range*17 AS INT) AS x1, CAST(r.range*35 AS INT) AS y1, CAST(c.range*17 + 17 AS INT) AS x2, CAST(r.range*35 + 35 AS INT) AS y2 FROM boxes, range(3) c, range(3) r)"


def _cells(boxes: DataFrame) -> DataFrame:
    c, r = F.floor(F.col("cell_id") / 3).cast("int"), F.col("cell_id") % 3
    return boxes.select("image_id").distinct().withColumn("cell_id", F.explode(F.sequence(F.lit(0), F.lit(8)))).select("image_id", "cell_id", (c * 17).alias("x1"), (r * 35).alias("y1"), (c * 17 + 17).alias("x2"), (r * 35 + 35).alias("y2"))


@query(f"""WITH {D.BOXES_SQL}, {_CELLS} SELECT b.image_id, b.box_id, count(c.cell_id) AS n_cells, CASE count(c.cell_id) WHEN 0 THEN 'orphan' WHEN 1 THEN 'match' ELSE 'straddling' END AS verdict
FROM boxes b LEFT JOIN cells c ON c.image_id = b.image_id AND greatest(0, least(b.x2, c.x2) - greatest(b.x1, c.x1))*greatest(0, least(b.y2, c.y2) - greatest(b.y1, c.y1))*4 >= b.area GROUP BY ALL""")
def q35_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.boxes(spark, sf_dir)
    return S.reconcile(b, _cells(b))


@query(f"""WITH {D.ROWS_SQL}, i AS {_bands_sql("rows", "v >= 60", "image_id", 1, 1)}, l AS {_bands_sql("rows", "v >= 1 AND v < 60", "image_id", 1, 1)}
SELECT i.image_id, i.s AS start, i.e AS "end", min(l.s) AS label_start FROM i LEFT JOIN l ON l.image_id = i.image_id AND l.s >= i.e AND (l.s - i.e)*2 <= (i.e - i.s)*3 GROUP BY ALL""")
def q36_label_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.line_profiles(spark, sf_dir)
    labels = B.find_bands(r.where("v < 60"), "v", 1, 1, 1)
    return B.label_below(B.find_bands(r, "v", 1, 1, 60), labels)


@query("""WITH o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice/100)/16 AS width FROM orders),
f AS (SELECT *, lag(width) OVER (PARTITION BY o_custkey ORDER BY width, o_orderkey) AS p FROM o),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR (CASE WHEN greatest(p, width) <= 0 THEN CASE WHEN p = width THEN 0e0 ELSE 'inf'::DOUBLE END ELSE abs(width-p)/greatest(p, width) END) > 0.05e0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY width, o_orderkey) AS c FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, c ORDER BY width, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey, c) AS n FROM g),
m AS (SELECT o_custkey, c, (max(width) FILTER (k = (n-1)//2) + max(width) FILTER (k = n//2))/2e0 AS med FROM r GROUP BY ALL),
s AS (SELECT o_custkey, width AS mid FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY width) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM o WHERE width > 0) z WHERE k = n//2)
SELECT r.o_custkey, r.o_orderkey, r.width, floor(med/0.25e0 + 0.5e0)*0.25e0 AS unified, CASE WHEN r.width BETWEEN mid*0.8e0 AND mid*1.2e0 AND r.width > 0 AND r.width <> mid THEN mid END AS width_unified
FROM r JOIN m ON m.o_custkey = r.o_custkey AND m.c = r.c LEFT JOIN s ON s.o_custkey = r.o_custkey""")
def q37_width_unification(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.floor(F.col("o_totalprice") / 100) / 16).alias("width"))
    return B.sheet_widths(B.unify_widths(o, 0.05, 0.25, ["o_custkey"], "o_orderkey"), ["o_custkey"])


def _solve_sql() -> str:
    det = lambda m: f"({m[0]}*({m[4]}*{m[8]} - {m[5]}*{m[7]}) - {m[1]}*({m[3]}*{m[8]} - {m[5]}*{m[6]}) + {m[2]}*({m[3]}*{m[7]} - {m[4]}*{m[6]}))"
    m = ["n", "sx", "sy", "sx", "sxx", "sxy", "sy", "sxy", "syy"]
    swap = lambda k: [f"v{i // 3}" if i % 3 == k else x for i, x in enumerate(m)]
    return ", ".join(f"CAST(floor({det(swap(k))}/{det(m)}*1000 + 0.5e0) AS BIGINT) AS c{k}_milli" for k in range(3))


@query(f"""WITH {D.HEAT_SQL}, s AS (SELECT image_id, count(*)::DOUBLE AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x*x)::DOUBLE AS sxx, sum(x*y)::DOUBLE AS sxy, sum(y*y)::DOUBLE AS syy, sum(v)::DOUBLE AS v0, sum(x*v)::DOUBLE AS v1, sum(y*v)::DOUBLE AS v2 FROM heat GROUP BY 1)
SELECT image_id, {_solve_sql()} FROM s""")
def q38_plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.plane_fit(D.heat(spark, sf_dir), "v").select("image_id", *[milli(F.col(f"c{k}"), f"c{k}_milli") for k in range(3)])


@query("""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN k % 3 = 0 THEN 'icon' ELSE 'auto' END AS mode, CASE WHEN k % 2 = 0 THEN k % 7 ELSE 2 END AS turdsize, CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END AS "precision", k % 4 = 0 AS stroke, 'stacked' AS layering FROM e""")
def q39_options_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    some = F.to_json(F.struct(F.when(k % 3 == 0, "icon").alias("mode"), F.when(k % 2 == 0, k % 7).alias("turdsize"), F.when(k % 5 == 0, 1).alias("precision"), F.when(k % 4 == 0, True).alias("stroke")))
    e = D.table(spark, sf_dir, "events").select("event_id", O.row_options(some).alias("o"))
    return e.select("event_id", "o.mode", "o.turdsize", "o.precision", "o.stroke", "o.layering")


@query("""WITH t AS (SELECT page_id AS image_id, unnest(l) AS t, CAST(unnest(range(len(l))) AS INT) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<(/?[a-zA-Z][^<>]*)>', 1) AS l FROM pages) z),
a AS (SELECT *, lower(regexp_extract(t, '^/?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, t LIKE '/%' AS close, regexp_replace(t, '^/?[a-zA-Z][a-zA-Z0-9]*', '') AS attrs FROM t)
SELECT image_id, pos, name, close, CASE WHEN regexp_matches(attrs, '(^| )href="([^"]*)"') THEN regexp_extract(attrs, '(^| )href="([^"]*)"', 2) END AS href,
 CAST(coalesce(sum(CASE WHEN name <> 'ul' THEN 0 WHEN close THEN -1 WHEN attrs LIKE '%/' THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS depth FROM a""")
def q40_markup_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.table(spark, sf_dir, "pages").select(F.col("page_id").alias("image_id"), "html")
    return T.group_depth(T.tags(pages), "ul").select("image_id", "pos", "name", "close", T.attr_value(F.col("attrs"), "href").alias("href"), "depth")


def _circle_sql() -> str:
    return f"""s AS (SELECT shape_id, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(y*y) AS syy, sum(x*y) AS sxy, -sum(x*x+y*y) AS v0, -sum(x*(x*x+y*y)) AS v1, -sum(y*(x*x+y*y)) AS v2 FROM proc GROUP BY 1),
f AS (SELECT shape_id, {_solve_sql().replace("CAST(floor(", "").replace("*1000 + 0.5e0) AS BIGINT) AS c", " AS c").replace("_milli", "")} FROM s),
g AS (SELECT shape_id, -c1/2 AS cx, -c2/2 AS cy, sqrt(c1*c1/4 + c2*c2/4 - c0) AS r FROM f),
d AS (SELECT g.*, (SELECT max(abs(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) - r)) FROM proc WHERE proc.shape_id = g.shape_id) AS e FROM g)"""


@query(f"WITH {D.OUTLINES_SQL}, {_circle_sql()} SELECT shape_id, " + ", ".join(f"CAST(floor({c}*1000 + 0.25e0) AS BIGINT) AS {c}_milli" for c in ("cx", "cy", "r")) + ", e <= least(greatest(0.5e0, 0.01e0*r), 0.05e0*r) AS accepted FROM d")
def q41_circle_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = G.circle_fit(D.outlines(spark, sf_dir))
    return f.select("shape_id", *[F.floor(F.col(c) * 1000 + 0.25).alias(f"{c}_milli") for c in ("cx", "cy", "r")], "accepted")


@query(f"""WITH {D.OUTLINES_SQL}, e AS (SELECT shape_id, k, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, lag(x) OVER w AS px, lag(y) OVER w AS py FROM proc WINDOW w AS (PARTITION BY shape_id ORDER BY k))
SELECT shape_id, CAST(floor(sum(x*ny - nx*y)/2*100 + 0.5e0) AS BIGINT) AS area_centi, CAST(floor(sum(coalesce(sqrt((x-px)*(x-px)+(y-py)*(y-py)), 0))*100 + 0.5e0) AS BIGINT) AS length_centi, CAST(floor(min(x)*100 + 0.5e0) AS BIGINT) AS x_min_centi, CAST(floor(max(y)*100 + 0.5e0) AS BIGINT) AS y_max_centi FROM e GROUP BY 1""")
def q42_path_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.outlines(spark, sf_dir)
    w = W.partitionBy("shape_id").orderBy("k")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    d = p.select("shape_id", "x", "y", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)).alias("d"))
    centi = lambda c, n: C.half_up(c, 100).alias(n)
    m = d.groupBy("shape_id").agg(centi(F.sum("d"), "length_centi"), centi(F.min("x"), "x_min_centi"), centi(F.max("y"), "y_max_centi"))
    return G.shoelace(p).select("shape_id", centi(F.col("area"), "area_centi")).join(m, "shape_id")


_MS_CASES = {(1, 14): "top-left", (2, 13): "top-right", (4, 11): "right-bottom", (7, 8): "left-bottom", (3, 12): "left-right", (6, 9): "top-bottom"}
_CROSS, _FLAT = "['top-right','left-bottom']", "['top-left','right-bottom']"


@query(f"""WITH {D.EMB_SQL}, i AS (SELECT DISTINCT image_id FROM emb), g AS (SELECT image_id, CAST(a.range AS INT) - 1 AS x, CAST(b.range AS INT) - 1 AS y FROM i, range(10) a, range(10) b),
p AS (SELECT g.*, coalesce(v, 0) AS v FROM g LEFT JOIN emb ON emb.image_id = g.image_id AND emb.x = g.x AND emb.y = g.y),
r AS (SELECT image_id, x, y, v, lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS b, lead(v) OVER (PARTITION BY image_id, x ORDER BY y) AS d FROM p),
q AS (SELECT *, lead(b) OVER (PARTITION BY image_id, x ORDER BY y) AS c FROM r),
c AS (SELECT image_id, x, y, v + b + c + d AS t, CAST(v > 127 AS INT) + 2*CAST(b > 127 AS INT) + 4*CAST(c > 127 AS INT) + 8*CAST(d > 127 AS INT) AS s FROM q WHERE b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL),
u AS (SELECT image_id, x, y, unnest(CASE {" ".join(f"WHEN s IN {k} THEN ['{v}']" for k, v in _MS_CASES.items())} WHEN s = 5 THEN CASE WHEN t <= 510 THEN {_CROSS} ELSE {_FLAT} END WHEN s = 10 THEN CASE WHEN t <= 510 THEN {_FLAT} ELSE {_CROSS} END ELSE [] END) AS e FROM c)
SELECT image_id, x, y, split_part(e, '-', 1) AS a, split_part(e, '-', 2) AS b FROM u""")
def q43_marching_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.marching_segments(D.emb(spark, sf_dir), "v")


# Order-dependent kernels: no SQL form. Their results are held against invariants in the tests.


def _spread(images: DataFrame) -> DataFrame:
    """Small images cost little to move and much to trace: dealt evenly, in as many parts as there are cores."""
    n = max(images.sparkSession.sparkContext.defaultParallelism, int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return images.repartition(n, "image_id")


def _icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(D.packed(D.posterised(D.emb(spark, sf_dir), 128), 8, 8))


@query("")
def q44_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.plans import convert as V

    c = V.contours(_icons(spark, sf_dir), colours=4, turdsize=1)
    return c.select("image_id", "layer", "contour_id", "parent_id", "depth", milli(F.col("area"), "area_milli"), F.size("points").alias("n_points"))


@query("")
def q45_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.plans import convert as V

    s = V.trace_strokes(_spread(D.drawn(spark, 12)))
    return s.select("image_id", "stroke_idx", "component", "closed", milli(F.col("width"), "width_milli"), F.size("segments").alias("n_segments"))


@query("")
def q46_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.plans import convert as V

    c = V.fit(_icons(spark, sf_dir))
    return c.select("image_id", "curve_idx", "layer", "component", "kind", milli(F.col("area"), "area_milli"), T.path_data(F.col("segments")).alias("d"))


@query("")
def q47_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.plans import convert as V

    q = V.quantize(_spread(D.packed(D.emb(spark, sf_dir), 8, 8)), mode="photo")
    return q.select("image_id", "z_order", "color.r", "color.g", "color.b", "n_pixels")


@query("")
def q48_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.plans import convert as V

    r = V.convert(_icons(spark, sf_dir), {"mode": "icon", "colors": 4})
    return r.select("image_id", "svg", F.octet_length("svg").alias("n_bytes"), F.get_json_object("meta_json", "$.stats.node_count").cast("int").alias("n_nodes"), F.col("error.code").alias("error"))


@query("")
def q49_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelgrain.plans import sheet as V

    return V.sheet_report(_spread(D.sheets(spark))).select("image_id", "segmentation", "n_cols", "n_rows", "n_icons", "n_orphans", "n_straddling", milli(F.col("score"), "score_milli"))


@query(f"WITH {D.EMB_SQL} SELECT image_id, idx, CAST(floor((r*0.299e0 + g*0.587e0 + b*0.114e0)*1000 + 0.5e0) AS BIGINT) AS luma601_milli, CAST(floor((r*0.2126e0 + g*0.7152e0 + b*0.0722e0)*1000 + 0.5e0) AS BIGINT) AS luma709_milli FROM emb")
def q50_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.emb(spark, sf_dir).select("image_id", "idx", milli(C.luma601(*P.rgb()), "luma601_milli"), milli(C.luma709(*P.rgb()), "luma709_milli"))


@query(f"WITH {D.EMB_SQL} SELECT image_id, idx, printf('#%02x%02x%02x', r, g, b) AS hex, r AS r6, r // 16 * 17 AS r3, g // 16 * 17 AS g3, b // 16 * 17 AS b3, true AS void FROM emb")
def q51_hex_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.emb(spark, sf_dir).select("image_id", "idx", C.format_hex(*P.rgb()).alias("hex"))
    digit = lambda i: F.substring("hex", i, 1)
    short = C.parse_hex(F.concat(F.lit(" #"), digit(2), F.upper(digit(4)), digit(6)))
    return p.select("image_id", "idx", "hex", C.parse_hex(F.substring("hex", 2, 6))["r"].alias("r6"), *[short[c].alias(f"{c}3") for c in "rgb"], C.parse_hex(F.concat("hex", F.lit("0"))).isNull().alias("void"))


@query(f"WITH {D.EMB_SQL} SELECT image_id, (y - 3)*6 + x - 2 AS idx, x - 2 AS x, y - 3 AS y, v FROM emb WHERE x BETWEEN 2 AND 7 AND y BETWEEN 3 AND 6")
def q52_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.crop(D.emb(spark, sf_dir).withColumn("width", F.lit(8)), 2, 3, 9, 4).select("image_id", "idx", "x", "y", "v")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, (CAST(l_extendedprice AS DOUBLE) - 30000e0)/700e0 AS v FROM lineitem), w AS (SELECT *, CAST(floor(abs(v)*100 + 0.5e0) AS BIGINT) AS w FROM v)
SELECT l_orderkey, l_linenumber, (CASE WHEN v < 0 AND w > 0 THEN '-' ELSE '' END) || (w // 100) || '.' || lpad((w % 100)::VARCHAR, 2, '0') AS coord FROM w""")
def q53_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("l_extendedprice").cast("double") - 30000.0) / 700.0
    return D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.format_coord(v).alias("coord"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5,
  substring(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS name FROM pages""")
def q54_escaped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html(F.col("html")).cast("binary")).alias("escaped_md5"), T.sanitize_name(F.col("url")).alias("name"))


@query(f"WITH {D.EMB_SQL} SELECT image_id, " + ", ".join(f"CAST(floor(avg({c}) + 0.5e0) AS INT) AS {c}" for c in "rgb") + f" FROM emb WHERE {SAT} >= 150 GROUP BY image_id")
def q55_dominant_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.dominant_colour(D.emb(spark, sf_dir))


_KTH = ", ".join(f"max({c}) FILTER (k{c} = (n - 1)//2) AS {c}" for c in "rgb")
_RANKS = ", ".join(f"row_number() OVER (PARTITION BY image_id ORDER BY {c}) - 1 AS k{c}" for c in "rgb")


@query(f"WITH {D.EMB_SQL}, i AS (SELECT * FROM emb WHERE a >= 10 AND {SAT} >= 100), k AS (SELECT *, {_RANKS}, count(*) OVER (PARTITION BY image_id) AS n FROM i) SELECT image_id, {_KTH} FROM k GROUP BY image_id")
def q56_dominant_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.dominant_ink(D.emb(spark, sf_dir).withColumn("coverage", P.ink_coverage(200))).select("image_id", "r", "g", "b")


@query(f"WITH {D.EMB_SQL}, i AS (SELECT image_id, avg((a >= 10 AND {SAT} >= 90 AND greatest(r, g, b) <= 250)::INT) AS fraction FROM emb GROUP BY image_id) SELECT image_id, fraction, fraction BETWEEN 0.001e0 AND 0.3e0 AS usable FROM i")
def q57_mask_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mask_usable(D.emb(spark, sf_dir).withColumn("ink", P.chroma_ink()))


@query(f"""WITH {D.EMB_SQL}, p AS (SELECT image_id, x//4 + y//4*2 AS cluster, {_L} AS l, {_A} AS a_, {_B} AS b_ FROM emb),
m AS (SELECT image_id, cluster, avg(l) AS ml, avg(a_) AS ma, avg(b_) AS mb FROM p GROUP BY ALL)
SELECT p.image_id, CAST(floor(sum((l-ml)*(l-ml) + (a_-ma)*(a_-ma) + (b_-mb)*(b_-mb))*1000 + 0.5e0) AS BIGINT) AS error_milli FROM p JOIN m ON m.image_id = p.image_id AND m.cluster = p.cluster GROUP BY p.image_id""")
def q58_cluster_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.floor(F.col("x") / 4) + F.floor(F.col("y") / 4) * 2
    return H.within_cluster_error(D.emb(spark, sf_dir).withColumn("cluster", quarter)).select("image_id", milli(F.col("error"), "error_milli"))


@query(f"""WITH {D.OUTLINES_SQL}, d AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0e0) AS d FROM proc WINDOW w AS (PARTITION BY shape_id ORDER BY k))
SELECT shape_id, k, CAST(floor((sum(d) OVER (PARTITION BY shape_id ORDER BY k))/(sum(d) OVER (PARTITION BY shape_id))*1000 + 0.5e0) AS BIGINT) AS t_milli FROM d""")
def q59_chord_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chord_lengths(D.outlines(spark, sf_dir)).select("shape_id", "k", milli(F.col("t"), "t_milli"))


@query(f"""WITH {D.OUTLINES_SQL}, n AS (SELECT p.shape_id, p.x, p.y, q.x AS nx, q.y AS ny FROM proc p JOIN proc q ON q.shape_id = p.shape_id AND q.k = (p.k + 1) % 24)
SELECT shape_id, CAST(floor(sum(x*ny - nx*y)/2*1000 + 0.25e0) AS BIGINT) AS area_milli FROM n GROUP BY shape_id""")
def q60_shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shoelace(D.outlines(spark, sf_dir)).select("shape_id", F.floor(F.col("area") * 1000 + 0.25).alias("area_milli"))


@query(f"""WITH {D.BOXES_SQL}, p AS (SELECT a.image_id, a.box_id, b.box_id AS o_box_id, CAST(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1))*greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS BIGINT) AS inter, a.area + b.area AS total
FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id < b.box_id) SELECT image_id, box_id, o_box_id, inter, total - inter AS uni FROM p WHERE inter > 0""")
def q61_box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.box_overlaps(D.boxes(spark, sf_dir))


@query(f"WITH {D.EMB_SQL} SELECT image_id, idx, v < 128 AND NOT (image_id % 2 = 0 AND y BETWEEN image_id % 5 AND image_id % 5 + 1) AS ink FROM emb")
def q62_strip_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.emb(spark, sf_dir).withColumn("ink", F.col("v") < 128)
    start = (F.col("image_id") % 5).cast("int")
    rows = p.select("image_id").distinct().select("image_id", start.alias("start"), (start + 2).alias("end"), F.when(F.col("image_id") % 2 == 0, "text").otherwise("icon").alias("kind"))
    return B.strip_text_rows(p, rows).select("image_id", "idx", "ink")


@query(f"WITH {D.EMB_SQL}, n AS (SELECT image_id, count(*) FILTER (v/64e0 - 2 > 1) AS high, count(*) FILTER (v/64e0 - 2 > -1) AS low FROM emb GROUP BY image_id) SELECT image_id, CASE WHEN low = 0 THEN 1e0 ELSE high/low::DOUBLE END AS score FROM n")
def q63_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stability(D.emb(spark, sf_dir).select("image_id", (F.col("v") / 64.0 - 2).alias("v")))


@query("SELECT (range % 32 + 0.5e0)/32 AS x, (range // 32 + 0.5e0)/32 AS y FROM range(1024)")
def q64_grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.grid_points(spark, 32)


@query(f"""WITH {D.BOXES_SQL} SELECT a.image_id, a.box_id, max(b.box_id) AS parent_id FROM boxes a LEFT JOIN boxes b ON a.image_id = b.image_id AND a.box_id <> b.box_id
AND a.x1 >= b.x1 AND a.x2 <= b.x2 AND a.y1 >= b.y1 AND a.y2 <= b.y2 AND a.area*100 < b.area*98 AND b.area < 4000*0.9e0 GROUP BY ALL""")
def q65_last_painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_painted_container(D.boxes(spark, sf_dir), F.lit(4000))


@query(f"""WITH {D.BOXES_SQL}, {_CELLS}, h AS (SELECT b.image_id, b.box_id, c.cell_id FROM boxes b JOIN cells c ON c.image_id = b.image_id
  AND greatest(0, least(b.x2, c.x2) - greatest(b.x1, c.x1))*greatest(0, least(b.y2, c.y2) - greatest(b.y1, c.y1))*4 >= b.area),
p AS (SELECT c.image_id, c.cell_id, count(h.box_id) AS n FROM cells c LEFT JOIN h ON h.image_id = c.image_id AND h.cell_id = c.cell_id GROUP BY ALL),
o AS (SELECT image_id, count(*) FILTER (n = 1) AS matched, count(*) FILTER (n = 0) AS empty, count(*) FILTER (n > 1) AS multi, count(*) AS cells FROM p GROUP BY image_id),
b AS (SELECT b.image_id, b.box_id, count(h.cell_id) AS n FROM boxes b LEFT JOIN h ON h.image_id = b.image_id AND h.box_id = b.box_id GROUP BY ALL),
v AS (SELECT image_id, count(*) FILTER (n > 1) AS straddling, count(*) FILTER (n = 0) AS orphans FROM b GROUP BY image_id)
SELECT o.image_id, matched, empty, multi, straddling, orphans, CAST(floor(greatest(0e0, least(1e0, matched/cells::DOUBLE - (straddling + orphans)*0.1e0))*1000 + 0.5e0) AS BIGINT) AS agreement_milli FROM o JOIN v ON v.image_id = o.image_id""")
def q66_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = D.boxes(spark, sf_dir)
    return S.agreement(b, _cells(b)).select("image_id", "matched", "empty", "multi", "straddling", "orphans", milli(F.col("agreement"), "agreement_milli"))


@query(f"WITH {D.BOXES_SQL} SELECT image_id, box_id, CAST(x1 - 60 AS DOUBLE) AS x_min, CAST(y1 AS DOUBLE) AS y_min, CAST(x2 + 3 AS DOUBLE) AS x_max, CAST(y2 + 2 AS DOUBLE) AS y_max FROM boxes")
def q67_path_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, top, right, low = F.col("x1") - 60, F.col("y1"), F.col("x2") + 3, F.col("y2") + 2
    d = F.concat_ws(" ", F.lit("M"), left, top, F.lit("C"), "x2", top, right, "y2", left, low, F.lit("A 900 900 0 0 1"), "x2", "y2", F.lit("Z"))
    return D.boxes(spark, sf_dir).select("image_id", "box_id", T.path_bbox(d).alias("b")).select("image_id", "box_id", "b.*")


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<path')) AS INT) AS n_paths, CAST(len(regexp_extract_all(html, '<g[ >]')) AS INT) AS n_groups,
  CASE WHEN regexp_matches(html, 'viewBox="([^"]*)"') THEN regexp_extract(html, 'viewBox="([^"]*)"', 1) END AS view_box, CAST(strlen(html) AS INT) AS n_bytes FROM pages""")
def q68_markup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.svg_summary(D.table(spark, sf_dir, "pages"), "html", "page_id")


@query(f"""WITH RECURSIVE {D.EMB_SQL}, ink AS (SELECT image_id, idx, x, y FROM emb WHERE v > 127),
l AS (SELECT a.image_id, a.idx, b.idx AS other FROM ink a JOIN ink b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
c AS (SELECT image_id, idx, idx AS root FROM ink UNION SELECT l.image_id, l.other, c.root FROM c JOIN l ON l.image_id = c.image_id AND l.idx = c.idx),
r AS (SELECT image_id, idx, min(root) AS root FROM c GROUP BY ALL)
SELECT image_id, idx, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INT) AS region FROM r""")
def q69_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.regions(D.emb(spark, sf_dir), F.col("v") > 127, 8)


@query(f"""WITH {D.OUTLINES_SQL}, s AS (SELECT shape_id, avg(x) AS cx, avg(y) AS cy, (max(x) - min(x))/2 AS rx, (max(y) - min(y))/2 AS ry FROM proc GROUP BY shape_id),
d AS (SELECT s.*, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) AS d, x - cx AS dx, y - cy AS dy FROM proc JOIN s ON s.shape_id = proc.shape_id),
f AS (SELECT shape_id, cx, cy, rx, ry, max(abs(d - rx*ry/sqrt(pow(rx*dy/d, 2) + pow(ry*dx/d, 2)))) AS residual FROM d GROUP BY ALL)
SELECT shape_id, """ + ", ".join(f"CAST(floor({c}*1000 + 0.25e0) AS BIGINT) AS {c}_milli" for c in ("cx", "cy", "rx", "ry", "residual")) + ", residual <= least(greatest(0.5e0, least(rx, ry)*0.01e0), least(rx, ry)*0.05e0) AS accepted FROM f")
def q70_ellipse_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [F.floor(F.col(c) * 1000 + 0.25).alias(f"{c}_milli") for c in ("cx", "cy", "rx", "ry", "residual")]
    return G.ellipse_fit(D.outlines(spark, sf_dir)).select("shape_id", *steps, "accepted")
