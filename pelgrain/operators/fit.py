"""Closed-form fits and exact geometry of point sets and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Nodes and weights of the five-point Gauss rule on [-1, 1].
GAUSS = (
    (0.0, 0.5688888888888889),
    (-0.5384693101056831, 0.47862867049936647),
    (0.5384693101056831, 0.47862867049936647),
    (-0.906179845938664, 0.23692688505618908),
    (0.906179845938664, 0.23692688505618908),
)


def _det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def solve3(m: list[list[Column]], v: list[Column], least: float) -> list[Column]:
    """Cramer's rule; nulls where the determinant is under `least`."""
    det = _det3(m)
    swap = lambda k: [[v[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]
    return [F.when(F.abs(det) >= least, _det3(swap(k)) / det) for k in range(3)]


def plane_fit(pixels: DataFrame, value: str) -> DataFrame:
    """image_id, c0, c1, c2: the least-squares plane of integer values; sums are exact, one solve for each image."""
    x, y, v = (F.col(c).cast("long") for c in ("x", "y", value))
    s = pixels.groupBy("image_id").agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"), F.sum(v).alias("v0"), F.sum(x * v).alias("v1"), F.sum(y * v).alias("v2")
    )
    d = {c: F.col(c).cast("double") for c in s.columns[1:]}
    m = [[d["n"], d["sx"], d["sy"]], [d["sx"], d["sxx"], d["sxy"]], [d["sy"], d["sxy"], d["syy"]]]
    return s.select("image_id", *[c.alias(f"c{k}") for k, c in enumerate(solve3(m, [d["v0"], d["v1"], d["v2"]], 1e-7))])


def plane_residual(pixels: DataFrame, value: str, fit: DataFrame) -> DataFrame:
    """image_id, residual: root mean square of what the plane leaves."""
    p = pixels.join(fit, "image_id")
    d = F.col(value) - (F.col("c0") + F.col("c1") * F.col("x") + F.col("c2") * F.col("y"))
    return p.groupBy("image_id").agg(F.sqrt(F.avg(d * d)).alias("residual"))


def lab_gradient(pixels: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """image_id, layer, residual, dir_x, dir_y, promoted: the linear gradient of each layer's colours in Lab.

    pixels: image_id, layer, x, y, lab. Flat layers (standard deviation under 1) and layers of under
    three pixels give none. The direction is that of the steepest change over the three channels.
    """
    keys = ["image_id", "layer"]
    ch = {c: F.col(f"lab.{c}") for c in "lab"}
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    s = pixels.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"),
        *[F.sum(v * w).alias(f"s{c}{k}") for c, v in ch.items() for k, w in enumerate((F.lit(1.0), x, y))], sum((F.var_pop(v) for v in list(ch.values())[1:]), F.var_pop(ch["l"])).alias("var"),
    ).where("n >= 3 and var >= 1.0")
    m = [[F.col("n"), F.col("sx"), F.col("sy")], [F.col("sx"), F.col("sxx"), F.col("sxy")], [F.col("sy"), F.col("sxy"), F.col("syy")]]
    fit = s.select(*keys, *[c.alias(f"{n}{k}") for n in "lab" for k, c in enumerate(solve3(m, [F.col(f"s{n}{j}") for j in range(3)], 1e-7))]).where("l0 is not null and a0 is not null and b0 is not null")
    off = [ch[n] - (F.col(f"{n}0") + F.col(f"{n}1") * x + F.col(f"{n}2") * y) for n in "lab"]
    r = pixels.join(fit, keys).groupBy(*keys).agg(F.sqrt(F.avg(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])).alias("residual"))
    dot = lambda i, j: sum((F.col(f"{n}{i}") * F.col(f"{n}{j}") for n in "ab"), F.col(f"l{i}") * F.col(f"l{j}"))
    g = fit.select(*keys, dot(1, 1).alias("e"), dot(2, 2).alias("g"), dot(1, 2).alias("f"))
    top = (F.col("e") + F.col("g") + F.sqrt((F.col("e") - F.col("g")) * (F.col("e") - F.col("g")) + F.col("f") * F.col("f") * 4)) / 2
    vx, vy = F.col("f"), top - F.col("e")
    length = F.sqrt(vx * vx + vy * vy)
    axis = F.abs("f") < 1e-9
    dx = F.when(axis, F.when(F.col("e") >= F.col("g"), 1.0).otherwise(0.0)).when(length < 1e-9, 1.0).otherwise(vx / length)
    dy = F.when(axis, F.when(F.col("e") >= F.col("g"), 0.0).otherwise(1.0)).when(length < 1e-9, 0.0).otherwise(vy / length)
    return r.join(g.select(*keys, dx.alias("dir_x"), dy.alias("dir_y")), keys).withColumn("promoted", F.col("residual") < tolerance)


def ink_gradient(samples: DataFrame, least: int = 30, most: float = 36.0) -> DataFrame:
    """image_id, n, x1, y1, x2, y2, start, end (structs r, g, b), residual: a plane through the colours of an icon's saturated ink.

    samples: image_id, x, y, r, g, b. The axis is the direction in which the three channels change most
    together; it reaches from the 5th to the 95th percentile of the samples along it. Too few samples,
    samples on one line, a flat colour or a poor fit give no row.
    """
    c, mean, cov = F.col, F.avg, F.covar_pop
    s = samples.groupBy("image_id").agg(
        F.count("*").alias("n"), mean("x").alias("mx"), mean("y").alias("my"), cov("x", "x").alias("xx"), cov("x", "y").alias("xy"), cov("y", "y").alias("yy"),
        *[f.alias(f"{n}{k}") for k in "rgb" for n, f in (("m", mean(k)), ("cx", cov("x", k)), ("cy", cov("y", k)))],
    ).where(c("n") >= least)
    det = c("xx") * c("yy") - c("xy") * c("xy")
    s = s.where(det > 1e-9)
    s = s.withColumns({f"bx{k}": (c("yy") * c(f"cx{k}") - c("xy") * c(f"cy{k}")) / det for k in "rgb"} | {f"by{k}": (c("xx") * c(f"cy{k}") - c("xy") * c(f"cx{k}")) / det for k in "rgb"})
    dot = lambda a, b: c(f"{a}r") * c(f"{b}r") + c(f"{a}g") * c(f"{b}g") + c(f"{a}b") * c(f"{b}b")
    s = s.withColumns({"e": dot("bx", "bx"), "f": dot("bx", "by"), "g": dot("by", "by")})
    top = (c("e") + c("g") + F.sqrt((c("e") - c("g")) * (c("e") - c("g")) + c("f") * c("f") * 4)) / 2
    s = s.withColumn("top", top).where("top >= 1e-9")
    flat = F.abs("f") < 1e-12
    vx, vy = F.when(flat, F.when(c("e") >= c("g"), 1.0).otherwise(0.0)).otherwise(c("f")), F.when(flat, F.when(c("e") >= c("g"), 0.0).otherwise(1.0)).otherwise(c("top") - c("e"))
    sign = F.when(vx + vy < 0, -1.0).otherwise(1.0) / F.sqrt(vx * vx + vy * vy)
    s = s.withColumns({"dx": vx * sign, "dy": vy * sign}).drop("e", "f", "g", "top", "xx", "xy", "yy", *[f"c{a}{k}" for a in "xy" for k in "rgb"])
    p = samples.join(s, "image_id")
    ox, oy = c("x") - c("mx"), c("y") - c("my")
    off = [c(k) - (c(f"m{k}") + c(f"bx{k}") * ox + c(f"by{k}") * oy) for k in "rgb"]
    r = p.groupBy("image_id").agg(F.percentile(ox * c("dx") + oy * c("dy"), F.array(F.lit(0.05), F.lit(0.95))).alias("t"), F.sqrt(F.avg(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])).alias("residual"))
    out = s.join(r, "image_id").where((F.abs(c("t")[1] - c("t")[0]) >= 1e-6) & (c("residual") <= most))
    at = lambda k: (c("mx") + c("dx") * c("t")[k], c("my") + c("dy") * c("t")[k])
    paint = lambda k: F.struct(*[F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c(f"m{n}") + (c(f"bx{n}") * c("dx") + c(f"by{n}") * c("dy")) * c("t")[k])) + 0.5).cast("int").alias(n) for n in "rgb"])
    return out.select("image_id", "n", at(0)[0].alias("x1"), at(0)[1].alias("y1"), at(1)[0].alias("x2"), at(1)[1].alias("y2"), paint(0).alias("start"), paint(1).alias("end"), "residual")


def circle_fit(points: DataFrame, key: str = "shape_id", tolerance: float = 0.5) -> DataFrame:
    """key, cx, cy, r, residual, accepted: the algebraic least-squares circle. Eight sums and a second look at the points."""
    x, y = F.col("x"), F.col("y")
    z = x * x + y * y
    s = points.groupBy(key).agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.sum(x * z).alias("sxz"), F.sum(y * z).alias("syz"), F.sum(z).alias("szz"))
    c = F.col
    k = solve3([[c("n"), c("sx"), c("sy")], [c("sx"), c("sxx"), c("sxy")], [c("sy"), c("sxy"), c("syy")]], [-c("szz"), -c("sxz"), -c("syz")], 1e-15)
    f = s.select(key, (-k[1] / 2.0).alias("cx"), (-k[2] / 2.0).alias("cy"), k[0].alias("c")).withColumn("r2", c("cx") * c("cx") + c("cy") * c("cy") - c("c"))
    f = f.where("r2 > 0").select(key, "cx", "cy", F.sqrt("r2").alias("r"))
    d = F.abs(F.sqrt((x - c("cx")) * (x - c("cx")) + (y - c("cy")) * (y - c("cy"))) - c("r"))
    far = points.join(f, key).groupBy(key).agg(F.max(d).alias("residual"))
    bound = F.least(F.greatest(F.lit(tolerance), c("r") * 0.01), c("r") * 0.05)
    return f.join(far, key).withColumn("accepted", c("residual") <= bound)


def ellipse_fit(points: DataFrame, key: str = "shape_id", tolerance: float = 0.5) -> DataFrame:
    """key, cx, cy, rx, ry, residual, accepted: centroid and half the box, judged along each point's angle."""
    c = F.col
    s = points.groupBy(key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), ((F.max("x") - F.min("x")) / 2).alias("rx"), ((F.max("y") - F.min("y")) / 2).alias("ry")).where("rx >= 1e-10 and ry >= 1e-10")
    dx, dy = c("x") - c("cx"), c("y") - c("cy")
    d = F.sqrt(dx * dx + dy * dy)
    sin, cos = F.when(d > 0, dy / d).otherwise(0.0), F.when(d > 0, dx / d).otherwise(1.0)
    edge = c("rx") * c("ry") / F.sqrt(c("rx") * sin * c("rx") * sin + c("ry") * cos * c("ry") * cos)
    far = points.join(s, key).groupBy(key).agg(F.max(F.abs(d - edge)).alias("residual"))
    least = F.least("rx", "ry")
    return s.join(far, key).withColumn("accepted", c("residual") <= F.least(F.greatest(F.lit(tolerance), least * 0.01), least * 0.05))


def shoelace(points: DataFrame, key: str = "shape_id", order: str = "k") -> DataFrame:
    """key, area: signed, of the closed polygon."""
    w = W.partitionBy(key).orderBy(order)
    first = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = {c: F.coalesce(F.lead(c).over(w), F.first(c).over(first)).alias(f"n{c}") for c in "xy"}
    p = points.select(key, "x", "y", *nxt.values())
    return p.groupBy(key).agg((F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"))


def rect_fit(points: DataFrame, key: str = "shape_id", order: str = "k", tolerance: float = 0.5) -> DataFrame:
    """key, x, y, width, height, accepted: a box its polygon fills to 0.93, with every point near an edge."""
    c = F.col
    box = points.groupBy(key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).where("x1 - x0 >= 1e-10 and y1 - y0 >= 1e-10")
    w, h = c("x1") - c("x0"), c("y1") - c("y0")
    d = F.least(F.abs(c("x") - c("x0")), F.abs(c("x") - c("x1")), F.abs(c("y") - c("y0")), F.abs(c("y") - c("y1")))
    far = points.join(box, key).groupBy(key).agg(F.max(d).alias("far"))
    j = box.join(far, key).join(shoelace(points, key, order), key)
    ok = (F.abs("area") >= w * h * 0.93) & (c("far") <= F.greatest(F.lit(tolerance), F.least(w, h) * 0.15))
    return j.select(key, c("x0").alias("x"), c("y0").alias("y"), w.alias("width"), h.alias("height"), ok.alias("accepted"))


def recognise(points: DataFrame, key: str = "shape_id", order: str = "k", tolerance: float = 0.5) -> DataFrame:
    """key, kind: circle, else ellipse, else rect, else null."""
    a = circle_fit(points, key, tolerance).where("accepted").select(key, F.lit("circle").alias("ca"))
    b = ellipse_fit(points, key, tolerance).where("accepted").select(key, F.lit("ellipse").alias("cb"))
    d = rect_fit(points, key, order, tolerance).where("accepted").select(key, F.lit("rect").alias("cd"))
    j = points.select(key).distinct().join(a, key, "left").join(b, key, "left").join(d, key, "left")
    return j.select(key, F.coalesce("ca", "cb", "cd").alias("kind"))


def line_fit(points: DataFrame, key: str = "shape_id") -> DataFrame:
    """key, px, py, dx, dy: the total-least-squares line through the centroid."""
    c = F.col
    s = points.groupBy(key).agg(F.avg("x").alias("px"), F.avg("y").alias("py"), F.covar_pop("x", "x").alias("a"), F.covar_pop("x", "y").alias("b"), F.covar_pop("y", "y").alias("d"))
    t = F.atan2(c("b") * 2, c("a") - c("d")) / 2
    return s.select(key, "px", "py", F.cos(t).alias("dx"), F.sin(t).alias("dy"))


def chord_lengths(points: DataFrame, key: str = "shape_id", order: str = "k") -> DataFrame:
    """points with `t`: the share of the open polyline's length up to each; 0 where there is no length."""
    w = W.partitionBy(key).orderBy(order)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    p = points.withColumn("_d", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    p = p.withColumns({"_s": F.sum("_d").over(w), "_t": F.sum("_d").over(W.partitionBy(key))})
    return p.withColumn("t", F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).otherwise(0.0)).drop("_d", "_s", "_t")


def corners(points: DataFrame, smoothness: float, key: str = "shape_id", order: str = "k") -> DataFrame:
    """points with `corner`: the turn at a vertex of the closed polygon, over pi, reaches smoothness / 1.34."""
    w, all_ = W.partitionBy(key).orderBy(order), W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = {f"n{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(all_)) for c in "xy"}
    p = {f"p{c}": F.coalesce(F.lag(c).over(w), F.last(c).over(all_)) for c in "xy"}
    q = points.withColumns({f"_{k}": v for k, v in (n | p).items()})
    ax, ay, bx, by = F.col("x") - F.col("_px"), F.col("y") - F.col("_py"), F.col("_nx") - F.col("x"), F.col("_ny") - F.col("y")
    turn = F.abs(F.atan2(ax * by - ay * bx, ax * bx + ay * by))
    return q.withColumn("corner", turn / F.pi() >= smoothness / 1.34).drop("_nx", "_ny", "_px", "_py")


def point_in_polygon(points: DataFrame, edges: DataFrame, key: str = "shape_id") -> DataFrame:
    """points (key, point_id, x, y) with `inside`: an odd number of edges (key, x1, y1, x2, y2) crossed by a ray."""
    p = points.join(edges, key, "left")
    c = F.col
    cross = ((c("y1") > c("y")) != (c("y2") > c("y"))) & (c("x") < (c("x2") - c("x1")) * (c("y") - c("y1")) / (c("y2") - c("y1")) + c("x1"))
    return p.groupBy(key, "point_id").agg((F.count(F.when(cross, 1)) % 2 == 1).alias("inside"))


def _cubic(p: list[Column], t: float) -> Column:
    u = 1 - t
    return p[0] * (u * u * u) + p[1] * (3 * u * u * t) + p[2] * (3 * u * t * t) + p[3] * (t * t * t)


def _slope(p: list[Column], t: float) -> Column:
    u = 1 - t
    return (p[1] - p[0]) * (3 * u * u) + (p[2] - p[1]) * (6 * u * t) + (p[3] - p[2]) * (3 * t * t)


def cubic_geometry(segments: DataFrame, key: str = "shape_id", spans: int = 8) -> DataFrame:
    """key, area, length, bbox of closed paths of cubics (key, x0, y0, ..., x3, y3).

    Area by Green's theorem, exact with the five-point rule; length by that rule on eight spans;
    the box by the roots of the slopes.
    """
    xs, ys = ([F.col(f"{c}{k}") for k in range(4)] for c in "xy")
    area = length = None
    for node, weight in GAUSS:
        t = (node + 1) / 2
        a = (_cubic(xs, t) * _slope(ys, t) - _cubic(ys, t) * _slope(xs, t)) * (weight / 4)
        area = a if area is None else area + a
        for k in range(spans):
            t = (k + (node + 1) / 2) / spans
            dx, dy = _slope(xs, t), _slope(ys, t)
            v = F.sqrt(dx * dx + dy * dy) * (weight / 2 / spans)
            length = v if length is None else length + v

    def reach(p: list[Column]) -> tuple[Column, Column]:
        a, b, c = p[3] - p[2] * 3 + p[1] * 3 - p[0], p[2] * 2 - p[1] * 4 + p[0] * 2, p[1] - p[0]
        disc = b * b - a * c * 4
        roots = [F.when(F.abs(a) > 1e-12, F.when(disc >= 0, (-b + F.sqrt(disc) * s) / (a * 2))).when(F.abs(b) > 1e-12, -c / b) for s in (1, -1)]
        at = [F.when((r > 0) & (r < 1), p[0] * (1 - r) * (1 - r) * (1 - r) + p[1] * 3 * (1 - r) * (1 - r) * r + p[2] * 3 * (1 - r) * r * r + p[3] * r * r * r) for r in roots]
        return F.least(p[0], p[3], *at), F.greatest(p[0], p[3], *at)

    (x0, x1), (y0, y1) = reach(xs), reach(ys)
    return segments.groupBy(key).agg(F.sum(area).alias("area"), F.sum(length).alias("length"), F.min(x0).alias("x_min"), F.min(y0).alias("y_min"), F.max(x1).alias("x_max"), F.max(y1).alias("y_max"))


def snapped_angles(lines: DataFrame, snaps: tuple[float, ...] = (0.0, 45.0, 90.0, 135.0), most: float = 6.0) -> DataFrame:
    """lines (x1, y1, x2, y2) turned about their middle to the nearest direction mod 180 degrees, if within `most`."""
    c = F.col
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    size, angle = F.sqrt(dx * dx + dy * dy), F.degrees(F.atan2(dy, dx))
    off = lambda s: F.pmod(angle - s + 90.0, F.lit(180.0)) - 90.0
    turn = F.least(*[F.struct(F.abs(off(s)).alias("a"), F.lit(k).alias("k"), off(s).alias("d")) for k, s in enumerate(snaps)])
    p = lines.withColumns({"_t": turn, "_s": size, "_a": angle})
    ok = (c("_s") >= 1e-12) & (c("_t.a") <= most)
    t = F.radians(c("_a") - c("_t.d"))
    mx, my, hx, hy = (c("x1") + c("x2")) / 2, (c("y1") + c("y2")) / 2, c("_s") / 2 * F.cos(t), c("_s") / 2 * F.sin(t)
    new = {"x1": mx - hx, "y1": my - hy, "x2": mx + hx, "y2": my + hy}
    return p.withColumns({n: F.when(ok, v).otherwise(c(n)) for n, v in new.items()}).withColumn("snapped", ok).drop("_t", "_s", "_a")


def gridded(points: DataFrame, pitch: float = 1.0, most: float = 1.5) -> DataFrame:
    """points on the nearest grid point, where both coordinates are near enough."""
    near = {c: F.floor(F.col(c) / pitch + 0.5) * pitch for c in "xy"}
    ok = (F.abs(F.col("x") - near["x"]) <= most) & (F.abs(F.col("y") - near["y"]) <= most)
    return points.withColumns({c: F.when(ok, v).otherwise(F.col(c)) for c, v in near.items()})


def mirror_axes(points: DataFrame, key: str = "shape_id", tol: float = 1.0) -> DataFrame:
    """key, axis: the mean x of shapes of which every point has a partner mirrored at it; others are left out.

    The join is within a shape, on rows of height `tol`, so it meets neighbours only.
    """
    mid = points.groupBy(key).agg(F.avg("x").alias("axis"))
    p = points.join(mid, key).withColumn("_id", F.xxhash64("x", "y"))
    band = F.floor(F.col("y") / tol)
    q = points.select(key, F.col("x").alias("qx"), F.col("y").alias("qy"), F.explode(F.array(*[F.floor(F.col("y") / tol) + d for d in (-1, 0, 1)])).alias("_b"))
    hit = p.withColumn("_b", band).join(q, [key, "_b"]).where(F.sqrt((F.col("qx") - (F.col("axis") * 2 - F.col("x"))) * (F.col("qx") - (F.col("axis") * 2 - F.col("x"))) + (F.col("qy") - F.col("y")) * (F.col("qy") - F.col("y"))) <= tol)
    lone = p.join(hit.select(key, "_id").distinct(), [key, "_id"], "left_anti").select(key).distinct()
    return mid.join(lone, key, "left_anti")


def weld_pairs(ends: DataFrame, eps: float, key: str = "image_id") -> DataFrame:
    """Pairs of stroke ends (key, end_id, x, y) within eps: an equi join on cells of side eps and their neighbours."""
    cell = lambda c: F.floor(F.col(c) / eps)
    a = ends.select(key, F.col("end_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = ends.select(key, F.col("end_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(d).alias("d")).select(key, "b", "bx", "by", (F.floor(F.col("bx") / eps) + F.col("d.i")).alias("cx"), (F.floor(F.col("by") / eps) + F.col("d.j")).alias("cy"))
    near = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))) <= eps
    return a.join(b, [key, "cx", "cy"]).where((F.col("a") < F.col("b")) & near).select(key, "a", "b")


def odd_nodes(edges: DataFrame, key: str = "image_id") -> DataFrame:
    """key, n_odd: graph nodes with an odd number of edge ends (edges: key, from, to)."""
    ends = edges.select(key, F.explode(F.array("from", "to")).alias("n"))
    deg = ends.groupBy(key, "n").agg(F.count("*").alias("d"))
    return deg.groupBy(key).agg(F.count(F.when(F.col("d") % 2 == 1, 1)).alias("n_odd"))


def component_widths(distances: DataFrame) -> DataFrame:
    """image_id, component, width, n: twice the greatest half-width of each component (image_id, component, dist)."""
    return distances.groupBy("image_id", "component").agg((F.max("dist") * 2).alias("width"), F.count("*").alias("n"))


def primitive_length(kind: Column, rx: Column, ry: Column, w: Column, h: Column) -> Column:
    """Outline length: Ramanujan's for circles and ellipses, corners of a box as quarter circles of rx."""
    pi = 3.141592653589793
    k = F.try_divide(rx - ry, rx + ry)
    k = k * k * 3
    round_ = (rx + ry) * pi * (k / (F.sqrt(F.lit(4.0) - k) + 10.0) + 1.0)
    return F.when(kind.isin("circle", "ellipse"), round_).when(kind == "rect", (w + h) * 2 - rx * (8 - 2 * pi))
