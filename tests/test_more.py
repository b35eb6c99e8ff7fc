"""Regularisation, mask selection, gradients, reports."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_kernels import disc, painted

from pelgrain.functions import text as T
from pelgrain.kernels import masks as M
from pelgrain.kernels import quant, scene
from pelgrain.kernels import regularize as R
from pelgrain.operators import fit as G
from pelgrain.options import Options
from pelgrain.plans import convert as V
from pelgrain.sources.images import read_sidecar


def stroke(*points, **k):
    return R.Stroke([("M" if i == 0 else "L", list(map(float, p))) for i, p in enumerate(points)], **k)


def test_angles_and_grid():
    a, b = R.snap_angle((0, 0), (10, 0.5), (0.0, 90.0), 6)
    assert a[1] == pytest.approx(b[1]) == pytest.approx(0.25)
    assert R.snap_angle((0, 0), (10, 5), (0.0, 90.0), 6) == ((0, 0), (10, 5))
    assert R.snap_to_grid((1.4, 2.6), 1, 0.5) == (1, 3) and R.snap_to_grid((1.4, 2.6), 1, 0.3) == (1.4, 2.6)


def test_weld_and_close():
    s = [stroke((0, 0), (5, 5)), stroke((5.4, 5.2), (9, 9)), stroke((20, 0), (25, 5), (20.5, 0.5))]
    assert R.weld(s, 1.0) == 4  # the last stroke's own ends meet as well
    assert s[0].segments[-1][1] == s[1].segments[0][1] == pytest.approx([5.2, 5.1])
    assert [R.close_loop(x, 1.2) for x in s] == [False, False, True] and s[2].closed


def test_passes_report_what_they_did():
    t = np.linspace(0, math.pi, 15)
    s = [stroke((0, 0), (5, 0.1), (10, 0.2), width=2.0), stroke(*[(30 + 6 * math.cos(a), 30 + 6 * math.sin(a)) for a in t], width=2.1), stroke(*[(60 + 5 * math.cos(a), 9 + 5 * math.sin(a)) for a in 2 * t], width=4.0)]
    r = R.regularize(s)
    assert (r.lines_fitted, r.arcs_fitted, r.loops_closed, r.angles_snapped) == (1, 2, 1, 1)
    assert s[1].primitive["kind"] == "arc" and s[2].primitive["kind"] == "circle"
    assert s[0].width == s[1].width == 2.0 and s[2].width == 4.0 and r.widths_unified and 0.5 < r.confidence <= 1


def test_mirror_axis(spark):
    s = [stroke((2, 0), (8, 0)), stroke((4, 5), (6, 5))]
    assert R.mirror_axis(s, 0.1) == 5 and R.mirror_axis([stroke((2, 0), (9, 1))], 0.1) is None
    p = spark.createDataFrame([(0, 2.0, 0.0), (0, 8.0, 0.0), (0, 4.0, 5.0), (0, 6.0, 5.0), (1, 2.0, 0.0), (1, 9.0, 3.0)], "shape_id int, x double, y double")
    assert [tuple(r) for r in G.mirror_axes(p, tol=0.5).collect()] == [(0, 5.0)]


def test_spark_forms_agree_with_the_kernels(spark):
    rng = np.random.default_rng(1)
    lines = [(k, *map(float, rng.normal(0, 10, 4))) for k in range(60)]
    df = spark.createDataFrame(lines, "k int, x1 double, y1 double, x2 double, y2 double")
    for r in G.snapped_angles(df).collect():
        a, b = R.snap_angle(lines[r.k][1:3], lines[r.k][3:], (0.0, 45.0, 90.0, 135.0), 6.0)
        assert (r.x1, r.y1, r.x2, r.y2) == pytest.approx((*a, *b))
    pts = [(k, *map(float, rng.uniform(0, 6, 2))) for k in range(50)]
    ends = spark.createDataFrame([("i", *p) for p in pts], "image_id string, end_id int, x double, y double")
    assert {(r.a, r.b) for r in G.weld_pairs(ends, 0.5).collect()} == {(i, j) for i, *p in pts for j, *q in pts if i < j and math.dist(p, q) <= 0.5}
    g = {r.end_id: (r.x, r.y) for r in G.gridded(ends, 1.0, 0.3).collect()}
    assert all(g[k] == pytest.approx(R.snap_to_grid((x, y), 1.0, 0.3)) for k, x, y in pts)
    e = spark.createDataFrame([("i", 1, 2), ("i", 2, 3), ("i", 2, 4), ("j", 1, 1)], "image_id string, from int, to int")
    assert {r.image_id: r.n_odd for r in G.odd_nodes(e).collect()} == {"i": 4, "j": 0}
    row = spark.range(1).select(G.primitive_length(F.lit("circle"), F.lit(2.0), F.lit(2.0), F.lit(0.0), F.lit(0.0)).alias("c"), G.primitive_length(F.lit("rect"), F.lit(1.0), F.lit(1.0), F.lit(4.0), F.lit(3.0)).alias("r")).first()
    assert row.c == pytest.approx(4 * math.pi) and row.r == pytest.approx(scene.primitive_geometry({"kind": "rect", "x": 0, "y": 0, "width": 4, "height": 3, "rx": 1, "ry": 1})["length"])


def test_mask_selection():
    a, b = np.zeros((4, 4), np.uint8), np.zeros((4, 4), np.uint8)
    a[:2], b[:3] = 255, 255
    assert M.iou(a, b) == pytest.approx(2 / 3) and M.iou(a * 0, b * 0) == 0.0
    c = [(0.5, (0, 1), a), (0.9, (0, 0), b), (0.5, (0, 0), 255 - b)]
    assert M.select(c, 0.5) == [1, 2] and M.select(c, 0.7) == [1, 2, 0] and M.select([], 0.5) == []
    assert (M.upsample(a, 8, 8) == np.kron(a, np.ones((2, 2), np.uint8))).all()
    flat = np.full((3, 5, 3), 9, np.uint8)
    out, scale = M.model_input(flat, 10)
    assert scale == 2.0 and out.shape == (10, 10, 3) and (out[:6] == 9).all() and (out[6:] == 0).all()


def test_gradients_of_both_kinds():
    y, x = np.mgrid[:40, :40]
    px = np.full((40, 40, 4), 255, np.uint8)
    px[..., 0], px[..., 1], px[..., 2] = 40 + x * 4, 60, 200 - x * 3
    g = V.gradient(px, np.full(1600, 255, np.uint8))
    assert g["kind"] == "linear" and abs(g["x2"] - g["x1"]) > 35 and abs(g["y2"] - g["y1"]) < 2
    d = np.minimum(np.hypot(x - 19.5, y - 19.5) * 8, 255).astype(np.uint8)
    px[..., 0] = px[..., 1] = px[..., 2] = d
    assert V.gradient(px, np.full(1600, 255, np.uint8))["kind"] == "radial"
    assert V.gradient(painted(np.zeros((9, 9), np.uint8)), np.full(81, 255, np.uint8)) is None
    svg, _ = V.convert_one(px, Options(mode="photo", gradients="on", colors=2))
    assert "radialGradient" in svg or "linearGradient" in svg


def test_masks_regroup_nodes():
    px = painted(disc(32, 8))
    layers = quant.quantize(px, "icon", 4, "cutout")
    nodes = scene.build(V.shapes_of(layers, px, Options(mode="icon"), False, lambda: None), 32, 32)
    ink = next(z for z, x in enumerate(layers) if x.color != (255, 255, 255) and (x.mask > 127).sum() > 50)
    out = V.regroup(nodes, [("none", np.zeros((32, 32), np.uint8)), ("blob", layers[ink].mask.reshape(32, 32))], layers)
    assert {n["group"] for n in out if n["layer"] == ink} == {"blob"}


def test_reports(spark):
    px = painted(disc(32, 8))
    df = spark.createDataFrame([("i", 32, 32, bytearray(px.tobytes()))], "image_id string, width int, height int, rgba binary")
    m = read_sidecar(V.convert(df, {"mode": "icon"}))
    r = m.select(T.meta_report(F.col("meta")).alias("a"), T.markdown_report(F.col("meta")).alias("b"), F.size("meta.nodes").alias("n")).first()
    assert r.a.startswith(f"{r.n} nodes, ") and r.a.count("    painted ") == r.n and r.b.count("| `s-") == r.n


def test_masks_group_the_layers_of_a_conversion(spark):
    px = np.full((24, 24, 4), 255, np.uint8)
    px[3:9, 3:9, :3], px[14:21, 14:21, :3] = (200, 0, 0), (0, 0, 200)
    images = spark.createDataFrame([("a", 24, 24, bytearray(px.tobytes())), ("b", 24, 24, bytearray(px.tobytes()))], "image_id string, width int, height int, rgba binary")
    left = np.zeros((12, 12), int)  # half the size: drawn to the image's
    left[:6, :6] = 255
    rows = [("a", k, n, 12, 12, i, int(v)) for k, (n, m) in enumerate((("far", left[::-1, ::-1] * 0), ("corner", left), ("same", left))) for i, v in enumerate(m.ravel())]
    given = spark.createDataFrame(rows, "image_id string, mask_idx long, mask_id string, width int, height int, idx int, cov int")
    out = V.convert(images, {"mode": "icon", "colors": 3, "layering": "cutout"}, given)
    groups = {(r.image_id, (r.fill.r, r.fill.b)): r.group for r in V.inspect(out).collect()}
    assert groups["a", (200, 0)] == "corner" and groups["a", (0, 200)] != "corner"
    assert 'id="corner"' in {r.image_id: r.svg for r in out.collect()}["a"]
    assert groups["b", (200, 0)].startswith("g-")


def test_sheets_name_paint_and_write_their_icons(spark, tmp_path):
    from pelgrain.plans import sheet
    from pelgrain.sources import derived as D

    images = D.sheets(spark)
    icons = sheet.sheet_icons(images).collect()
    assert {(r.name, tuple(r.color)) for r in icons if r.image_id == "0"} == {(f"icon-{r}-{c}", (210, 30, 50)) for r in range(3) for c in range(3)}
    assert all(r.gradient is None and 'stroke="#d21e32"' in r.svg for r in icons)
    assert sheet.write_sheets(images, str(tmp_path / "none"), dry_run=True).count() == 2 and not (tmp_path / "none").exists()
    manifest = sheet.write_sheets(images, f"file://{tmp_path}/out")
    assert sorted((r.image_id, r.n_icons) for r in manifest.collect()) == [("0", 9), ("1", 9)]
    assert spark.read.parquet(f"file://{tmp_path}/out/icons").count() == 18


def test_ink_paint_finds_a_ramp():
    from pelgrain.plans.sheet import grown, ink_paint

    y, x = np.mgrid[:40, :60]
    px = np.full((40, 60, 4), 255, np.uint8)
    px[..., 0], px[..., 1], px[..., 2] = 180 + x, 10, 20 + y // 2
    ink = (abs(y - 20) < 12) & (abs(x - 30) < 25)
    flat, ramp = ink_paint(px, ink, 100, 7)
    assert flat == (210, 10, 30) and ramp["residual"] < 1 and ramp["x2"] > ramp["x1"] > 100 and ramp["end"]["r"] > ramp["start"]["r"]
    assert ink_paint(px, ink & False, 0, 0) == (None, None)
    one = np.zeros((9, 9), bool)
    one[4, 4] = True
    assert (grown(one, 3) == ((abs(np.mgrid[:9, :9] - 4)).max(axis=0) <= 3)).all()
