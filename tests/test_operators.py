"""Operators on small hand-made tables, sources, options and streaming."""

import base64
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_kernels import disc, painted

from pelgrain import options as O
from pelgrain.functions import color as C
from pelgrain.functions import text as T
from pelgrain.kernels import png, quant, resample
from pelgrain.kernels import scene
from pelgrain.operators import bands as B
from pelgrain.operators import colours as H
from pelgrain.operators import fit as G
from pelgrain.operators import layers as L
from pelgrain.operators import neighbourhood as N
from pelgrain.operators import pixels as P
from pelgrain.operators import shapes as S
from pelgrain.plans import convert as V
from pelgrain.sources import derived as D
from pelgrain.sources import images as I
from pelgrain.streaming.files import convert_stream


def table(spark, px, image_id="i"):
    h, w = px.shape[:2]
    rows = [(image_id, y * w + x, x, y, *map(int, px[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id string, idx int, x int, y int, r int, g int, b int, a int")


def masked(spark, ink):
    return spark.createDataFrame([("i", y * ink.shape[1] + x, x, y, bool(ink[y, x])) for y in range(ink.shape[0]) for x in range(ink.shape[1])], "image_id string, idx int, x int, y int, ink boolean")


def one(df, *cols):
    (r,) = df.select(*cols).collect()
    return tuple(r) if len(cols) > 1 else r[0]


@pytest.fixture(scope="module")
def random_image():
    return np.random.default_rng(5).integers(0, 256, (20, 24, 4)).astype(np.uint8)


def test_lab_and_back(spark):
    rgb = [(r, g, b) for r in (0, 10, 128, 255) for g in (0, 77, 255) for b in (0, 200)]
    df = spark.createDataFrame(rgb, "r int, g int, b int").withColumn("lab", C.lab(F.col("r"), F.col("g"), F.col("b")))
    got = df.select("r", "g", "b", "lab.l", "lab.a", "lab.b", C.lab_to_srgb(F.col("lab")).alias("back")).collect()
    want = quant.to_lab(np.array([(r[0], r[1], r[2]) for r in got]))
    assert np.allclose([[r[3], r[4], r[5]] for r in got], want, atol=1e-9)
    # half a step is added before rounding: never down, at most one up
    assert all(0 <= b - a <= 1 for r in got for a, b in zip(r[:3], r.back, strict=True))


def test_hex_colours(spark):
    df = spark.createDataFrame([("#fff",), ("0a1B2c",), ("#12",), (None,), ("#gggggg",)], "s string")
    assert [tuple(r.c) if r.c else None for r in df.select(C.parse_hex(F.col("s")).alias("c")).collect()] == [(255, 255, 255), (10, 27, 44), None, None, None]
    assert one(spark.range(1).select(C.format_hex(F.lit(10), F.lit(0), F.lit(255)).alias("h")), "h") == "#0a00ff"


def test_matte_and_crop(spark):
    px = np.array([[[100, 0, 0, 0], [100, 0, 0, 255], [100, 0, 0, 128]]], np.uint8)
    t = table(spark, px)
    assert [r.r for r in P.matte(t, (200, 0, 0)).orderBy("x").collect()] == [200, 100, math.floor(100 * 128 / 255 + 200 * (1 - 128 / 255) + 0.5)]
    assert [r.a for r in P.apply_alpha_mode(t, "threshold", 128).orderBy("x").collect()] == [0, 255, 255]
    assert P.apply_alpha_mode(t, "keep") is t
    assert [(r.x, r.y, r.idx) for r in P.crop(t, 1, 0, 2, 5).orderBy("x").collect()] == [(0, 0, 0), (1, 0, 1)]
    with pytest.raises(ValueError):
        P.apply_alpha_mode(t, "other")


def test_pixel_table_and_kernel_agree(spark, random_image):
    px = random_image.copy()
    px[..., 3] = 255
    assert one(N.jpeg_quality(table(spark, px), ["r", "g", "b"]), "quality") == pytest.approx(resample.blockiness(px))
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in N.deblock(table(spark, px), ["r", "g", "b"]).collect()}
    want = resample.deblock(px)
    assert all(got[y, x] == tuple(map(int, want[y, x, :3])) for y in range(20) for x in range(24))
    luma = np.floor(px[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.int64)
    assert one(H.otsu_luma(table(spark, px)), "threshold") == quant.otsu(luma.ravel())


def test_classes_agree(spark):
    images = {"disc": painted(disc(40, 12)), "thin": painted(disc(64, 3), (0, 0, 0)), "noise": np.random.default_rng(1).integers(0, 256, (40, 40, 4)).astype(np.uint8)}
    images["noise"][..., 3] = 255
    tiles = np.full((16, 16, 4), 255, np.uint8)
    for k in range(16):
        tiles[k // 4 * 4 : k // 4 * 4 + 4, k % 4 * 4 : k % 4 * 4 + 4, :3] = [(250, 0, 0), (0, 250, 0), (0, 0, 250), (10, 10, 10)][k % 4]
    images["tiles"] = tiles
    df = None
    for name, px in images.items():
        df = table(spark, px, name) if df is None else df.unionByName(table(spark, px, name))
    got = {r.image_id: r.mode for r in N.classify(df).collect()}
    assert got == {name: resample.classify(px) for name, px in images.items()} and len(set(got.values())) >= 3


def test_background_needs_three_corners(spark):
    px = painted(disc(8, 2))
    assert one(H.detect_background(table(spark, px)), "corner", "r") == (0, 255) and resample.background(px) == (255, 255, 255)
    px[0, 0, :3] = (9, 9, 9)
    assert one(H.detect_background(table(spark, px)), "corner") == 1
    px[7, 7, :3] = (9, 9, 200)
    assert H.detect_background(table(spark, px)).count() == 0 and resample.background(px) is None


def test_duotone(spark):
    assert one(H.duotone(table(spark, painted(disc(20, 6), (0, 0, 0)))), "is_duotone")
    px = painted(disc(20, 6), (0, 0, 0))
    px[:6, :, :3] = (230, 60, 10)
    assert not one(H.duotone(table(spark, px)), "is_duotone")


def test_gaps_and_islands(spark):
    p = spark.createDataFrame([("i", k, v) for k, v in enumerate([0, 5, 5, 5, 0, 5, 5, 0, 0, 0, 0, 5, 5, 5, 5])], "image_id string, pos int, n int")
    assert sorted((r.start, r.end) for r in B.find_bands(p, "n", 3, 3).collect()) == [(1, 7), (11, 15)]
    assert B.find_bands(p.where("n > 9"), "n").count() == 0


def test_lattice_scores(spark):
    ink = np.zeros((60, 80), bool)
    for r in range(3):
        for c in range(4):
            ink[r * 20 + 3 : r * 20 + 15, c * 20 + 3 : c * 20 + 15] = True
    assert one(B.infer_lattice(masked(spark, ink)), "n_cols", "n_rows", "score", "is_lattice") == (4, 3, 1.0, True)
    assert one(B.infer_lattice(masked(spark, ink[:20, :20])), "score") == 0.0


def test_rows_of_text(spark):
    ink = np.zeros((60, 40), bool)
    for top in (2, 32):
        ink[top : top + 16, 4:16] = ink[top : top + 16, 24:36] = True
        ink[top + 20 : top + 24, 2:38] = True
    rows = B.classify_rows(masked(spark, ink))
    kinds = {(r.start, r.end): r.kind for r in rows.collect()}
    assert kinds == {(2, 18): "icon", (22, 26): "text", (32, 48): "icon", (52, 56): "text"}
    assert B.strip_text_rows(masked(spark, ink), rows).where("ink").count() == 4 * 16 * 12
    found = B.label_below(rows.where("kind = 'icon'"), rows.where("kind = 'text'")).orderBy("start").collect()
    assert [r.label_start for r in found] == [22, 52]


def test_dilation_and_segments(spark):
    ink = np.zeros((7, 7), bool)
    ink[3, 3] = True
    grown = {(r.x, r.y) for r in N.dilate(masked(spark, ink), 1).where("ink").collect()}
    assert grown == {(x, y) for x in (2, 3, 4) for y in (2, 3, 4)}
    px = np.zeros((3, 3, 4), np.uint8)
    px[1, 1] = 255
    px[0, 0] = 255
    assert N.marching_segments(table(spark, px), "r").count() == 8


def test_layers(spark):
    cov = spark.createDataFrame([("i", 0, z, v) for z, v in enumerate((10, 200, 50))], "image_id string, idx int, z_order int, cov int")
    assert [r.cov for r in L.stacked(cov).orderBy("z_order").collect()] == [200, 200, 50]
    layers = spark.createDataFrame([("i", 0, 255, 255, 255), ("i", 1, 250, 250, 250), ("i", 2, 200, 0, 0)], "image_id string, z_order int, r int, g int, b int")
    bg = spark.createDataFrame([("i", 254, 254, 254)], "image_id string, r int, g int, b int")
    assert [r.z_order for r in L.background_policy(layers, bg).orderBy("z_order").collect()] == [1, 2]
    assert L.background_policy(layers, bg, "keep") is layers
    assert {r.rect for r in L.background_policy(layers, bg, "rect").collect()} == {True}
    assert L.background_policy(layers, bg.withColumn("r", F.lit(0))).count() == 3
    logits = spark.createDataFrame([("i", 2.0), ("i", 0.0), ("i", -3.0), ("j", -5.0), ("k", None)], "image_id string, v double")
    assert {r.image_id: r.score for r in L.stability(logits).collect()} == {"i": 0.5, "j": 1.0, "k": 0.0}
    assert [(r.x, r.y) for r in L.grid_points(spark, 2).collect()] == [(0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75)]


def test_masks_join_their_layers(spark):
    lay = spark.createDataFrame([("i", 0, 0, 255), ("i", 0, 1, 255), ("i", 1, 2, 255), ("i", 1, 3, 255), ("i", 2, 0, 255), ("i", 2, 3, 255)], "image_id string, layer int, idx int, cov int")
    m = spark.createDataFrame([("i", 0, 0, 255), ("i", 0, 1, 255), ("i", 1, 2, 255), ("i", 1, 3, 255)], "image_id string, mask_idx int, idx int, cov int")
    assert {r.layer: r.mask_idx for r in L.mask_overlap(lay, m).collect()} == {0: 0, 1: 1}
    assert one(L.mask_iou(m), "inter", "uni") == (0, 4)


def test_boxes(spark):
    rows = [("i", 1, 0, 0, 10, 10), ("i", 2, 1, 1, 9, 9), ("i", 3, 2, 2, 4, 4), ("i", 4, 2, 2, 4, 4), ("j", 5, 3, 3, 4, 4)]
    b = spark.createDataFrame([(*r, (r[4] - r[2]) * (r[5] - r[3])) for r in rows], "image_id string, box_id long, x1 int, y1 int, x2 int, y2 int, area long")
    assert {r.box_id: r.parent_id for r in S.containment_parent(b).collect()} == {1: None, 2: 1, 3: 2, 4: 3, 5: None}
    assert {r.box_id: r.depth for r in S.containment_depth(b).collect()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 0}
    assert {r.box_id: r.parent_id for r in S.last_painted_container(b, F.lit(100)).collect()} == {1: None, 2: None, 3: 2, 4: 2, 5: None}
    cells = spark.createDataFrame([("i", 0, 0, 0, 5, 10), ("i", 1, 5, 0, 10, 10)], "image_id string, cell_id int, x1 int, y1 int, x2 int, y2 int")
    assert {r.box_id: r.verdict for r in S.reconcile(b, cells).collect()} == {1: "straddling", 2: "straddling", 3: "match", 4: "match", 5: "orphan"}
    assert one(S.agreement(b.where("box_id in (3)"), cells), "matched", "empty", "agreement") == (1, 1, 0.5)
    assert {(r.box_id, r.o_box_id): r.inter for r in S.box_overlaps(b).collect()}[1, 2] == 64


def test_fits(spark):
    t = [2 * math.pi * k / 20 for k in range(20)]
    rows = [(0, k, 5 + 3 * math.cos(a), 6 + 3 * math.sin(a)) for k, a in enumerate(t)] + [(1, k, 5 + 8 * math.cos(a), 6 + 4 * math.sin(a)) for k, a in enumerate(t)]
    rows += [(2, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (5.0, 0.0), (10.0, 0.0), (10.0, 4.0), (5.0, 4.0), (0.0, 4.0)])] + [(3, k, float(k), float(k % 2) * 9) for k in range(9)]
    p = spark.createDataFrame(rows, "shape_id int, k int, x double, y double")
    assert {r.shape_id: r.kind for r in G.recognise(p).collect()} == {0: "circle", 1: "ellipse", 2: "rect", 3: None}
    c = {r.shape_id: r for r in G.circle_fit(p).collect()}[0]
    assert (c.cx, c.cy, c.r) == pytest.approx((5, 6, 3)) and c.residual < 1e-9
    assert {r.shape_id: r.area for r in G.shoelace(p).collect()}[2] == pytest.approx(40)
    e = [r.t for r in G.chord_lengths(p.where("shape_id = 2")).orderBy("k").collect()]
    assert e[0] == 0 and e[-1] == 1 and e[1] == pytest.approx(5 / 24)
    assert [r.corner for r in G.corners(p.where("shape_id = 2"), 0.6).orderBy("k").collect()] == [True, False, True, True, False, True]
    d = spark.createDataFrame([(0, k, float(k), 2.0 * k + 1) for k in range(5)], "shape_id int, k int, x double, y double")
    r = G.line_fit(d).first()
    assert r.dy / r.dx == pytest.approx(2)


def test_planes_and_gradients(spark):
    px = [("i", x, y, 3 * x + 2 * y + 7) for x in range(8) for y in range(6)]
    df = spark.createDataFrame(px, "image_id string, x int, y int, v int")
    f = G.plane_fit(df, "v")
    assert one(f, "c0", "c1", "c2") == pytest.approx((7, 3, 2)) and one(G.plane_residual(df, "v", f), "residual") == pytest.approx(0, abs=1e-9)
    lab = df.select("image_id", F.lit(0).alias("layer"), "x", "y", F.struct((F.col("x") * 5.0).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")).alias("lab"))
    assert one(G.lab_gradient(lab), "dir_x", "promoted") == (1.0, True)
    assert G.lab_gradient(lab.withColumn("lab", F.struct(F.lit(1.0).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")))).count() == 0


def test_cubics_and_points_in_polygons(spark):
    k = 4 / 3 * (math.sqrt(2) - 1)
    arcs = [(1, 0, 1, k, k, 1, 0, 1), (0, 1, -k, 1, -1, k, -1, 0), (-1, 0, -1, -k, -k, -1, 0, -1), (0, -1, k, -1, 1, -k, 1, 0)]
    s = spark.createDataFrame([(0, *map(float, a)) for a in arcs], "shape_id int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    assert one(G.cubic_geometry(s), "area", "length", "x_min", "y_max") == pytest.approx((math.pi, 2 * math.pi, -1, 1), rel=1e-3)
    edges = spark.createDataFrame([(0, 0.0, 0.0, 4.0, 0.0), (0, 4.0, 0.0, 4.0, 4.0), (0, 4.0, 4.0, 0.0, 4.0), (0, 0.0, 4.0, 0.0, 0.0)], "shape_id int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(0, 1, 2.0, 2.0), (0, 2, 5.0, 2.0), (0, 3, -1.0, 1.0)], "shape_id int, point_id int, x double, y double")
    assert {r.point_id: r.inside for r in G.point_in_polygon(pts, edges).collect()} == {1: True, 2: False, 3: False}


def test_text_functions(spark):
    v = [1.005, -0.001, -1.235, 2.5, 0.0, 1e6 + 0.126]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert [r.s for r in df.select(T.format_coord(F.col("v")).alias("s")).collect()] == [scene.coord(x, 2) for x in v]
    row = spark.createDataFrame([('<a & "b\'">', "My  Icon--№1!")], "h string, n string").select(T.escape_html(F.col("h")).alias("h"), T.sanitize_name(F.col("n")).alias("n")).first()
    assert row.h == "&lt;a &amp; &quot;b&#39;&quot;&gt;" and row.n == "my-icon-1"
    svg = '<svg viewBox="0 0 8 8"><g id="g1"><path id="p" d="M 1 2 L 3 4 C 0 0 9 9 5 6 Z" fill="#fff"/><g id="g2"><circle id="c"/></g></g><rect id="r"/></svg>'
    s = spark.createDataFrame([("i", svg)], "image_id string, svg string")
    got = {r.id: (r.name, r.group, r.fill) for r in T.parse_shapes(s).collect()}
    assert got == {"p": ("path", "g1", "#fff"), "c": ("circle", "g2", None), "r": ("rect", None, None)}
    assert one(T.svg_summary(s), "n_paths", "n_groups", "view_box") == (1, 2, "0 0 8 8")
    d = spark.createDataFrame([("M 1 2 L 3 4 C 0 0 9 9 5 6 Z", 'id="s-1" d="x"', "translate(3.5, -2)"), ("", 'id="d"', "scale(2)")], "d string, a string, t string")
    r = d.select(T.path_bbox(F.col("d")).alias("b"), T.attr_value(F.col("a"), "d").alias("v"), T.translate(F.col("t")).alias("t")).collect()
    assert tuple(r[0].b) == (0, 0, 9, 9) and r[0].v == "x" and tuple(r[0].t) == (3.5, -2.0) and tuple(r[1].b) == (0, 0, 0, 0) and r[1].v is None and tuple(r[1].t) == (0, 0)


def test_options():
    o = O.from_json('{"alphaMode": "matte:#fff", "colors": [{"r": 1, "g": 2, "b": 3}, "#0a0"], "css": "draw", "timeout_ms": 5, "mode": null}')
    assert o.alpha_mode == ("matte", (255, 255, 255)) and o.colors == ((1, 2, 3), (0, 170, 0)) and o.css == "draw" and o.timeout_ms == 5 and o.mode == "auto"
    bad = ['{"colour": 3}', '{"colors": 1}', '{"colors": 65}', '{"colors": []}', '{"tolerance": -1}', '{"smoothness": 1.5}', '{"precision": 11}', '{"maxTraceDimension": 7}', '{"max_pixels": 0}', '{"mode": "x"}', '{"alphaMode": "threshold:300"}', '{"alphaMode": "keep", "alpha_mode": "keep"}', '{"stroke": 1}', "[]"]
    for text in bad:
        with pytest.raises(O.OptionError):
            O.from_json(text)
    with pytest.raises(O.OptionError, match="colors"):
        O.from_json('{"precision": 11, "colors": 1}')


def test_row_options_and_scaling(spark):
    df = spark.createDataFrame([('{"precision": 1, "mode": "icon"}',), ("{}",), (None,)], "j string")
    got = df.select(O.row_options(F.col("j")).alias("o")).select("o.precision", "o.mode", "o.tolerance").collect()
    assert [tuple(r) for r in got] == [(1, "icon", 0.5), (2, "auto", 0.5), (2, "auto", 0.5)]
    s = spark.range(1).select(O.scaled_geometry(F.lit(0.5), F.lit(1.0), F.lit(2)).alias("s"), O.downscale_factor(F.lit(400), F.lit(200), 100).alias("f")).first()
    assert tuple(s.s) == (0.5, 1) and s.f == 0.25


def files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png.encode_png(painted(disc(32, 10))))
    (tmp_path / "b.png").write_bytes(b"no image at all")
    return I.read_files(spark, f"file://{tmp_path}/*.png")


def test_files_to_results(spark, tmp_path):
    images = I.decode(files(spark, tmp_path))
    res = {r.image_id[-5:]: r for r in V.convert(images, {"mode": "icon"}).collect()}
    assert res["a.png"].error is None and res["a.png"].svg.startswith("<svg") and res["b.png"].error.code == "InvalidInput" and res["b.png"].svg is None
    small = I.decode(files(spark, tmp_path), O.Options(max_input_bytes=20)).collect()
    assert {r.image_id[-5:]: r.error.kind for r in small if r.error} == {"a.png": "input-bytes", "b.png": None}
    (tmp_path / "out").mkdir()
    df = V.convert(images, {"mode": "icon"})
    I.write_results(df, f"file://{tmp_path}/out/r")
    back = spark.read.parquet(f"file://{tmp_path}/out/r")
    nodes = V.inspect(back.where("svg is not null"))
    assert nodes.count() == json.loads(back.where("svg is not null").first().meta_json)["stats"]["node_count"]
    I.export_text(back, f"file://{tmp_path}/out/t")
    assert spark.read.text(f"file://{tmp_path}/out/t").count() == 2


def test_row_patches_timeouts_and_partitions(spark):
    px = painted(disc(24, 8))
    rows = [(str(k), 24, 24, bytearray(px.tobytes()), '{"timeoutMs": 0}' if k == 3 else '{"nope": 1}' if k == 4 else '{"mode": "icon"}') for k in range(6)]
    df = spark.createDataFrame(rows, "image_id string, width int, height int, rgba binary, options_json string")
    got = {r.image_id: (r.svg, r.error.code if r.error else None) for r in V.convert(df.repartition(3)).collect()}
    assert got["3"] == (None, "Timeout") and got["4"] == (None, "InvalidInput") and len({got[k][0] for k in "0125"}) == 1
    assert got == {r.image_id: (r.svg, r.error.code if r.error else None) for r in V.convert(df.coalesce(1)).collect()}
    with pytest.raises(O.OptionError):
        V.convert(df, {"colors": 1})


def test_packed_pixels_round_trip(spark, random_image):
    h, w = random_image.shape[:2]
    img = D.packed(table(spark, random_image), w, h, alpha="a")
    assert bytes(one(img, "rgba")) == random_image.tobytes()
    back = I.pixels(img).orderBy("idx").collect()
    assert [(r.r, r.g, r.b, r.a) for r in back] == [tuple(map(int, p)) for p in random_image.reshape(-1, 4)]


def test_other_sources(spark, tmp_path):
    data = png.encode_png(painted(disc(8, 3)))
    text = base64.b64encode(data).decode()
    df = spark.createDataFrame([("a", "data:image/png;base64," + text), ("b", text), ("c", "%%%")], "k string, s string")
    got = {r.image_id: r.content for r in I.read_base64(df, "s", "k").collect()}
    assert bytes(got["a"]) == bytes(got["b"]) == data and got["c"] is None
    (tmp_path / "m.json").write_text(json.dumps([{"id": "x", "width": 2, "height": 1, "pixels": [0, 255]}, {"id": "bad", "width": 2, "height": 2, "pixels": [1]}]))
    assert [(r.mask_id, r.idx, r.cov) for r in I.read_masks(spark, f"file://{tmp_path}/m.json").collect()] == [("x", 0, 0), ("x", 1, 255)]
    old = spark.createDataFrame([('{"nodes": [{"id": "n"}]}',)], "meta_json string")
    assert one(I.read_sidecar(old), "meta.schema_version") == 0
    assert "schema_version: number" in I.typescript() and I.json_schema()["type"] == "object" and I.json_schema()["properties"]["nodes"]["items"]["properties"]["fill"]["type"] == ["object", "null"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "z.png").write_bytes(data)
    r = I.read_images(spark, f"file://{tmp_path}/p").first()
    assert bytes(r.rgba) == painted(disc(8, 3)).tobytes()


def test_stream_of_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    files(spark, src)
    for turn in range(2):
        q = convert_stream(spark, f"file://{src}", f"file://{tmp_path}/out", f"file://{tmp_path}/cp", O.Options(mode="icon"))
        q.awaitTermination(60)
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2 + turn
        (src / "c.png").write_bytes(png.encode_png(painted(disc(16, 5))))
