"""Kernels on small hand-made images, against closed forms and invariants."""

import hashlib
import math

import numpy as np
import pytest

from pelgrain.kernels import blake3, curves, png, quant, raster, resample, scene, strokes
from pelgrain.options import Options
from pelgrain.plans.convert import convert_one
from pelgrain.plans.sheet import bands, sheet_one


def disc(n, r, cx=None, cy=None, hole=0.0):
    y, x = np.mgrid[:n, :n] + 0.5
    d = np.hypot(x - (cx or n / 2), y - (cy or n / 2))
    cover = np.clip(r + 0.5 - d, 0, 1) * (np.clip(d - hole + 0.5, 0, 1) if hole else 1)
    return np.floor(cover * 255 + 0.5).astype(np.uint8)


def painted(cover, ink=(200, 30, 30)):
    c = cover[..., None] / 255
    out = np.full((*cover.shape, 4), 255, np.uint8)
    out[..., :3] = np.floor(255 * (1 - c) + np.array(ink) * c + 0.5)
    return out


def test_labels_equal_a_flood_fill():
    rng = np.random.default_rng(2)
    for eight in (True, False):
        for density in (0.3, 0.5, 0.7):
            m = rng.random((24, 31)) < density
            got, want, k = raster.label(m, eight), np.zeros(m.shape, int), 0
            for y, x in zip(*np.nonzero(m), strict=True):
                if want[y, x]:
                    continue
                k += 1
                todo = [(y, x)]
                want[y, x] = k
                while todo:
                    a, b = todo.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            v, u = a + dy, b + dx
                            if (eight or not dy or not dx) and 0 <= v < 24 and 0 <= u < 31 and m[v, u] and not want[v, u]:
                                want[v, u] = k
                                todo.append((v, u))
            assert (got == want).all()


def test_square_is_one_contour():
    m = np.zeros((6, 6), np.uint8)
    m[1:5, 1:5] = 255
    (c,) = raster.contours(m)
    p = np.array(c["points"])
    assert c["depth"] == 0 and c["parent_id"] == -1
    assert p.min() == pytest.approx(1, abs=0.01) and p.max() == pytest.approx(5, abs=0.01)
    assert raster.polygon_area(c["points"]) > 0


def test_hole_and_island_nest():
    m = np.zeros((15, 15), np.uint8)
    m[1:14, 1:14] = 255
    m[4:11, 4:11] = 0
    m[6:9, 6:9] = 255
    found = raster.contours(m)
    assert [(c["parent_id"], c["depth"]) for c in found] == [(-1, 0), (0, 1), (1, 2)]
    assert raster.polygon_area(found[1]["points"]) < 0 < raster.polygon_area(found[2]["points"])


def test_speckle_goes_by_size():
    m = np.zeros((6, 6), np.uint8)
    m[2, 2] = 255
    assert len(raster.contours(m, 5)) == 0 and len(raster.contours(m, 0)) == 1


def test_contours_count_regions():
    rng = np.random.default_rng(4)
    m = (rng.random((20, 20)) < 0.5).astype(np.uint8) * 255
    found = raster.contours(m)
    ink, paper = raster.label(m > 127, True).max(), raster.label(np.pad(m, 1) <= 127, False).max()
    assert sum(c["depth"] % 2 == 0 for c in found) == ink and sum(c["depth"] % 2 for c in found) == paper - 1


def test_disc_is_a_circle_of_its_size():
    (c,) = raster.contours(disc(64, 20))
    p = curves.recognise(c["points"], 0.5)
    assert p["kind"] == "circle" and p["rx"] == pytest.approx(20, abs=0.1)
    g = curves.geometry(curves.fit_closed(c["points"]))
    assert g["area"] == pytest.approx(math.pi * 400, rel=0.02) and g["centroid"] == pytest.approx((32, 32), abs=0.1)


def test_geometry_of_exact_paths():
    box = lambda x, y, s, flip=False: [("M", [x, y]), *[("L", p) for p in ([[x, y + s], [x + s, y + s], [x + s, y]] if flip else [[x + s, y], [x + s, y + s], [x, y + s]])], ("Z", [])]
    g = curves.geometry(box(0.0, 0.0, 4.0))
    assert g["area"] == pytest.approx(16) and g["length"] == pytest.approx(16) and g["bbox"] == pytest.approx((0, 0, 4, 4))
    for flip in (True, False):
        g = curves.geometry(box(0.0, 0.0, 10.0) + box(2.0, 2.0, 6.0, flip) + box(4.0, 4.0, 2.0))
        assert g["area"] == pytest.approx(100 - 36 + 4) and g["centroid"] == pytest.approx((5, 5))
    k = 4 / 3 * (math.sqrt(2) - 1)
    arc = [("M", [1.0, 0.0])] + [("C", [*a, *b, *c]) for a, b, c in (((1, k), (k, 1), (0, 1)), ((-k, 1), (-1, k), (-1, 0)), ((-1, -k), (-k, -1), (0, -1)), ((k, -1), (1, -k), (1, 0)))] + [("Z", [])]
    g = curves.geometry(arc)
    assert g["area"] == pytest.approx(math.pi, rel=1e-3) and g["length"] == pytest.approx(2 * math.pi, rel=1e-3)


def test_rectangles_and_ellipses_are_told():
    m = np.zeros((40, 60), np.uint8)
    m[8:32, 10:50] = 255
    (c,) = raster.contours(m)
    p = curves.recognise(c["points"], 0.5)
    assert p["kind"] == "rect" and (p["width"], p["height"]) == pytest.approx((40, 24), abs=0.1)
    t = np.arange(64) * 2 * math.pi / 64
    assert curves.recognise([(20 + 12 * math.cos(a), 20 + 6 * math.sin(a)) for a in t], 0.5)["kind"] == "ellipse"


def test_kmeans_is_repeatable_and_splits_clear_colours():
    rng = np.random.default_rng(1)
    lab = np.concatenate([rng.normal(m, 1, (50, 3)) for m in ((20, 0, 0), (80, 0, 0), (50, 60, 0))])
    near = quant.kmeans(lab, 3)
    assert (near == quant.kmeans(lab, 3)).all()
    assert [len(set(near[i : i + 50])) for i in (0, 50, 100)] == [1, 1, 1] and len(set(near)) == 3


def test_generator_is_the_published_one():
    r = quant.XorShift(42)
    x = 42
    seq = []
    for _ in range(3):
        x ^= x >> 12
        x ^= x << 25 & quant.MASK
        x ^= x >> 27
        seq.append(x * 0x2545F4914F6CDD1D & quant.MASK)
    assert [r.draw(), r.draw()] == seq[1:]


def test_quantise_exact_colours_in_scan_order():
    px = painted(np.zeros((8, 8), np.uint8))
    px[:, 4:, :3] = (0, 0, 255)
    px[6:, :, :3] = (0, 160, 0)
    found = quant.quantize(px, "icon", 8, "cutout")
    assert [x.color for x in found] == [(255, 255, 255), (0, 0, 255), (0, 160, 0)]
    assert sum(int((x.mask > 0).sum()) for x in found) == 64
    stacked = quant.quantize(px, "icon", 8, "stacked")
    assert (stacked[0].mask == 255).all()


def test_transparent_pixels_belong_to_no_layer():
    px = painted(np.zeros((4, 4), np.uint8))
    px[0, 0, 3] = 0
    assert all(x.mask[0] == 0 for x in quant.quantize(px, "icon"))
    px[..., 3] = 0
    assert quant.quantize(px, "icon") == []


def test_classes():
    px = painted(np.zeros((4, 4), np.uint8))
    px[:2, :, 3] = 128
    px[:2, :, :3] = (255, 0, 0)
    assert resample.classify(px) in ("icon", "line-art")
    ten = np.full((8, 8, 4), 255, np.uint8)
    for k in range(16):
        ten[k // 4 * 2 : k // 4 * 2 + 2, k % 4 * 2 : k % 4 * 2 + 2, :3] = ((k * 53) % 256, (k * 149) % 256, (k * 211) % 256)
    assert not resample.has_blends(np.zeros((3, 3, 3), np.int64))
    assert resample.classify(painted(disc(64, 3), (0, 0, 0))) == "line-art"


def test_strokes_of_a_ring_and_a_bar():
    y, x = np.mgrid[:96, :96]
    ring = np.abs(np.hypot(x - 48, y - 48) - 30) <= 3
    found, fill = strokes.trace(ring)
    assert len(found) == 1 and found[0]["closed"] and found[0]["width"] == pytest.approx(7, abs=1.5) and not fill.any()
    bar = (np.abs(y - 48) <= 3) & (x > 10) & (x < 86)
    found, _ = strokes.trace(bar)
    assert len(found) == 1 and not found[0]["closed"]
    xs = [p[0] for p in found[0]["points"]]
    assert min(xs) < 18 and max(xs) > 79
    blob = np.hypot(x - 48, y - 48) <= 12
    found, fill = strokes.trace(blob)
    assert not found and fill.sum() == blob.sum()


def test_thinning_keeps_components_and_is_thin():
    rng = np.random.default_rng(3)
    m = np.pad(rng.random((20, 20)) < 0.6, 2)
    s = strokes.thin(m)
    assert not (s & ~m).any()
    assert (strokes.thin(s) == s).all()


def test_every_edge_is_walked_once():
    edges = [(0, 1, [(0, 0), (0, 1)]), (1, 2, [(0, 1), (0, 2)]), (2, 0, [(0, 2), (0, 0)]), (1, 3, [(0, 1), (1, 1)]), (3, 4, [(1, 1), (2, 1)]), (3, 5, [(1, 1), (1, 3)])]
    steps = [frozenset(p) for t in strokes.trails(6, edges) for p in zip(t, t[1:], strict=False)]
    assert sorted(map(sorted, steps)) == sorted(sorted((c[0], c[-1])) for _, _, c in edges)


def test_published_hash_values():
    assert blake3.blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.blake3_hex(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def test_ids_follow_geometry_and_paint():
    a = [("M", [0.0, 0.0]), ("L", [1.0, 0.0]), ("Z", [])]
    i = scene.stable_id(a, None, (1, 2, 3))
    assert i == scene.stable_id(list(a), None, (1, 2, 3)) and len(i) == 10
    assert i != scene.stable_id(a, None, (1, 2, 4)) and i != scene.stable_id([("M", [0.0, 0.01]), *a[1:]], None, (1, 2, 3))
    text = scene.canonical(a, None, None)
    assert text == "M0.000,0.000,L1.000,0.000,Z|path|none"
    assert scene.stable_id(a, None, None, "sha2") == "s-" + hashlib.sha256(text.encode()).hexdigest()[:8]
    assert scene.unique(["aaa", "aaa", "bbb", "aaa"]) == ["aaa", "aaa-2", "bbb", "aaa-3"]


@pytest.mark.parametrize("kind", range(5))
def test_png_round_trip_of_all_filters(kind):
    import struct
    import zlib

    px = np.random.default_rng(kind).integers(0, 256, (7, 9, 4)).astype(np.uint8)
    assert (png.decode(png.encode_png(px)) == px).all()
    flat = px.reshape(7, 36).astype(np.int64)
    raw = b""
    for y in range(7):
        a = np.concatenate([np.zeros(4, int), flat[y, :-4]])
        b = flat[y - 1] if y else np.zeros(36, int)
        c = np.concatenate([np.zeros(4, int), b[:-4]])
        p = a + b - c
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        guess = [0 * a, a, b, (a + b) // 2, np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))][kind]
        raw += bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = png.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", 9, 7, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert (png.decode(data) == px).all()


def test_broken_images_raise_one_kind_of_error():
    good = png.encode_png(painted(disc(8, 3)))
    for data in (b"", b"GIF89a", good[:40], good[:-30], b"BM" + b"\0" * 60, b"\x89PNG\r\n\x1a\nxxxx"):
        with pytest.raises(png.ImageError):
            png.decode(data)


def test_resizing_keeps_flat_images_flat():
    px = np.full((9, 13, 4), 77, np.uint8)
    for name in ("nearest", "triangle", "catmull-rom", "lanczos3"):
        out = resample.resize(px, 20, 5, name)
        assert out.shape == (5, 20, 4) and np.abs(out.astype(int) - 77).max() <= 1
    assert (resample.bilateral(px) == px).all() and (resample.deblock(px) == px).all() and resample.blockiness(px) == 100.0


def test_conversion_is_repeatable_and_faithful():
    px = painted(disc(64, 20, hole=8))
    svg, nodes = convert_one(px, Options(mode="icon"))
    assert svg == convert_one(px, Options(mode="icon"))[0]
    ring = [n for n in nodes if n["fill"] != (255, 255, 255) and n["area"] < 3000]
    assert ring and ring[0]["area"] == pytest.approx(math.pi * (400 - 64), rel=0.1)
    assert sorted(n["draw_order"] for n in nodes) == list(range(len(nodes)))


def test_flat_grouping_emits_every_shape():
    px = painted(disc(64, 20, hole=8))
    for grouping in ("component", "flat"):
        svg, nodes = convert_one(px, Options(mode="icon", grouping=grouping))
        assert sum(svg.count(f"<{t} ") for t in ("path", "circle", "ellipse")) + svg.count("<rect x=") == len(nodes)


def test_bands():
    p = np.array([0, 5, 5, 5, 0, 5, 5, 0, 0, 0, 0, 5, 5, 5, 5])
    assert bands(p, 3, 3) == [(1, 7), (11, 15)] and bands(p, 5, 3) == [(1, 7)] and bands(np.zeros(4), 1) == []


def test_sheet_finds_its_icons():
    n, px = 40, np.full((120, 160, 4), 255, np.uint8)
    for r in range(3):
        for c in range(4):
            d = disc(n, 13, hole=9)[..., None] > 127
            px[r * n : r * n + n, c * n : c * n + n, :3] = np.where(d, (200, 30, 40), 255)
    report, icons = sheet_one(px, Options(stroke=True))
    assert (report["n_cols"], report["n_rows"], report["n_icons"], report["n_orphans"]) == (4, 3, 12, 0) and report["score"] == 1.0
    assert len({i["stroke_width"] for i in icons}) == 1 and not report["warnings"]
