"""Images to vector documents: DataFrame in, DataFrame out.

Every stage works on one image, so a whole conversion is one narrow step without a shuffle; the
intermediate tables (layers, contours, curves, nodes) are steps of their own for those who want them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pelgrain.kernels import curves, masks, quant, raster, resample, scene, strokes
from pelgrain.options import OptionError, Options, patch, validate
from pelgrain.schema import CONTOUR, ERROR, NODE, RGB, SEGMENT

PHOTO_LIMIT, PHOTO_SIZE = 1600, 1024
GRADIENT_TOLERANCE, GRADIENT_SAMPLE = 12.0, 16_384
#: Contours of so many points at most are kept with their fits, and so many of them in a process; longer ones hardly recur.
SHORT, KNOWN = 160, 1 << 14
#: Rows leave a task's Python together up to about so many bytes; a large one alone.
BATCH = 1 << 20


class Timeout(Exception):
    pass


def fault(e: Exception) -> dict:
    code = "Timeout" if isinstance(e, Timeout) else "InvalidInput" if isinstance(e, OptionError) else "Internal"
    return {"code": code, "message": str(e) or code, "kind": None, "value": None, "max": None}


def _deadline(o: Options) -> Callable[[], None]:
    end = None if o.timeout_ms is None else time.monotonic() + o.timeout_ms / 1000

    def check() -> None:
        if end is not None and time.monotonic() >= end:
            raise Timeout(f"over {o.timeout_ms} ms")

    return check


def matte(rgba: np.ndarray, o: Options) -> np.ndarray:
    """The image after its alpha mode."""
    if o.alpha_mode == "keep":
        return rgba
    kind, value = o.alpha_mode
    out = rgba.copy()
    if kind == "threshold":
        out[..., 3] = np.where(rgba[..., 3] >= value, 255, 0)
        return out
    a = rgba[..., 3:] / 255.0
    mixed = np.floor(rgba[..., :3] * a + np.array(value) * (1 - a) + 0.5)
    out[..., :3] = np.where(rgba[..., 3:] == 255, rgba[..., :3], np.where(rgba[..., 3:] == 0, np.array(value), mixed))
    out[..., 3] = 255
    return out


def gradient(rgba: np.ndarray, mask: np.ndarray, tolerance: float = GRADIENT_TOLERANCE) -> dict | None:
    """Linear or radial gradient of a layer in Lab, whichever leaves less, if that is under the tolerance.

    Fitted on an even stride of at most 16 384 covered pixels. Flat layers have none.
    """
    h, w = rgba.shape[:2]
    at = np.flatnonzero(mask)
    at = at[:: max(1, -(-len(at) // GRADIENT_SAMPLE))]
    if len(at) < 3:
        return None
    lab = quant.to_lab(rgba.reshape(-1, 4)[at, :3].astype(np.int64))
    if np.sqrt(((lab - lab.mean(axis=0)) ** 2).sum(axis=1).mean()) < 1.0:
        return None
    x, y = (at % w).astype(np.float64), (at // w).astype(np.float64)
    best = min((g for g in (_linear(lab, x, y), _radial(lab, x, y)) if g), key=lambda g: g[0], default=None)
    return best[1] if best and best[0] < tolerance else None


def _misfit(lab: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, float]:
    c = np.linalg.solve(m.T @ m, m.T @ lab)
    return c, float(np.sqrt(((lab - m @ c) ** 2).sum(axis=1).mean()))


def _linear(lab: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, dict] | None:
    """A plane for each channel, and the direction in which the three together change most."""
    m = np.stack([np.ones(len(x)), x, y], axis=1)
    if abs(np.linalg.det(m.T @ m)) < 1e-7:
        return None
    c, off = _misfit(lab, m)
    values, vectors = np.linalg.eigh(c[1:] @ c[1:].T)
    d = vectors[:, int(np.argmax(values))]
    d = d if (d[0], d[1]) > (0, 0) else -d
    t = (x - x.mean()) * d[0] + (y - y.mean()) * d[1]
    lo, hi = float(t.min()), float(t.max())
    if hi - lo < 1e-5:
        lo, hi = lo - 0.5, hi + 0.5
    ends = [(float(x.mean() + s * d[0]), float(y.mean() + s * d[1])) for s in (lo, hi)]
    stops = [{"offset": float(k), "color": quant.to_rgb(np.array([1.0, *p]) @ c)} for k, p in enumerate(ends)]
    return off, {"kind": "linear", "x1": ends[0][0] + 0.5, "y1": ends[0][1] + 0.5, "x2": ends[1][0] + 0.5, "y2": ends[1][1] + 0.5, "stops": stops}


def _radial(lab: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, dict] | None:
    """A line over the distance from the centroid for each channel."""
    cx, cy = float(x.mean()), float(y.mean())
    d = np.hypot(x - cx, y - cy)
    m = np.stack([np.ones(len(d)), d], axis=1)
    if abs(np.linalg.det(m.T @ m)) <= 1e-7:
        return None
    c, off = _misfit(lab, m)
    r = float(d.max()) if d.max() >= 1e-5 else 1.0
    stops = [{"offset": float(k), "color": quant.to_rgb(np.array([1.0, k * r]) @ c)} for k in (0, 1)]
    return off, {"kind": "radial", "cx": cx + 0.5, "cy": cy + 0.5, "r": r, "stops": stops}


def prepare(rgba: np.ndarray, o: Options, was_jpeg: bool) -> tuple[np.ndarray, str, Options, tuple[int, int, int] | None]:
    """Alpha, class and background at full size, then the reduced and smoothed image and options scaled to it."""
    rgba = matte(rgba, o)
    mode = resample.classify(rgba) if o.mode == "auto" else o.mode
    back = resample.background(rgba)
    factor = 1.0
    if o.max_trace_dimension:
        rgba, factor = resample.shrink_to(rgba, o.max_trace_dimension, mode)
    if mode == "photo" and max(rgba.shape[:2]) > PHOTO_LIMIT:
        rgba, f = resample.shrink_to(rgba, PHOTO_SIZE, mode)
        factor *= f
    if factor != 1.0:
        o = replace(o, tolerance=o.tolerance * factor, turdsize=max(1, int(np.floor(o.turdsize * factor * factor + 0.5))))
    if was_jpeg and resample.blockiness(rgba) < 90:
        rgba = resample.deblock(rgba)
    if mode == "photo":
        rgba = resample.bilateral(rgba)
    return rgba, mode, o, back


def drop_background(layers: list[quant.Layer], back: tuple[int, int, int] | None, policy: str) -> tuple[list[quant.Layer], tuple[int, int, int] | None]:
    if policy == "keep" or back is None or not layers:
        return layers, None
    lab = quant.to_lab(np.array([back, *[x.color for x in layers]]))
    d = ((lab[1:] - lab[0]) ** 2).sum(axis=1)
    k = int(np.argmin(d))
    if d[k] > 100.0:
        return layers, None
    return layers[:k] + layers[k + 1 :], back if policy == "rect" else None


def fitted(points: list[tuple[float, float]], tolerance: float, smoothness: float) -> tuple[list[curves.Segment], dict | None, dict]:
    """Path, primitive and geometry of one contour. Short contours come again and again at the same place, and are fitted once."""
    p = np.asarray(points, np.float64)
    segments, primitive, g = (_known_fit if len(p) <= SHORT else _fit)(p.tobytes(), tolerance, smoothness)
    return list(segments), primitive and dict(primitive), dict(g)


def _fit(points: bytes, tolerance: float, smoothness: float) -> tuple[list[curves.Segment], dict | None, dict]:
    p = np.frombuffer(points, np.float64).reshape(-1, 2)
    segments, primitive = curves.fit_closed(p, tolerance, smoothness), curves.recognise(p, tolerance)
    g = scene.primitive_geometry(primitive) if primitive else curves.geometry(segments)
    return segments, primitive, g | {"outline": scene.outline(segments, primitive), "text": scene.form(segments, primitive)}


_known_fit = lru_cache(KNOWN)(_fit)


def shapes_of(layers: list[quant.Layer], rgba: np.ndarray, o: Options, gradients: bool, check: Callable[[], None]) -> list[dict]:
    """One shape for each ink contour, with its holes as further subpaths; islands in holes are shapes of their own."""
    h, w = rgba.shape[:2]
    out = []
    for z, layer in enumerate(layers):
        check()
        found = raster.contours(layer.mask.reshape(h, w), o.turdsize)
        paint = gradient(rgba, layer.mask) if gradients else None
        top: dict[int, int] = {}
        for c in found:
            top[c["contour_id"]] = c["contour_id"] if c["parent_id"] < 0 else top[c["parent_id"]]
        for c in found:
            if c["depth"] % 2:
                continue
            check()
            holes = [k for k in found if k["parent_id"] == c["contour_id"]]
            segments, primitive, g = fitted(c["points"], o.tolerance, o.smoothness)
            if holes:
                segments, primitive = segments + [s for k in holes for s in fitted(k["points"], o.tolerance, o.smoothness)[0]], None
                g = curves.geometry(segments)
            out.append({"segments": segments, "primitive": primitive, "fill": layer.color, "gradient": paint, "layer": z, "component": top[c["contour_id"]], **g})
    return out


def stroke_shapes(rgba: np.ndarray, o: Options) -> list[dict]:
    """Centre lines as open paths with a width, each a group; blobs as filled shapes."""
    found, fill = strokes.trace(strokes.binarise(rgba), o.turdsize, o.tolerance)
    out = []
    for k, s in enumerate(found):
        g = curves.geometry([x for x in s["segments"] if x[0] != "Z"])
        x0, y0, x1, y1 = g["bbox"]
        out.append({"segments": s["segments"], "primitive": None, "fill": None, "layer": 0, "component": k, **g, "area": max((x1 - x0) * (y1 - y0), 1.0), "centroid": (0.0, 0.0), "stroke_width": s["width"], "closed": s["closed"]})
    blobs = shapes_of([quant.Layer((fill * 255).astype(np.uint8).ravel(), (0, 0, 0))], rgba, o, False, lambda: None) if fill.any() else []
    return out + [b | {"component": len(found) + b["component"]} for b in blobs]


def convert_one(rgba: np.ndarray, o: Options, was_jpeg: bool = False, given: list[tuple[str, np.ndarray]] = ()) -> tuple[str, list[dict]]:
    """Markup and nodes of one image. Masks that are `given`, by name, group the layers that lie mostly in one."""
    check = _deadline(o)
    check()
    if o.stroke:
        rgba = matte(rgba, o)
        if o.max_trace_dimension:
            rgba, _ = resample.shrink_to(rgba, o.max_trace_dimension, "icon")
        shapes, rect = stroke_shapes(rgba, o), None
    else:
        rgba, mode, o, back = prepare(rgba, o, was_jpeg)
        check()
        layers, rect = drop_background(quant.quantize(rgba, mode, o.colors, o.layering), back, o.background)
        shapes = shapes_of(layers, rgba, o, o.gradients == "on" or o.gradients == "auto" and mode == "photo", check)
    check()
    h, w = rgba.shape[:2]
    nodes = scene.build(shapes, w, h, o.id_style)
    if given and not o.stroke:
        nodes = regroup(nodes, [(name, masks.upsample(m, w, h)) for name, m in given], layers)
    svg = scene.emit(nodes, w, h, precision=o.precision, output=o.output, origin="none" if o.stroke else o.transform_origin, current_color=o.current_color, rect=rect, css=o.css, grouping=o.grouping)
    return svg, nodes


def unpack(width: int, height: int, rgba: bytes) -> np.ndarray:
    return np.frombuffer(bytes(rgba), np.uint8).reshape(int(height), int(width), 4)


def _rows(images: DataFrame, schema: T.StructType, one: Callable[[dict], list[dict]], extra: tuple[str, ...] = ()) -> DataFrame:
    names = schema.names

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, weight = [], 0
        for b in it:
            for r in b.to_dict("records"):
                new = one(r)
                out += new
                weight += sum(1024 + sum(len(v) for v in x.values() if isinstance(v, (str, bytes, list))) for x in new)
                if weight >= BATCH:
                    yield pd.DataFrame(out, columns=names)
                    out, weight = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    return images.select("image_id", "width", "height", "rgba", *extra).mapInPandas(batches, schema)


RESULT = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("svg", T.StringType()), T.StructField("meta_json", T.StringType()), T.StructField("error", ERROR)])


def _packed_masks(given: DataFrame) -> DataFrame:
    """Mask pixels (image_id, mask_idx, mask_id, width, height, idx, cov) -> image_id, masks: an array of whole masks in order."""
    from pyspark.sql import functions as F

    keys = ["image_id", "mask_idx", "mask_id", "width", "height"]
    whole = given.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", F.col("cov").cast("int").alias("cov"))))["cov"].alias("pixels"))
    return whole.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*keys[1:], "pixels"))).alias("masks"))


def convert(images: DataFrame, options: Options | str | dict | None = None, mask_pixels: DataFrame | None = None) -> DataFrame:
    """images (image_id, width, height, rgba[, was_jpeg, error, options_json]) -> image_id, svg, meta_json, error.

    options_json, where the table has it, is a patch of each row over the options. An image that
    fails is a row with an error; it never fails the job. Rows that come with an error keep it.
    mask_pixels (as read_masks gives them, by the same image_id) name groups: a layer of which 0.6
    or more lies in a mask is put into that mask's group, the first of equal ones. Masks of another
    size are drawn to the image's.
    """
    if mask_pixels is not None:
        images = images.join(_packed_masks(mask_pixels), "image_id", "left")
    base = options if isinstance(options, Options) else patch(Options(), options)
    validate(base)
    extra = tuple(c for c in ("was_jpeg", "error", "options_json", "masks") if c in images.columns)

    def one(r: dict) -> list[dict]:
        out = {"image_id": str(r["image_id"]), "svg": None, "meta_json": None, "error": None}
        if r.get("error") is not None:
            e = r["error"]
            return [out | {"error": e if isinstance(e, dict) else e.asDict()}]
        try:
            o = validate(patch(base, r["options_json"])) if r.get("options_json") else base
            given = r.get("masks")
            given = [(m["mask_id"], np.array(m["pixels"], np.uint8).reshape(m["height"], m["width"])) for m in given] if given is not None else []
            svg, nodes = convert_one(unpack(r["width"], r["height"], r["rgba"]), o, bool(r.get("was_jpeg")), given)
            return [out | {"svg": svg, "meta_json": scene.dumps(nodes, svg)}]
        except Exception as e:
            return [out | {"error": fault(e)}]

    return _rows(images, RESULT, one, extra)


LAYER = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("z_order", T.IntegerType()), T.StructField("color", RGB), T.StructField("mask", T.BinaryType()), T.StructField("n_pixels", T.LongType())])


def quantize(images: DataFrame, colours: int | str | tuple = "auto", mode: str = "auto", layering: str = "stacked") -> DataFrame:
    """Layers of each image, bottom first."""
    def one(r: dict) -> list[dict]:
        px = unpack(r["width"], r["height"], r["rgba"])
        found = quant.quantize(px, resample.classify(px) if mode == "auto" else mode, colours, layering)
        return [{"image_id": str(r["image_id"]), "z_order": z, "color": dict(zip("rgb", x.color, strict=True)), "mask": x.mask.tobytes(), "n_pixels": int((x.mask > 127).sum())} for z, x in enumerate(found)]

    return _rows(images, LAYER, one)


def contours(images: DataFrame, colours: int | str | tuple = "auto", mode: str = "icon", turdsize: int = 2, layering: str = "stacked") -> DataFrame:
    """Contours of each layer, with parents and depths."""
    def one(r: dict) -> list[dict]:
        px = unpack(r["width"], r["height"], r["rgba"])
        return [
            {"image_id": str(r["image_id"]), "layer": z, **{k: c[k] for k in ("contour_id", "parent_id", "depth", "area")}, "points": [{"x": x, "y": y} for x, y in c["points"]]}
            for z, layer in enumerate(quant.quantize(px, mode, colours, layering))
            for c in raster.contours(layer.mask.reshape(px.shape[:2]), turdsize)
        ]

    return _rows(images, CONTOUR, one)


CURVE = T.StructType([T.StructField("image_id", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("curve_idx", "layer", "component")], T.StructField("segments", T.ArrayType(SEGMENT)), T.StructField("kind", T.StringType()), T.StructField("area", T.DoubleType()), T.StructField("length", T.DoubleType())])


def fit(images: DataFrame, options: Options = Options(mode="icon")) -> DataFrame:
    """Fitted curves of each layer's contours, with what primitive they are."""
    def one(r: dict) -> list[dict]:
        px = unpack(r["width"], r["height"], r["rgba"])
        found = shapes_of(quant.quantize(px, options.mode, options.colors, options.layering), px, options, False, lambda: None)
        return [{"image_id": str(r["image_id"]), "curve_idx": k, "layer": s["layer"], "component": s["component"], "segments": [{"op": op, "c": c} for op, c in s["segments"]], "kind": s["primitive"]["kind"] if s["primitive"] else "path", "area": s["area"], "length": s["length"]} for k, s in enumerate(found)]

    return _rows(images, CURVE, one)


STROKE = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("stroke_idx", T.IntegerType()), T.StructField("component", T.IntegerType()), T.StructField("closed", T.BooleanType()), T.StructField("width", T.DoubleType()), T.StructField("width_profile", T.ArrayType(T.DoubleType())), T.StructField("segments", T.ArrayType(SEGMENT))])


def trace_strokes(images: DataFrame, turdsize: int = 2, tolerance: float = 0.5) -> DataFrame:
    """Centre lines of each image's ink."""
    def one(r: dict) -> list[dict]:
        found, _ = strokes.trace(strokes.binarise(unpack(r["width"], r["height"], r["rgba"])), turdsize, tolerance)
        return [{"image_id": str(r["image_id"]), "stroke_idx": k, "component": s["component"], "closed": s["closed"], "width": s["width"], "width_profile": s["widths"], "segments": [{"op": op, "c": c} for op, c in s["segments"]]} for k, s in enumerate(found)]

    return _rows(images, STROKE, one)


def regroup(nodes: list[dict], masks: list[tuple[str, np.ndarray]], layers: list[quant.Layer], least: float = 0.6) -> list[dict]:
    """Nodes of layers that lie mostly in a mask go into that mask's group; the first of equal masks."""
    home: dict[int, str] = {}
    for z, layer in enumerate(layers):
        total = int(layer.mask.astype(np.int64).sum())
        share = [int(np.minimum(layer.mask, m.ravel()).astype(np.int64).sum()) / total for _, m in masks] if total else []
        if share and max(share) >= least:
            home[z] = masks[int(np.argmax(share))][0]
    return [n | {"group": home[n["layer"]], "group_path": [home[n["layer"]]]} if n["layer"] in home else n for n in nodes]


NODES = T.StructType([T.StructField("image_id", T.StringType()), *NODE.fields])


def inspect(results: DataFrame) -> DataFrame:
    """image_id and the columns of every node, from the sidecar of converted images; native."""
    from pyspark.sql import functions as F

    from pelgrain.sources.images import read_sidecar

    return read_sidecar(results).select("image_id", F.inline("meta.nodes"))
