"""Contact sheets: find the grid, cut the icons, trace each, report."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pelgrain.kernels import scene
from pelgrain.kernels.raster import label
from pelgrain.kernels.resample import upscale
from pelgrain.operators.pixels import ALPHA_MIN, USABLE, VALUE_MAX
from pelgrain.plans.convert import _rows, fault, stroke_shapes, unpack
from pelgrain.options import Options
from pelgrain.schema import RGB

#: Ink of a cell and of a cluster at least; share of a cluster inside a cell; canonical box (fixed values).
LEAST_INK, OVERLAP, BOX, DILATE = 12, 0.25, 24.0, 3
#: Saturation of an icon's core, samples of a gradient at least, and its residual at most (fixed values).
CORE, SAMPLES, POOR = 150, 30, 36.0


def chroma_ink(rgba: np.ndarray) -> np.ndarray:
    from pelgrain.kernels.quant import otsu

    rgb = rgba[..., :3].astype(np.int64)
    sat = rgb.max(axis=2) - rgb.min(axis=2)
    ok = (rgba[..., 3] >= ALPHA_MIN) & (rgb.max(axis=2) <= VALUE_MAX)
    cut = otsu(sat[ok], 90) if ok.sum() > 1 and len(np.unique(sat[ok])) > 1 else 90
    return ok & (sat >= max(cut, 1))


def luma_ink(rgba: np.ndarray) -> np.ndarray:
    """Ink by distance from the border's lower median, against the tenth of the distances over 40."""
    lum = (rgba[..., :3] @ np.array([0.2126, 0.7152, 0.0722])).astype(np.float32)
    seen = rgba[..., 3] >= ALPHA_MIN
    edge = np.zeros(lum.shape, bool)
    edge[:2] = edge[-2:] = edge[:, :2] = edge[:, -2:] = True
    v = np.sort(lum[edge & seen])
    back = v[(len(v) - 1) // 2] if len(v) >= 16 else 255.0
    d = np.abs(lum - back)
    far = np.sort(d[seen & (d > 40)])
    return seen & (d / far[int(np.floor((len(far) - 1) * 0.1 + 0.5))] > 0.5) if len(far) else np.zeros(lum.shape, bool)


def segment(rgba: np.ndarray) -> tuple[np.ndarray, str]:
    """Chroma ink if its share is usable, else luma ink."""
    for name, f in (("chroma", chroma_ink), ("luma", luma_ink)):
        ink = f(rgba)
        if USABLE[0] <= ink.mean() <= USABLE[1]:
            return ink, name
    raise ValueError("no usable ink")


def bands(profile: np.ndarray, min_run: int, min_gap: int = 4, min_profile: int = 2) -> list[tuple[int, int]]:
    at = np.flatnonzero(profile >= min_profile)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) - 1 >= min_gap)
    heads, tails = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1
    return [(int(a), int(b)) for a, b in zip(heads, tails, strict=True) if b - a >= min_run]


def refined(profile: np.ndarray, min_run: int = 10) -> list[tuple[int, int]]:
    found = bands(profile, min_run)
    if len(found) >= 2:
        mid = sorted(b - a for a, b in found)[len(found) // 2]
        found = bands(profile, max(mid // 4, min_run))
    return found


def grown(ink: np.ndarray, radius: int) -> np.ndarray:
    """Ink grown by a Chebyshev radius."""
    for axis in (0, 1):
        wide = np.pad(ink, [(radius, radius) if k == axis else (0, 0) for k in (0, 1)])
        ink = np.logical_or.reduce([np.roll(wide, d, axis) for d in range(-radius, radius + 1)])
        ink = ink[radius:-radius] if axis == 0 else ink[:, radius:-radius]
    return ink


def ink_paint(rgba: np.ndarray, ink: np.ndarray, x: int, y: int) -> tuple[tuple[int, int, int] | None, dict | None]:
    """Mean colour of an icon's saturated ink, and its gradient in sheet coordinates where a plane describes it; x, y: the icon's corner."""
    rgb = rgba[..., :3].astype(np.float64)
    on = ink & (rgb.max(axis=2) - rgb.min(axis=2) >= CORE)
    if not on.any():
        return None, None
    v = rgb[on]
    flat = tuple(int(c) for c in np.floor(v.mean(axis=0) + 0.5))
    if len(v) < SAMPLES:
        return flat, None
    at = np.argwhere(on)[:, ::-1].astype(np.float64) + (x, y)
    mid = at.mean(axis=0)
    slope, _, rank, _ = np.linalg.lstsq(at - mid, v - v.mean(axis=0), rcond=1e-9)
    left = v - v.mean(axis=0) - (at - mid) @ slope
    values, vectors = np.linalg.eigh(slope @ slope.T)
    residual = float(np.sqrt((left**2).sum(axis=1).mean()))
    if rank < 2 or values[1] < 1e-9 or residual > POOR:
        return flat, None
    d = vectors[:, 1] * (-1 if vectors[:, 1].sum() < 0 else 1)
    ends = np.percentile((at - mid) @ d, (5, 95))
    if ends[1] - ends[0] < 1e-6:
        return flat, None
    (x1, y1), (x2, y2) = (mid + t * d for t in ends)
    stops = [dict(zip("rgb", (int(c) for c in np.floor(np.clip(v.mean(axis=0) + t * (d @ slope), 0, 255) + 0.5)), strict=True)) for t in ends]
    return flat, {"x1": float(x1), "y1": float(y1), "x2": float(x2), "y2": float(y2), "start": stops[0], "end": stops[1], "residual": residual}


def uniformity(found: list[tuple[int, int]]) -> float:
    w = sorted(b - a for a, b in found)
    n = len(w)
    if n < 2:
        return float(n)
    spread = w[-1] - w[0] if n < 4 else w[3 * n // 4] - w[n // 4]
    return max(0.0, min(1.0, 1 - spread / w[n // 2])) if w[n // 2] else 0.0


def sheet_one(rgba: np.ndarray, options: Options) -> tuple[dict, list[dict]]:
    """Report and icons of one sheet."""
    ink, how = segment(rgba)
    cols, rows = refined(ink.sum(axis=0)), refined(ink.sum(axis=1))
    counts = sorted(int(ink[a:b, c:d].sum()) for a, b in rows for c, d in cols)
    score = 0.0
    if counts and len(counts) > 1:
        floor = max(counts[len(counts) // 2] // 10, 1)
        score = min(sum(n >= floor for n in counts) / len(counts), uniformity(cols), uniformity(rows))
    # strokes of one icon hang together once they are grown; boxes and counts are those of the ink
    regions = np.where(ink, label(grown(ink, DILATE), True), 0)
    orphans = straddling = 0
    for k in range(1, int(regions.max(initial=0)) + 1):
        y, x = np.nonzero(regions == k)
        if len(y) < LEAST_INK:
            continue
        x0, x1, y0, y1 = x.min(), x.max() + 1, y.min(), y.max() + 1
        over = sum(max(0, min(x1, d) - max(x0, c)) * max(0, min(y1, b) - max(y0, a)) >= OVERLAP * (x1 - x0) * (y1 - y0) for a, b in rows for c, d in cols)
        orphans, straddling = orphans + (over == 0), straddling + (over > 1)
    icons, warnings = [], []
    for r, (a, b) in enumerate(rows):
        for c, (p, q) in enumerate(cols):
            y, x = np.nonzero(ink[a:b, p:q])
            if len(y) < LEAST_INK:
                continue
            x0, x1, y0, y1 = max(0, p + x.min() - 2), min(ink.shape[1], p + x.max() + 3), max(0, a + y.min() - 2), min(ink.shape[0], a + y.max() + 3)
            own = np.full((y1 - y0, x1 - x0, 4), 255, np.uint8)
            own[..., :3][ink[y0:y1, x0:x1]] = 0
            big = upscale(own, 2)
            try:
                shapes = stroke_shapes(big, options)
                if not shapes:
                    raise ValueError("no strokes")
                paint, ramp = ink_paint(rgba[y0:y1, x0:x1], ink[y0:y1, x0:x1], int(x0), int(y0))
                icons.append({"name": f"icon-{r}-{c}", "color": paint and dict(zip("rgb", paint, strict=True)), "gradient": ramp, "row": r, "col": c, "x": int(x0), "y": int(y0), "w": int(x1 - x0), "h": int(y1 - y0), "shapes": shapes, "size": big.shape[1::-1]})
            except Exception as e:  # one icon that fails is a warning, not the sheet's failure
                warnings.append(f"{c},{r}: {e}")
    for i in icons:
        scale = BOX / max(i["size"])
        i["scale"] = scale
        w = sorted(s["stroke_width"] * scale for s in i["shapes"] if s.get("stroke_width"))
        i["stroke_width"] = w[len(w) // 2] if w else 0.0
    # the only step across cells: widths near the sheet's upper median become it
    w = sorted(i["stroke_width"] for i in icons if i["stroke_width"] > 0)
    mid = w[len(w) // 2] if w else None
    for i in icons:
        near = mid is not None and 0.8 * mid <= i["stroke_width"] <= 1.2 * mid
        i["unified"] = mid if near else None
        s = i["scale"]
        for x in i["shapes"]:
            x["segments"] = [(op, [v * s for v in c]) for op, c in x["segments"]]
            x["bbox"], x["length"], x["area"] = tuple(v * s for v in x["bbox"]), x["length"] * s, x["area"] * s * s
            x["centroid"] = tuple(v * s for v in x["centroid"])
            if x["primitive"]:
                x["primitive"] = {k: v * s if isinstance(v, float) and k != "rotation" else v for k, v in x["primitive"].items()}
            if x.get("stroke_width"):
                x["stroke_width"] = mid if near else x["stroke_width"] * s
                x["stroke_color"] = i["color"] and tuple(i["color"].values())
        nodes = scene.build(i["shapes"], int(BOX), int(BOX), options.id_style)
        i["svg"] = scene.emit(nodes, int(BOX), int(BOX), precision=options.precision, origin="none")
        i["n_paths"] = len(nodes)
    report = {"segmentation": how, "n_cols": len(cols), "n_rows": len(rows), "score": score, "n_icons": len(icons), "n_orphans": int(orphans), "n_straddling": int(straddling), "stroke_width": mid, "warnings": warnings}
    return report, icons


RAMP = T.StructType([*[T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")], T.StructField("start", RGB), T.StructField("end", RGB), T.StructField("residual", T.DoubleType())])
ICON = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("color", RGB), T.StructField("gradient", RAMP), *[T.StructField(c, T.IntegerType()) for c in ("row", "col", "x", "y", "w", "h", "n_paths")], T.StructField("stroke_width", T.DoubleType()), T.StructField("width_unified", T.DoubleType()), T.StructField("svg", T.StringType())])
REPORT = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("segmentation", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("n_cols", "n_rows", "n_icons", "n_orphans", "n_straddling")], T.StructField("score", T.DoubleType()), T.StructField("stroke_width", T.DoubleType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def sheet_icons(images: DataFrame, options: Options = Options(stroke=True)) -> DataFrame:
    """One row for each icon found: its name, colours, cell, crop, stroke width and markup."""
    def one(r: dict) -> list[dict]:
        try:
            _, icons = sheet_one(unpack(r["width"], r["height"], r["rgba"]), options)
        except ValueError:
            return []
        return [{"image_id": str(r["image_id"]), **{k: i[k] for k in ("name", "color", "gradient", "row", "col", "x", "y", "w", "h", "n_paths", "stroke_width", "svg")}, "width_unified": i["unified"]} for i in icons]

    return _rows(images, ICON, one)


def sheet_report(images: DataFrame, options: Options = Options(stroke=True)) -> DataFrame:
    """One row for each sheet; an unusable sheet has an error."""
    def one(r: dict) -> list[dict]:
        none = dict.fromkeys(REPORT.names) | {"image_id": str(r["image_id"])}
        try:
            return [none | sheet_one(unpack(r["width"], r["height"], r["rgba"]), options)[0]]
        except Exception as e:
            return [none | {"error": fault(e)["message"]}]

    return _rows(images, REPORT, one)




def write_sheets(images: DataFrame, path: str, options: Options = Options(stroke=True), dry_run: bool = False) -> DataFrame:
    """Icons and reports of sheets, written as `icons` and `manifest` under path (the manifest as JSON lines); returns the manifest.

    A dry run writes nothing.
    """
    manifest = sheet_report(images, options)
    if dry_run:
        return manifest
    sheet_icons(images, options).write.mode("overwrite").parquet(f"{path}/icons")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return images.sparkSession.read.schema(REPORT).json(f"{path}/manifest")
