"""Images, masks and results in and out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelgrain.kernels import formats, png
from pelgrain.options import Options
from pelgrain.schema import ERROR, IMAGE, META

#: Longest side of any image (fixed value).
MAX_SIDE = 8192


def read_files(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """image_id (the path), length, content: files as bytes. With options, files over their limit are told by length and never read."""
    f = spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_id"), "length", "content")
    if options is None:
        return f
    large = F.col("length") > options.max_input_bytes
    return f.where(~large).unionAll(f.where(large).select("image_id", "length", F.lit(None).cast("binary").alias("content")))


def read_base64(df: DataFrame, column: str, key: str) -> DataFrame:
    """image_id, content from base64 text, with or without a data: prefix; null where it is no base64."""
    plain = F.regexp_replace(F.col(column), "^data:[^,]*,", "")
    return df.select(F.col(key).alias("image_id"), F.try_to_binary(plain, F.lit("base64")).alias("content"))


def is_jpeg(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 3)) == "FFD8FF"


def limit_error(content: Column, options: Options, length: Column | None = None) -> Column:
    """The error of inputs that are too large, before anything is decoded; by their length where that is known."""
    n = F.octet_length(content).cast("long") if length is None else length
    err = F.struct(
        F.lit("LimitExceeded").alias("code"), F.concat(F.lit("input has "), n.cast("string"), F.lit(f" bytes, the limit is {options.max_input_bytes}")).alias("message"),
        F.lit("input-bytes").alias("kind"), n.alias("value"), F.lit(options.max_input_bytes).cast("long").alias("max"),
    )
    return F.when(n > options.max_input_bytes, err)


DECODED = T.StructType([*IMAGE.fields, T.StructField("error", ERROR)])


def _fault(code: str, message: str, kind: str | None = None, value: int | None = None, most: int | None = None) -> dict:
    return {"code": code, "message": message, "kind": kind, "value": value, "max": most}


def decode_one(data: bytes | None, options: Options) -> dict:
    """One file -> width, height, rgba, error; header limits come before the pixels."""
    none = {"width": None, "height": None, "rgba": None}
    if data is None:
        return none | {"error": _fault("InvalidInput", "no bytes")}
    data = bytes(data)
    size = formats.dimensions(data)
    if size and max(size) > MAX_SIDE:
        return none | {"error": _fault("LimitExceeded", f"side of {max(size)} pixels", "dimension", max(size), MAX_SIDE)}
    if size and size[0] * size[1] > options.max_pixels:
        return none | {"error": _fault("LimitExceeded", f"{size[0] * size[1]} pixels", "pixels", size[0] * size[1], options.max_pixels)}
    try:
        px = formats.decode(data)
    except png.ImageError as e:
        return none | {"error": _fault("InvalidInput", str(e))}
    except Exception as e:  # a broken image is a row with an error, never a failed job
        return none | {"error": _fault("Internal", str(e))}
    return {"width": px.shape[1], "height": px.shape[0], "rgba": px.tobytes(), "error": None}


def decode(files: DataFrame, options: Options = Options()) -> DataFrame:
    """image_id, content -> images with an error column. Too large inputs are told by native expressions and never reach the decoder.

    PNG, JPEG, GIF and BMP are decoded, turned by their Exif orientation and converted from their
    colour profile; WebP has no decoder and gives InvalidInput.
    """
    length = F.col("length") if "length" in files.columns else None
    f = files.select("image_id", "content", limit_error(F.col("content"), options, length).alias("error"), is_jpeg(F.col("content")).alias("was_jpeg"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("rgba", "binary"))]
    large = f.where("error is not null").select("image_id", *none, F.coalesce("was_jpeg", F.lit(False)).alias("was_jpeg"), "error")

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for i, data, jpeg in zip(b["image_id"], b["content"], b["was_jpeg"], strict=True):
                yield pd.DataFrame([{"image_id": i, "was_jpeg": bool(jpeg), **decode_one(data, options)}], columns=DECODED.names)

    small = f.where("error is null").select("image_id", "content", "was_jpeg").mapInPandas(batches, DECODED)
    return small.unionByName(large.select(*DECODED.names))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images by Spark's own source, for formats it knows; its bytes are blue first and swapped here."""
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in it:
            for i, w, h, n, data in zip(b["image_id"], b["width"], b["height"], b["n"], b["data"], strict=True):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                out = np.full((h, w, 4), 255, np.uint8)
                out[..., :3] = px[..., 2::-1] if n >= 3 else px[..., :1]
                if n == 4:
                    out[..., 3] = px[..., 3]
                yield pd.DataFrame([{"image_id": i, "width": w, "height": h, "rgba": out.tobytes(), "was_jpeg": str(i).lower().endswith((".jpg", ".jpeg"))}])

    src = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("n"), "image.data").withColumnRenamed("origin", "image_id")
    return src.mapInPandas(batches, IMAGE)


def pixels(images: DataFrame) -> DataFrame:
    """Packed images -> pixel rows image_id, idx, x, y, r, g, b, a. Without Python: slices of the hex string."""
    n = F.col("width") * F.col("height")
    i = images.where("rgba is not null").select("image_id", "width", F.hex("rgba").alias("hx"), F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    part = lambda k: F.conv(F.substring(F.col("hx"), F.col("idx") * 8 + (2 * k + 1), F.lit(2)), 16, 10).cast("smallint")
    return i.select("image_id", "idx", (F.col("idx") % F.col("width")).alias("x"), F.floor(F.col("idx") / F.col("width")).cast("int").alias("y"), *[part(k).alias(c) for k, c in enumerate("rgba")])


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of {id, width, height, pixels} -> image_id (file), mask_idx (place in its file), mask_id, width, height, idx, cov.

    Masks whose number of pixels is not width x height are dropped.
    """
    one = "array<struct<id:string,width:int,height:int,pixels:array<int>>>"
    f = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("image_id"), F.from_json("value", one).alias("masks"))
    m = f.select("image_id", F.posexplode("masks").alias("mask_idx", "m")).select("image_id", F.col("mask_idx").cast("long").alias("mask_idx"), F.col("m.id").alias("mask_id"), "m.width", "m.height", "m.pixels")
    m = m.where(F.size("pixels") == F.col("width") * F.col("height"))
    return m.select("image_id", "mask_idx", "mask_id", "width", "height", F.posexplode("pixels").alias("idx", "cov"))


def read_sidecar(df: DataFrame, column: str = "meta_json") -> DataFrame:
    """Metadata JSON as a struct; payloads without a version are version 0."""
    m = F.from_json(F.col(column), META)
    return df.withColumn("meta", m.withField("schema_version", F.coalesce(m["schema_version"], F.lit(0))))


def write_results(results: DataFrame, path: str) -> None:
    """svg, meta_json and error of each image, as Parquet."""
    results.write.mode("overwrite").parquet(path)


def export_text(results: DataFrame, path: str) -> None:
    """One JSON line for each image; files of single images are left to the consumer."""
    results.select(F.to_json(F.struct("image_id", "svg", "meta_json")).alias("value")).write.mode("overwrite").text(path)


def json_schema() -> dict:
    """JSON Schema (draft 2020-12) of the sidecar."""
    names = {T.StringType: "string", T.BooleanType: "boolean", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer"}

    def of(t: T.DataType) -> dict:
        if isinstance(t, T.StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in t.fields}, "required": [f.name for f in t.fields if f.name != "fill"]}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        return {"type": names.get(type(t), "number")}

    out = of(META)
    fill = out["properties"]["nodes"]["items"]["properties"]["fill"]
    fill["type"] = ["object", "null"]
    for c in fill["properties"].values():
        c |= {"minimum": 0, "maximum": 255}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Meta", **out}


def typescript() -> str:
    """The sidecar's types for TypeScript."""
    names = {T.StringType: "string", T.BooleanType: "boolean"}

    def of(t: T.DataType) -> str:
        if isinstance(t, T.StructType):
            return "{ " + " ".join(f"{f.name}: {of(f.dataType)};" for f in t.fields) + " }"
        return of(t.elementType) + "[]" if isinstance(t, T.ArrayType) else names.get(type(t), "number")

    return f"export type Meta = {of(META)};\n"
