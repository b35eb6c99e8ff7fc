"""Conversion of image files as they arrive. An extension: the batch plan on a file stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from pelgrain.options import Options
from pelgrain.plans.convert import convert
from pelgrain.sources.images import decode


def convert_stream(spark: SparkSession, path: str, out: str, checkpoint: str, options: Options = Options(), files_per_batch: int = 1000) -> StreamingQuery:
    """Watches a folder and appends results as Parquet; each file is converted once, also over restarts."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    images = decode(files.select(files.path.alias("image_id"), "content"), options)
    return convert(images, options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
