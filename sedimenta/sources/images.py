"""Images as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str, offset: int = 0, length: int | None = None) -> DataFrame:
    """(image_id, data) of the files under a path, cut to a window; an offset past the end gives no row."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > offset)
    data = F.substring("content", offset + 1, length if length and length > 0 else (1 << 31) - 1)
    return files.select(F.col("path").alias("image_id"), (F.col("content") if not offset and not length else data).alias("data"))


def chunks(images: DataFrame, size: int = 4 << 20, overlap: int = 0) -> DataFrame:
    """(image_id, chunk_no, start, data) with ``overlap`` bytes of the next chunk."""
    n = F.ceil(F.octet_length("data") / size).cast("int")
    rows = images.where(F.octet_length("data") > 0).select("image_id", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    at = F.col("chunk_no").cast("long") * size
    return rows.select("image_id", "chunk_no", at.alias("start"), F.substr("data", (at + 1).cast("int"), F.lit(size + overlap)).alias("data"))
