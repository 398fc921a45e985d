"""Files of images as rows: drivers read metadata, DataFrame plans do the rest.

A driver is a function from the bytes of a volume to its records. Contents are not read
by drivers; extents name the bytes, and ``objects`` joins them with the image's chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import extract, graph

SCHEMA = (
    "image_id string, fs string, id long, parent_id long, name string, kind string, deleted boolean, size long, mode int, mtime double,"
    " extents array<struct<ordinal: int, start: long, length: long, sparse: boolean>>, inline binary, codec string"
)


@dataclass
class Record:
    """One name of a file. Extents are (start, length) in bytes of the image; a start of None is a hole."""

    id: int
    parent_id: int | None
    name: str
    kind: str = "file"  # file, dir, link, other
    deleted: bool = False
    size: int = 0
    mode: int = 0
    mtime: float | None = None
    extents: list[tuple[int | None, int]] = field(default_factory=list)
    inline: bytes | None = None
    codec: str | None = None


Driver = Callable[[memoryview], Iterator[Record]]
DRIVERS: dict[str, Driver] = {}


def driver(*names: str) -> Callable[[Driver], Driver]:
    def add(f: Driver) -> Driver:
        DRIVERS.update(dict.fromkeys(names, f))
        return f

    return add


def scan(images: DataFrame, fs: str, id_col: str = "image_id", data_col: str = "data") -> DataFrame:
    """Records of every image by the driver of a file system; an image that is none, or breaks off, gives what was read."""
    read = DRIVERS[fs]
    extent = pa.list_(pa.struct([("ordinal", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("sparse", pa.bool_())]))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.float64(), extent, pa.binary(), pa.string()]
    names = ["image_id", "fs", "id", "parent_id", "name", "kind", "deleted", "size", "mode", "mtime", "extents", "inline", "codec"]

    def rows(image: str | None, data: bytes) -> Iterator[tuple]:
        for r in read(memoryview(data)):
            extents = [{"ordinal": k, "start": a or 0, "length": n, "sparse": a is None} for k, (a, n) in enumerate(r.extents)]
            yield image, fs, r.id, r.parent_id, r.name, r.kind, r.deleted, r.size, r.mode, r.mtime, extents, r.inline, r.codec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = []
                for row in rows(image, data or b""):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return images.select(F.col(id_col).cast("string"), F.col(data_col)).mapInArrow(run, SCHEMA)


def paths(records: DataFrame, roots: list[int]) -> DataFrame:
    """The records with ``path``: parents of each image are followed to a root; names of no known parent go under $orphans."""
    key = lambda c: F.concat_ws("/", "image_id", F.col(c).cast("string"))
    folders = records.where("kind = 'dir'").groupBy("image_id", "id").agg(F.min_by(F.struct("parent_id", "name"), F.struct("deleted", "name")).alias("r"))
    up = F.when(F.col("r.parent_id").isNotNull() & ~F.col("id").isin(roots), F.concat_ws("/", "image_id", F.col("r.parent_id").cast("string")))
    tree = folders.select(key("id").alias("id"), up.alias("parent_id"), F.when(F.col("id").isin(roots), "").otherwise(F.col("r.name")).alias("name"))
    known = graph.path_closure(tree, []).select(F.col("id").alias("_up"), F.col("path").alias("_path"))
    rows = records.join(known, key("parent_id") == F.col("_up"), "left")
    own = F.when(F.col("id").isin(roots) & (F.col("kind") == "dir"), "/").when(F.col("_path").isNull(), F.concat(F.lit(f"/{graph.ORPHANS}/"), "name"))
    return rows.withColumn("path", own.otherwise(F.concat(F.when(F.col("_path").startswith("/") | (F.col("_path") == ""), F.col("_path")).otherwise(F.concat(F.lit("/"), "_path")), F.lit("/"), "name"))).drop("_up", "_path")


def objects(records: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """(image_id, id, deleted, data) of files: inline bytes, or extents joined with chunks (image_id, chunk_no, data)."""
    files = records.where("kind = 'file'").dropDuplicates(["image_id", "id", "deleted"])
    placed = files.where("inline is null and size > 0").select("image_id", F.concat_ws(":", "id", F.col("deleted").cast("string")).alias("object_id"), F.col("size").alias("logical_size"), "codec", F.explode("extents").alias("e"))
    whole = extract.materialised(placed.select("image_id", "object_id", "logical_size", "e.*"), chunks, size)
    rest = files.where("inline is not null or size <= 0").select("image_id", "id", "deleted", F.coalesce("inline", F.lit(b"")).alias("data"))
    keyed = files.select("image_id", "id", "deleted", F.concat_ws(":", "id", F.col("deleted").cast("string")).alias("object_id"))
    return keyed.join(whole, ["image_id", "object_id"]).select("image_id", "id", "deleted", "data").unionByName(rest)
