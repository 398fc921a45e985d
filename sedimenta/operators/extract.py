"""Objects from extents, block codecs, and RAID member superblocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.scalar import le


def lznt1(data: bytes) -> bytes:
    """LZNT1: chunks of up to 4096 bytes, each stored or as literals and back references."""
    out, at = bytearray(), 0
    while at + 2 <= len(data):
        head = int.from_bytes(data[at : at + 2], "little")
        if not head:
            break
        if at + 3 + (head & 0xFFF) > len(data):
            raise ValueError("chunk cut off")
        body, at = data[at + 2 : at + 3 + (head & 0xFFF)], at + 3 + (head & 0xFFF)
        if not head & 0x8000:
            out += body
            continue
        first, k = len(out), 0
        while k < len(body):
            flags, k = body[k], k + 1
            for bit in range(8):
                if k >= len(body):
                    break
                if not flags >> bit & 1:
                    out.append(body[k])
                    k += 1
                    continue
                if k + 2 > len(body):
                    raise ValueError("reference cut off")
                token, k = int.from_bytes(body[k : k + 2], "little"), k + 2
                width = 12 - max(0, (len(out) - first - 1).bit_length() - 4)  # bits of the length shrink as the chunk fills
                back, size = (token >> width) + 1, (token & (1 << width) - 1) + 3
                if back > len(out) - first:
                    raise ValueError("reference before its chunk")
                for _ in range(size):
                    out.append(out[-back])
    return bytes(out)


def decode(codec: str | None, data: bytes) -> bytes | None:
    """The decoded block; None for an unknown codec or a damaged block."""
    try:
        if not codec or codec == "none":
            return data
        if codec == "zlib":
            return zlib.decompressobj().decompress(data)
        if codec == "deflate":
            return zlib.decompressobj(-15).decompress(data)
        if codec == "lznt1":
            return lznt1(data)
        if codec == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    except Exception as error:  # each library raises its own kind for damaged input
        if isinstance(error, MemoryError):
            raise
    return None


def decoded(blocks: DataFrame, codec: str = "codec", data: str = "data") -> DataFrame:
    """All columns and ``decoded``; null where ``decode`` gives none, so undecoded blocks can be listed."""
    schema = StructType([*blocks.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (codec, data)}
            out = [None if d is None else decode(c, d) for c, d in zip(at[codec], at[data], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return blocks.mapInArrow(run, schema)


def materialised(extents: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """(image_id, object_id, data) of objects from extents (image_id, object_id, ordinal, start, length, sparse, logical_size).

    Extents meet only the chunks (image_id, chunk_no, data; ``size`` bytes each) they touch, by an
    equi-join on the chunk's number. Holes and bytes past the image are zeros; an object ends at its logical size.
    """
    touched = F.when(F.col("sparse") | (F.col("length") <= 0), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("length") - 1) / size)))
    parts = extents.withColumn("chunk_no", F.explode(touched))
    body = chunks.select("image_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.substr("data", F.lit(1), F.lit(size)).alias("_body"))
    begin = F.greatest("start", F.col("chunk_no") * size)
    n = F.when(F.col("chunk_no").isNull(), F.greatest("length", F.lit(0))).otherwise(F.least(F.col("start") + F.col("length"), (F.col("chunk_no") + 1) * size) - begin).cast("int")
    parts = parts.join(body, ["image_id", "chunk_no"], "left")
    found = F.coalesce(F.hex(F.substr("_body", (begin - F.col("chunk_no") * size + 1).cast("int"), n)), F.lit(""))
    parts = parts.select("image_id", "object_id", "logical_size", F.struct("ordinal", "chunk_no", F.rpad(found, 2 * n, F.lit("0")).alias("hex")).alias("part"))
    rows = parts.groupBy("image_id", "object_id").agg(F.max("logical_size").alias("size"), F.sort_array(F.collect_list("part")).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), ""))
    return rows.select("image_id", "object_id", F.substr(whole, F.lit(1), F.col("size").cast("int")).alias("data"))


# Magic number of md superblocks, and where versions 1.1 and 1.2 keep them.
MD_MAGIC, MD_PLACES = 0xA92B4EFC, (4096, 0)


def superblock(data: Column) -> Column:
    """Level, chunk, members, role, data offset and set of a RAID member by its md superblock; null without one.

    Versions 1.1 and 1.2 stand near the start, 1.0 in the last 8 to 12 KiB, 0.90 in the last whole 64 KiB but one.
    """
    size = F.octet_length(data).cast("long")

    def signed(level: Column) -> Column:
        return F.when(level >= 1 << 31, level - (1 << 32)).otherwise(level).cast("int")

    def version_1(place: int | Column) -> Column:
        place = place if isinstance(place, Column) else F.lit(place)
        number = le(data, place + 160, 4)
        fields = F.struct(
            signed(le(data, place + 72, 4)).alias("level"),
            (le(data, place + 88, 4) * 512).alias("chunk"),
            le(data, place + 92, 4).cast("int").alias("members"),
            le(data, place + 256 + 2 * number, 2).cast("int").alias("role"),
            (le(data, place + 128, 6) * 512).alias("data_offset"),
            F.lower(F.hex(F.substr(data, (place + 17).cast("int"), F.lit(16)))).alias("set_id"),
        )
        return F.when((le(data, place, 4) == MD_MAGIC) & (le(data, place + 4, 4) == 1), fields)

    def version_0(place: Column) -> Column:
        word = lambda k: le(data, place + 4 * k, 4)
        part = lambda k, n: F.hex(F.reverse(F.substr(data, (place + 4 * k + 1).cast("int"), F.lit(n))))
        fields = F.struct(
            signed(word(7)).alias("level"),
            word(65).alias("chunk"),
            word(10).cast("int").alias("members"),
            word(992 + 3).cast("int").alias("role"),
            F.lit(0).cast("long").alias("data_offset"),
            F.lower(F.concat(part(5, 4), part(13, 4), part(14, 4), part(15, 4))).alias("set_id"),
        )
        return F.when((place >= 0) & (word(0) == MD_MAGIC) & (word(1) == 0) & (word(2) >= 90), fields)

    last_1 = F.floor((size - 8192) / 4096) * 4096
    last_0 = F.floor(size / 65536) * 65536 - 65536
    return F.coalesce(*[version_1(p) for p in MD_PLACES], version_1(last_1), version_0(last_0))
