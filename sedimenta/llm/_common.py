"""Helpers shared by the training-data operators.

Only columns an operator needs are carried; everything else (including extra
columns with clashing names) is dropped before the first transformation.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast sides are used up to this many rows; beyond it a shuffled join is planned.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"sedimenta-{os.getuid()}")  # a single machine, as in tests
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["written_path"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.__dict__.get("written_path")
        if path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, buckets: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % buckets


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the text, null texts as empty ones."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slabs(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text (or a single row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
            to = min(max(at + 1, to), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 100_000, size: int = 64 << 20) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or ``size`` bytes that never part rows of equal keys, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    n = have = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, have = n + batch.num_rows, have + batch.nbytes
        if n >= rows or have >= size:
            x = pa.Table.from_batches(held)
            other = np.zeros(x.num_rows, bool)
            for key in keys:
                column = x.column(key).to_numpy()
                other |= column != column[-1]
            if other.any():
                at = int(np.flatnonzero(other)[-1]) + 1
                yield x.slice(0, at)
                held = x.slice(at).combine_chunks().to_batches()
            n, have = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


class WordIds(dict):
    """64-bit ids of words (bytes); emptied when full, so its memory is bounded."""

    def __init__(self, seed: int = 0, most: int = 1_000_000) -> None:
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes (modulo 2**64) of every ``width`` consecutive ids, by doubling."""
    if len(ids) < width:
        return np.empty(0, np.uint64)
    out, have, power, block, span = None, 0, np.uint64(0x9E3779B97F4A7C15), ids, 1
    rest = width
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, have = block, span
                else:  # out covers `have` ids, block the next `span`
                    n = len(ids) - have - span + 1
                    out, have = out[:n] * power + block[have : have + n], have + span
            rest >>= 1
            if rest:
                n = len(block) - span
                block, power, span = block[:n] * power + block[span : span + n], power * power, span * 2
        return mix(out[: len(ids) - width + 1])


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    used = max([k + 1 for k in range(len(planes)) if planes[k].any()], default=1)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def unsqueeze(data: bytes, kind: type, n: int) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:], max_output_size=max(1, n * data[0])), np.uint8)
    out[:, : data[0]] = raw.reshape(data[0], n).T
    return out.view(kind).ravel()


class Bloom:
    """A set of longs that may say yes too often: 32 bits for each, at most 2**27 (16 MB) in all; beyond, it only lets more through."""

    def __init__(self, bits: int, word: np.ndarray, mask: np.ndarray) -> None:
        self.bits, self.words = bits, np.zeros(max(1, (1 << bits) >> 6), np.uint64)
        self.words[word] = mask

    @classmethod
    def of(cls, rows: DataFrame, column: str, most: int = 27) -> Bloom:
        """From a column of a written table; its words reach the driver, at most 2**21 of them."""
        bits = min(most, max(10, (32 * rows.count()).bit_length()))

        def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(np.concatenate(list(places(batch.column(0).drop_null().to_numpy(), bits))))
                mask = np.uint64(1) << (at & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(mask.view(np.int64))], names=["word", "mask"])

        got = rows.select(column).mapInArrow(bits_of, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        return cls(bits, got.column("word").to_numpy(), got.column("mask").to_numpy().view(np.uint64))

    def may_have(self, values: np.ndarray) -> np.ndarray:
        left = np.arange(len(values))
        for k in range(PLACES):
            at = next(places(values[left], self.bits, k))
            left = left[self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1]
        out = np.zeros(len(values), bool)
        out[left] = True
        return out


#: Bits that a Bloom filter sets for each value.
PLACES = 4


def places(values: np.ndarray, bits: int, first: int = 0) -> Iterator[np.ndarray]:
    """The places, below 2**bits, of each long: an array for each of ``PLACES`` hashes."""
    with np.errstate(over="ignore"):
        one = mix(values.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
        step = mix(one) | np.uint64(1)
        for k in range(first, PLACES):
            yield one + np.uint64(k) * step >> np.uint64(64 - bits)
