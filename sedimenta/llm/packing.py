"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Each piece of a document goes where the sum, over all residual gaps, of the
squared number of open bins with that gap becomes smallest; ties go to the
fullest bin. Pieces are dealt to groups of bounded size that are packed
independently, so the work scales out and no task sees more than a group.

Defined results: a null text counts as empty (one piece with the end token
only); repeated rows are packed as often as they occur; an empty table gives no
rows; a text longer than a sequence is cut, the first piece taking the rest.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of the byte-level BPE in a tokenizers file.

    When ``ranks`` names the same vocabulary as a tiktoken file, that faster
    implementation is used; texts that spell a special token go through
    ``tokenizers`` itself, which treats them as one id.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or SPECIAL in text:
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def tokenised(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of at most ``capacity`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, ranks, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for slab in C.slabs(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(slab.column(0).to_pylist(), slab.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text), END], "<u4")
                start, piece = 0, 0
                end = len(ids) % capacity or capacity
                while start < len(ids):
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, piece = end, end + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return C.id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the order given."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)  # open bins by level; full ones don't count
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        if size >= capacity:
            bins[i], offsets[i], made = made, 0, made + 1
            continue
        # twice the change, less a constant, of the sum of squares when a bin of level h takes the item
        change = 2 * (n[size:] - n[: capacity - size + 1]) + 2
        change[0] -= 1  # a new bin: no bin leaves a level
        change[-1] -= 1  # a filled bin: none reaches an open level
        change[1:][n[1 : capacity - size + 1] == 0] = 1 << 40
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        if level == 0:
            place, made = made, made + 1
        else:
            place = open_bins[level].pop()
            n[level] -= 1
        bins[i], offsets[i] = place, level
        if level + size < capacity:
            open_bins[level + size].append(place)
            n[level + size] += 1
    return bins, offsets


def packed(pieces: DataFrame, capacity: int = 1024, group_rows: int = 100_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (columns of ``PIECES``, a written table).

    Pieces are packed in groups of about ``group_rows``, as few as that allows, each in
    descending order and in a random one; the better counts.
    """
    total = pieces.count()
    groups = max(1, -(-total // group_rows))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = group.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable", na_position="first", ignore_index=True)
        lengths = order["length"].to_numpy(np.int64)
        best = None
        for how in (np.argsort(-lengths, kind="stable"), np.random.default_rng(len(lengths)).permutation(len(lengths))):
            bins, offsets = sum_of_squares(lengths[how], capacity)
            if best is None or bins.max(initial=-1) < best[1].max(initial=-1):
                best = how, bins, offsets
        how, bins, offsets = best
        out = order.iloc[how].drop(columns="salt")
        out["sequence_id"] = bins + (np.int64(order["salt"].iloc[0]) << 32)
        out["offset"] = offsets
        return out

    # the place of the row in the written pieces parts repeated rows of one id
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start", F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    salted = pieces.withColumn("salt", salt).repartitionByRange(groups, "salt")  # a group to a task; by hash some tasks would get several
    return salted.groupBy("salt").applyInPandas(run, PIECES + ", sequence_id long, offset long")


def best_fit(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise once, keep the short piece rows in the shared folder, then pack."""
    return packed(C.written(tokenised(docs, path, ranks, pattern, capacity, id_col, text_col), "pieces"), capacity)


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(C.table(spark, sf_dir, "documents"))
