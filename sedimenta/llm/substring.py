"""Removal of repeated passages by fixed-block anchors.

A window of W consecutive words that occurs in two documents holds, in the
document taken as reference, a whole one of its non-overlapping blocks of W // 2
words. So the non-overlapping blocks of all documents are the index, every
rolling window of W // 2 words is a probe, and only around blocks that some other
document has too are hits extended to exact repeats of W words: the windows
there are grouped by their content and all but those of the smallest id go.
Overlapping windows that go make up the maximal repeats.

Anchors meet the windows by a Bloom filter of bounded size. What it lets through in
vain is found unique when windows are grouped, so results don't depend on its size.

What is shuffled is packed: per task and range of hashes one sorted, gap-coded
list, with one entry for each distinct window of the task. A passage that a third
of all documents share therefore sends one entry a task, not one a document.

Windows are compared by 96-bit hashes of their word sequences.

Defined results: null and empty texts have no words; texts shorter than a window
lose nothing; rows with equal ids do not remove each other's windows (neither id
is smaller); a null id counts as larger than any other; repeated rows get equal
rows; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from ._common import squeeze, unsqueeze

#: Stands for a null id within the operator.
NO_ID = np.iinfo(np.int64).max
#: Bits (a power of 2) of the filter by which windows look up anchors: 16 MB at most. More anchors than it has room
#: for let windows through that are grouped in vain, and change no result.
FILTER_BITS = 27
#: Bytes of input for each range of hashes; a task holds one range at a time.
RANGE_BYTES = 32 << 20
#: Words of a task's group of documents that are worked on together.
GROUP_WORDS = 1_500_000
PROBE_BITS = 44


def gaps(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def ungaps(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64, n), dtype=np.uint64)


class Group:
    """Word ids of some documents, end to end, and which windows lie within one document."""

    def __init__(self, ids: list[int], marks: list[int], words: list[np.ndarray]) -> None:
        self.ids, self.marks = np.array(ids, np.int64), np.array(marks, np.uint64).view(np.int64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(words)), self.sizes)

    def windows(self, width: int, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window at each word, and whether the window ends in the same document."""
        hashes = C.rolling(self.words if ids is None else ids, width)
        return hashes, self.doc[: len(hashes)] == self.doc[width - 1 :] if len(hashes) else np.empty(0, bool)


def grouped(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[Group]:
    """Documents that have a window, gathered to groups of bounded size."""
    table, ids, marks, words, n = C.WordIds(), [], [], [], 0
    for slab in C.slabs(batches):
        for doc_id, text in zip(slab.column(0).to_pylist(), slab.column(1).cast(pa.binary()).to_pylist(), strict=True):
            own = text.split()
            if len(own) < window:
                continue
            ids.append(NO_ID if doc_id is None else doc_id)
            marks.append(xxhash.xxh64_intdigest(text, 42))
            words.append(table.of(own))
            n += len(own)
            if n >= GROUP_WORDS:
                yield Group(ids, marks, words)
                ids, marks, words, n = [], [], [], 0
    if words:
        yield Group(ids, marks, words)


def bucket_cuts(buckets: int, bits: int) -> np.ndarray:
    return np.array([(k << bits) // buckets for k in range(1, buckets)], np.uint64)


def shared_anchors(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Hashes (first PROBE_BITS bits) of index blocks that two documents have."""
    block = window // 2

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = bucket_cuts(buckets, PROBE_BITS)
        for g in grouped(batches, window):
            hashes, inside = g.windows(block)
            at = np.flatnonzero(inside)
            key, doc = hashes[at] >> np.uint64(64 - PROBE_BITS), g.doc[at]
            in_index = (at - g.start[doc]) % block == 0
            order = np.argsort(key, kind="stable")
            key, doc, in_index = key[order], doc[order], in_index[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            last = np.concatenate([first[1:], [len(key)]]) - 1 if len(key) else first
            flags = np.logical_or.reduceat(in_index, first).astype(np.uint8) if len(key) else np.empty(0, np.uint8)
            flags = flags | (doc[first] != doc[last]).astype(np.uint8) << 1 if len(key) else flags
            key = key[first]
            ends = [0, *np.searchsorted(key, cuts).tolist(), len(key)]
            rows = [(k, b - a, gaps(key[a:b]), squeeze(flags[a:b])) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "n", "hash", "flags"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([ungaps(h, n) for h, n in zip(pdf["hash"], pdf["n"], strict=True)])
        flags = np.concatenate([unsqueeze(f, np.uint8, n) for f, n in zip(pdf["flags"], pdf["n"], strict=True)])
        order = np.argsort(key, kind="stable")
        key, flags = key[order], flags[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(first, len(key))) > 1
        either = np.bitwise_or.reduceat(flags, first)
        return pd.DataFrame({"anchor": key[first][(either & 1 > 0) & (many | (either & 2 > 0))].astype(np.int64)})

    return docs.mapInArrow(probe, "bucket int, n int, hash binary, flags binary").groupBy("bucket").applyInPandas(meet, "anchor long")


def repeated_starts(docs: DataFrame, window: int, buckets: int, anchors: C.Bloom) -> DataFrame:
    """For each document the starts of its windows that a document of smaller id has, in parts."""
    sent = docs.sparkSession.sparkContext.broadcast(anchors)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cuts, block = sent.value, bucket_cuts(buckets, 64), window // 2
        names = ["bucket", "origin", "n", "hash", "more", "place", "start", "docs", "marks"]
        kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6)
        for g in grouped(batches, window):
            hashes, inside = g.windows(window)
            probes, whole = g.windows(block)
            hit = whole & known.may_have((probes >> np.uint64(64 - PROBE_BITS)).astype(np.int64))
            upto = np.concatenate([[0], np.cumsum(hit)])
            n = np.arange(len(hashes))  # an anchor starts within the window's first window - block + 1 words
            inside = inside & (upto[n + window - block + 1] > upto[n])
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            key = hashes[at]
            more = (C.rolling(C.mix(g.words ^ np.uint64(0x5851F42D4C957F2D)), window)[at] >> np.uint64(32)).astype(np.uint32)
            doc = g.doc[at]
            order = np.lexsort((g.ids[doc], key ^ more))  # equal windows stand together
            order = order[np.argsort(key[order], kind="stable")]
            key, more, doc, at = key[order], more[order], doc[order], at[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])])
            first = np.flatnonzero(new)
            here = g.ids[doc] > g.ids[doc[first]][np.cumsum(new) - 1]  # a smaller id in the same group has it
            start = (at - g.start[doc]).astype(np.uint32)
            origin = xxhash.xxh64_intdigest(g.ids.tobytes() + g.marks.tobytes()) >> 1
            out = []

            def add(bucket: int, own: np.ndarray, key: np.ndarray | None, more: np.ndarray | None, doc: np.ndarray = doc, start: np.ndarray = start, g: Group = g, origin: int = origin, out: list = out) -> None:
                of, place = np.unique(doc[own], return_inverse=True)
                out.append((bucket, origin, len(own), None if key is None else gaps(key), None if more is None else squeeze(more), squeeze(place.astype(np.uint32)), squeeze(start[own]), g.ids[of].tobytes(), g.marks[of].tobytes()))

            asked = np.flatnonzero(~here)  # equal smallest ids all stay in question
            key, more = key[asked], more[asked]
            ends = [0, *np.searchsorted(key, cuts).tolist(), len(key)]
            for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                if b > a:
                    add(k, asked[a:b], key[a:b], more[a:b])
            if here.any():  # settled; under no range of hashes
                add(-1 - origin % buckets, np.flatnonzero(here), None, None)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each list that came in, what goes: one list back for its group of documents."""
        n = pdf["n"].to_numpy()
        later = np.ones(n.sum(), bool)
        if pdf["bucket"].iloc[0] >= 0:
            place = [unsqueeze(p, np.uint32, k) for p, k in zip(pdf["place"], n, strict=True)]
            own = np.concatenate([np.frombuffer(d, np.int64)[p] for d, p in zip(pdf["docs"], place, strict=True)])
            key = np.concatenate([ungaps(h, k) for h, k in zip(pdf["hash"], n, strict=True)])
            more = np.concatenate([unsqueeze(m, np.uint32, k) for m, k in zip(pdf["more"], n, strict=True)])
            order = np.argsort(own, kind="stable")
            order = order[np.argsort((key ^ more)[order], kind="stable")]
            order = order[np.argsort(key[order], kind="stable")]
            key, more, own = key[order], more[order], own[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])])
            later[order] = own > own[np.flatnonzero(new)][np.cumsum(new) - 1]
        rows, base = [], 0
        for r in pdf.itertuples():
            keep = later[base : base + r.n]
            base += r.n
            if keep.any():
                same = keep.all()
                place, start = (r.place, r.start) if same else (squeeze(unsqueeze(x, np.uint32, r.n)[keep]) for x in (r.place, r.start))
                rows.append((r.origin, int(keep.sum()), place, start, r.docs, r.marks))
        return pd.DataFrame(rows, columns=["origin", "n", "place", "start", "docs", "marks"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        """All starts that go, by document of a group."""
        ids = np.concatenate([np.frombuffer(d, np.int64) for d in pdf["docs"]])
        marks = np.concatenate([np.frombuffer(m, np.int64) for m in pdf["marks"]])
        base = np.cumsum([0, *(len(d) // 8 for d in pdf["docs"])])
        place = np.concatenate([unsqueeze(p, np.uint32, n).astype(np.int64) + b for p, n, b in zip(pdf["place"], pdf["n"], base, strict=False)])
        start = np.concatenate([unsqueeze(s, np.uint32, n) for s, n in zip(pdf["start"], pdf["n"], strict=True)])
        of, back = np.unique(np.stack([ids, marks]), axis=1, return_inverse=True)
        both = np.sort(back.ravel()[place].astype(np.uint64) << np.uint64(32) | start)
        doc = (both >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        cut = np.append(first, len(doc))
        start = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pd.DataFrame({"id": of[0][doc[first]], "mark": of[1][doc[first]], "starts": [squeeze(np.diff(start[a:b], prepend=np.uint32(0))) for a, b in zip(cut, cut[1:], strict=False)], "n": np.diff(cut).astype(np.int32)})

    rows = docs.mapInArrow(hits, "bucket int, origin long, n int, hash binary, more binary, place binary, start binary, docs binary, marks binary")
    back = rows.groupBy("bucket").applyInPandas(meet, "origin long, n int, place binary, start binary, docs binary, marks binary")
    return back.groupBy("origin").applyInPandas(gather, "id long, mark long, starts binary, n int")


def kept_words(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, one space between) for every row."""
    spark = docs.sparkSession
    docs = C.id_text(docs, id_col, text_col)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # as planned from the files; nothing is run
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // RANGE_BYTES), 1_000_000))
    found = C.written(shared_anchors(docs, window, buckets), "anchors")
    gone = repeated_starts(docs, window, buckets, C.Bloom.of(found, "anchor", FILTER_BITS)).groupBy("id", "mark").agg(F.collect_list(F.struct("n", "starts")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in C.slabs(batches):
            out = []
            for doc_id, text, parts in zip(slab.column(0).to_pylist(), slab.column(1).cast(pa.binary()).to_pylist(), slab.column(2).to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                if parts:
                    change = np.zeros(n + 1, np.int64)
                    for part in parts:
                        at = np.cumsum(unsqueeze(part["starts"], np.uint32, part["n"]), dtype=np.int64)
                        change[at] += 1  # starts of a part differ
                        change[at + window] -= 1
                    kept = np.flatnonzero(np.cumsum(change)[:n] == 0)
                    words = [words[i] for i in kept.tolist()]
                out.append((doc_id, n, n - len(words), b" ".join(words)))
            ids, sizes, removed, left = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    marked = docs.withColumns({"own_id": F.coalesce("doc_id", F.lit(NO_ID)), "own_mark": F.xxhash64("text")})
    both = marked.join(gone, (F.col("own_id") == F.col("id")) & (F.col("own_mark") == F.col("mark")), "left")
    return both.select("doc_id", "text", "gone").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_words(C.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
g AS (SELECT doc_id, p0, md5(array_to_string(w[p0:p0 + 49], ' ')) k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) p0 FROM d WHERE len(w) >= 50)),
r AS (SELECT doc_id, p0 FROM (SELECT doc_id, p0, min(doc_id) OVER (PARTITION BY k) least FROM g) WHERE least < doc_id),
c AS (SELECT doc_id, list(DISTINCT p) c FROM (SELECT doc_id, unnest(range(p0, p0 + 50)) p FROM r) GROUP BY 1),
x AS (SELECT doc_id, unnest(w) x, generate_subscripts(w, 1) p FROM d WHERE len(w) > 0),
t AS (SELECT x.doc_id, string_agg(x, ' ' ORDER BY p) s, count(*) n FROM x LEFT JOIN c USING (doc_id) WHERE c.c IS NULL OR NOT list_contains(c.c, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, (len(w) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(s, '')) kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
