"""Exact links between texts that can be similar, without a row for each pair.

Two sets with a Jaccard similarity of s share one of the first n - ceil(s * n) + 1
elements of each, in any order common to both. Frequent shingles come last in that
order, so passages that many documents share seldom index anything. How frequent a
shingle is comes from a count sketch of fixed size over all documents; it affects
only the order, and so the cost, never the links.

Shingles whose texts all lie in one known component need no work. Of the others each
proposes the pairs whose sizes and places allow the similarity. A shingle that would
propose more than EACH pairs a text, or that too many texts have for one task, makes a
family of its texts instead, by one row a text. A family's members are dealt to sides of
bounded size, and cells of two sides compare their members in memory, by inverted lists
of all their shingles. Members that are linked are never compared with each other again,
and a cell returns only the links of a spanning forest, so no table grows with the
square of a family. A component too large for a side is dealt over several; these are
not compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .components import components

#: Cells of the count sketch (a power of 2); its size is 4 bytes a cell, whatever the input.
SKETCH_BITS = 20
SEGMENTS = 64
#: Members, and shingles of all members, of one side of a cell.
SIDE_MEMBERS, SIDE_SHINGLES = 1_000, 1_000_000
#: Pairs that a shingle may propose for each text that has it, and texts of a shingle that one task compares.
EACH, BUCKET = 2, 5_000


def shingles(words: list[bytes], size: int, table: C.WordIds) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole sequence when it is shorter."""
    ids = table.of(words)
    return np.unique(C.rolling(ids, min(size, max(1, len(ids)))))


class Sketch:
    """How often the shingles of a task occur, by the first bits of their hashes."""

    def __init__(self) -> None:
        self.counts = np.zeros(1 << SKETCH_BITS, np.uint32)

    def add(self, own: np.ndarray) -> None:
        np.add.at(self.counts, (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)

    def segments(self) -> list[tuple[int, bytes]]:
        return [(k, C.squeeze(part)) for k, part in enumerate(np.split(self.counts, SEGMENTS)) if part.any()]


def summed(parts: DataFrame) -> np.ndarray:
    """The sketch of all tasks from their parts (segment, counts); SEGMENTS rows reach the driver."""
    width = (1 << SKETCH_BITS) // SEGMENTS

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.uint64)
        for counts in pdf["counts"]:
            total += C.unsqueeze(counts, np.uint32, width)
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "counts": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    out = np.zeros((SEGMENTS, width), np.uint32)
    for row in parts.groupBy("segment").applyInPandas(add, "segment int, counts binary").collect():
        out[row["segment"]] = np.frombuffer(row["counts"], np.uint32)
    return out.ravel()


def necessary(docs: DataFrame, size: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """doc_id, content (a hash of the words), n distinct shingles and the necessary ones, from (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, often = C.WordIds(42), sent.value
        for slab in C.slabs(batches):
            contents, sizes, parts = [], [], []
            for text in slab.column(1).cast(pa.binary()).to_pylist():
                words = text.lower().split()
                own = shingles(words, size, table)
                need = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
                order = np.argsort(often[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                contents.append(xxhash.xxh64_intdigest(b" ".join(words), 7))
                sizes.append(len(own))
                parts.append(own[order[:need]].tobytes())
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(np.array(contents, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "content", "n", "tokens"])

    return docs.mapInArrow(run, "doc_id long, content long, n int, tokens binary")


def token_rows(rows: DataFrame, wanted: C.Bloom | None = None, large: C.Bloom | None = None) -> DataFrame:
    """(token, node, component, n, place, large) from (node, component, n, tokens), only tokens that may be wanted."""
    sent = rows.sparkSession.sparkContext.broadcast((wanted, large))
    names = ["token", "node", "component", "n", "place", "large"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, large = sent.value
        for batch in batches:
            lists = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            if not lists:
                continue
            sizes = np.array([len(x) for x in lists])
            row, token = np.repeat(np.arange(len(lists)), sizes), np.concatenate(lists)
            place = (np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            if wanted is not None:
                keep = wanted.may_have(token)
                row, token, place = row[keep], token[keep], place[keep]
            many = large.may_have(token) if large is not None else np.zeros(len(token), bool)
            for a in range(0, len(token), 100_000):
                at, part = pa.array(row[a : a + 100_000]), slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(token[part]), *[batch.column(k).take(at) for k in range(3)], pa.array(place[part]), pa.array(many[part])], names=names)

    return rows.select("node", "component", "n", "tokens").mapInArrow(run, "token long, node long, component long, n int, place int, large boolean")


def bucket_pairs(group: np.ndarray, component: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) within groups (rows sorted by group, then n) of different components whose sizes and places allow
    the similarity; groups with more than ``each`` pairs a member are returned as a mask of rows instead."""
    n = n.astype(np.int64)
    members = np.bincount(group)
    count, crowded = np.zeros(len(members), np.int64), np.zeros(len(members), bool)
    i, step, found = np.arange(len(group)), 1, [np.empty((2, 0), np.int64)]
    while len(i):
        i = i[i + step < len(group)]
        j = i + step
        within = (group[i] == group[j]) & (n[i] >= similarity * n[j] - 1e-9) & ~crowded[group[i]]
        i, j = i[within], j[within]
        common = np.minimum(n[i] - place[i], n[j] - place[j])
        good = (component[i] != component[j]) & (common * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-6)
        if good.any():
            found.append(np.stack([i[good], j[good]]))
            count += np.bincount(group[i[good]], minlength=len(count))
            crowded = count > each * members
        step += 1
    pairs = np.concatenate(found, 1)
    pairs = pairs[:, ~crowded[group[pairs[0]]]]
    return pairs[0], pairs[1], crowded[group]


def candidates(rows: DataFrame, similarity: float, each: int = EACH, most: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to verify, at most ``each`` for a member and shingle, and the members of families too dense for that, from (node, component, n, tokens)."""
    indexed = F.col("place") <= F.col("n") - F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-9)  # the smaller of two similar sets has the shingle as early
    mixed = token_rows(rows).groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("first"), F.count("*").alias("members"), F.max(indexed).alias("indexed"))
    mixed = C.written(mixed.where("low <> high and indexed").select("token", "first", "members"), "mixed")
    many = C.written(mixed.where(F.col("members") > most), "large")
    met = token_rows(rows, C.Bloom.of(mixed, "token"), C.Bloom.of(many, "token"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(dense: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.full(both.shape[1], dense)), pa.array(both[0]), pa.array(both[1])], names=["dense", "a", "b"])

        for x in C.whole_groups(batches, ["token"]):
            c = {name: x.column(name).to_numpy() for name in ("token", "node", "component", "n", "place")}
            group = np.cumsum(np.concatenate([[False], c["token"][1:] != c["token"][:-1]]))
            start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            mixed_ = (np.minimum.reduceat(c["component"], start) != np.maximum.reduceat(c["component"], start))[group]
            c = {name: v[mixed_] for name, v in c.items()}
            group = np.unique(group[mixed_], return_inverse=True)[1]
            i, j, crowded = bucket_pairs(group, c["component"], c["n"], c["place"], similarity, each)
            if len(i):
                yield out(False, c["node"][i], c["node"][j])
            at = np.flatnonzero(crowded)
            if len(at):  # a chain in order of size, broken where no two sizes around the gap allow the similarity
                near = (group[at[1:]] == group[at[:-1]]) & (c["n"][at[:-1]] >= similarity * c["n"][at[1:]] - 1e-9)
                head = np.maximum.accumulate(np.where(np.concatenate([[True], ~near]), np.arange(len(at)), 0))
                yield out(True, c["node"][at], c["node"][at[head]])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.where("not large").drop("large").repartition(tasks, "token").sortWithinPartitions("token", "n").mapInArrow(meet, "dense boolean, a long, b long")
    found = C.written(found.distinct(), "candidates")
    stars = met.where("large").select("token", F.col("node").alias("a")).join(mixed.select("token", F.col("first").alias("b")), "token").select("a", "b")
    links = C.written(found.where("dense").select("a", "b").unionByName(stars).distinct(), "families")
    groups = components(links).withColumnRenamed("component", "family")
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    own = rows.groupBy("node").agg(F.min("component").alias("component"), F.max("n").alias("n"))
    members = nodes.join(groups, "node", "left").join(own.hint("merge"), "node").select("node", "component", "n", F.coalesce("family", "node").alias("family"))
    members = C.written(members, "members")
    C.discard(mixed, many, links)
    return found.where("not dense").select("a", "b"), members


def cells(members: DataFrame, side_members: int = SIDE_MEMBERS, side_shingles: int = SIDE_SHINGLES) -> DataFrame:
    """(cell, side, node, component): every two members of a family and of different components meet in one cell, on one side (0) or on sides 0 and 1."""
    parts = F.greatest(F.ceil(F.sum("members") / side_members), F.ceil(F.sum("shingles") / side_shingles)).cast("int")
    sizes = C.written(members.groupBy("family", "component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")), "sizes")
    is_large = (F.col("members") > side_members) | (F.col("shingles") > side_shingles)
    large = sizes.where(is_large).groupBy("family", "component").agg(parts.alias("parts")).select("family", F.col("component").alias("whole"), "parts")
    small = sizes.where(~is_large).groupBy("family").agg(parts.alias("parts")).select("family", F.lit(None).cast("long").alias("whole"), "parts")
    of = C.written(large.unionByName(small), "sides")
    sides = of.select("family", "whole", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    side = F.struct(F.coalesce("whole", F.lit(-1)).alias("whole"), F.col("whole").isNull().alias("small"), F.col("part"))
    one, two = sides.select("family", side.alias("one")), sides.select("family", side.alias("two"))
    same_large = ~F.col("one.small") & ~F.col("two.small") & (F.col("one.whole") == F.col("two.whole"))
    pairs = one.join(two, "family").where((F.col("one") <= F.col("two")) & ~same_large)
    pairs = pairs.select("family", F.xxhash64("family", "one", "two").alias("cell"), "one", "two")
    roles = pairs.select("family", "cell", F.col("one").alias("of"), F.lit(0).alias("side")).unionByName(pairs.where("one <> two").select("family", "cell", F.col("two").alias("of"), F.lit(1).alias("side")))
    roles = roles.select("family", "cell", "side", "of.*")
    placed = members.join(large.select("family", F.col("whole").alias("component"), F.col("parts").alias("large_parts")), ["family", "component"], "left")
    placed = placed.join(small.select("family", F.col("parts").alias("small_parts")), "family", "left")
    is_small = F.col("large_parts").isNull()
    placed = placed.select(
        "family", "node", "component",
        F.when(is_small, -1).otherwise(F.col("component")).alias("whole"),
        is_small.alias("small"),
        F.when(is_small, F.pmod(F.xxhash64("component", F.lit(1)), "small_parts")).otherwise(F.pmod(F.xxhash64("node", F.lit(2)), "large_parts")).cast("int").alias("part"),
    )
    return placed.join(roles, ["family", "whole", "small", "part"]).select("cell", "side", "node", "component")


def cell_links(side: np.ndarray, component: np.ndarray, sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Links (indexes) that, with the known components, span all similar pairs of a cell.

    With two sides only members of different sides are compared. From each member in
    turn all members not reached yet are looked up in inverted lists of the shingles;
    what is linked is reached, with its whole component.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, code = np.unique(np.concatenate(sets) if m else np.empty(0, np.uint32), return_inverse=True)
    shared = np.bincount(code) > 1 if len(code) else np.zeros(0, bool)
    keep = shared[code]
    owner, code = owner[keep], code[keep]
    at = np.searchsorted(owner, np.arange(m + 1))
    both = side.min(initial=0) != side.max(initial=0)
    by_component = np.argsort(component, kind="stable")
    _, first, number = np.unique(component[by_component], return_index=True, return_inverse=True)
    group_of = np.empty(m, np.int64)
    group_of[by_component] = number
    groups = np.split(by_component, first[1:])
    open_ = np.ones(m, bool)
    listed, lists = 0, None

    def inverted() -> tuple[np.ndarray, np.ndarray]:
        left = open_[owner]
        own, what = owner[left], code[left]
        order = np.argsort(what, kind="stable")
        return own[order], np.concatenate([[0], np.cumsum(np.bincount(what, minlength=len(shared)))])

    for group in groups:
        if not open_[group[0]]:
            continue
        open_[group] = False
        queue = group.tolist()
        while queue:
            i = queue.pop()
            left = int(open_.sum())
            if not left:
                return
            if lists is None or left < listed // 2:
                listed, lists = left, inverted()
            own, start = lists
            a = start[code[at[i] : at[i + 1]]]
            n = start[code[at[i] : at[i + 1]] + 1] - a
            if not n.sum():
                continue
            met = own[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
            common = np.bincount(met, minlength=m)
            near = open_ & (common * (1 + similarity) >= similarity * (sizes + sizes[i]) - 1e-6) & (common > 0)
            if both:
                near &= side != side[i]
            for j in np.flatnonzero(near).tolist():
                if open_[j]:
                    yield i, j
                    more = groups[group_of[j]]
                    open_[more] = False
                    queue += more.tolist()


def verified(rows: DataFrame, similarity: float, held_bytes: int = 16 << 20) -> DataFrame:
    """Links (a, b) between nodes, from (cell, side, node, component, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in C.whole_groups(batches, ["cell"], 1 << 62, held_bytes):
            c = {k: x.column(k).to_numpy() for k in ("cell", "side", "node", "component")}
            sets = [np.frombuffer(s, np.uint32) for s in x.column("shingles").to_pylist()]
            edge = np.flatnonzero(np.concatenate([[True], c["cell"][1:] != c["cell"][:-1], [True]]))
            for a, b in zip(edge, edge[1:], strict=False):
                links = np.array(list(cell_links(c["side"][a:b], c["component"][a:b], sets[a:b], similarity)), np.int64).reshape(-1, 2)
                if len(links):
                    ends = c["node"][a:b][links]
                    yield pa.RecordBatch.from_arrays([pa.array(ends.max(1)), pa.array(ends.min(1))], names=["a", "b"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("cell", "side", "node", "component", "shingles").repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")
