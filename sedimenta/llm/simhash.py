"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints that link within ``budget`` bits agree on at least one of
``budget + 1`` segments. For each segment there is a trie of the fingerprints
rotated so that this segment comes first; only pairs below the same node at the
segment's end are traversed, which is exact. Pairs of nodes go down together,
differing bits add up, and a pair is pruned beyond the budget.

Equal fingerprints are merged before the join, links within a task become a
spanning star before they leave it, and whole components come from the links.

Defined results: null and empty texts, and texts of white space, have no words,
fingerprint zero and link like any other; repeated rows get equal rows; an empty
table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import families
from .components import components, local_labels

BITS = 64


def fingerprint(words: list[bytes], size: int) -> int:
    """64-bit SimHash of the ``size``-word shingles, repeats included."""
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= size:
        return hash_(b" ".join(words), 42)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashes = np.array([hash_(line[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], ">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (a signed long with the same bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in C.slabs(batches):
            prints = [fingerprint(t.lower().split(), size) for t in slab.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return C.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(keys: np.ndarray, depth: int, budget: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted, distinct keys with equal first ``depth`` bits and at most ``budget`` differing ones.

    A node is a range of the sorted keys. Pairs of nodes go down level by level,
    in blocks of at most about ``most`` pairs, so memory is bounded.
    """
    zeros: dict[int, np.ndarray] = {}

    def middle(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
        if level not in zeros:
            zeros[level] = np.concatenate([[0], np.cumsum(keys >> np.uint64(BITS - 1 - level) & np.uint64(1) == 0)])
        return lo + zeros[level][hi] - zeros[level][lo]

    root = keys >> np.uint64(BITS - depth) if depth else np.zeros(len(keys), np.uint64)
    edge = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    lo, hi = edge[:-1], edge[1:]
    stack = [(depth, np.stack([lo, hi, lo, hi, np.zeros_like(lo)])[:, hi - lo > 1])]
    while stack:
        level, pairs = stack.pop()
        while pairs.shape[1]:
            alone = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
            if alone.any():
                i, j = pairs[0, alone], pairs[2, alone]
                near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
                yield i[near], j[near]
                pairs = pairs[:, ~alone]
            if level == BITS or not pairs.shape[1]:
                break
            if pairs.shape[1] > most:
                half = pairs.shape[1] // 2
                stack.append((level, pairs[:, half:]))
                pairs = pairs[:, :half]
                continue
            al, ah, bl, bh, spent = pairs
            am, bm = middle(al, ah, level), middle(bl, bh, level)
            twin = al == bl
            down = [np.stack([al, am, bl, bm, spent]), np.stack([am, ah, bm, bh, spent]), np.stack([al, am, bm, bh, spent + 1]), np.stack([am, ah, bl, bm, spent + 1])[:, ~twin]]
            pairs = np.concatenate(down, 1)
            kept = (pairs[1] > pairs[0]) & (pairs[3] > pairs[2]) & (pairs[4] <= budget) & ~((pairs[0] == pairs[2]) & (pairs[1] - pairs[0] == 1))
            pairs, level = pairs[:, kept], level + 1


def segments(budget: int) -> list[tuple[int, int]]:
    """Start and width of each of ``budget + 1`` segments of the fingerprint."""
    cuts = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def trie_links(prints: DataFrame, budget: int) -> DataFrame:
    """Links (a, b) between nodes, spanning all pairs within the budget, from distinct (fp, node)."""
    parts = segments(budget)
    turned = F.array(*[F.struct(F.lit(t).alias("trie"), F.expr(f"(fp << {a}) | shiftrightunsigned(fp, {BITS - a})" if a else "fp").alias("key")) for t, (a, _) in enumerate(parts)])
    rows = prints.select("node", F.explode(turned).alias("x")).select("node", "x.trie", "x.key")
    width = F.element_at(F.array(*[F.lit(BITS - w) for _, w in parts]), F.col("trie") + 1)
    rows = rows.withColumn("root", F.call_function("shiftrightunsigned", F.col("key"), width))
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "trie", "root").sortWithinPartitions("trie", "root")

    def links(trie: int, node: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(key)
        key, node = key[order], node[order]
        label = np.arange(len(key))
        for i, j in trie_pairs(key, parts[trie][1], budget):
            if len(i):
                again = local_labels(len(key), np.concatenate([i, np.arange(len(key))]), np.concatenate([j, label]))
                label = again
        least = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        low = least[label]
        return pa.RecordBatch.from_arrays([pa.array(node[node != low]), pa.array(low[node != low])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole roots are gathered until there are enough rows for one traversal."""
        for x in C.whole_groups(batches, ["trie", "root"]):
            tries = x.column("trie").to_numpy()
            for t in np.unique(tries):
                sel = tries == t
                yield links(int(t), x.column("node").to_numpy()[sel], x.column("key").to_numpy()[sel].view(np.uint64))

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest id that links reach) for every row."""
    prints = C.written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    classes = C.written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    groups = components(trie_links(classes, budget))
    classes = C.written(classes.join(groups, "node", "left").select(F.col("fp").alias("class"), F.coalesce("component", "node").alias("component_id")), "classes")
    return prints.join(classes, prints["fp"] == classes["class"], "left").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by similarity: wider budgets than segments of a fingerprint can serve.


def word_prints(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, SimHash of the distinct words, and a hash of all words in order; beside them, with a segment, parts of the sketch of shingles."""
    names = ["doc_id", "fp", "content", "segment", "counts"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sketch = C.WordIds(42), families.Sketch()
        for slab in C.slabs(batches):
            prints, contents, met = [], [], []
            for text in slab.column(1).cast(pa.binary()).to_pylist():
                words = text.lower().split()
                ids = table.of(words)
                own = np.unique(ids)
                ones = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) if len(own) else np.zeros(BITS, np.int64)
                prints.append(int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big"))
                contents.append(xxhash.xxh64_intdigest(b" ".join(words), 7))
                met.append(np.unique(C.rolling(ids, min(size, max(1, len(ids))))))
            sketch.add(np.concatenate(met))
            none = [pa.nulls(len(prints), t) for t in kinds[3:]]
            yield pa.RecordBatch.from_arrays([slab.column(0), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, contents)], *none], names=names)
        if parts := sketch.segments():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(parts), t) for t in kinds[:3]], *[pa.array(x, t) for x, t in zip(zip(*parts, strict=True), kinds[3:], strict=True)]], names=names)

    return C.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long, content long, segment int, counts binary")


def turned_keys(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Fingerprints with their bits in another order."""
    bits = np.unpackbits(key.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, order]
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits), axis=1)).view(">u8").ravel().astype(np.uint64)


def near_pairs(keys: np.ndarray, depth: int, budget: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sorted keys below common nodes; a node with more than ``most`` keys goes by its children and their first keys."""
    if depth >= BITS:  # equal keys: a chain
        yield np.arange(len(keys) - 1), np.arange(1, len(keys))
        return
    root = keys >> np.uint64(BITS - depth)
    edge = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1], [True]]))
    large = np.flatnonzero(np.diff(edge) > most)
    fits = np.repeat(np.diff(edge) <= most, np.diff(edge))
    at = np.flatnonzero(fits)
    own, first = keys[at], np.flatnonzero(np.concatenate([[True], keys[at][1:] != keys[at][:-1]])) if len(at) else np.empty(0, np.int64)
    if len(at):
        same = np.flatnonzero(own[1:] == own[:-1])
        yield at[same], at[same + 1]
        for i, j in trie_pairs(own[first], depth, budget):
            yield at[first[i]], at[first[j]]
    for k in large:
        a, b = edge[k], edge[k + 1]
        deeper = min(BITS, depth + 8)
        for i, j in near_pairs(keys[a:b], deeper, budget, most):
            yield a + i, a + j
        sub = keys[a:b] >> np.uint64(BITS - deeper) if deeper < BITS else keys[a:b]
        heads = a + np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]]))
        for i, j in trie_pairs(keys[heads], depth, budget):
            yield heads[i], heads[j]


def orders_for(depth: int, apart: int, recall: float) -> int:
    """How many orders of the bits make fingerprints ``apart`` bits away share their first ``depth`` bits in one of them."""
    return math.ceil(math.log(1 - recall) / math.log1p(-math.comb(BITS - depth, apart) / math.comb(BITS, apart)))


def similar_candidates(prints: DataFrame, budget: int, recall: float, apart: int = 5, nearest: int = 4, most: int = 512) -> DataFrame:
    """Pairs (a, b) of nodes that tries over several orders of the bits put near each other.

    More rows need deeper roots, which fewer near pairs share, so the number of orders
    follows the depth: the share of pairs ``apart`` bits away that meet stays the same.
    """
    total = prints.count()
    depth = min(48, max(10, int(total).bit_length() + 1))
    orders = orders_for(depth, apart, recall)
    rng = np.random.default_rng(3)
    permutations = [rng.permutation(BITS) for _ in range(orders)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, node = batch.column(1).to_numpy().view(np.uint64), batch.column(0).to_numpy()
            for t, order in enumerate(permutations):
                k = turned_keys(key, order)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), t, np.int32)), pa.array((k >> np.uint64(BITS - depth)).astype(np.int64)), pa.array(k.view(np.int64)), pa.array(node)], names=["trie", "root", "key", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(x: pa.Table) -> Iterator[pa.RecordBatch]:
            tries = x.column("trie").to_numpy()
            for t in np.unique(tries):
                sel = tries == t
                key, node = x.column("key").to_numpy()[sel].view(np.uint64), x.column("node").to_numpy()[sel]
                order = np.lexsort((node, key))
                key, node = key[order], node[order]
                parts = [(i, j) for i, j in near_pairs(key, depth, budget, most) if len(i)]
                if not parts:
                    continue
                i, j = (np.concatenate(p) for p in zip(*parts, strict=True))
                d = np.bitwise_count(key[i] ^ key[j])
                one, two, d = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])
                by = np.lexsort((two, d, one))
                one, two = one[by], two[by]
                start = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
                place = np.arange(len(one)) - np.repeat(start, np.diff(np.append(start, len(one))))
                # links to the nearest, and to the first of all those in reach, span the rest
                keep = place < nearest
                a, b = np.append(node[one[keep]], node[one[start]]), np.append(node[two[keep]], node[np.minimum.reduceat(two, start)])
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for x in C.whole_groups(batches, ["trie", "root"]):
            yield from flush(x)

    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select("node", "fp").mapInArrow(spread, "trie int, root long, key long, node long")
    return rows.repartition(tasks, "trie", "root").sortWithinPartitions("trie", "root").mapInArrow(run, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the documents that ``nodes`` (a written table with column node) names: sorted distinct 32-bit hashes."""
    wanted = docs.sparkSession.sparkContext.broadcast(C.Bloom.of(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = C.WordIds(42)
        for slab in C.slabs(batches):
            slab = slab.filter(pa.array(wanted.value.may_have(slab.column(0).to_numpy())))
            sets = []
            for text in slab.column(1).cast(pa.binary()).to_pylist():
                ids = table.of(text.lower().split())
                sets.append(np.unique((C.rolling(ids, min(size, max(1, len(ids)))) >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    sets = C.id_text(docs, id_col, text_col).where("doc_id is not null").mapInArrow(run, "node long, shingles binary")
    return C.written(sets.dropDuplicates().join(nodes.select("node").distinct().hint("merge"), "node", "left_semi"), "shingles")


def similar_links(docs: DataFrame, pairs: DataFrame, size: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b), of a written table, whose shingle sets have the Jaccard similarity."""
    nodes = C.written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    sets = shingle_sets(docs, nodes, size, id_col, text_col)
    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(s, np.uint32) for s in batch.column(2).to_pylist()]
            y = [np.frombuffer(s, np.uint32) for s in batch.column(3).to_pylist()]
            common = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)])
            union = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)]) - common
            yield batch.filter(pa.array(common >= similarity * union - 1e-9)).select(["a", "b"])

    links = C.written(pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(linked, "a long, b long"), "similar")
    C.discard(nodes, sets)
    return links


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, budget: int = 14, recall: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id of documents that links of the given Jaccard similarity connect.

    Fingerprints of distinct words propose pairs: two texts with a similarity of
    0.8 in five-word shingles differ in few words, so their fingerprints differ in
    about 4 of 64 bits. A pair is linked when the similarity of its shingle sets
    says so. The tries keep only the nearest proposals of each text; links between
    the components found so are searched by necessary shingles, which misses none. Texts without words are one group. Null ids have no group.
    """
    rows = C.written(word_prints(docs, size, id_col, text_col), "fingerprints")
    counts = families.summed(rows.where("segment is not null").select("segment", "counts"))
    prints = rows.where("segment is null and doc_id is not null").select("doc_id", "fp", "content")
    classes = C.written(prints.groupBy("content").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp")), "classes")
    pairs = C.written(similar_candidates(classes, budget, recall), "pairs")
    links = similar_links(docs, pairs, size, similarity, id_col, text_col)
    groups = components(links)
    known = C.written(classes.join(groups, "node", "left").select("node", "content", F.coalesce("component", "node").alias("component")), "classes")
    C.discard(pairs, links, groups, classes)
    texts = C.id_text(docs, id_col, text_col).where("doc_id is not null")
    firsts = families.necessary(texts, size, similarity, counts).dropDuplicates(["doc_id", "content"])
    firsts = firsts.join(known.withColumnRenamed("node", "doc_id").hint("merge"), ["doc_id", "content"]).where("n > 0")
    firsts = C.written(firsts.select(F.col("doc_id").alias("node"), "component", "n", "tokens"), "necessary")
    pairs, members = families.candidates(firsts, similarity)
    links = similar_links(docs, C.written(pairs, "pairs"), size, similarity, id_col, text_col)
    sets = shingle_sets(docs, members, size, id_col, text_col)
    links = links.unionByName(families.verified(families.cells(members).join(sets, "node"), similarity))
    links = C.written(links, "links")
    for side in ("a", "b"):  # links between texts become links between components
        links = links.join(known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_")), side)
    groups = components(links.select(F.col("a_").alias("a"), F.col("b_").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    C.discard(firsts, members, sets)
    classes = C.written(known.join(groups, "component", "left").select(F.col("content").alias("class"), F.coalesce("whole", "component").alias("component_id")), "classes")
    return prints.join(classes, prints["content"] == classes["class"]).select("doc_id", "component_id")


def deduplicated(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the smallest id of each group, with all columns; rows that share an id stay together, null ids stay."""
    gone = similar_groups(docs, size, similarity, id_col=id_col, text_col=text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(C.written(gone, "copies").hint("merge"), id_col, "left_anti").select(*docs.columns)
