"""Quality classification by a factorisation machine.

Features are hashed words, statistics of the text's structure and its length.
Pairwise interactions have low rank, and the sum-of-squares identity
    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)
makes a score linear in the number of features.

Defined results: null and empty texts are scored as texts without words; with no
usable label (or only one kind of it) the score is the share of label 1, or 0.5;
several labels of one document count as their maximum, null labels are ignored;
repeated rows get equal rows; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

WORDS = 1 << 14
RANK = 4
#: Byte classes: lower, upper, digit, white space, other ASCII, beyond ASCII.
CLASS = np.array([5 if b > 127 else 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b" \t\n\v\f\r" else 4 for b in range(256)], np.uint8)
STATS = 14
DIM = WORDS + STATS


def structure(text: bytes, words: list[bytes]) -> list[float]:
    """Statistics of the structure, each roughly within 0 to 1."""
    n, w = max(1, len(text)), max(1, len(words))
    share = np.bincount(CLASS[np.frombuffer(text, np.uint8)], minlength=6) / n
    lines = text.split(b"\n")
    letters = max(share[0] + share[1], 1e-9)
    return [
        1.0,
        share[0],
        share[1] / letters,
        min(1.0, 8 * share[2]),
        share[3],
        min(1.0, 4 * share[4]),
        share[5],
        min(1.0, len(text) / w / 16),
        len(set(words)) / w,
        len(set(lines)) / len(lines),
        min(1.0, 20 * text.count(b"|") / w),
        min(1.0, sum(text.count(x) for x in (b"!", b"#", b"$", b"%", b"&", b"*")) / w),
        min(1.0, np.log1p(len(text)) / 12),
        min(1.0, 10 * len(lines) / w),
    ]


def features(slab: pa.RecordBatch, ids: C.WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat arrays of row, feature and value; the words of a row have unit length together."""
    hashed, sizes, stats = [], [], []
    for text in slab.column(slab.schema.get_field_index("text")).cast(pa.binary()).to_pylist():
        words = text.split()
        hashed.append(ids.of(words))
        sizes.append(len(words))
        stats.append(structure(text, words))
    n = len(sizes)
    keys = np.repeat(np.arange(n, dtype=np.int64) * WORDS, sizes) + (np.concatenate(hashed) & np.uint64(WORDS - 1)).astype(np.int64)
    keys, count = np.unique(keys, return_counts=True)
    row, x = keys // WORDS, np.log1p(count)
    x = x / np.sqrt(np.maximum(np.bincount(row, x * x, n), 1e-9))[row]
    return np.concatenate([row, np.repeat(np.arange(n), STATS)]), np.concatenate([keys % WORDS, np.tile(np.arange(WORDS, DIM), n)]), np.concatenate([x, np.array(stats).ravel()])


def raw_score(model: dict, row: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic function, and the factor sums of each row."""
    sums = np.stack([np.bincount(row, model["v"][at, f] * x, n) for f in range(RANK)], 1)
    squares = np.bincount(row, (model["v"][at] ** 2).sum(1) * x * x, n)
    return model["b"] + np.bincount(row, model["w"][at] * x, n) + 0.5 * ((sums**2).sum(1) - squares), sums


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 14, batch: int = 64) -> dict:
    """AdaGrad on the logistic loss, with a fixed seed."""
    rng = np.random.default_rng(11)
    share = np.mean([y for *_, y in rows]) if rows else 0.5
    model = {"b": 0.0, "w": np.zeros(DIM), "v": np.zeros((DIM, RANK))}
    if not 0 < share < 1:
        return model | {"b": 30.0 if share == 1 else -30.0 if share == 0 else 0.0}
    model["b"], model["v"] = float(np.log(share / (1 - share))), rng.normal(0, 0.02, (DIM, RANK))
    seen = {k: np.full_like(model[k], 1e-3) for k in ("w", "v")}
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            part = [rows[i] for i in order[a : a + batch]]
            row = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            at, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            z, sums = raw_score(model, row, at, x, len(part))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([p[2] for p in part])) / len(part)
            uniq, back = np.unique(at, return_inverse=True)
            gx = g[row] * x
            gw = np.bincount(back, gx, len(uniq)) + 1e-6 * model["w"][uniq]
            gv = np.stack([np.bincount(back, gx * (sums[row, f] - model["v"][at, f] * x), len(uniq)) for f in range(RANK)], 1) + 1e-5 * model["v"][uniq]
            for k, d in (("w", gw), ("v", gv)):
                seen[k][uniq] += d * d
                model[k][uniq] -= 0.15 * d / np.sqrt(seen[k][uniq])
            model["b"] -= 0.1 * g.sum()
    return model


def train(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 6_000) -> dict:
    """Fit on at most ``most`` labelled rows (a documented bound), chosen by a hash of the id."""
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    sample = sample.orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = C.WordIds()
        for slab in C.slabs(batches):
            row, at, x = features(slab, ids)
            order = np.argsort(row, kind="stable")
            ends = np.cumsum(np.bincount(row, minlength=slab.num_rows))
            cut = lambda v, t: [p.astype(t).tobytes() for p in np.split(v[order], ends[:-1])]
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(cut(at, np.int32), pa.binary()), pa.array(cut(x, np.float64), pa.binary())], names=["y", "at", "x"])

    text = C.id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("y", "text")
    rows = text.mapInArrow(run, "y int, at binary, x binary").collect()
    return fit(sorted(((np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"]), r["y"]) for r in rows), key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes())))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 from 0.5 on) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by WORDS and RANK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = C.WordIds(), sent.value
        for slab in C.slabs(batches):
            z, _ = raw_score(m, *features(slab, ids), slab.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return C.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: dict, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is at least ``least``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = C.WordIds(), sent.value
        for slab in C.slabs(batches, text_col):
            text = slab.column(slab.schema.get_field_index(text_col)).fill_null("")
            z, _ = raw_score(m, *features(pa.RecordBatch.from_arrays([text], names=["text"]), ids), slab.num_rows)
            yield slab.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) >= least))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = train(docs, C.table(spark, sf_dir, "labels"), C.fold("doc_id", 3) != 1)
    return score(docs, model).withColumn("held_out", C.fold("doc_id", 3) == 1).select("doc_id", "held_out", "score", "predicted")
