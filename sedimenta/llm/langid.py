"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit, over hashed
character bigrams and trigrams, predicts that bit. Loss-weighted decoding picks
the codeword with the smallest weighted logistic loss; a small lead over the
second one flags the text as ambiguous.

Defined results: null texts and texts without a letter give ``und`` with score 0;
with nothing to learn from, every text gives ``und``; repeated rows get equal
rows; an empty table gives no rows. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

DIM = 1 << 13
WORDLIKE = re.compile(r"[^\W\d_]")
OUT = "doc_id long, lang_pred string, score double, ambiguous boolean, margin double"


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode categories L*); signs such as numerals and superscripts are none."""
    return any(c.isalpha() for c in map(re.Match.group, WORDLIKE.finditer(text)))


def ngram_rows(texts: list[str]) -> np.ndarray:
    """Unit rows of square-rooted counts of hashed bigrams and trigrams, lower case."""
    units = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(u) for u in units])
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * DIM, sizes)
    c = np.concatenate(units).astype(np.uint32)
    out = np.zeros(len(texts) * DIM)
    with np.errstate(over="ignore"):
        two = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA6B)
        three = (two[:-1] * np.uint32(0xC2B2AE35)) ^ (c[2:] * np.uint32(0x27D4EB2F))
    for gram, width in ((two, 2), (three, 3)):
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        keys = row[: len(gram)] + ((gram >> np.uint32(8)) & np.uint32(DIM - 1))
        same = row[: len(gram)] == row[width - 1 :]
        out += np.bincount(keys[same], minlength=len(out))
    x = np.sqrt(out.reshape(len(texts), DIM)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Rows of +-1: all distinct splits for up to 6 classes, else the best of random codes."""
    if classes <= 1:
        return np.ones((classes, 1), np.float32)
    if classes <= 6:
        return np.array([(1, *bits) for bits in itertools.product((1, -1), repeat=classes - 1) if -1 in bits], np.float32).T.copy()
    rng, best = np.random.default_rng(seed), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, 10 + 4 * int(np.ceil(np.log2(classes))))).astype(np.float32)
        code = code[:, np.abs(code.sum(0)) < classes]
        least = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if best is None or least > best[0]:
            best = least, code
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 150) -> dict:
    """One logistic classifier a bit, all fitted together; a bit weighs as its lead over chance."""
    code = codewords(classes)
    bits = code[y]
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    weight = (len(y) / classes / np.maximum(np.bincount(y, minlength=classes), 1))[y][:, None].astype(np.float32)
    seen_w, seen_b = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(steps):
        g = -bits * weight / (1 + np.exp(np.clip(bits * (x @ w + b), -30, 30))) / max(1, len(y))
        gw, gb = x.T @ g + 1e-5 * w, g.sum(0)
        seen_w += gw * gw
        seen_b += gb * gb
        w -= 0.5 * gw / np.sqrt(seen_w)
        b -= 0.5 * gb / np.sqrt(seen_b)
    right = ((x @ w + b) * bits > 0).mean(0) if len(y) else np.ones(code.shape[1])
    return {"w": w, "b": b, "code": code, "bit_weight": np.maximum(2 * right - 1, 0.01).astype(np.float32)}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, score in 0 to 1, and lead over the second class by weighted loss."""
    f = x @ model["w"] + model["b"]
    loss = (np.logaddexp(0, -model["code"][None] * f[:, None]) * model["bit_weight"]).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    two = np.sort(p, axis=1)[:, ::-1]
    return loss.argmin(1), two[:, 0], two[:, 0] - (two[:, 1] if p.shape[1] > 1 else 0)


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable, per_lang: int = 1200, most: int = 10_000) -> tuple[list[str], dict | None]:
    """Fit on about ``per_lang`` texts of each language and ``most`` of all (documented bounds), chosen by a hash of the id."""
    known = docs.where(F.col(lang_col).isNotNull() & usable).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.where(F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], None
    per_lang = min(per_lang, most / len(langs))
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, per_lang / counts[k]))])
    unit = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1 << 30)) / F.lit(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in C.slabs(batches, rows=128):
            for lang, x in zip(slab.column(0).to_pylist(), ngram_rows(slab.column(1).to_pylist()), strict=True):
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype(np.int32).tobytes()]), pa.array([x[at].tobytes()])], names=["lang", "at", "x"])

    rows = known.where(unit < share[F.col("lang")]).select("lang", "text").mapInArrow(run, "lang string, at binary, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["x"])))
    x = np.zeros((len(rows), DIM), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["x"], np.float32)
    return langs, fit(x, np.array([langs.index(r["lang"]) for r in rows], np.int64), len(langs))


def predict(docs: DataFrame, langs: list[str], model: dict | None, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.2) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((langs, model))  # dimensions x bits, fixed by parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = sent.value
        for slab in C.slabs(batches, rows=128):
            ids, texts = slab.column(0), slab.column(1).to_pylist()
            has = np.array([bool(m) and has_letter(t) for t in texts])
            best, score, lead = decode(m, ngram_rows(texts)) if m else (np.zeros(len(texts), int),) * 3
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([names[b] if h else "und" for b, h in zip(best, has, strict=True)], pa.string()),
                    pa.array(np.where(has, score, 0.0), pa.float64()),
                    pa.array(~has | (lead < ambiguous_below), pa.bool_()),
                    pa.array(np.where(has, lead, 0.0), pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score", "ambiguous", "margin"],
            )

    return C.id_text(docs, id_col, text_col).mapInArrow(run, OUT)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    langs, model = train(docs, "doc_id", "text", "lang", C.fold("doc_id", 5) != 0)
    return predict(docs, langs, model).withColumn("held_out", C.fold("doc_id", 5) == 0).select("doc_id", "held_out", "lang_pred", "score", "ambiguous", "margin")
