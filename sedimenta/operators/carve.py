"""The carve operator: match signatures, size what follows, and accept greedily.

Images are rows (image_id, data). One Arrow function works on an image as a whole,
so an object never straddles a piece; images spread over tasks. Counters, content
de-duplication across images and file names are DataFrame plans on the small rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import validate
from .catalog import SPECS, Spec

COLUMNS = "image_id string, format string, ext string, category string, offset long, size long, md5 string, sha1 string, entropy double, confidence double, validated boolean, truncated boolean"
TEXT = re.compile(rb"[\x20-\x7E\t\n\r]{256,}")
SAMPLE = 64 << 10


def entropy(data: bytes) -> float:
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / max(1, len(data))
    return float(-(p * np.log2(p)).sum()) + 0.0


def text_share(data: bytes) -> float:
    """Share of printable, tab, line-end and non-ASCII bytes; 0 with any NUL."""
    b = np.frombuffer(data, np.uint8)
    return 0.0 if (b == 0).any() else float(((b >= 0x20) & (b != 0x7F) | np.isin(b, (9, 10, 13))).mean()) if len(b) else 0.0


def candidates(data: bytes, specs: tuple[Spec, ...]) -> list[tuple[int, int]]:
    """(start, registration number) of each signature hit, by start, then priority, then registration."""
    found = []
    matcher = matcher_of(specs)
    for last, (length, own) in matcher.iter(data.decode("latin-1")) if len(matcher) else ():
        at = last - length + 1
        found += [(at - moff, k) for k, moff in own if at >= moff]
    return sorted(found, key=lambda c: (c[0], -specs[c[1]].priority, c[1]))


@lru_cache(8)
def matcher_of(specs: tuple[Spec, ...]) -> ahocorasick.Automaton:
    """One automaton for all magics: a single pass over an image, whatever the size of the catalog."""
    by_magic: dict[bytes, list[tuple[int, int]]] = {}
    for k, s in enumerate(specs):
        by_magic.setdefault(s.magic, []).append((k, s.magic_offset))
    out = ahocorasick.Automaton()
    for magic, own in by_magic.items():
        out.add_word(magic.decode("latin-1"), (len(magic), own))
    out.make_automaton()
    return out


def sized(data: bytes, starts: list[int], at: int, spec: Spec) -> tuple[int, bool, bool] | None:
    """(size, guessed, clamped), or None when the candidate is no such object."""
    cap = min(spec.max_size, len(data) - at)
    if cap < spec.min_size:
        return None
    if spec.confirm:
        window = data[at : at + min(spec.confirm_window, cap)]
        if (window[spec.confirm_offset : spec.confirm_offset + len(spec.confirm)] != spec.confirm) if spec.confirm_offset >= 0 else spec.confirm not in window:
            return None
    if spec.min_entropy and entropy(data[at : at + min(cap, SAMPLE)]) < spec.min_entropy:
        return None
    size, guessed = 0, False
    if spec.validator:
        size = validate.REGISTRY[spec.validator](memoryview(data)[at : at + cap])
        if size < 0:
            return None
    if not size and spec.footer:
        end = data.find(spec.footer, at + len(spec.magic), at + cap)
        size = end + len(spec.footer) + spec.footer_extra - at if end >= 0 else 0
    if not size:
        nxt = bisect_right(starts, at)
        size = min(cap, starts[nxt] - at if nxt < len(starts) else cap)
        size = len(data[at : at + size].rstrip(b"\0"))
        guessed = True
        if size < spec.min_size:
            return None
    if spec.text and text_share(data[at : at + min(size, SAMPLE)]) < 0.85:
        return None
    return min(size, cap), guessed, size > cap


def boundaries(judged: list[tuple[int, int, tuple[int, bool, bool] | None]], specs: tuple[Spec, ...], end_of_image: int) -> list[int]:
    """Offsets where a next object may begin, for sizes that end there.

    A candidate within the stretch that validated ones cover begins nothing, unless it
    reaches at least as far with a higher priority. Validated candidates extend the cover
    whether or not they begin something; at an offset that is a bound already, the rest
    of the candidates say nothing.
    """
    bounds: list[int] = []
    cover, cover_priority = -1, 0
    for at, k, s in judged:
        if s is None or s[0] <= 0 or at + s[0] >= end_of_image or bounds and bounds[-1] == at:
            continue
        end, priority = at + s[0], specs[k].priority
        if at >= cover or end >= cover and priority > cover_priority:
            bounds.append(at)
        if specs[k].validator:
            if end > cover:
                cover, cover_priority = end, priority
            elif end == cover:
                cover_priority = max(cover_priority, priority)
    return bounds


def accepted(data: bytes, specs: tuple[Spec, ...], max_files: int = 20_000) -> Iterator[tuple]:
    """Rows of accepted objects, in order: a validated object masks what starts within it, equal content counts once."""
    found = candidates(data, specs)
    starts = sorted({c[0] for c in found})
    judged = [(at, k, sized(data, starts, at, specs[k])) for at, k in found]
    bounds = boundaries(judged, specs, len(data))
    start = end = -1
    masks, seen, n = False, set(), 0
    for at, k, s in judged:
        if n >= max_files:
            break
        if s is None or masks and start <= at < end:
            continue
        spec, (size, guessed, clamped) = specs[k], s
        if clamped and at + size >= len(data):
            continue
        if spec.bound_to_next and (nxt := bisect_right(bounds, at)) < len(bounds):
            size = min(size, bounds[nxt] - at)
            if size < spec.min_size:
                continue
        body = data[at : at + size]
        key = hashlib.md5(body).hexdigest(), size
        start, end = at, at + size
        if key in seen:
            masks = True
            continue
        seen.add(key)
        n += 1
        masks = not guessed and not clamped
        yield spec.name, spec.ext, spec.category, at, size, key[0], hashlib.sha1(body).hexdigest(), entropy(body[:SAMPLE]), 0.5 if guessed else 0.6 if clamped else 1.0, not guessed, clamped


def text_runs(data: bytes, claimed: list[tuple[int, int]]) -> Iterator[tuple]:
    """Runs of printable bytes that start outside what was accepted."""
    starts = [a for a, _ in claimed]
    for m in TEXT.finditer(data):
        k = bisect_right(starts, m.start()) - 1
        if k < 0 or claimed[k][1] <= m.start():
            yield "TEXT_RUN", "txt", "text", m.start(), len(m[0]), hashlib.md5(m[0]).hexdigest(), "", entropy(m[0][:SAMPLE]), 0.3, False, False


def carve(images: DataFrame, specs: tuple[Spec, ...] = SPECS, loose_text: bool = False, max_files: int = 20_000, id_col: str = "image_id", data_col: str = "data") -> DataFrame:
    """Objects found in every image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.float64()] * 2 + [pa.bool_()] * 2
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            for image, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(accepted(data or b"", specs, max_files))
                if loose_text:
                    rows += list(text_runs(data or b"", sorted((r[3], r[3] + r[4]) for r in rows)))
                if rows:
                    cols = zip(*[(image, *r) for r in rows], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return images.select(F.col(id_col).cast("string").alias("image_id"), F.col(data_col).alias("data")).mapInArrow(run, COLUMNS)


def named(carved: DataFrame) -> DataFrame:
    """Output path of each object: category/ext/FORMAT_number.ext, numbered by format in order of offset."""
    k = F.row_number().over(Window.partitionBy("image_id", "format").orderBy("offset"))
    return carved.withColumn("path", F.concat_ws("/", "category", "ext", F.format_string("%s_%05d.%s", "format", k, "ext")))


def summary(carved: DataFrame) -> DataFrame:
    return carved.groupBy("category", "format").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
