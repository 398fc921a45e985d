"""Personal data by a semi-Markov conditional random field.

Segments of up to ``MOST`` tokens are scored as wholes: how many digits, which
separators, whether the checksum holds, what word stands before. A dynamic
programme over each run of tokens chooses boundaries and kinds together; words
without a digit or @ cannot start, end or be part of an entity, so runs between
them are solved on their own, which is exact. Weights maximise the likelihood of
sentences generated here, with entities and look-alikes.

Spans of the base patterns always stay; the field adds what they miss, such as
phone numbers without a country code.

Defined results: null texts count as empty; texts without data get zero counts,
the hash of the empty string and an empty span list; repeated rows get equal rows;
an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

KINDS = ("email", "ip", "card", "phone")
MOST = 5
#: Characters of the longest candidate; longer addresses are left to the base patterns.
LONGEST = 320
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
# The same without a second look at any character: a match cannot start within a run of digits, nor a domain hold an @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP_RUN = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
OPEN, CLOSE = "<\"'[{:;=", ".,;:!?)\"']}>"


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return sum(own[::2] + [d * 2 - 9 * (d > 4) for d in own[1::2]]) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind, then start."""
    out = []
    at, upto = text.find("@"), 0
    while at >= 0:
        a = at
        while a > upto and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", a, m.end()))
            upto = m.end()
        else:
            upto = at + 1  # no address reaches over an @
        at = text.find("@", at + 1)
    out += [("ip", *m.span()) for m in IP_RUN.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that have a digit or @, as (start, end)."""
    run: list[tuple[int, int]] = []
    at = 0
    while m := MARK.search(text, at):
        a = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        b = m.end()
        while b < len(text) and not text[b].isspace():
            b += 1
        if run and (a - run[-1][1] > 1 or "\n" in text[run[-1][1] : a]):
            yield run
            run = []
        run.append((a, b))
        at = b
    if run:
        yield run


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A segment without the punctuation around it."""
    while a < b and text[a] in OPEN:
        a += 1
    opened, closed = text.count("(", a, b), text.count(")", a, b)
    while b > a and text[b - 1] in CLOSE:
        if text[b - 1] == ")":
            if opened >= closed:  # it ends a pair
                break
            closed -= 1
        b -= 1
    return a, b


CUES = re.compile(r"(?:\b(phone|tel|call|fax|mobile|cell|dial)|\b(card|visa|credit|mastercard)|\b(ip|host|server|addr\w*)|\b(e-?mail|mail|contact))\W*$", re.I)
NATIONAL = re.compile(r"(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}")
MAIL = re.compile(r"[\w.%+-]+@(?:[\w-]+\.)+[a-z]{2,}", re.I)
QUAD = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}")
GROUPS = re.compile(r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{13,19}")


def span_features(text: str, a: int, b: int, tokens: int) -> list[float]:
    """Features of a whole segment, boundaries trimmed."""
    s = text[a:b]
    d = digits_of(s)
    n = max(1, len(s))
    cue = CUES.search(text[max(0, a - 24) : a])
    return [
        1.0,
        tokens == 1,
        tokens == 2,
        tokens >= 3,
        "@" in s,
        MAIL.fullmatch(s) is not None,
        QUAD.fullmatch(s) is not None and all(int(p) <= 255 for p in s.split(".")),
        s.count(".") == 3,
        7 <= len(d) <= 9,
        len(d) == 10,
        11 <= len(d) <= 12,
        13 <= len(d) <= 19,
        len(d) < 7,
        len(d) > 19,
        13 <= len(d) <= 19 and luhn(d),
        GROUPS.fullmatch(s) is not None,
        NATIONAL.fullmatch(s) is not None,
        s.startswith("+"),
        s.startswith(("(", "+")) and ")" in s,
        "-" in s or " " in s,
        any(c.isalpha() for c in s),
        "@" not in s and any(c.isalpha() for c in s),
        len(d) / n > 0.7,
        any(c in "$%€£/:#*_=" for c in s),
        s[-1:].isdigit(),
        cue is not None and cue[1] is not None,
        cue is not None and cue[2] is not None,
        cue is not None and cue[3] is not None,
        cue is not None and cue[4] is not None,
    ]


def lattice(text: str, run: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, list[float]]]:
    """Candidate segments of a run: first token, token after the last, start, end, features. None is longer than ``LONGEST``."""
    for i in range(len(run)):
        for j in range(i + 1, min(len(run), i + MOST) + 1):
            if run[j - 1][1] - run[i][0] > 2 * LONGEST:
                break
            a, b = trimmed(text, run[i][0], run[j - 1][1])
            if 6 <= b - a <= LONGEST:
                yield i, j, a, b, span_features(text, a, b, j - i)


def scored(text: str, run: list[tuple[int, int]], w: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """Candidate segments without their features, and the scores of each; features are kept for a block at a time."""
    segments, scores, rows = [], [np.empty((0, w.shape[1]))], lattice(text, run)
    while block := list(itertools.islice(rows, 2_000)):
        segments += [s[:4] for s in block]
        scores.append(np.array([s[4] for s in block], float) @ w)
    return segments, np.concatenate(scores)


def best_path(n: int, segments: list, scores: np.ndarray) -> list[tuple[int, int]]:
    """(segment, kind) of the best segmentation; a token outside scores 0."""
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    by_end: dict[int, list[int]] = {}
    for k, s in enumerate(segments):
        by_end.setdefault(s[1], []).append(k)
    top, kind = scores.max(1, initial=-1e9), scores.argmax(1) if len(scores) else []
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in by_end.get(j, ()):
            if (v := best[segments[k][0]] + top[k]) > best[j]:
                best[j], back[j] = v, k
    out, j = [], n
    while j:
        k = back[j]
        if k is None:
            j -= 1
        else:
            out.append((k, int(kind[k])))
            j = segments[k][0]
    return out[::-1]


def marginals(n: int, segments: list, scores: np.ndarray) -> np.ndarray:
    """Probability of each (segment, kind) under the field."""
    f, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    f[0] = b[n] = 0.0
    whole = np.logaddexp.reduce(scores, 1)
    for j in range(1, n + 1):
        f[j] = np.logaddexp.reduce([f[j - 1], *(f[s[0]] + whole[k] for k, s in enumerate(segments) if s[1] == j)])
    for i in range(n - 1, -1, -1):
        b[i] = np.logaddexp.reduce([b[i + 1], *(b[s[1]] + whole[k] for k, s in enumerate(segments) if s[0] == i)])
    return np.exp(np.array([f[s[0]] + b[s[1]] for s in segments])[:, None] + scores - f[n])


def sentence(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A made-up sentence with entities and look-alikes, and its true spans."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        while not luhn(s := rng.choice("3456") + d(rng.choice((12, 13, 14, 15, 15, 15, 18)))):
            pass
        sep = rng.choice(("", "", " ", "-"))
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4)) if sep and len(s) == 16 else s

    makers = {
        "email": lambda: f"{word()}{rng.choice(('.', '_', '', '+'))}{d(2)}@{word()}{rng.choice(('', d(1)))}.{rng.choice(('com', 'org', 'example.com', 'co.uk', 'net'))}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice((f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{rng.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"+{d(11)}")),
    }
    likes = (
        lambda: d(rng.randint(1, 6)),
        lambda: f"{d(1)}.{d(1)}.{d(2)}",
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: f"${d(3)},{d(3)}.{d(2)}",
        lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"{rng.randint(300, 999)}.{d(3)}.{d(3)}.{d(2)}",
        lambda: next(s for s in iter(lambda: d(16), None) if not luhn(s)),
        lambda: d(rng.randint(7, 12)),
        lambda: d(rng.randint(20, 30)),
        lambda: f"{word()}{d(2)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((8, 16, 32, 40, 64)))),
        lambda: rng.choice(("token", "key", "id", "sha")) + rng.choice(("=", ' = "', ": ", "#")) + "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((10, 32, 40)))) + rng.choice(("", '"', '"###')),
        lambda: "AK" + "".join(rng.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(18)),
        lambda: f"@{word()}{d(2)}",
        lambda: f"{d(3)}-{d(2)}-{d(5)}-{d(3)}",
        lambda: f"{d(8)}-{d(4)}-{d(4)}",
        lambda: f"{d(4)} {d(4)}",
        lambda: f"{d(3)} {d(3)} {d(3)} {d(3)}",
    )
    cues = {"email": ("mail", "contact:"), "ip": ("host", "server"), "card": ("card", "visa"), "phone": ("call", "phone:", "tel")}
    text, spans = "", []
    for _ in range(rng.randint(2, 6)):
        text += " ".join(word() for _ in range(rng.randint(0, 4))) + " "
        if rng.random() < 0.6:
            kind = rng.choice(KINDS)
            if rng.random() < 0.3:
                text += rng.choice(cues[kind]) + " "
            s = makers[kind]()
            spans.append((kind, len(text), len(text) + len(s)))
            text += s + rng.choice(("", "", ".", ","))
        else:
            text += rng.choice(likes)()
        text += " "
    return text, spans


@lru_cache(1)
def weights(sentences: int = 1500, epochs: int = 6) -> np.ndarray:
    """Features x kinds, by stochastic ascent on the likelihood; the seed is fixed."""
    rng = random.Random(5)
    data = []
    for _ in range(sentences):
        text, spans = sentence(rng)
        true = {(a, b): KINDS.index(k) for k, a, b in spans}
        for run in runs(text):
            if segments := list(lattice(text, run)):
                gold = np.zeros((len(segments), len(KINDS)))
                for k, s in enumerate(segments):
                    if (kind := true.get((s[2], s[3]))) is not None:
                        gold[k, kind] = 1
                data.append((len(run), segments, np.array([s[4] for s in segments], float), gold))
    w = np.zeros((len(data[0][2][0]), len(KINDS)))
    seen = np.full_like(w, 1e-2)
    for epoch in range(epochs):
        rng.shuffle(data)
        for n, segments, x, gold in data:
            g = x.T @ (gold - marginals(n, segments, x @ w)) - 1e-4 * w
            seen += g * g
            w += 0.4 * g / np.sqrt(seen)
    return w


def added_spans(text: str, base: list[tuple[str, int, int]], w: np.ndarray) -> list[tuple[str, int, int]]:
    """What the field finds apart from the base spans."""
    out, taken = [], []
    for _, a, b in sorted(base, key=lambda s: s[1]):  # stretches that base spans cover
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    ends = [(b,) for _, b in taken]
    for run in runs(text):
        if run[-1][1] - run[0][0] < 6:
            continue
        segments, scores = scored(text, run, w)
        for k, kind in best_path(len(run), segments, scores) if segments else ():
            a, b = segments[k][2:4]
            at = bisect.bisect_left(ends, (a + 1,))  # the first taken stretch that ends after a
            if at == len(ends) or taken[at][0] >= b:
                out.append((KINDS[kind], a, b))
    return out


def find(text: str, w: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, by kind as listed, then start."""
    base = base_spans(text)
    more = added_spans(text, base, w) if MARK.search(text) else []
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and spans (arrays of kind, start, end) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in C.slabs(batches):
            found = [find(t, sent.value) for t in slab.column(1).to_pylist()]
            lists = [[[{"kind": k, "start": a, "end": b} for k, a, b in f[side]] for f in found] for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([slab.column(0), slab.column(1), *[pa.array(x, kind) for x in lists]], names=["doc_id", "text", "base", "spans"])

    each = "array<struct<kind: string, start: long, end: long>>"
    return C.id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, text string, base {each}, spans {each}")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with every found span replaced by [KIND]; other columns stay, null texts too."""
    sent = docs.sparkSession.sparkContext.broadcast(weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in C.slabs(batches, text_col):
            at = slab.schema.get_field_index(text_col)
            out = []
            for text in slab.column(at).to_pylist():
                if text is not None:
                    kept, upto = [], 0
                    for kind, a, b in sorted(find(text, sent.value)[1], key=lambda s: (s[1], -s[2])):
                        if b <= upto:
                            continue
                        if a >= upto:
                            kept += [text[upto:a], f"[{kind.upper()}]"]
                        upto = b
                    text = "".join([*kept, text[upto:]]) if kept else text
                out.append(text)
            yield pa.RecordBatch.from_arrays([*slab.columns[:at], pa.array(out, pa.string()), *slab.columns[at + 1 :]], names=slab.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans_of(C.table(spark, sf_dir, "documents"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    counts = [of(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
