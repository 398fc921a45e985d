"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Terms are words, weighted by how often they occur. For each term and sample,
r and c are Gamma(2, 1) and beta is uniform, all from hashes of term and sample;
    t = floor(ln w / r + beta),  ln y = r (t - beta),  ln a = ln c - ln y - r
and the term of least a, with its t, is the sample. Two texts share a sample with
a probability equal to their generalised Jaccard similarity.

Each candidate is one long: a in its upper half, the identity of (term, t) in the
lower one, so that samples are plain minima, aggregated where the text is.

Defined results: null texts count as empty; texts without words have a
fingerprint of zeros; equal texts have equal fingerprints; of rows with equal ids
the one with the greater text comes first; null ids come last; a single row
follows itself; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

#: Samples of a fingerprint, computed in blocks of ``BLOCK`` (wider aggregates are not compiled).
SAMPLES, BLOCK = 32, 32
SPACE = r"[\x20\x09-\x0D]+"


def terms(text: Column, version: int) -> Column:
    """Hashes of the words; their last bit says of which version of the text they are."""
    mark = (lambda h: h.bitwiseOR(F.lit(1))) if version else (lambda h: h.bitwiseAND(F.lit(~1)))
    return F.transform(F.array_remove(F.split(text, SPACE, -1), ""), lambda w: mark(F.xxhash64(w)))


def runs(ordered: Column) -> Column:
    """Of a sorted array, each distinct value with the place of its end."""
    ends = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == F.size(ordered)) | (F.get(ordered, i) != F.get(ordered, i - 1)))
    ends = F.when(F.size(ordered) > 0, ends).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda e: F.struct(F.get(ordered, e - 1).alias("term"), e.alias("end")))


def weighted(run: Column) -> Column:
    """Of the runs of both versions' terms, each term with the logarithms of its weights; null where a version lacks it."""

    def one(e: Column, k: Column) -> Column:
        before, after = F.when(k > 0, F.get(run, k - 1)), F.get(run, k + 1)
        n = e["end"] - F.coalesce(before["end"], F.lit(0))
        twin = F.when(after["term"] == e["term"].bitwiseOR(F.lit(1)), after["end"] - e["end"])
        term = e["term"].bitwiseAND(F.lit(~1))
        second = e["term"] != term
        both = F.struct(term.alias("term"), F.when(~second, F.ln(n)).alias("w0"), F.when(second, F.ln(n)).otherwise(F.ln(twin)).alias("w1"))
        return F.when(~second | before.isNull() | (before["term"] != term), both)

    return F.filter(F.transform(run, one), lambda x: x.isNotNull())


def unit(bits: Column, width: int) -> Column:
    """The low ``width`` bits as a number strictly between 0 and 1."""
    return (bits.bitwiseAND(F.lit((1 << width) - 1)) + 0.5) * (0.5**width)


def candidate(term: Column, log_weight: Column, k: int) -> Column:
    """The packed long of a term for sample k."""
    h1 = F.xxhash64(term.bitwiseXOR(F.lit((0x5851F42D4C957F2D * (k + 1)) % (1 << 62))))
    h2 = F.xxhash64(h1)
    r = -F.ln(unit(h1, 32) * unit(F.shiftrightunsigned(h1, 32), 32))
    log_c = F.ln(-F.ln(unit(h2, 22) * unit(F.shiftrightunsigned(h2, 22), 21)))
    beta = unit(F.shiftrightunsigned(h2, 43), 21)
    t = F.floor(log_weight / r + beta)
    log_a = log_c - r * (t - beta) - r
    rank = F.least(F.greatest((log_a + 64) * 16777216.0, F.lit(0.0)), F.lit(2147483647.0)).cast("long")
    identity = h1.bitwiseXOR(F.shiftleft(t, 16)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(rank, 32).bitwiseOR(identity)


def signature(mins: list[str]) -> Column:
    """The samples' identities, 8 hex digits each."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")) for c in mins])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    same = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.when(F.substr(a, i * 8 + 1, F.lit(8)) == F.substr(b, i * 8 + 1, F.lit(8)), 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda x, y: x + y) / float(SAMPLES)


def chained(docs: DataFrame, parts: int) -> DataFrame:
    """Rows with the text of the next document by descending id, dealt by ranges of ids.

    The first row of a range is sent to the range before it as well, as a helper
    that ends it; no row is read by a single task.
    """
    spark = docs.sparkSession
    splits = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    splits = F.array(*[F.lit(int(s)) for s in sorted(set(splits or []))]).cast("array<bigint>")
    own = F.coalesce(F.size(F.filter(splits, lambda s: s < F.col("doc_id"))), F.lit(0))
    dealt = docs.select("doc_id", "text", own.alias("own"))
    tops = {r["own"]: r["top"] for r in docs.select("doc_id", own.alias("own")).groupBy("own").agg(F.max("doc_id").alias("top")).collect()}  # a row for each range
    order = sorted(tops, reverse=True)
    sends = [(tops[b], a, b) for a, b in zip(order, order[1:] + order[:1], strict=True)]  # the top row of b also ends a
    target = F.array().cast("array<int>")
    if sends:
        table = spark.createDataFrame([(b, top, a) for top, a, b in sends], "b int, top long, a int")
        dealt = dealt.join(F.broadcast(table), (dealt["own"] == table["b"]) & dealt["doc_id"].eqNullSafe(table["top"]), "left")
        target = F.when(F.col("a").isNotNull(), F.array("a")).otherwise(target)
    spots = F.concat(F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("helper"))), F.transform(target, lambda a: F.struct(a.alias("part"), F.lit(True).alias("helper"))))
    dealt = dealt.select("doc_id", "text", F.explode(spots).alias("x")).select("doc_id", "text", "x.part", "x.helper")
    line = Window.partitionBy("part").orderBy("helper", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return dealt.withColumns({"rn": F.row_number().over(line), "next": F.lead("text").over(line)})


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    docs = C.id_text(docs, id_col, text_col)
    rows = chained(docs, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.when(~F.col("helper"), F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("next", F.lit("")), F.lit(1), half))))
    keys = ["part", "rn", "helper", "doc_id", "n_chars", "sha", "blank0", "blank1"]
    first, second = terms(F.col("text"), 0), F.coalesce(terms(F.col("edited"), 1), F.array().cast("array<bigint>"))
    rows = rows.select("part", "rn", "helper", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), first.alias("a"), second.alias("b"))
    rows = rows.withColumns({"blank0": F.size("a") == 0, "blank1": F.size("b") == 0}).select(*keys, F.sort_array(F.concat("a", "b")).alias("s"))
    rows = rows.select(*keys, runs(F.col("s")).alias("x"))  # a column of its own: lambdas would sort again for each element
    rows = rows.select(*keys, F.explode_outer(weighted(F.col("x"))).alias("e")).select(*keys, "e.*")
    # both versions share the hashes and logarithms of a term; each block of samples has its own hash of it
    blocks = SAMPLES // BLOCK
    rows = rows.select(*keys, "w0", "w1", "term", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    rows = rows.select(*keys, "w0", "w1", "block", F.xxhash64("term", "block").alias("term"))
    mins = [[f"m{v}_{k}" for k in range(BLOCK)] for v in (0, 1)]
    rows = rows.groupBy(*keys, "block").agg(*[F.min(candidate(F.col("term"), F.col(f"w{v}"), k)).alias(m) for v in (0, 1) for k, m in enumerate(mins[v])])
    zeros = F.lit("0" * 8 * BLOCK)
    rows = rows.select(*keys, "block", *[F.when(F.col(f"blank{v}"), zeros).otherwise(signature(mins[v])).alias(f"fp{v}") for v in (0, 1)])
    rows = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("block") == k, F.col(f"fp{v}"))).alias(f"fp{v}_{k}") for v in (0, 1) for k in range(blocks)])
    rows = rows.select(*keys, *[F.concat(*[F.col(f"fp{v}_{k}") for k in range(blocks)]).alias(name) for v, name in ((0, "fingerprint"), (1, "edited_fingerprint"))])
    rows = rows.withColumn("next_fp", F.lead("fingerprint").over(Window.partitionBy("part").orderBy("rn"))).where(~F.col("helper"))
    return rows.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"))


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))
