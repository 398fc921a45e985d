"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is a set of words at fixed places. Exact containment needs every word,
so the necessary prefix of a window, with words ordered by rarity in the corpus,
is its rarest word alone. Only that word is joined to the words of documents.
A hit's place in the document must leave room for the words before and after it
(length and position bounds), then the whole window is compared.

The windows are broadcast in blocks of bounded size; each block meets all
documents, so more windows mean more passes, not more memory.

Defined results: null and empty texts have no words; an item of fewer words than
a window is one window, one without words none; equal windows of several items
count for each; repeated rows get equal rows, and a repeated item id counts once; words in
windows of an item without id are hit, but no item is counted for them;
an empty documents table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that are not part of words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for the document itself; no word has it.
WHOLE = "\x01"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words in order."""
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(plain, NOT_WORD, -1), "")


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: their words, and the ids (as strings) of the items that have them."""
    w = F.col("w")
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))))
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    rows = rows.select("item", "w", F.explode(starts).alias("at"))
    return rows.select("item", F.slice(w, F.col("at") + 1, size).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))


def corpus_counts(docs: DataFrame, tokens: DataFrame, text_col: str) -> DataFrame:
    """How often each of the tokens (column token) occurs in all documents."""
    rows = docs.select(F.explode(words(F.coalesce(F.col(text_col), F.lit("")))).alias("token"))
    return rows.join(F.broadcast(tokens), "token").groupBy("token").agg(F.count("*").alias("n"))


def blocks_of(rows: DataFrame, key: Column, n: int, most: int) -> list[DataFrame]:
    """Disjoint parts of about ``most`` rows at most."""
    parts = -(-n // most)
    return [rows] if parts <= 1 else [rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p) for p in range(parts)]


def hits(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = C.BROADCAST_ROWS) -> DataFrame:
    """doc_id, mark (a hash of the text), n_words and hit: one row a document with a null hit, and one for each window in it."""
    windows = C.written(item_windows(items, size, item_col, item_text_col), "windows")
    n = windows.count()
    tokens = windows.select(F.explode("window").alias("token")).distinct()
    counted = [corpus_counts(docs, part, text_col) for part in blocks_of(tokens, F.col("token"), size * n, 10 * most)]
    rarity = counted[0]
    for part in counted[1:]:
        rarity = rarity.unionByName(part)
    # the prefix: of each window the rarest word; words that no document has rule the window out
    placed = windows.select("window", "items", F.posexplode("window").alias("before", "token")).join(C.written(rarity, "rarity"), "token", "left")
    placed = placed.groupBy("window").agg(F.first("items").alias("items"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "before")).alias("rarest"))
    prefix = C.written(placed.where("rarest.n > 0").select("window", "items", "rarest.token", "rarest.before"), "prefix")
    whole = prefix.sparkSession.range(1).select(F.lit(WHOLE).alias("token"), F.lit(0).alias("before"), F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), F.concat(words(text), F.array(F.lit(WHOLE))).alias("w"))
    rows = base.select("doc_id", "mark", "w", F.posexplode_outer("w").alias("pos", "token"))
    at, width = F.col("pos") - F.col("before"), F.size("window")
    found = None
    for k, part in enumerate(blocks_of(prefix, F.col("window"), n, most)):
        part = part.unionByName(whole) if k == 0 else part
        met = rows.join(F.broadcast(part), "token")
        # size of w is one more than the words
        met = met.where((F.col("token") == WHOLE) | (at >= 0) & (at + width < F.size("w")) & (F.slice("w", F.greatest(at + 1, F.lit(1)), width) == F.col("window")))
        met = met.select("doc_id", "mark", (F.size("w") - 1).alias("n_words"), F.when(F.col("token") != WHOLE, F.struct(at.alias("at"), width.alias("size"), "items")).alias("hit"))
        found = met if found is None else found.unionByName(met)
    return found


def by_document(found: DataFrame) -> DataFrame:
    """For every row doc_id, n_words and hits: array of (at, size, items) of windows in it."""
    rows = found.groupBy("doc_id", "mark", "n_words").agg(F.collect_list("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("times"))
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc_id", "n_words", "hits")


def digests(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row."""
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    rows = by_document(hits(docs, items, size)).select("doc_id", F.col("n_words").cast("long"), F.size(covered).cast("long").alias("n_hit"), ids.alias("ids"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without any window of the items, with all their columns."""
    own = uuid.uuid4().hex  # names that no column of the documents has
    met = hits(docs, items, size, id_col, text_col).where("hit is not null").select(F.col("doc_id").alias(f"id_{own}"), F.col("mark").alias(f"mark_{own}")).distinct()
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(C.written(met, "hits"), F.col(id_col).eqNullSafe(F.col(f"id_{own}")) & (mark == F.col(f"mark_{own}")), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


ORACLE = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM benchmark),
i AS (SELECT DISTINCT item_id, w[p0:p0 + 9] k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) p0 FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(k) n FROM i),
g AS (SELECT doc_id, n, p0, w[p0:p0 + n - 1] k FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) p0 FROM w, n WHERE len(w) >= n)),
h AS (SELECT doc_id, n, p0, item_id FROM g JOIN i USING (k)),
c AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + n)) p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR s FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
