"""Queries over the driver's tables, one for each relational operator, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import catalog, graph, intervals, raid, results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Text patterns that stand in for signatures: name, category, magic, priority.
PATTERNS = (("THE", "code", " the ", 0), ("QUE", "document", " que ", 5), ("UND", "document", " und ", 5), ("LIST", "data", " | ", 10), ("THEA", "code", " the a", 20), ("MAIL", "email", "@mail", 15))
VALUES = ", ".join(f"('{n}', '{c}', '{m}', {p})" for n, c, m, p in PATTERNS)


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def patterns(df: DataFrame) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(PATTERNS, "format string, category string, magic string, priority int"))


def hits(t: Callable) -> DataFrame:
    """All places (from 0, overlaps too) of each pattern: running lengths of the pieces between matches of it as a lookahead."""
    docs = t("documents").select("doc_id", "text")
    found = docs.join(patterns(docs), F.contains("text", F.col("magic")))
    sizes = F.transform(F.split("text", F.concat(F.lit(r"(?=\Q"), F.col("magic"), F.lit(r"\E)")), -1), lambda p: F.char_length(p))
    sizes = F.concat(F.when(F.startswith("text", "magic"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), sizes)
    rows = found.select("doc_id", "format", "category", "priority", sizes.alias("sizes"))
    rows = rows.select("doc_id", "format", "category", "priority", F.size("sizes").alias("of"), F.posexplode("sizes").alias("nth", "size"))
    line = Window.partitionBy("doc_id", "format").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("pos", F.sum("size").over(line).cast("int")).where("nth < of - 1").select("doc_id", "format", "category", "priority", "pos")


HITS = f"""p(format, category, magic, priority) AS (VALUES {VALUES}),
h AS (SELECT doc_id, format, category, priority, i::INT AS pos FROM (SELECT doc_id, text, format, category, priority, magic, unnest(range(0, length(text))) i FROM documents JOIN p ON contains(text, magic)) WHERE substr(text, i::INT + 1, length(magic)) = magic)"""


@query("q_sig_counts", f"WITH p(format, category, magic, priority) AS (VALUES {VALUES}) SELECT category, format, count(*) AS n FROM documents JOIN p ON contains(text, magic) GROUP BY ALL")
def _(t):
    docs = t("documents").select("text")
    return docs.join(patterns(docs), F.contains("text", F.col("magic"))).groupBy("category", "format").agg(F.count("*").alias("n"))


@query("q_sig_positions", f"WITH {HITS} SELECT doc_id, format, count(*) n, min(pos) first_pos, max(pos) last_pos FROM h GROUP BY ALL")
def _(t):
    return hits(t).groupBy("doc_id", "format").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("q_sig_priority", f"WITH {HITS} SELECT doc_id, pos, arg_max(format, priority) AS format, max(priority) AS priority FROM h GROUP BY doc_id, pos")
def _(t):
    return hits(t).groupBy("doc_id", "pos").agg(F.max_by("format", "priority").alias("format"), F.max("priority").alias("priority"))


@query("q_next_boundary", f"""WITH {HITS}, s AS (SELECT DISTINCT doc_id, pos FROM h), w AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM s)
SELECT doc_id, pos, next, least(coalesce(next - pos, 256), 256) AS size FROM w""")
def _(t):
    return results.next_start(hits(t), "doc_id", "pos", 256)


@query("q_footer_size", "SELECT page_id, (strpos(html, '<article>') - 1)::INT AS start, CASE WHEN strpos(html, '</article>') > strpos(html, '<article>') THEN (strpos(html, '</article>') + 10 - strpos(html, '<article>'))::INT END AS size FROM pages WHERE contains(html, '<article>')")
def _(t):
    a, b = F.instr("html", "<article>"), F.instr("html", "</article>")
    return t("pages").where(F.contains("html", F.lit("<article>"))).select("page_id", (a - 1).alias("start"), F.when(b > a, b + 10 - a).alias("size"))


@query("q_dedup_hash", "SELECT md5(text) AS md5, strlen(text)::INT AS size, min(doc_id) AS first, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def _(t):
    return results.first_per_content(t("documents").where("text is not null"), F.col("text"), "doc_id")


@query("q_entropy", """WITH c AS (SELECT doc_id, ch, count(*) n FROM (SELECT doc_id, unnest(string_split(text, '')) ch FROM documents) GROUP BY ALL), s AS (SELECT doc_id, sum(n) t FROM c GROUP BY 1)
SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM c JOIN s USING (doc_id) GROUP BY 1""")
def _(t):
    # partial counts by (document, character); the entropy from sums of n and n log n alone
    ch = t("documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("doc_id", "ch").agg(F.count("*").alias("n"))
    return ch.groupBy("doc_id").agg(F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6).alias("entropy"))


@query("q_text_ratio", r"SELECT doc_id, round(1 - length(regexp_replace(text, '[\x20-\x7E\t\n\r]|[^\x00-\x7F]', '', 'g')) / length(text), 6) AS ratio FROM documents WHERE length(text) > 0")
def _(t):
    return t("documents").where("char_length(text) > 0").select("doc_id", F.round(1 - F.char_length(F.regexp_replace("text", r"[\x20-\x7E\t\n\r]|[^\x00-\x7F]", "")) / F.char_length("text"), 6).alias("ratio"))


@query("q_text_runs", r"SELECT page_id, i AS nth, length(x)::INT AS size, md5(x) AS md5 FROM (SELECT page_id, unnest(r) x, generate_subscripts(r, 1)::INT i FROM (SELECT page_id, regexp_extract_all(html, '[ -;=?-~]{64,}') r FROM pages) WHERE len(r) > 0)")
def _(t):
    runs = F.regexp_extract_all(F.col("html"), F.lit("[ -;=?-~]{64,}"), F.lit(0))
    return t("pages").select("page_id", F.posexplode(runs).alias("i", "x")).select("page_id", (F.col("i") + 1).alias("nth"), F.char_length("x").alias("size"), F.md5(F.col("x").cast("binary")).alias("md5"))


def page_rows(t: Callable) -> DataFrame:
    """Pages as rows of the unified result table."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1)
    return t("pages").select(F.col("page_id").alias("index"), scalar.base_name(path).alias("name"), path.alias("path"), F.char_length("html").alias("size"), (F.col("page_id") % 7 == 0).alias("deleted"), F.lit("page").alias("method"))


PAGE_ROWS = r"r AS (SELECT page_id AS index, regexp_extract(path, '([^/]*)$', 1) AS name, path, size, page_id % 7 = 0 AS deleted, 'page' AS method, CASE WHEN regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^.+\.[^.]+$') THEN lower(regexp_extract(path, '\.([^.]+)$', 1)) ELSE '' END AS ext FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path, length(html)::INT AS size FROM pages))"


@query("q_results_page", f"WITH {PAGE_ROWS} SELECT index, name, path, size, deleted, method FROM r WHERE NOT deleted AND contains(lower(coalesce(nullif(path, ''), name)), 'en') ORDER BY size DESC, index LIMIT 50 OFFSET 10")
def _(t):
    return results.page(page_rows(t), q="EN", only="live", sort="size", offset=10, limit=50)


@query("q_ext_histogram", f"WITH {PAGE_ROWS} SELECT CASE WHEN ext = '' THEN '(none)' ELSE ext END AS ext, count(*) AS n FROM r GROUP BY 1")
def _(t):
    return results.extension_histogram(page_rows(t))


@query("q_total_matched", f"WITH {PAGE_ROWS} SELECT count(*) AS total, count_if(NOT deleted AND contains(lower(coalesce(nullif(path, ''), name)), 'de')) AS matched FROM r")
def _(t):
    return results.totals(page_rows(t), q="de", only="live")


def spans(t: Callable) -> DataFrame:
    """Events as ranges: seconds from the event on, as long as its value says."""
    return t("events").select("event_id", "user_id", "event_type", scalar.seconds("ts").alias("start"), (scalar.seconds("ts") + F.lit(60) + (F.abs(F.col("value")) * 10).cast("long")).alias("end"))


SPANS = "e AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 60 + trunc(abs(value) * 10)::BIGINT AS f FROM events)"
ISLANDS = f"""{SPANS}, m AS (SELECT *, CASE WHEN s > coalesce(max(f) OVER (PARTITION BY user_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 3600 THEN 1 ELSE 0 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS g FROM m), i AS (SELECT user_id, min(s) AS s, max(f) AS f, count(*) AS n FROM g GROUP BY user_id, g)"""


def merged(t: Callable) -> DataFrame:
    return intervals.islands(spans(t), ["user_id"], tolerance=3600)


@query("q_islands", f'WITH {ISLANDS} SELECT user_id, s AS "start", f AS "end", n FROM i')
def _(t):
    return merged(t)


@query("q_gaps", f"""WITH {ISLANDS} SELECT user_id, b AS gap_start, s AS gap_end FROM (SELECT user_id, s, lag(f) OVER (PARTITION BY user_id ORDER BY s) AS b FROM i) WHERE s - b > 86400
UNION ALL SELECT user_id, max(f), 2000000000 FROM i GROUP BY 1 HAVING 2000000000 - max(f) > 86400""")
def _(t):
    return intervals.gaps(merged(t), ["user_id"], 86_400, high=F.lit(2_000_000_000).cast("long"))


@query("q_coalesce_status", """WITH c AS (SELECT *, CASE WHEN lag(l_returnflag) OVER w IS NOT DISTINCT FROM l_returnflag THEN 0 ELSE 1 END AS c FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)),
r AS (SELECT *, sum(c) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT l_suppkey, run::BIGINT AS run, l_returnflag, min(l_orderkey) AS first, max(l_orderkey) AS last, count(*) AS n FROM r GROUP BY ALL""")
def _(t):
    return intervals.coalesce_adjacent(t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "l_returnflag")


CLICKS = "c AS (SELECT user_id, min(s) - 1000 AS s, min(s) + 500000 AS f FROM e GROUP BY 1)"


def claimed(t: Callable) -> DataFrame:
    return spans(t).groupBy("user_id").agg((F.min("start") - 1000).alias("start"), (F.min("start") + 500_000).alias("end"))


@query("q_skip_anti", f"WITH {SPANS}, {CLICKS} SELECT event_id, user_id, e.s AS at FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = e.user_id AND e.s >= c.s AND e.s < c.f)")
def _(t):
    return intervals.outside(spans(t).select("event_id", "user_id", F.col("start").alias("at")), claimed(t), ["user_id"], "at")


@query("q_asof_container", f"WITH {SPANS}, {CLICKS} SELECT e.event_id, e.user_id, e.s AS at, CASE WHEN c.f > e.s THEN c.s END AS range_start, CASE WHEN c.f > e.s THEN c.f END AS range_end FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.s >= c.s")
def _(t):
    return intervals.containing(spans(t).select("event_id", "user_id", F.col("start").alias("at")), claimed(t), ["user_id"], "at")


@query("q_band_anti", f"WITH {SPANS} SELECT event_id, s AS at FROM e WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM e o WHERE o.event_type = 'purchase' AND abs(o.s - e.s) <= 120)")
def _(t):
    rows = spans(t).select("event_id", "event_type", F.col("start").alias("at"))
    return intervals.band_anti(rows.where("event_type <> 'purchase'").drop("event_type"), rows.where("event_type = 'purchase'").select(F.col("at").alias("other")), "at", "other", 120)


@query("q_overlap_anti", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, epoch(l_shipdate)::BIGINT // 86400 AS s, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, s AS "start", f AS "end" FROM l a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM l b WHERE b.l_returnflag = 'A' AND b.l_partkey = a.l_partkey AND a.s < b.f AND b.s < a.f)""")
def _(t):
    day = F.floor(scalar.seconds("l_shipdate") / 86_400)
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", day.alias("start"), (day + F.round("l_quantity").cast("long")).alias("end"))
    return intervals.overlap_anti(rows.where("l_returnflag = 'R'").drop("l_returnflag"), rows.where("l_returnflag = 'A'"), ["l_partkey"], 64)


@query("q_latest_version", "SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1")
def _(t):
    return results.latest_version(t("events").select("user_id", "event_id", "ts", "value"), "user_id", "ts", "event_id").select("user_id", "event_id", "ts", "value")


@query("q_first_nonempty", "SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE coalesce(text, '') <> '' GROUP BY 1")
def _(t):
    return results.first_non_empty(t("conversations"), "conv_id", "turn", "text")


@query("q_concat_ordered", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS talk FROM conversations GROUP BY 1")
def _(t):
    turns = t("conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return turns.select("conv_id", F.array_join(F.transform("x", lambda r: F.concat(r["role"], F.lit(": "), r["text"])), "\n").alias("talk"))


def tree(t: Callable) -> DataFrame:
    n = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    parts = [t("region").select(n("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name")), t("nation").select(n("n", "n_nationkey"), n("r", "n_regionkey"), "n_name"), t("customer").select(n("c", "c_custkey"), n("n", "c_nationkey"), "c_name"), t("orders").select(n("o", "o_orderkey"), n("c", "o_custkey"), F.col("o_orderkey").cast("string"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("q_path_closure", """WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS up, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey::VARCHAR FROM orders),
w AS (SELECT id, name AS path FROM n WHERE up IS NULL OR up NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, w.path || '/' || n.name FROM n JOIN w ON n.up = w.id) SELECT id, path FROM w""")
def _(t):
    return graph.path_closure(tree(t), [])


@query("q_chain_heads", "SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn + 1 = c.turn)")
def _(t):
    rows = t("conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("node"), F.struct("conv_id", (F.col("turn") + 1).alias("turn")).alias("following"))
    return graph.chain_heads(rows, "node", "following").select("conv_id", "turn")


@query("q_union_sources", "SELECT 'customer:' || c_custkey AS id, c_name AS name, round(c_acctbal * 100)::BIGINT AS size, 'table_walk' AS method FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name, round(s_acctbal * 100)::BIGINT, 'carve' FROM supplier")
def _(t):
    row = lambda kind, k, n, b, how: (F.concat(F.lit(kind), F.col(k).cast("string")).alias("id"), F.col(n).alias("name"), F.round(F.col(b) * 100).cast("long").alias("size"), F.lit(how).alias("method"))
    return t("customer").select(*row("customer:", "c_custkey", "c_name", "c_acctbal", "table_walk")).unionByName(t("supplier").select(*row("supplier:", "s_suppkey", "s_name", "s_acctbal", "carve")))


@query("q_raid0_map", "SELECT o_orderkey, ((o_orderkey * 4096) // 65536) % 3 AS member, ((o_orderkey * 4096) // 65536) // 3 * 65536 + (o_orderkey * 4096) % 65536 AS member_offset FROM orders")
def _(t):
    at = raid.address(0, F.col("o_orderkey") * 4096, 65_536, 3)
    return t("orders").select("o_orderkey", at["member"].alias("member"), at["member_offset"].alias("member_offset"))


@query("q_raid5_map", "SELECT o_orderkey, s AS stripe, p AS parity, (p + 1 + k % 3) % 4 AS member, s * 65536 + (o_orderkey * 4096) % 65536 AS member_offset FROM (SELECT o_orderkey, k, k // 3 AS s, 3 - (k // 3) % 4 AS p FROM (SELECT o_orderkey, (o_orderkey * 4096) // 65536 AS k FROM orders))")
def _(t):
    at = raid.address(5, F.col("o_orderkey") * 4096, 65_536, 4)
    return t("orders").select("o_orderkey", *[at[k].alias(k) for k in ("stripe", "parity", "member", "member_offset")])


@query("q_parity_xor", "SELECT l_orderkey AS stripe, bit_xor(l_partkey) AS parity, count(*) AS members FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("stripe")).agg(F.bit_xor("l_partkey").alias("parity"), F.count("*").alias("members"))


@query("q_raid_rebuild", "SELECT l_orderkey AS stripe, 0 AS at, bit_xor(l_partkey) AS rebuilt FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1")
def _(t):
    return raid.rebuild(t("lineitem").select(F.col("l_orderkey").alias("stripe"), F.lit(0).alias("at"), F.col("l_partkey").alias("word"), "l_linenumber"), "stripe", "at", "word", F.col("l_linenumber") == 1)


@query("q_rank_margin", """WITH s AS (SELECT p_brand, p_type, sum(l_quantity) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_type DESC) AS k FROM s),
b AS (SELECT p_brand, max(p_type) FILTER (k = 1) AS best, max(score) FILTER (k = 1) AS score, max(score) FILTER (k = 2) AS runner_up FROM r WHERE k <= 2 GROUP BY 1)
SELECT *, CASE WHEN runner_up IS NULL OR runner_up * 2 <= score THEN 1.0 WHEN runner_up < score THEN 0.7 ELSE 0.35 END::DOUBLE AS confidence FROM b""")
def _(t):
    s = t("lineitem").select("l_partkey", "l_quantity").join(t("part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return results.rank_with_margin(s.groupBy("p_brand", "p_type").agg(F.sum("l_quantity").alias("score")), "p_brand", "p_type", "score")


@query("q_running_budget", "SELECT doc_id, running FROM (SELECT doc_id, sum(512 + strlen(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 200000")
def _(t):
    rows = t("documents").select("doc_id", F.octet_length("text").alias("size"))
    return intervals.running_total(rows, "doc_id", F.lit(512) + F.col("size")).where("running <= 200000").select("doc_id", "running")


@query("q_confidence", "SELECT doc_id, CASE WHEN quality = 1 AND n_chars < 20000 THEN 1.0 WHEN quality = 1 THEN 0.6 WHEN quality = 0 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    q = F.col("quality")
    ladder = F.when((q == 1) & (F.col("n_chars") < 20_000), 1.0).when(q == 1, 0.6).when(q == 0, 0.5).otherwise(0.3)
    return t("documents").select("doc_id", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", ladder.alias("confidence"))


@query("q_human_size", "SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0) ELSE printf('%.2f GB', n / 1073741824.0) END AS human FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT * (o_orderkey % 50) AS n FROM orders)")
def _(t):
    return t("orders").select("o_orderkey", scalar.human_size(F.floor("o_totalprice") * (F.col("o_orderkey") % 50)).alias("human"))


@query("q_iso_time", "SELECT event_id, CASE WHEN s > 0 THEN strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS iso FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE floor(epoch(ts))::BIGINT END AS s FROM events)")
def _(t):
    return t("events").select("event_id", scalar.iso_time(F.when(F.col("event_id") % 5 == 0, F.lit(0)).otherwise(scalar.seconds("ts"))).alias("iso"))


@query("q_filetime", "SELECT o_orderkey, greatest((o_orderkey * 9999999967) // 10000000 * 1000 // 1 - 11644473600, 0) AS seconds FROM orders")
def _(t):
    whole = F.call_function("div", F.col("o_orderkey") * 9_999_999_967, F.lit(10_000_000))
    ticks = whole.cast("decimal(20,0)") * 10_000_000_000  # beyond 64 bits from order 922,338 on
    return t("orders").select("o_orderkey", scalar.from_filetime(ticks).alias("seconds"))


@query("q_fat_time", """WITH x AS (SELECT o_orderkey, (o_orderkey * 37) % 65536 AS d, (o_orderkey * 101) % 65536 AS t FROM orders), y AS (SELECT o_orderkey, (d >> 9) + 1980 AS y, (d >> 5) & 15 AS m, d & 31 AS day, t >> 11 AS h, (t >> 5) & 63 AS mi, (t & 31) * 2 AS s FROM x)
SELECT o_orderkey, coalesce(CASE WHEN m BETWEEN 1 AND 12 AND day >= 1 AND h < 24 AND mi < 60 AND s < 60 THEN epoch(try_cast(format('{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}', y, m, day, h, mi, s) AS TIMESTAMP))::BIGINT END, 0) AS seconds FROM y""")
def _(t):
    d, at = (F.col("o_orderkey") * 37 % 65_536).cast("int"), (F.col("o_orderkey") * 101 % 65_536).cast("int")
    return t("orders").select("o_orderkey", scalar.from_fat(d, at).alias("seconds"))


@query("q_hash_suite", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def _(t):
    b = F.col("text").cast("binary")
    return t("documents").select("doc_id", F.md5(b).alias("md5"), F.sha1(b).alias("sha1"), F.sha2(b, 256).alias("sha256"))


@query("q_crc32")
def _(t):
    return t("documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


@query("q_base64_hex", "SELECT doc_id, to_base64(encode(text)) AS b64, hex(encode(text)) AS hex, true AS same FROM documents")
def _(t):
    b = F.col("text").cast("binary")
    return t("documents").select("doc_id", F.regexp_replace(F.base64(b), "\r\n", "").alias("b64"), F.hex(b).alias("hex"), (F.unbase64(F.base64(b)) == b).alias("same"))


@query("q_hex_whole", "SELECT doc_id, hex(encode(text)) AS hex, unhex(hex(encode(text))) = encode(text) AS same FROM documents")
def _(t):
    b = F.col("text").cast("binary")
    return t("documents").select("doc_id", F.hex(b).alias("hex"), (F.unhex(F.hex(b)) == b).alias("same"))


@query("q_sanitize", r"""SELECT page_id, array_to_string(list_transform(list_filter(string_split(url, '/'), lambda p: p NOT IN ('', '.', '..')), lambda p: CASE WHEN regexp_replace(regexp_replace(p, '[<>:"/\\|?*]', '_', 'g'), '[. ]+$', '') = '' THEN 'unnamed' ELSE regexp_replace(regexp_replace(p, '[<>:"/\\|?*]', '_', 'g'), '[. ]+$', '')[1:200] END), '/') AS path FROM pages""")
def _(t):
    return t("pages").select("page_id", scalar.sanitize_path(F.col("url")).alias("path"))


@query("q_hexdump", "SELECT doc_id, i * 16 AS at, hex(b[i * 16 + 1:i * 16 + 16]) AS hex FROM (SELECT doc_id, encode(text) AS b, unnest(range(0, (strlen(text) + 15) // 16)) AS i FROM documents)")
def _(t):
    lines = F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit(".{1,32}"), F.lit(0))
    rows = t("documents").select("doc_id", F.posexplode(lines).alias("i", "hex"))
    return rows.select("doc_id", (F.col("i").cast("long") * 16).alias("at"), "hex")


@query("q_fragment_trim", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS len, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, least(len, 80 - (upto - len)) AS kept FROM r WHERE upto - len < 80""")
def _(t):
    # The SQL leaves the order of rows with one order, line and part open; by length, equal tables give equal rows.
    order = [F.asc_nulls_last(c) for c in ("l_linenumber", "l_partkey", "len")]
    line = Window.partitionBy("l_orderkey").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.rint("l_quantity").cast("long").alias("len")).withColumn("upto", F.sum("len").over(line))
    return rows.where("upto - len < 80").select("l_orderkey", "l_linenumber", "l_partkey", F.least(F.col("len"), 80 - (F.col("upto") - F.col("len"))).alias("kept"))


@query("q_manifest", "SELECT doc_id AS id, source || '/' || lang || '_' || lpad(doc_id::VARCHAR, 5, '0') || '.txt' AS path, n_chars AS size, CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no' END AS deleted, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def _(t):
    b = F.col("text").cast("binary")
    path = F.concat("source", F.lit("/"), "lang", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit(".txt"))
    return t("documents").select(F.col("doc_id").alias("id"), path.alias("path"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 3 == 0, "yes").otherwise("no").alias("deleted"), F.md5(b).alias("md5"), F.sha1(b).alias("sha1"))


@query("q_unique_names", """SELECT p_partkey, CASE WHEN k = 0 THEN p_brand ELSE p_brand || '_' || k END AS name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)""")
def _(t):
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return t("part").select("p_partkey", F.when(k == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("_"), k.cast("string"))).alias("name"))


@query("q_covered_bytes", "SELECT l_linestatus AS status, sum(l_quantity::BIGINT)::BIGINT AS bytes, count(*) AS ranges FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy(F.col("l_linestatus").alias("status")).agg(F.sum(F.round("l_quantity").cast("long")).alias("bytes"), F.count("*").alias("ranges"))


_MIME_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scalar.MIME.items())


@query("q_mime", f"WITH {PAGE_ROWS} SELECT CASE ext {_MIME_CASE} ELSE 'application/octet-stream' END AS mime, count(*) AS n FROM r GROUP BY 1")
def _(t):
    return t("pages").groupBy(scalar.mime(F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1)).alias("mime")).agg(F.count("*").alias("n"))


@query("q_carve_pages", r"""WITH p AS (SELECT page_id, html, strpos(html, '<!DOCTYPE html') AS a FROM pages WHERE html LIKE '%<!DOCTYPE html%'),
o AS (SELECT page_id, substr(html, a, coalesce(nullif(strpos(substr(html, a + 14), '</html>'), 0) + 13 + 7, length(html))) AS body FROM p)
SELECT 'document' AS category, 'HTML' AS format, count(*) AS n, sum(strlen(body))::BIGINT AS bytes FROM o""")
def _(t):
    """Pages as images: HTML objects by header and footer."""
    from ..operators import carve, catalog

    images = t("pages").select(F.col("page_id").alias("image_id"), F.col("html").cast("binary").alias("data"))
    return carve.summary(carve.carve(images, catalog.selected(categories=["document"])))


# Joins, aggregates and orders that file system records need, on the driver's tables.


@query("q_name_or_number", "SELECT c_custkey, coalesce(name, 'inode_' || c_custkey) AS name FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS name FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(t):
    names = t("orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("name"))
    rows = t("customer").select("c_custkey").join(names, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("name", F.concat(F.lit("inode_"), F.col("c_custkey").cast("string"))).alias("name"))


@query("q_fold_children", "SELECT o_orderkey, count(l_orderkey) AS n, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber || ':' || l_partkey), '') AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    child = F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    folded = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(child)), ",").alias("children"))
    rows = t("orders").select("o_orderkey").join(folded, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("children", F.lit("")).alias("children"))


@query("q_names_not_held", "SELECT o_orderkey, o_orderpriority AS name FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(t):
    held = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return t("orders").select("o_orderkey", F.col("o_orderpriority").alias("name")).join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("q_furthest_extent", "SELECT source, max(doc_id * 512 + n_chars) AS end_at FROM (SELECT * FROM documents) GROUP BY 1")
def _(t):
    """Documents as extents: where the last one of each source ends."""
    rows = t("documents").select("source", (F.col("doc_id") * 512).alias("offset"), "n_chars")
    return results.furthest_extent(rows, "source", "offset", "n_chars").withColumnRenamed("end", "end_at")


@query("q_label_summary", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus <> 'P') AS valid, max(o_orderkey) FILTER (o_orderstatus <> 'P') AS highest FROM orders GROUP BY 1")
def _(t):
    return results.label_summary(t("orders"), "o_orderpriority", F.col("o_orderstatus") != "P", "o_orderkey")


@query("q_health", """SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'unallocated' WHEN p_size * 4096 < 65536 THEN 'unknown' WHEN p_partkey % 3 = 0 THEN 'healthy'
WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE 'damaged' END AS health FROM part""")
def _(t):
    """Parts as areas of a disk."""
    guid = F.when(F.col("p_partkey") % 7 == 0, F.lit("21686148-6449-6e6f-744e-656564454649"))
    return t("part").select("p_partkey", results.health(F.when(F.col("p_partkey") % 3 == 0, "ext4"), F.col("p_size") * 4096, guid, F.col("p_size") > 5).alias("health"))


@query("q_fat_flavour", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey % 2 = 0 AS lfn, l_suppkey * 4000 - 32 - 2 * 250 - ceil(l_linenumber * 512 * 32 / 512) AS d FROM lineitem),
w AS (SELECT *, CASE WHEN d <= 0 OR floor(d / 4) BETWEEN 4085 AND 65524 THEN 'fat16' WHEN floor(d / 4) < 4085 THEN 'fat12' ELSE 'fat32' END AS w FROM c)
SELECT CASE WHEN lfn THEN 'vfat' ELSE w END AS flavour, count(*) AS n FROM w GROUP BY 1""")
def _(t):
    """Line items as boot sectors."""
    clusters = results.fat_clusters(F.col("l_suppkey") * 4000, F.lit(32), F.lit(2), F.lit(250), F.col("l_linenumber") * 512, F.lit(512), F.lit(4))
    return t("lineitem").groupBy(results.fat_flavour(clusters, F.col("l_partkey") % 2 == 0).alias("flavour")).agg(F.count("*").alias("n"))


@query("q_member_order", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 4, s_name) AS place FROM supplier")
def _(t):
    """Suppliers as members of an array: by role, then by path."""
    line = Window.partitionBy("s_nationkey").orderBy(F.col("s_suppkey") % 4, "s_name")
    return t("supplier").select("s_suppkey", F.row_number().over(line).alias("place"))


@query("q_newest_first", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(t):
    """Events as jobs: a top-k report, newest first."""
    return t("events").select("event_id", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100)


@query("q_paths_broken", """WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN c_custkey + 1000000 WHEN c_custkey % 7 = 1 THEN NULL ELSE c_custkey - 1 END AS up, c_name AS name FROM customer),
w AS (SELECT id, name AS path, up IS NOT NULL AS broken FROM n WHERE up IS NULL OR up NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, w.path || '/' || n.name, false FROM n JOIN w ON n.up = w.id)
SELECT id, CASE WHEN broken THEN '$orphans/' ELSE '' END || path AS path FROM w""")
def _(t):
    """Customers as files whose parents are one number less, some of them unknown."""
    up = F.when(F.col("c_custkey") % 50 == 0, F.col("c_custkey") + 1_000_000).when(F.col("c_custkey") % 7 == 1, None).otherwise(F.col("c_custkey") - 1)
    return graph.path_closure(t("customer").select(F.col("c_custkey").alias("id"), up.alias("parent_id"), F.col("c_name").alias("name")), [])


@query("q_signature_categories", "SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in catalog.categories()) + ") AS v(category)")
def _(t):
    spark = t("region").sparkSession
    return catalog.signatures(spark).select("category").distinct().orderBy("category")


@query("q_copies_compared", "SELECT count(*) AS compared, count_if(o_orderstatus <> l_linestatus) AS differ FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1")
def _(t):
    second = t("lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linestatus")
    rows = t("orders").select("o_orderkey", "o_orderstatus").join(second, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.agg(F.count("*").alias("compared"), F.count_if(F.col("o_orderstatus") != F.col("l_linestatus")).alias("differ"))


@query("q_two_level_lookup", "SELECT c_nationkey, count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    # a line's order, that order's customer; lines are counted by order before they meet them
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))
    rows = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("q_index_selection", "SELECT page_id, url FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND length(html) > 0")
def _(t):
    chosen = t("labels").where("quality = 1").select("doc_id")
    return t("pages").where("char_length(html) > 0").select("page_id", "url").join(chosen, F.col("page_id") == F.col("doc_id"), "left_semi")


@query("q_preferred_name", """SELECT user_id, arg_min(event_type, k) AS event_type FROM (SELECT user_id, event_type, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END * 1000000000000 + event_id AS k FROM events) GROUP BY 1""")
def _(t):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return t("events").groupBy("user_id").agg(F.min_by("event_type", F.struct(rank, "event_id")).alias("event_type"))


@query("q_holes", f"""WITH {SPANS}, g AS (SELECT user_id, s, f, event_id, lag(f) OVER (PARTITION BY user_id ORDER BY s, event_id) AS before FROM e)
SELECT user_id, s AS "start", f - s AS length, false AS sparse FROM g UNION ALL SELECT user_id, before, s - before, true FROM g WHERE s > before""")
def _(t):
    before = F.lag("end").over(Window.partitionBy("user_id").orderBy("start", "event_id"))
    rows = spans(t).select("user_id", "start", "end", before.alias("before"))
    extent = F.struct(F.col("start"), (F.col("end") - F.col("start")).alias("length"), F.lit(False).alias("sparse"))
    hole = F.struct(F.col("before").alias("start"), (F.col("start") - F.col("before")).alias("length"), F.lit(True).alias("sparse"))
    return rows.select("user_id", F.explode(F.when(F.col("start") > F.col("before"), F.array(hole, extent)).otherwise(F.array(extent))).alias("x")).select("user_id", "x.*")


@query("q_clipped", f"""WITH {SPANS}, w AS (SELECT event_id, s, f, s - s % 86400 + 43200 AS a FROM e) SELECT event_id, greatest(s, a) AS "start", least(f, a + 43200) AS "end" FROM w WHERE s < a + 43200 AND f > a""")
def _(t):
    rows = spans(t).withColumn("a", F.col("start") - F.col("start") % 86_400 + 43_200).where("start < a + 43200 and end > a")
    return rows.select("event_id", F.greatest("start", "a").alias("start"), F.least("end", F.col("a") + 43_200).alias("end"))


@query("q_deleted_count", f"WITH {PAGE_ROWS} SELECT method, count(*) AS n, count_if(deleted) AS n_deleted FROM r GROUP BY 1")
def _(t):
    return page_rows(t).groupBy("method").agg(F.count("*").alias("n"), F.count_if("deleted").alias("n_deleted"))


@query("q_counters", "SELECT 'events_' || event_type AS key, count(*) AS value FROM events GROUP BY 1 UNION ALL SELECT 'orders_' || o_orderstatus, count(*) FROM orders GROUP BY 1")
def _(t):
    events = t("events").select(F.concat(F.lit("events_"), F.col("event_type")).alias("key"))
    return events.unionByName(t("orders").select(F.concat(F.lit("orders_"), F.col("o_orderstatus")).alias("key"))).groupBy("key").agg(F.count("*").alias("value"))


@query("q_techniques", "SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS techniques FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY 1")
def _(t):
    first = t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ",").alias("techniques"))


@query("q_tail_trimmed", "SELECT doc_id, length(rtrim(text, '. '))::INT AS n FROM documents WHERE text IS NOT NULL")
def _(t):
    return t("documents").where("text is not null").select("doc_id", F.char_length(F.rtrim("text", F.lit(". "))).alias("n"))


@query("q_extraction_rollup", "SELECT source, count_if(text IS NOT NULL) AS written, count_if(text IS NULL) AS failed, count_if(lang IS NULL) AS undecoded, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy("source").agg(F.count_if(F.col("text").isNotNull()).alias("written"), F.count_if(F.col("text").isNull()).alias("failed"), F.count_if(F.col("lang").isNull()).alias("undecoded"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


@query("q_listed", f"WITH {PAGE_ROWS} SELECT index, path FROM r WHERE deleted ORDER BY path, index LIMIT 200")
def _(t):
    return page_rows(t).where("deleted").orderBy("path", "index").limit(200).select("index", "path")


@query("q_distinct_hits", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t("events").select("user_id", "event_type").distinct()


@query("q_progress", "SELECT o_custkey, round(sum(CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 50 ELSE 0 END) / count(*), 6) AS percent FROM orders GROUP BY 1")
def _(t):
    done = F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "P", 50).otherwise(0)
    return t("orders").groupBy("o_custkey").agg(F.round(F.sum(done) / F.count("*"), 6).alias("percent"))


@query("q_json_manifest", f"WITH {PAGE_ROWS} SELECT index, to_json({{'index': index, 'path': path, 'size': size, 'deleted': deleted}})::VARCHAR AS entry FROM r")
def _(t):
    return page_rows(t).select("index", F.to_json(F.struct("index", "path", "size", "deleted")).alias("entry"))
