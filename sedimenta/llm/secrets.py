"""Secret scans with an incremental ledger of blobs, in DataFrame operations only.

Every text is content-addressed by its SHA-256. A store keeps a ledger of the pairs of
blob and rule version that have been scanned, and the findings, by blob and rule version.
A scan reads each distinct blob once, only blobs that lack a rule version, and of these
applies only the rule versions they lack; the findings are kept and joined back to every
path (document) that has the blob. Versions of a rule stay side by side in the store.

Findings are written before the ledger's rows, and count only once these are there, so
a run that breaks off between the two leaves nothing to repair.

Offsets come from the matches and the pieces of text between them, in order;
they count code points, and ends are exclusive.

Defined results: null texts count as empty; texts without a finding get zero
counts, the hash of the empty string and an empty span list; repeated rows get
equal rows; an empty table gives no rows. Texts are scanned whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` and ``least`` say which part has how many characters at least."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: str | None = None  # a string that every match has
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules' patterns and least lengths.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, None, True),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 16, "AKIA", True),
    Rule("hex", 1, "[0-9a-f]{32,}", 0, 32, None, True),  # the runs of [0-9a-f]+ with 32 characters or more
)
# Formats that providers publish.
MORE = (
    Rule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    Rule("slack", 1, r"\bxox[abprs]-[0-9]{8,}-[A-Za-z0-9-]{16,}", 0, 24, "xox"),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 40, "eyJ"),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 27, "-----BEGIN "),
)
RULES = (*BASE, *MORE)
FINDING = "struct<rule:string,kind:string,nth:int,gap:int,size:int,ok:boolean>"


def matches(rule: Rule, text: Column, unseen: Column) -> Column:
    """Every match of the rule in order: how far from the end of the one before, how long, whether it counts."""
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    rows = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("g"), judged.alias("j")),
        lambda x, i: F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.kind).alias("kind"), i.alias("nth"), F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("size"), (F.char_length(x["j"]) >= rule.least).alias("ok")),
    )
    there = text.rlike(rule.pattern) if rule.hint is None else text.contains(rule.hint) & text.rlike(rule.pattern)
    return F.when(unseen & there, rows).otherwise(F.array().cast(f"array<{FINDING}>"))


def scan(paths: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Findings (blob, rule, kind, start, end) of blobs (columns blob, text) by rules that the ledger (blob, rules) lacks."""
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))
    seen = F.array().cast("array<string>")
    if ledger is not None:
        keys = F.array(*[F.lit(r.key) for r in rules])
        known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("rules", keys)))).alias("seen"))
        blobs = blobs.join(known, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
        seen = F.coalesce(F.col("seen"), seen)
    found = F.concat(*[matches(r, F.col("text"), ~F.array_contains(seen, r.key)) for r in rules])
    rows = blobs.select("blob", F.explode(found).alias("x")).select("blob", "x.*")
    upto = Window.partitionBy("blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).where("ok")
    return rows.select("blob", "rule", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


class Store:
    """A ledger and findings in a folder; every run adds a part to both."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def ledger(self) -> DataFrame | None:
        """(blob, rules, run), one row for each blob and run that scanned it."""
        return self.table("ledger", "blob string, rules array<string>, run string")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, rule, kind, start, end) of the rules, from runs that the ledger knows."""
        found, ledger = self.table("findings", "blob string, rule string, kind string, start long, end long, run string"), self.ledger()
        if found is None or ledger is None:
            return self.spark.createDataFrame([], "blob string, rule string, kind string, start long, end long")
        runs = ledger.select("run").distinct()  # a row for each run
        return found.where(F.col("rule").isin([r.key for r in rules])).join(F.broadcast(runs), "run", "left_semi").drop("run")

    def extend(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what the ledger lacks of the paths (columns blob, text), and keep it."""
        run, ledger, keys = uuid.uuid4().hex, self.ledger(), F.array(*[F.lit(r.key) for r in rules])
        scan(paths, rules, ledger).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.folder}/findings")
        new = paths.select("blob").distinct().withColumn("rules", keys)
        if ledger is not None:
            known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
            lacks = F.array_except("rules", F.coalesce("seen", F.array().cast("array<string>")))
            new = new.join(known, "blob", "left").select("blob", lacks.alias("rules")).where(F.size("rules") > 0)
        new.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.folder}/ledger")


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return C.id_text(docs, id_col, text_col).withColumn("blob", F.sha2("text", 256))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of structs sorted by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES, store: Store | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts, base_sha256 and spans for every row, from the store once it knows all texts; by default a new one."""
    paths = addressed(docs, id_col, text_col)
    store = store or Store(docs.sparkSession, f"{C.shared_dir(docs.sparkSession)}/secrets-{uuid.uuid4().hex}")
    store.extend(paths, rules)
    order = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    one = F.struct("start", order.alias("rank"), "end", "kind")
    base = [r.kind for r in rules if r.base]
    summary = store.findings(rules).groupBy("blob").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in base],
        joined(F.collect_list(F.when(F.col("kind").isin(base), one))).alias("base"),
        joined(F.collect_list(one)).alias("spans"),
    )
    rows = paths.select("doc_id", "blob").join(summary, "blob", "left")
    return rows.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))


def _duck() -> str:
    """The same in DuckDB: matches and the pieces between them as lists, then running lengths."""
    base = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rules = [(r.kind, (base if r.kind == "assign" else r.pattern).replace("'", "''"), r.group, r.least) for r in RULES]
    lists = ", ".join(f"regexp_extract_all(t, '{p}') AS {k}_m, string_split_regex(t, '{p}') AS {k}_g, regexp_extract_all(t, '{p}', {g}) AS {k}_j" for k, p, g, _ in rules)
    one = """list_filter(list_transform(range(1, len({k}_m) + 1), lambda i: {{'s': list_sum(list_transform({k}_g[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform({k}_m[1:i-1], lambda g: length(g))), 0),
      'n': length({k}_m[i]), 'ok': length({k}_j[i]) >= {n}, 'kind': '{k}'}}), lambda x: x.ok) AS {k}_"""
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    row = f"lambda x: {{'s': x.s, 'k': list_position({kinds}, x.kind), 'e': x.s + x.n, 'kind': x.kind}}"
    text = "lambda x: x.kind || ':' || x.s || ':' || x.e"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), m AS (SELECT doc_id, {lists} FROM d), s AS (SELECT doc_id, {", ".join(one.format(k=k, n=n) for k, _, _, n in rules)} FROM m),
a AS (SELECT doc_id, len(assign_) n_assign, len(access_) n_access, len(hex_) n_hex, list_sort(list_transform(assign_ || access_ || hex_, {row})) b, list_sort(list_transform({" || ".join(f"{r.kind}_" for r in RULES)}, {row})) c FROM s)
SELECT doc_id, n_assign::BIGINT n_assign, n_access::BIGINT n_access, n_hex::BIGINT n_hex, sha256(coalesce(array_to_string(list_transform(b, {text}), ','), '')) base_sha256, coalesce(array_to_string(list_transform(c, {text}), ','), '') spans FROM a"""


ORACLE = _duck()
