"""Interval algebra on half-open ranges [start, end): islands, gaps, coverage joins, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", tolerance: int = 0) -> DataFrame:
    """Merge ranges of a key that overlap or lie within ``tolerance`` of each other."""
    line = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + tolerance), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def gaps(merged: DataFrame, keys: list[str], least: int, start: str = "start", end: str = "end", low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Complement of islands, ranges longer than ``least`` only; ``low`` and ``high`` bound the first and last gap."""
    line = Window.partitionBy(*keys).orderBy(start)
    before = F.lag(end).over(line)
    rows = merged.select(*keys, (F.coalesce(before, low) if low is not None else before).alias("gap_start"), F.col(start).alias("gap_end"))
    if high is not None:
        rows = rows.unionByName(merged.groupBy(*keys).agg(F.max(end).alias("gap_start")).withColumn("gap_end", high))
    return rows.where(F.col("gap_end") - F.col("gap_start") > least)


def coalesce_adjacent(df: DataFrame, keys: list[str], order: list[str], status: str) -> DataFrame:
    """Runs of neighbouring rows with equal status: run number, length, first and last of the order column."""
    line = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(status).over(line).eqNullSafe(F.col(status)), 0).otherwise(1)
    runs = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run", status).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def outside(points: DataFrame, merged: DataFrame, keys: list[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Points that no island covers. Islands are disjoint, so the last one that starts at or before a point decides: an as-of lookup by window."""
    return _with_last_start(points, merged, keys, at, start, end).where(F.col("_end").isNull() | (F.col("_end") <= F.col(at))).drop("_start", "_end")


def containing(points: DataFrame, merged: DataFrame, keys: list[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Points with the island that covers them (range_start, range_end), or nulls."""
    rows = _with_last_start(points, merged, keys, at, start, end)
    inside = F.col("_end") > F.col(at)
    return rows.withColumns({"range_start": F.when(inside, F.col("_start")), "range_end": F.when(inside, F.col("_end"))}).drop("_start", "_end")


def _with_last_start(points: DataFrame, merged: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    left = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"), F.lit(None).cast("long").alias("_s"), F.lit(None).cast("long").alias("_e"))
    right = merged.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    line = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumns({"_start": F.last("_s", True).over(line), "_end": F.last("_e", True).over(line)})
    return both.where("_kind = 1").select("_row.*", "_start", "_end")


def band_anti(left: DataFrame, right: DataFrame, at: str, other: str, width: int) -> DataFrame:
    """Rows of left without a row of right within ``width``: an equi-join on buckets of that width and their neighbours."""
    bucket = F.floor(F.col(at) / width)
    near = right.select(F.col(other).alias("_o")).distinct()
    near = near.withColumn("_b", F.explode(F.array(*[F.floor(F.col("_o") / width) + k for k in (-1, 0, 1)])))
    return left.withColumn("_bucket", bucket).join(near, (F.col("_bucket") == F.col("_b")) & (F.abs(F.col(at) - F.col("_o")) <= width), "left_anti").drop("_bucket")


def overlap_anti(left: DataFrame, right: DataFrame, keys: list[str], width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Ranges of left that overlap no range of right: both cut into cells of ``width``, joined on cell, compared."""
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / width)))
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(start).alias("_rs"), F.col(end).alias("_re"))
    r = r.withColumn("_cell", cell("_rs", "_re"))
    tagged = left.withColumn("_id", F.struct(*left.columns))
    hit = tagged.withColumn("_lcell", cell(start, end)).join(r, (F.col("_lcell") == F.col("_cell")) & (F.col(start) < F.col("_re")) & (F.col("_rs") < F.col(end)) if not keys else (F.col("_lcell") == F.col("_cell")) & (F.col(start) < F.col("_re")) & (F.col("_rs") < F.col(end)) & F.expr(" and ".join(f"{k} = _{k}" for k in keys))).select("_id").distinct()
    return tagged.join(hit, "_id", "left_anti").drop("_id")


def running_total(df: DataFrame, order: str, amount: Column, cells: int = 64) -> DataFrame:
    """Cumulative sum in a global order without one task for all rows: ranges, their totals, then sums within each."""
    cuts = df.select(F.percentile_approx(order, [k / cells for k in range(1, cells)])).first()[0] or []
    cell = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>"), lambda c: c < F.col(order)))
    rows = df.withColumns({"_amount": amount, "_cell": cell})
    totals = rows.groupBy("_cell").agg(F.sum("_amount").alias("_total"))  # one row a range
    base = totals.withColumn("_base", F.coalesce(F.sum("_total").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    line = Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(base.select("_cell", "_base")), "_cell").withColumn("running", F.sum("_amount").over(line) + F.col("_base")).drop("_cell", "_base", "_amount")
