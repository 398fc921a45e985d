"""Parent-pointer paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

ORPHANS, CYCLES = "$orphans", "$cycles"


def path_closure(nodes: DataFrame, roots: list) -> DataFrame:
    """(id, path) for nodes (id, parent_id, name), by pointer doubling: about log2(depth) joins, not one a level.

    Roots are the ids given, and nodes without a parent or with themselves as parent. A
    node whose parent is unknown goes under $orphans; nodes below it keep the partial
    path. A node whose chain never ends goes under $cycles. Every round is written, so
    none is computed twice; rounds end when no pointer is left, or when a round ends no
    chain: on a chain nodes of every depth lie, so what is left then is cycles.
    """
    known = nodes.select(F.col("id").alias("_id")).distinct()
    root = F.col("parent_id").isNull() | (F.col("parent_id") == F.col("id")) | F.col("id").isin(roots)
    state = nodes.select("id", F.when(~root, F.col("parent_id")).alias("up"), "name", F.col("name").alias("path"))
    state = state.join(known, F.col("up") == F.col("_id"), "left")
    state = stored(state.select("id", F.col("_id").alias("up"), "name", "path", (F.col("up").isNotNull() & F.col("_id").isNull()).alias("orphan")), "paths")
    left = before = None
    while True:
        left = state.where("up is not null").count()
        if not left or left == before:
            break
        above = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        state = state.join(above, F.col("up") == F.col("_id"), "left").select(
            "id", F.col("_up").alias("up"), "name", F.when(F.col("_id").isNull(), F.col("path")).otherwise(F.concat_ws("/", "_path", "path")).alias("path"), "orphan"
        )
        state, before = stored(state, "paths"), left
    path = F.when(F.col("up").isNotNull(), F.concat(F.lit(f"{CYCLES}/"), "name")).when(F.col("orphan"), F.concat(F.lit(f"{ORPHANS}/"), "name")).otherwise(F.col("path"))
    return state.select("id", path.alias("path"))


def chain_heads(rows: DataFrame, node: str, following: str) -> DataFrame:
    """Nodes that no other node points to."""
    pointed = rows.select(F.col(following).alias("_p")).where("_p is not null").distinct()
    return rows.join(pointed, F.col(node) == F.col("_p"), "left_anti")
