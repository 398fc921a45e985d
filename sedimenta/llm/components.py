"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """From links (a, b) to (node, component), component the smallest id reachable; unlinked nodes have no row.

    Hubs are met by minima that are aggregated before they are shuffled, and by
    joins of written tables, whose large partitions Spark can split.
    """
    a, b = F.col("a"), F.col("b")
    links = written(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = written(both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct(), "large")
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(lower, "a").where(b != F.col("m")).select(F.greatest(b, F.col("m")).alias("a"), F.least(b, F.col("m")).alias("b"))
        before, links = links, written(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(before, least, large, lower)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    nodes = links.select(a.alias("node"), b.alias("component"))
    nodes.__dict__["written_path"] = links.__dict__["written_path"]
    return nodes


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links (i, j), in memory."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        i, j = i[open_], j[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
