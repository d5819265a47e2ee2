"""Connected components by alternating star contractions, all on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _minima(pairs: DataFrame) -> DataFrame:
    """Of (u, v): each u with the least of itself and its v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(u, v) links of longs -> (node, component): the least node reachable.

    Nodes without a link do not appear.  Large-star and small-star rounds
    (Kiveris et al., SoCC 2014) end when the edges are stars; rounds grow with
    the logarithm of the size.  The minima are partial aggregates and written
    first, so a hub's edges meet its one row in a join of two plain shuffles,
    which Spark splits where one of them is skewed.
    """
    now = ws.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    mark, turn = None, 0
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(ws.save(_minima(both), f"{name}low{turn}"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = ws.save(large, f"{name}large{turn}")
        low = ws.save(_minima(large), f"{name}least{turn}")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        small = ws.save(small, f"{name}{turn + 1}")
        ws.drop(*(f"{name}{x}{turn}" for x in ("large", "low", "least", "")))
        seen = small.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first()
        now, turn = small, turn + 1
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
