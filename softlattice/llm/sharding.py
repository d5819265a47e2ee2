"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has `vnodes` points on the ring; a document stands at the hash of its
doc_id and belongs to the first point clockwise.  Shard s holds n // m rows, one
more if s < n % m, and no more: keys are dealt in ring order, and those that
find their shard full go on clockwise to the next point whose shard has room.
So counts differ by one at most (law `rows`), and only overflow moves.

The ring has `cells` equal arcs, points standing on arc borders.  One
aggregation counts the rows of each cell (bounded: `cells` numbers); the walk
over these counts is the plan, at most cells + shards segments of (cell, ranks,
shard, first slot), which is broadcast.  A row's rank in its cell then names its
shard and slot.  Equal rows are counted before they are ranked, so a doc_id that
fills a third of the table is one row until the end.

Null doc_id and null text are values of their own; an empty table gives none.
DataFrame and SQL functions only.
"""

from __future__ import annotations

import json
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = 1 << 14


def ring(shards: int, vnodes: int = 64, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every point, clockwise."""
    return sorted((int(md5(f"{s}/{v}".encode()).hexdigest()[:8], 16) % cells, s) for s in range(shards) for v in range(vnodes))


def walk(counts: dict[int, int], shards: int, cells: int = CELLS, vnodes: int = 64) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first rank) segments that place all rows."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    points = ring(shards, vnodes, cells)
    out, p = [], 0
    for cell in sorted(counts):
        while p < len(points) and points[p][0] < cell:
            p += 1
        left, rank, q = counts[cell], 0, p
        while left:
            s = points[q % len(points)][1]
            take = min(left, room[s] - used[s])
            if take > 0:
                out.append((cell, rank, rank + take, s, used[s]))
                used[s] += take
                rank, left = rank + take, left - take
            q += 1
    return out


def place(docs: DataFrame, shards: int = 8, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.isnull("text").alias("_null"))
    same = rows.groupBy("doc_id", "size", "text_crc32", "_null").agg(F.count("*").alias("_n"))
    same = same.withColumn("_cell", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(cells)).cast("int"))
    counts = {r[0]: r[1] for r in same.groupBy("_cell").agg(F.sum("_n")).collect()}  # cells rows at most
    segments = json.dumps(walk(counts, shards, cells))
    at = F.explode(F.from_json(F.lit(segments), "array<array<long>>")).alias("s")
    plan = spark.range(1).select(at).select(*[F.col("s")[i].cast(t).alias(c) for i, (c, t) in enumerate((("_cell", "int"), ("_from", "long"), ("_to", "long"), ("shard", "int"), ("_slot", "long")))])
    order = Window.partitionBy("_cell").orderBy("doc_id", "text_crc32", "size", "_null").rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn("_rank", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    hit = ranked.join(F.broadcast(plan), "_cell").where("_from < _rank + _n and _to > _rank")
    first, last = F.greatest("_from", "_rank"), F.least("_to", F.col("_rank") + F.col("_n")) - 1
    each = hit.withColumn("_at", F.explode(F.sequence(first, last)))
    return each.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_slot") + F.col("_at") - F.col("_from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"))
