"""Approximate nearest neighbours: stable projections, kd-tree, chi-square stop.

Vectors of unit length are projected to M dimensions by a fixed Gaussian matrix
(2-stable), so a projected squared distance is the true one times a chi-square
variable of M degrees of freedom.  Each chunk of candidates is indexed by a
kd-tree over the projections.  A query takes the tree's leaves in the order of
their projected distance and verifies their vectors by the true cosine; it stops
at the first leaf so far away that a neighbour nearer than its k-th would lie
within that projected radius with probability `tau` (Sun et al., PVLDB 2014).

Every row is indexed and every query meets every chunk of its length.  Queries
go in blocks (`block` of them, `BLOCK_BYTES` at most) broadcast to a scan of the
vectors; a task holds one chunk of `chunk` vectors, and gives k rows a query and
chunk, which are merged by partial ranking.  Scores are computed again from the
original vectors in a fixed order of additions, so equal vectors tie exactly and
the smaller vec_id wins.  Vectors are scaled by a power of two first, which
changes no score and keeps sums of large or small components finite.

Vectors that are null, zero, or hold null or non-finite components take no part.
Vectors of other lengths than the query's are no candidates of it.  Rows that
repeat a vec_id are queries and candidates each: `query_row` tells such queries
apart, and a query's own row is the only one it leaves out.  No vectors: no
rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace, least, small_batches

M, LEAF = 8, 128
BLOCK_BYTES = 64 << 20


def projection(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20_240_229)).standard_normal((dim, M))


def chi2_cdf(x: np.ndarray) -> np.ndarray:
    """P(chi-square of M degrees of freedom <= x), M even."""
    half = np.asarray(x) / 2
    term = total = np.ones_like(half)
    for i in range(1, M // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi2_quantile(p: float) -> float:
    low, high = 0.0, 1e3
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(np.array(mid)) < p else (low, mid)
    return high


def kd_leaves(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of a kd-tree's leaves: halved at the median of the widest dimension."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        p = points[rows]
        dim = int(np.argmax(p.max(0) - p.min(0)))
        half = np.argpartition(p[:, dim], len(rows) // 2)
        todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return out


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one query and rows of original vectors, each sum in the same order whatever the number of rows."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * math.sqrt((q * q).sum()))


class Best:
    """The k best candidates of each query: score descending, then id ascending."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids = k, [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n
        self.worst = np.full(n, -np.inf)

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[i], score]), np.concatenate([self.ids[i], ids])
        keep = np.lexsort((ids, -score))[: self.k]
        self.score[i], self.ids[i] = score[keep], ids[keep]
        if len(keep) == self.k:
            self.worst[i] = self.score[i][-1]


def search_chunk(qrow: np.ndarray, q: np.ndarray, row: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, tau: float, floor: np.ndarray | None = None) -> Best:
    """k nearest of a chunk for all queries but their own rows; `floor`: a cosine that each query's k-th is known to reach."""
    proj = projection(q.shape[1])
    unit = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    uq, ux = unit(q), unit(x)
    pq, px = uq @ proj, ux @ proj
    leaves = kd_leaves(px)
    low, high = np.array([px[r].min(0) for r in leaves]), np.array([px[r].max(0) for r in leaves])
    gap = np.zeros((len(q), len(leaves)))
    for d in range(M):
        gap += np.square(np.maximum(0, np.maximum(low[None, :, d] - pq[:, None, d], pq[:, None, d] - high[None, :, d])))
    order = np.argsort(gap, axis=1, kind="stable")
    limit, best = chi2_quantile(tau), Best(len(q), k)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    active = np.arange(len(q))
    for step in range(len(leaves)):
        if not len(active):
            break
        leaf = order[active, step]
        bound = np.maximum(best.worst[active], floor[active])
        stop = gap[active, leaf] > limit * np.maximum(0, 2 - 2 * bound)  # squared true distance of unit vectors
        active, leaf = active[~stop], leaf[~stop]
        for number in np.unique(leaf):
            rows, who = leaves[number], active[leaf == number]
            s = uq[who] @ ux[rows].T
            good = s >= np.maximum(best.worst[who], floor[who])[:, None] - 1e-9
            for j in np.flatnonzero(good.any(1)):
                i, at = who[j], rows[good[j]]
                at = at[row[at] != qrow[i]]
                if len(at):
                    best.add(i, exact(q[i], x[at]), ids[at])
    return best


def _scaled(v: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between 1/2 and 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def _vectors(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, vec_ids and scaled vectors of an Arrow batch or table whose vectors have one length."""
    row, ids = (np.asarray(table.column(c), np.int64) for c in ("row", "vec_id"))
    v = table.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return row, ids, _scaled(np.asarray(v.flatten(), float).reshape(len(ids), -1)) if len(ids) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, v (doubles) and dim of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False))) & F.exists(v, lambda e: e != 0)
    rows = vectors.where("vec_id is not null").select("vec_id", v.alias("v"), fine.alias("_fine")).where("_fine")
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim"))


def _finder(shared, k: int, tau: float, chunk: int):
    def run(batches):
        qrow, qid, q, floor = shared.value
        held, n = [], 0

        def flush():
            row, ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            best = search_chunk(qrow, q, row, ids, x, k, tau, floor)
            many = [len(s) for s in best.score]
            cols = [np.repeat(qrow, many), np.repeat(qid, many), np.concatenate(best.ids), np.concatenate(best.score)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_row", "query_id", "vec_id", "score"])

        for batch in batches:
            if batch.num_rows:
                held.append(_vectors(batch))
                n += batch.num_rows
            if n >= chunk:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def neighbours(vectors: DataFrame, is_query: F.Column, k: int = 5, tau: float = 0.99, block: int = 8192, chunk: int = 32_768, sample: int = 2000) -> DataFrame:
    """query_id, rank, vec_id, score and query_row: the k nearest found of each row for which is_query holds (a condition on vec_id)."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    ws = Workspace(spark, "neighbours")
    rows = ws.save(usable(vectors), "vectors")  # written once, so a row keeps its number
    found = []
    for (dim,) in rows.where(is_query).select("dim").distinct().orderBy("dim").toLocalIterator():
        same = rows.where(F.col("dim") == dim)
        seed = _vectors(least(same.select("row", "vec_id", "v"), "row", sample).toArrow())
        size = max(1, min(block, BLOCK_BYTES // (8 * dim)))
        held: list = []
        for r in chain(same.where(is_query).select("row", "vec_id", "v").orderBy("vec_id", "row").toLocalIterator(), [None]):
            if r is not None:
                held.append(r)
            if held and (r is None or len(held) == size):
                qrow, qid, q = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), _scaled(np.array([x[2] for x in held], float))
                first = search_chunk(qrow, q, *seed, k, 1 - 1e-12)
                shared = spark.sparkContext.broadcast((qrow, qid, q, first.worst - 1e-9))
                part = same.select("row", "vec_id", "v").mapInArrow(_finder(shared, k, tau, chunk), "query_row long, query_id long, vec_id long, score double")
                found.append(ws.save(part, f"found{len(found)}"))
                shared.destroy()
                held = []
    if not found:
        return spark.range(0).selectExpr("id query_id", "cast(id as int) rank", "id vec_id", "cast(id as double) score", "id query_row")
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score", "query_row")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
