"""MinHash near-duplicates: one-permutation hashing, banded buckets, star edges.

1. Each document's distinct 5-word shingles become 64-bit hashes; equal sets
   collapse to one node by a 128-bit key of the whole set.
2. One-permutation signature: the top bits of a shingle's hash name one of 256
   bins, the least hash of a bin is its value, and empty bins take the value of
   the first filled bin in their own pseudo-random probe order (optimal
   densification, Shrivastava, ICML 2017).
3. 51 bands of 5 bins: a pair of similarity 0.75 shares no bucket with
   probability (1 - 0.75^5)^51, about 1e-6.
4. Each bucket gives star edges, every member to the bucket's centre, so edges
   are linear in bucket rows.  They are confirmed on full sets; confirmed
   links give components.  The first centre is the member that shares most
   buckets with others, which is near the source of a group of copies; two
   more turns take a random centre and only members of other components.
5. A bucket whose members then lie in one component has nothing to add.  Of
   the others, small ones (`small` members at most) give their remaining pairs
   across components; the members of larger ones go to an exact prefix-filter
   join (rarest shingles first, of those that
   several components hold), where passages that many documents share come
   last and a pair counts at its first common shingle only.  The members of a
   bucket or shingle are dealt to blocks and meet by pairs of blocks, so no task
   holds a large group.  Either way a pair is a row only if parity sketches of
   both sets allow the similarity (`sketch`).  These pairs are confirmed too, and
   the components united.

The sets of documents that share a bucket are written once and read by every
step after.  Texts are whole, of any length; a long one is one row of its set.

Null or empty text, or no word: empty set, linked with nothing, its own
component.  doc_id names a document: rows that repeat one share its component,
and where their texts differ, the least of their sets stands for it in links;
`keep_one` keeps one row of them, of the least text hash.  A row without a
doc_id takes no part: its component is null, and it is kept.  An empty table
gives no rows.  Columns other than doc_id and text are not read, whatever their
names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .text import shingles, splitmix, words
from .workspace import Workspace, release, small_batches

BINS, BAND, K = 256, 5, 5
_SHIFT = np.uint64(64 - 8)
_SALT = np.uint64(0x5851F42D4C957F2D)
_probe: list[np.ndarray] = []


def probes() -> np.ndarray:
    """Row t: where each bin looks on its t-th try."""
    if not _probe:
        tries = splitmix(np.arange(BINS * 4096, dtype=np.uint64) ^ _SALT) >> _SHIFT
        _probe.append(tries.reshape(4096, BINS).astype(np.int64))
    return _probe[0]


def signature(shingle: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of sorted distinct hashes (one at least)."""
    bins = (shingle >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    value, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    value[bins[first]], filled[bins[first]] = shingle[first], True
    empty = np.flatnonzero(~filled)
    out = value.copy()
    for row in probes():
        if not len(empty):
            return out
        at = row[empty]
        hit = filled[at]
        out[empty[hit]] = value[at[hit]]
        empty = empty[~hit]
    out[empty] = shingle[0]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    n = BINS // BAND
    table = splitmix(sig[: n * BAND]).reshape(n, BAND)
    total = np.arange(n, dtype=np.uint64)
    for j in range(BAND):
        total = splitmix(total * np.uint64(31) + table[:, j])
    return total


def _by_document(batch: pa.RecordBatch):
    w = words(batch.column("text"))
    for i in range(batch.num_rows):
        yield shingles(w.hash[w.doc[i] : w.doc[i + 1]], K)


def _longs(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.uint64).view(np.int64)))


def _sign(batches):
    for batch in batches:
        n, one, two, band = [], [], [], []
        for s in _by_document(batch):
            n.append(len(s))
            if len(s):
                one.append(splitmix(s).sum(dtype=np.uint64))
                two.append(splitmix(s ^ _SALT).sum(dtype=np.uint64))
                band.append(bands(signature(s)))
            else:
                one.append(0)
                two.append(0)
                band.append(np.zeros(0, np.uint64))
        key = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), key(one), key(two), _longs(band)], names=["doc_id", "n_shingles", "key1", "key2", "bands"])


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _longs(list(_by_document(batch)))], names=["doc_id", "shingles"])


SKETCH = 1024
_SAMPLE = 16


def sketch(shingle: np.ndarray) -> np.ndarray:
    """Parity bits of the set (1024), and of the sixteenth of it whose hashes say so (1024), as 32 longs.

    The exclusive or of two sets' bits is that of their symmetric difference, so
    its ones are never more than the difference has elements.
    """
    h = splitmix(shingle ^ np.uint64(0xD1B54A32D192ED03))
    out = []
    for part in (h, h[(h >> np.uint64(32)) % np.uint64(_SAMPLE) == 0]):
        bits = np.bincount((part % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
        out.append(np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64))
    return np.concatenate(out)


def _sketches(batches):
    for batch in batches:
        rows = [np.asarray(x.values, np.int64).view(np.uint64) for x in batch.column("shingles")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _longs([sketch(x) for x in rows])], names=["doc_id", "bits"])


def _may_reach(na: str, nb: str, percent: int, exact: bool = False) -> F.Column:
    """Whether sketches `ba` and `bb` allow the similarity; exact: only the bound that never errs.

    It needs a difference of (100 - percent) / (100 + percent) of both sizes at
    most.  The ones may not exceed that many, nor, where many elements meet in a
    bit, their expectation by more than six standard deviations; likewise for
    the sample, whose own size varies.
    """
    ones = lambda lo: sum((F.bit_count(F.col("ba")[i].bitwiseXOR(F.col("bb")[i])) for i in range(lo, lo + 16)), F.lit(0))
    most = (F.col(na) + F.col(nb)) * (100 - percent) / (100 + percent)
    if exact:
        return ones(0) <= most
    bound = lambda d: F.least(d, SKETCH / 2 * (1 - F.exp(-2 * d / SKETCH)) + 3 * math.sqrt(SKETCH))
    part = most / _SAMPLE
    return (ones(0) <= bound(most)) & (ones(16) <= bound(part + 6 * F.sqrt(part) + 10))


#: Ids up to this many (8 MB) are broadcast to the scan; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of some documents, computed again from their texts: (doc_id, shingles)."""
    small = ids.count() <= BROADCAST_IDS
    some = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    return some.mapInArrow(_sets, "doc_id long, shingles array<long>").groupBy("doc_id").agg(F.min("shingles").alias("shingles"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity on their full sets."""
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _near_sizes(a: str, b: str, percent: int) -> F.Column:
    """The smaller set must have that share of the larger, or no overlap suffices."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _open(bucket: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """The rows of buckets whose members lie in more than one component."""
    mixed = bucket.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
    return bucket.join(ws.save(mixed, name), "h")


def _stars(bucket: DataFrame, percent: int, ws: Workspace, name: str) -> DataFrame:
    """Candidate edges: each bucket's member of highest rank to its members of other components.

    The centres are written first, so that the join with them is one of two plain
    shuffles, which Spark splits where a bucket is large.
    """
    centre = bucket.groupBy("h").agg(F.max(F.struct("rank", F.col("node").alias("centre"), F.col("n").alias("cn"), F.col("component").alias("cc"))).alias("c")).select("h", "c.centre", "c.cn", "c.cc")
    edge = bucket.join(ws.save(centre, name), "h").where("component <> cc").where(_near_sizes("n", "cn", percent))
    return edge.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


#: Members of a group in one block: two blocks are compared in about a second, and a row is copied once for each.
BLOCK = 4096


def _across(rows: DataFrame, bits: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Pairs across components of rows (h, node, n, component, rest, members) with the same h.

    rest: how many of the node's shingles can still be common when h is the first
    that is.  A group of `members` rows is dealt to blocks, and each pair of blocks
    is a key of its own: the rows of two blocks meet in one place only.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.join(bits, "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    side = lambda x: rows.select("h", "i", "j", F.col("node").alias(x), *[F.col(c).alias(k + x) for c, k in (("n", "n"), ("component", "c"), ("bits", "b"), ("rest", "r"), ("block", "g"))])
    enough = F.least("ra", "rb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    meet = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ((F.col("i") == F.col("j")) | (F.col("ga") != F.col("gb")))
    pairs = side("a").join(side("b"), ["h", "i", "j"]).where(meet & _near_sizes("na", "nb", percent) & enough & _may_reach("na", "nb", percent, exact))
    return pairs.select("a", "b").distinct()


def _rest(left: DataFrame, sets: DataFrame, ws: Workspace, percent: int, small: int, exact: bool) -> DataFrame:
    """Candidate pairs across components, from buckets of three or more that star edges did not settle."""
    left = left.where("size > 2")
    if left.isEmpty():
        return left.selectExpr("node as a", "node as b").limit(0)
    ids = left.select(F.col("node").alias("doc_id")).distinct()
    bits = ws.save(sets.join(ids, "doc_id", "left_semi").mapInArrow(_sketches, "doc_id long, bits array<long>"), "bits").withColumnRenamed("doc_id", "node")
    pairs = _across(left.where(F.col("size") <= small).withColumns({"rest": F.col("n"), "members": F.col("size")}), bits, percent, exact)
    large = ws.save(left.where(F.col("size") > small).select("node", "n", "component").distinct(), "large")
    if large.isEmpty():
        return pairs
    token = sets.withColumnRenamed("doc_id", "node").join(large, "node").select("node", "n", "component", F.explode("shingles").alias("h"))
    # Shingles of one component only can link nothing new: they come first in the order of the
    # prefix filter, so of n shingles with m open ones the prefix holds m - need + 1 open ones.
    often = ws.save(token.groupBy("h").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h", "df"), "often")
    ranked = token.join(often, "h").groupBy("node", "n", "component").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t"))
    length = (F.size("t") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    prefix = ranked.withColumn("m", F.size("t")).withColumn("length", length).where("length > 0")
    prefix = prefix.select("node", "n", "component", "m", F.posexplode(F.slice("t", F.lit(1), F.col("length"))).alias("at", "t"))
    prefix = ws.save(prefix.select("node", "n", "component", F.col("t.h").alias("h"), (F.col("m") - F.col("at")).alias("rest")), "prefix")
    members = ws.save(prefix.groupBy("h").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h", "members"), "members")
    return pairs.union(_across(prefix.join(members, "h"), bits, percent, exact)).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, small: int = 32, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; exact: bar no pair by an estimate (see `_may_reach`)."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "minhash")
    docs = docs.select("doc_id", "text")
    signed = ws.save(docs.mapInArrow(_sign, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    node = ws.save(full.groupBy("key1", "key2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "node")

    rows = node.select("node", "n", F.explode("bands").alias("h"))
    shared = ws.save(rows.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    bucket = ws.save(rows.join(shared, "h"), "bucket")
    crowd = ws.save(bucket.groupBy("node").agg(F.sum("size").alias("crowd")), "crowd")
    sets = ws.save(_set_table(docs, crowd.select(F.col("node").alias("doc_id"))), "sets")
    bucket = bucket.join(crowd, "node").withColumn("component", F.col("node"))

    links, last = None, None
    for turn, rank in enumerate(("crowd", F.xxhash64("node", "h"), F.xxhash64("h", "node"))):
        stars = ws.save(_stars(bucket.withColumn("rank", F.col(rank) if isinstance(rank, str) else rank), percent, ws, f"centre{turn}"), f"stars{turn}")
        if turn and stars.isEmpty():
            break
        found = ws.save(_confirm(stars, sets, percent), f"links{turn}")
        links = found if links is None else links.union(found)
        last = components(_edges(links), ws, f"turn{turn}")
        bucket = bucket.drop("component").join(last, "node", "left").withColumn("component", F.coalesce("component", "node"))
        bucket = ws.save(_open(bucket, ws, f"mixed{turn}"), f"open{turn}")
        release(spark)
    rest = ws.save(_rest(bucket, sets, ws, percent, small, exact), "rest")
    if not rest.isEmpty():
        found = ws.save(_confirm(rest, sets, percent), "links")
        last = components(_edges(links.union(found)), ws, "last")
    ws.drop("shared", "bucket", "crowd", "sets", *[f"{x}{i}" for x in ("centre", "mixed", "open") for i in range(3)], "large", "often", "prefix", "members", "bits", "rest")
    copies = node.where("node <> last").select("key1", "key2", "node")
    out = signed.select("doc_id", "n_shingles", "key1", "key2").join(copies, ["key1", "key2"], "left").withColumn("node", F.coalesce("node", "doc_id"))
    out = out.join(last, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns; of rows that repeat its doc_id, the one of least text hash."""
    ws = Workspace(docs.sparkSession, "kept")
    found = ws.save(near_duplicates(docs).where("doc_id is not null").select("doc_id", "kept"), "found")
    gone = found.where("not kept").select("doc_id").distinct()
    again = found.where("kept").groupBy("doc_id").agg(F.count("*").alias("_times")).where("_times > 1").select("doc_id")
    if again.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = ws.save(again, "again")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    one = docs.join(again, "doc_id", "left_semi").select("doc_id", F.struct(F.xxhash64("text"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])).alias("least"), whole)
    one = one.groupBy("doc_id").agg(F.min_by("row", "least").alias("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return docs.join(gone.union(again), "doc_id", "left_anti").select(*docs.columns).union(one)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
