"""Mixing sources to target weights by entropy balancing.

The mix keeps document rates r_d closest, in relative entropy, to 1 while each
source's words meet its target and no document is taken more than CAP times:

    minimise  sum r_d ln r_d - r_d + 1   s.t.  sum_{d in s} size_d r_d = T_s,  r_d <= CAP

The solution is the exponential tilt r_d = min(CAP, exp(l_s size_d)), and l_s
maximises the concave dual, whose slope is T_s - sum size_d r_d.  Documents of a
source that have one size share a rate, so the dual is summed over the table of
(source, size, documents), which one aggregation of all documents gives.  Every
Newton iteration is one aggregation of that table on the cluster, for all sources
at once; a step that leaves the bracket of the root is replaced by its middle,
and sums are decimal, so that they do not depend on the order of addition.  It
ends where every source's words are within `TOLERANCE` of its target.

Rounding: a document has floor(r_d) copies; of the rest f_d = r_d - floor(r_d)
it has one more where u_d / f_d is small, u_d a hash of its doc_id between 0 and
1 (sequential Poisson sampling), until the source's words are those of the
target; what is left at the boundary is a part of one document.  The boundary is
found by radix: each turn sums the words of 4096 ranges of that key and goes on
with the rows of one range, so no list of documents is sorted or moved.

Null texts have size 0 and are taken 0 times over; a null source is a source of
its own, last.  Rows that repeat a doc_id and a size share what falls on the
boundary.  An empty table gives no rows.  Texts are counted whole, of any length.
Other columns are passed on by `mix`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
WORD = r"[^\x20\x09-\x0D]+"
TOLERANCE = 1e-11
#: Bits of the rounding key, and of a range's number.
BITS, STEP = 52, 12


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """`s` (the source in a struct), `size`, `u` (the hash of doc_id, above 0 to 1) and the struct `row` of columns `keep`."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long") + 1) / float(1 << BITS)
    return docs.select(F.struct("source").alias("s"), size.alias("size"), u.alias("u"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))


def targets(totals: DataFrame) -> DataFrame:
    """(source, source_size) -> also target: shares by weight, stopped at CAP times the size, the excess reshared.

    The final shares are the water level of the capped sources: with sources in
    the order of CAP * size / weight, the first k are full and the rest share
    what those leave.  One row a source, so the one window is over sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("int"))
    t = totals.withColumn("weight", w)
    level = Window.orderBy(CAP * F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    all_ = Window.partitionBy()
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"total": F.sum("source_size").over(all_).cast("double"), "held": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * CAP, "rest": F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    share = (F.col("total") - F.col("held")) / F.col("rest")
    # The first source that isn't full has the level; later rows count sources as full that are not.
    t = t.withColumns({"open": CAP * F.col("source_size") > F.col("weight") * share, "share": share, "at": F.row_number().over(level)})
    t = t.withColumn("level", F.min(F.when(F.col("open"), F.struct("at", "share"))).over(all_))
    return t.select("source", "source_size", F.least(CAP * F.col("source_size"), F.coalesce(F.col("weight") * F.col("level.share"), F.lit(0.0))).alias("target"))


def _tilt() -> F.Column:
    """exp(l size / scale) of a row with its source's state."""
    return F.exp(F.col("l") * F.try_divide("size", "scale"))


def _rate() -> F.Column:
    return F.when(F.col("full"), F.lit(CAP)).when(F.col("l").isNull(), F.lit(0.0)).otherwise(F.least(F.lit(CAP), _tilt()))


def _base() -> F.Column:
    """Whole copies; safe against 1.9999999."""
    return F.least(F.floor(_rate() + 1e-9), F.lit(int(CAP))).cast("long")


def _key() -> F.Column:
    """Ascending with u / f, as an integer of BITS bits; null where there is no further copy to give."""
    f = _rate() - _base()
    return F.when((f > 0) & (F.col("size") > 0), F.least(F.floor(F.col("u") / (F.col("u") + F.greatest(f, F.lit(0.0))) * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("long"))


def balance(counts: DataFrame, ws: Workspace, rounds: int = 200) -> DataFrame:
    """(s, size, n) -> one row a source: s, source_size, target, scale (size of a typical word's document), l and full.

    l is null where there are no words or every document is taken CAP times.
    """
    words = F.sum(F.col("n") * F.col("size"))
    squares = F.sum(F.col("n") * F.col("size").cast("double") * F.col("size"))
    one = counts.groupBy("s").agg(words.alias("source_size"), squares.alias("squares"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    t = targets(one.select("s.source", "source_size")).select(F.struct("source").alias("s"), "target")
    state = one.join(t, "s").withColumns({"scale": F.try_divide("squares", "source_size"), "full": (F.col("source_size") > 0) & (F.col("target") >= CAP * F.col("source_size"))})
    ratio, least = F.log(F.try_divide("target", "source_size")), F.col("scale") / F.col("least")
    found = (F.col("source_size") > 0) & (F.col("target") > 0) & ~F.col("full")
    state = state.withColumns({"l": F.when(found, ratio), "lo": F.least(F.lit(0.0), ratio * least), "hi": math.log(CAP) * least, "off": F.when(found, F.lit(1.0)).otherwise(0.0)})
    state = ws.save(state.select("s", "source_size", "target", "scale", "full", "l", "lo", "hi", "off"), "state0")
    exact = lambda x: F.sum(x.cast("decimal(38,10)")).cast("double")
    weight = F.col("n") * F.col("size")
    for turn in range(1, rounds + 1):
        rows = counts.join(state.where(F.col("off") > TOLERANCE).select("s", "l", "scale", "full"), "s")
        slope = F.when(_tilt() < CAP, weight * F.col("size") / F.col("scale") * _tilt()).otherwise(0.0)
        sums = rows.groupBy("s").agg(exact(weight * _rate()).alias("got"), exact(slope).alias("slope"))
        new = state.join(sums, "s", "left").withColumn("over", F.col("got") - F.col("target"))
        new = new.withColumns({"lo": F.when(F.col("over") < 0, F.col("l")).otherwise(F.col("lo")), "hi": F.when(F.col("over") > 0, F.col("l")).otherwise(F.col("hi"))})
        step = F.col("l") - F.try_divide("over", "slope")
        inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        off = F.coalesce(F.try_divide(F.abs("over"), "target"), F.lit(0.0))
        new = new.withColumns({"off": off, "next": F.when(off <= TOLERANCE, F.col("l")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)})
        # A bracket without a number inside is as near as doubles come.
        new = new.withColumn("off", F.when((F.col("next") <= F.col("lo")) | (F.col("next") >= F.col("hi")), 0.0).otherwise(F.col("off")))
        worst = Observation()
        new = new.select("s", "source_size", "target", "scale", "full", F.col("next").alias("l"), "lo", "hi", "off")
        state = ws.save(new.observe(worst, F.max("off").alias("off")), f"state{turn}")
        if (worst.get["off"] or 0.0) <= TOLERANCE:
            break
    return state.select("s", "source_size", "target", "scale", "l", "full")


def plan(rows: DataFrame, ws: Workspace) -> DataFrame:
    """Of rows (s, size, u): one row a source with `balance`'s columns, `due` words of further copies, and the boundary: edge key, words before it and at it."""
    counts = ws.save(rows.groupBy("s", "size").agg(F.count("*").alias("n")), "counts")
    state = balance(counts, ws)
    copied = counts.join(state, "s").groupBy("s").agg(F.sum(F.col("n") * F.col("size") * _base()).alias("copied"))
    due = F.greatest(F.lit(0), F.least(F.round("target"), CAP * F.col("source_size")).cast("long") - F.coalesce("copied", F.lit(0)))
    state = ws.save(state.join(copied, "s", "left").withColumn("due", due).drop("copied"), "due")
    # The words of equal keys are one row from here on.
    left = rows.join(state.where("due > 0"), "s").select("s", _key().alias("key"), "size").where("key is not null")
    left = left.groupBy("s", "key").agg(F.sum("size").alias("words"))
    edge = state.where("due > 0").select("s", "due", F.lit(0).cast("long").alias("before"))
    for turn, shift in enumerate(range(BITS - STEP, -STEP, -STEP)):
        cell = F.shiftright("key", max(shift, 0)).alias("cell")
        cells = left.groupBy("s", cell).agg(F.sum("words").alias("words"), F.min("key").alias("low"), F.max("key").alias("high"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("s").orderBy("cell"))  # 4096 cells at most
        at = cells.join(edge.select("s", "due", "before"), "s").withColumn("upto", upto).where("upto >= due").groupBy("s").agg(F.min(F.struct("cell", "upto", "words", "low", "high", "due")).alias("c"))
        mixed = Observation()
        edge = at.select("s", "c.cell", "c.due", (F.col("c.upto") - F.col("c.words")).alias("before"), F.col("c.words").alias("at"), "c.low", "c.high")
        edge = ws.save(edge.observe(mixed, F.count_if(F.col("low") < F.col("high")).alias("n")), f"edge{turn}")
        if shift <= 0 or not (mixed.get["n"] or 0):
            break
        left = ws.save(left.withColumn("cell", cell).join(edge.select("s", "cell"), ["s", "cell"], "left_semi").drop("cell"), f"left{turn}")
    return state.join(edge.select("s", F.col("low").alias("edge"), "before", "at"), "s", "left")


def taken(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows (s, size, u, row) with their source's size, target, rate and the words taken."""
    key = _key()
    part = F.floor(F.col("size") * (F.col("due") - F.col("before")).cast("decimal(38,0)") / F.greatest(F.col("at"), F.lit(1))).cast("long")
    extra = F.when(key.isNull() | (F.col("due") <= 0), 0).when(F.col("edge").isNull() | (key < F.col("edge")), F.col("size")).when(key == F.col("edge"), part).otherwise(0)
    return rows.join(rates, "s").select("row", "size", "source_size", "target", _rate().alias("rate"), (_base() * F.col("size") + extra).cast("long").alias("taken"))


def with_taken(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs, and mix_size, mix_source_size, mix_target, mix_rate and mix_taken."""
    ws = Workspace(docs.sparkSession, "mixing")
    rows = ws.save(sized(docs, *keep), "rows")
    out = taken(rows, plan(rows, ws))
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *[F.col(c).alias(f"mix_{c}") for c in ("size", "source_size", "target", "rate", "taken")])


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix with the columns of docs: each as often as it is taken, a boundary document to the nearest copy."""
    ws = Workspace(docs.sparkSession, "mixing")
    rates = ws.save(plan(ws.save(sized(docs, "doc_id"), "rows"), ws), "rates")
    rows = taken(sized(docs, *docs.columns), rates)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = rows.select("row", F.explode(F.array_repeat(F.lit(1), copies)))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_taken(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return rows.select("doc_id", *[F.col(f"mix_{c}").alias(c) for c in ("size", "source_size", "target", "taken")])
