"""Impact codes: a categorical of many levels becomes a few statistics of each level.

Statistics per (variable, level, outcome) come from one groupBy over rows that
carry their current predictions; codes are a projection of them.  Smoothing
constants: SMOOTH added to counts, predictions clipped at CLIP / K.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import complete, text, weight
from ..sources.scratch import scratch
from .layout import Layout, effects, slot_effects

SMOOTH, CLIP = 0.5, 0.1
#: Names of the codes, in their order within an outcome.
CODES = ("effectTerm", "logbayes", "runTerm", "logRunTerm", "runTermF", "logRunTermF", "balance", "balanceLR", "superBalance", "superBalanceLR")


def impact_stats(df: DataFrame, layout: Layout, variables: Sequence[str], weight_col: str | None = None, predictions: str | None = None) -> DataFrame:
    """Per variable, level and outcome: n, nc, p, r, rc, pc, and the outcome's and the whole weight.

    predictions: an array column of current probabilities; uniform without one.
    """
    k = len(layout.outcomes)
    y = text(layout.formula.outcome)
    rows = df.where(complete(layout.formula.variables) & F.coalesce(y.isin(*layout.outcomes), F.lit(False))).where(weight(weight_col, df) > 0)
    probs = F.col(predictions) if predictions else F.array(*[F.lit(1.0 / k)] * k)
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), text(v).alias("level")) for v in variables])).alias("v")
    rows = rows.select(weight(weight_col, df).alias("_w"), y.alias("_y"), probs.alias("_p"), pairs).select("_w", "_y", "_p", "v.variable", "v.level")
    w, clip, aggs = F.col("_w"), CLIP / k, []
    for i, o in enumerate(layout.outcomes):
        p, mine = F.get("_p", F.lit(i)), F.col("_y") == o
        up, down = w / F.greatest(p, F.lit(clip)), w / F.greatest(1 - p, F.lit(clip))
        aggs.append(F.struct(
            F.lit(o).alias("outcome"), F.sum(F.when(mine, w).otherwise(0.0)).alias("nc"), F.sum(w * p).alias("p"), F.sum(F.when(mine, up).otherwise(-down)).alias("r"),
            F.sum(F.when(mine, up).otherwise(0.0)).alias("rc"), F.sum(F.when(mine, w * p).otherwise(0.0)).alias("pc"),
        ))
    by = rows.groupBy("variable", "level").agg(F.sum("_w").alias("n"), F.array(*aggs).alias("o")).select("variable", "level", "n", F.explode("o").alias("o")).select("variable", "level", "n", "o.*")
    return _with_whole(by)


def _with_whole(by: DataFrame) -> DataFrame:
    """Adds each outcome's weight and the total: the same for every variable, so from its own levels' sums."""
    whole = by.groupBy("variable", "outcome").agg(F.sum("nc").alias("outcome_weight"), F.sum("n").alias("total_weight"))
    return by.join(F.broadcast(whole), ["variable", "outcome"])


def merge_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """The statistics of the rows of both; a level that one lacks has none there."""
    sums = [F.sum(c).alias(c) for c in ("n", "nc", "p", "r", "rc", "pc")]
    return _with_whole(a.unionByName(b).groupBy("variable", "level", "outcome").agg(*sums))


def print_codes(codes: DataFrame, rows: int = 100) -> str:
    """The code table as tab-separated lines, ordered, `rows` of them at most (`codes` itself holds all)."""
    got = codes.orderBy("variable", "level", "outcome", "code").limit(rows).collect()
    return "\n".join(["\t".join(codes.columns), *("\t".join(map(str, r)) for r in got)])


def impact_codes(stats: DataFrame, effect: DataFrame | None = None) -> DataFrame:
    """(variable, level, outcome, code, value); effect: (variable, level, outcome, effect) of the model before."""
    stats, value = _code_values(stats, effect)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), v.alias("value")) for c, v in value.items()])).alias("c")
    return stats.select("variable", "level", "outcome", each).select("variable", "level", "outcome", "c.code", "c.value")


def _code_values(stats: DataFrame, effect: DataFrame | None) -> tuple[DataFrame, dict[str, Column]]:
    """The statistics, with the effects if there are any, and each code as an expression of them."""
    a = SMOOTH
    run, run_f = (F.col("rc") + a) / (F.col("nc") + a), (F.col("r") + a) / (F.col("n") + a)
    value = {
        "logbayes": F.log((F.col("total_weight") + a) * (F.col("nc") + a) / ((F.col("outcome_weight") + a) * (F.col("n") + a))),
        "runTerm": run, "logRunTerm": F.log(run), "runTermF": run_f, "logRunTermF": F.when(run_f > 0, F.log(run_f)).otherwise(float("nan")),
        "balance": (F.col("nc") - F.col("p")) / (F.col("n") + a), "balanceLR": F.log((F.col("nc") + a) / (F.col("p") + a)),
        "superBalance": (F.col("nc") - F.col("pc")) / (F.col("n") + a), "superBalanceLR": F.log((F.col("nc") + a) / (F.col("pc") + a)),
    }
    if effect is not None:
        stats = stats.join(effect, ["variable", "level", "outcome"], "left")
        value = {"effectTerm": F.coalesce("effect", F.lit(0.0))} | value
    return stats, value


def impact_code_filter(codes: DataFrame) -> DataFrame:
    """Codes whose squares sum over levels to more than 1e-12; one NaN drops a code."""
    norm = codes.groupBy("variable", "outcome", "code").agg(F.sum(F.col("value") * F.col("value")).alias("norm"))
    good = norm.where(~F.isnan("norm") & (F.col("norm") > 1e-12)).select("variable", "outcome", "code")
    return codes.join(F.broadcast(good), ["variable", "outcome", "code"], "left_semi")


def collect_codes(codes: DataFrame, outcomes: Sequence[str]) -> dict[str, tuple[tuple[str, ...], dict[str, tuple[float, ...]]]]:
    """variable -> (code names, level -> values), as large as the level tables; `code_tables` leaves these on the cluster."""
    got: dict[str, dict[tuple[int, int], dict[str, float]]] = {}
    for v, level, o, code, value in codes.select("variable", "level", "outcome", "code", "value").collect():
        got.setdefault(v, {}).setdefault((outcomes.index(o), CODES.index(code)), {})[level] = value
    out = {}
    for v, cols in got.items():
        order = sorted(cols)
        levels = sorted(set().union(*[cols[c].keys() for c in order]))
        out[v] = (tuple(f"{CODES[c]}_{outcomes[o]}" for o, c in order), {lv: tuple(cols[c].get(lv, 0.0) for c in order) for lv in levels})
    return out


def code_tables(stats: DataFrame, outcomes: Sequence[str], effect: DataFrame | None = None) -> dict[str, tuple[tuple[str, ...], DataFrame]]:
    """variable -> (names, table (level, codes)) of the codes that `impact_code_filter` would leave; the driver gets one row a variable and outcome.

    A row of the statistics gets all its codes as one array; the tables are Parquet files, so they are computed once.
    """
    spark = stats.sparkSession
    stats, value = _code_values(stats, effect)
    path = scratch(spark, "codes")
    stats.select("variable", "level", "outcome", F.array(*value.values()).alias("v")).write.parquet(f"{path}/outcomes")
    rows, known = spark.read.parquet(f"{path}/outcomes"), list(value)
    norms = rows.groupBy("variable", "outcome").agg(*[F.sum(F.get("v", F.lit(i)) * F.get("v", F.lit(i))).alias(c) for i, c in enumerate(known)]).collect()
    good: dict[str, list[tuple[int, int]]] = {}
    for r in norms:
        good.setdefault(r["variable"], []).extend((outcomes.index(r["outcome"]), CODES.index(c)) for c in known if r[c] is not None and r[c] > 1e-12)
    out = {}
    for n, v in enumerate(sorted(good)):
        picked = sorted(good[v])
        if picked:
            of = rows.where(F.col("variable") == v).groupBy("level").agg(F.map_from_entries(F.collect_list(F.struct("outcome", "v"))).alias("of"))
            codes = [F.coalesce(F.get(F.col("of")[outcomes[o]], F.lit(known.index(CODES[c]))), F.lit(0.0)) for o, c in picked]
            of.select("level", F.array(*codes).alias("codes")).write.parquet(f"{path}/{n}")
            out[v] = (tuple(f"{CODES[c]}_{outcomes[o]}" for o, c in picked), spark.read.parquet(f"{path}/{n}"))
    return out


def warm_start(old: Layout, x, new: Layout):
    """Coefficients in the new layout that predict as the old model: 1 on each outcome's own effectTerm, others copied."""
    out = [0.0] * new.dims
    was = {s.variable: s for s in old.slots}
    for c, o in enumerate(new.outcomes):
        for s in new.slots:
            for i, n in enumerate(s.names):
                at = c * new.width + s.start + i
                if s.kind == "codes":
                    out[at] = 1.0 if n == f"effectTerm_{o}" else 0.0
                elif s.variable in was:
                    out[at] = float(x[c * old.width + was[s.variable].start + i])
    return out


def translate(coded: Layout, x, plain: Layout, tables: dict[str, np.ndarray] | None = None):
    """Coefficients in the one-hot layout that predict as the coded model.

    tables: of the variables whose codes are on the cluster, the effects (level x outcome) in the order of plain's names.
    """
    tables, k = tables or {}, len(plain.outcomes)
    was, old = {s.variable: s for s in coded.slots}, np.asarray(x, float).reshape(k, coded.width)
    out = np.zeros((k, plain.width))
    for s in plain.slots:
        t, to = was[s.variable], slice(s.start, s.start + len(s.names))
        b = old[:, t.start : t.start + len(t.names)]
        if s.variable in tables:
            out[:, to] = tables[s.variable].T
        elif t.kind != "codes":
            out[:, to] = b
        else:
            codes = t.held()
            for i, n in enumerate(s.names):
                if n in codes:
                    out[:, s.start + i] = [sum(v * w for v, w in zip(codes[n], row, strict=True)) for row in b.tolist()]
    return out.ravel().tolist()


def effect_table(spark, layout: Layout, x) -> DataFrame:
    """(variable, level, outcome, effect) of the finite effects."""
    here = replace(layout, slots=tuple(s if s.table is None else replace(s, codes={}, table=None) for s in layout.slots))
    rows = [(v, level, layout.outcomes[c], e) for v, c, level, e in effects(here, x) if v and math.isfinite(e)]
    out = spark.createDataFrame(rows, "variable string, level string, outcome string, effect double")
    for s in layout.slots:
        if s.table is not None:
            pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, layout.outcomes)).alias("outcome"), "effect")).alias("e")
            more = slot_effects(spark, layout, x, s).select(F.lit(s.variable).alias("variable"), "level", pairs).select("variable", "level", "e.outcome", "e.effect")
            out = out.union(more.where(F.abs("effect") < float("inf")))  # NaN is above infinity
    return out
