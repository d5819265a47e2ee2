"""Training plans: plain Newton, and impact coding of many-level variables with translation back."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import complete, text, unused, weight
from ..functions.formula import Formula
from ..operators.impact import code_tables, effect_table, impact_stats, translate, warm_start
from ..operators.layout import Layout, Slot, encode, make_layout, slot_effects
from ..operators.objective import DataObjective, NormPenalty, SumFn, all_but_const
from ..operators.schema import Schema, level_counts, schema_scan
from ..operators.score import predict
from ..sources.scratch import scratch
from .optim import conjugate_gradient, newton
from .progress import Ticking

#: Coefficients up to which Newton's method is the default; it forms their Hessian, 8 bytes a pair, in every task.
MAX_NEWTON = 3000
METHODS = ("newton", "cg")
#: Bytes of encoded rows a task, where their number is known.
TASK_BYTES = 16 << 20


@dataclass
class Model:
    layout: Layout
    x: np.ndarray
    config: dict = field(default_factory=dict)

    def to_json(self) -> str:
        f, s = self.layout.formula, self.layout
        return json.dumps({
            "formula": {"outcome": f.outcome, "variables": f.variables, "numeric": sorted(f.numeric), "categorical": sorted(f.categorical), "intercept": f.intercept},
            "outcomes": s.outcomes, "slots": [[t.variable, t.kind, t.start, t.names, t.held()] for t in s.slots], "x": list(map(float, self.x)), "config": self.config,
        })

    @staticmethod
    def from_json(text_: str) -> Model:
        d = json.loads(text_)
        f = d["formula"]
        formula = Formula(f["outcome"], tuple(f["variables"]), frozenset(f["numeric"]), frozenset(f["categorical"]), f["intercept"])
        slots = tuple(Slot(v, k, st, tuple(n), {a: tuple(b) for a, b in c.items()}) for v, k, st, n, c in d["slots"])
        return Model(Layout(formula, tuple(d["outcomes"]), slots), np.array(d["x"]), d["config"])


def _needed(df: DataFrame, formula: Formula, weight_col: str | None) -> DataFrame:
    return df.select(*[f"`{c}`" for c in dict.fromkeys([*formula.terms(), *([weight_col] if weight_col else [])])])


def objective(df: DataFrame, layout: Layout, weight_col: str | None, strength: float, mask: str = "all_but_const", approximate: bool = False, n_rows: int | None = None):
    """Data term and penalty; the encoded rows are cached, since every step scans them.  n_rows: their number, by which they are dealt out."""
    encoded = encode(df, layout, weight_col)
    if n_rows is not None:
        encoded = encoded.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(8 * n_rows * layout.width / TASK_BYTES)))
    encoded = encoded.persist()
    m = all_but_const(layout) if mask == "all_but_const" else None
    return SumFn(DataObjective(encoded, layout, approximate), NormPenalty(layout.dims, strength, m)), encoded


def _maximise(fn, x0, rounds: int, method: str | None):
    """method: newton or cg; by default newton where its Hessian is of MAX_NEWTON rows at most.  Both climb the same concave function."""
    method = method or ("newton" if fn.dims <= MAX_NEWTON else "cg")
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}: {method!r}")
    fn = Ticking(fn, f"fit by {method}")
    return newton(fn, x0, rounds) if method == "newton" else conjugate_gradient(fn, x0, 10 * rounds)


def train(df: DataFrame, formula: Formula | str, weight_col: str | None = None, strength: float = 1e-5, max_rounds: int = 10, mask: str = "all_but_const", schema: Schema | None = None, method: str | None = None, approximate: bool = False) -> Model:
    """Two schema scans, then Newton (or conjugate gradients, see `_maximise`) on the penalised log-likelihood; approximate: by `fast_exp`."""
    formula = Formula.parse(formula) if isinstance(formula, str) else formula
    df = _needed(df, formula, weight_col)
    layout = make_layout(formula, schema or schema_scan(df, formula))
    fn, encoded = objective(df, layout, weight_col, strength, mask, approximate)
    best = _maximise(fn, np.zeros(layout.dims), max_rounds, method)
    encoded.unpersist()
    return Model(layout, best.x, {"strength": strength, "objective": best.f})


def _summed(df: DataFrame, formula: Formula, schema: Schema, weight_col: str | None) -> tuple[DataFrame, str | None, int | None]:
    """Rows for the fit, the column of their weights, and their number where it is known.

    Where no variable is numeric, rows that are equal in all of them and in the
    outcome become one, with the sum of their weights: the statistics and the
    objective are the same.
    """
    if schema.numeric:
        return df, weight_col, None
    w, path = weight(weight_col, df), scratch(df.sparkSession, "rows")
    rows = df.where(complete(formula.variables) & F.coalesce(text(formula.outcome).isin(*schema.outcomes), F.lit(False))).where(w > 0)
    names = [*formula.terms(), *unused(formula.terms(), ["weight"])]
    rows = rows.select(*[text(t).alias(f"c{i}") for i, t in enumerate(formula.terms())], w.alias("w"))
    rows.groupBy(*rows.columns[:-1]).agg(F.sum("w").alias("w")).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).toDF(*names)
    return rows, names[-1], rows.count()


def _with_levels(df: DataFrame, formula: Formula, schema: Schema, layout: Layout | None, x, variables: list[str]) -> tuple[Schema, dict[str, np.ndarray]]:
    """The schema with the levels of these variables, and the effects (level x outcome) of those whose codes are on the cluster: one row a level."""
    levels, tables, k = dict(schema.levels), {}, len(schema.outcomes)
    slots = {s.variable: s for s in layout.slots} if layout else {}
    for v in variables:
        got = level_counts(df, formula, [v]).select("level")
        if v in slots:
            got = got.join(slot_effects(df.sparkSession, layout, x, slots[v]), "level", "left")
            got = got.withColumn("effect", F.coalesce("effect", F.array(*[F.lit(0.0)] * k)))
        got = got.toArrow().sort_by("level")
        levels[v] = tuple(got["level"].to_pylist())
        if v in slots:
            tables[v] = got["effect"].combine_chunks().flatten().to_numpy().reshape(-1, k)
    return replace(schema, levels=levels), tables


def train_plus(df: DataFrame, formula: Formula | str, weight_col: str | None = None, strength: float = 1e-5, max_levels: int = 100, passes: int = 5, max_rounds: int = 20, polish: bool = False, mask: str = "all_but_const", method: str | None = None) -> Model:
    """Variables of over max_levels levels are impact-coded and refitted for some passes; the result is in one-hot terms.

    Levels and their codes stay on the cluster; the driver gets a row a level once, for the result.
    """
    formula = Formula.parse(formula) if isinstance(formula, str) else formula
    df = _needed(df, formula, weight_col)
    schema = schema_scan(df, formula, max_levels)
    wide = [v for v, levels in schema.levels.items() if not levels]
    if not wide:
        return train(df, formula, weight_col, strength, max_rounds, mask, schema, method)
    plain = make_layout(formula, schema)
    rows, weights, n_rows = _summed(df, formula, schema, weight_col)
    (p,) = unused(rows.columns, ["p"])
    layout = x = fitted = None
    for _ in range(passes):
        if layout is None:
            coded = code_tables(impact_stats(rows, plain, wide, weights), plain.outcomes)
        else:
            stats = impact_stats(predict(rows, layout, x, p), plain, wide, weights, p)
            coded = code_tables(stats, plain.outcomes, effect_table(df.sparkSession, layout, x))
        schema, _ = _with_levels(df, formula, schema, None, None, [v for v in wide if v not in coded and not schema.levels[v]])
        new = make_layout(formula, schema, coded)
        x0 = np.zeros(new.dims) if layout is None else np.array(warm_start(layout, x, new))
        fn, encoded = objective(rows, new, weights, strength, mask, n_rows=n_rows)
        best = _maximise(fn, x0, max_rounds, method)
        encoded.unpersist()
        if fitted is not None and best.f - fitted <= max(1.0, best.f) * 1e-3:
            if best.f > fitted:
                layout, x, fitted = new, best.x, best.f
            break
        layout, x, fitted = new, best.x, best.f
    schema, tables = _with_levels(df, formula, schema, layout, x, [s.variable for s in layout.slots if s.table is not None])
    plain = make_layout(formula, schema)
    out = np.array(translate(layout, x, plain, tables))
    if polish:
        fn, encoded = objective(rows, plain, weights, strength, mask, n_rows=n_rows)
        out = conjugate_gradient(fn, out, 5).x
        encoded.unpersist()
    return Model(plain, out, {"strength": strength, "objective": fitted, "coded": wide})


def known(df: DataFrame, model: Model) -> DataFrame:
    return df.where(F.coalesce(text(model.layout.formula.outcome).isin(*model.layout.outcomes), F.lit(False)))
