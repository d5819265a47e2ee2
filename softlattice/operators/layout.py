"""Column layout: [intercept] + numeric variables + one block of levels (or codes) a categorical, all name-sorted."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import complete, number, text, unused, weight
from ..functions.formula import Formula
from .schema import Schema

KIND = {"const": "Const", "numeric": "Numeric", "levels": "CategoricalLevels", "codes": "CategoricalVectorEnc"}
#: Tables of levels that hold up to so many numbers are broadcast; of larger ones Spark chooses the join.
BROADCAST_VALUES = 1_000_000


@dataclass(frozen=True)
class Slot:
    """A variable's columns [start, start + len(names)).

    codes: level -> values, for coded variables; table: the same on the cluster,
    (level, codes array<double>), so that the driver holds no level.
    """

    variable: str
    kind: str
    start: int
    names: tuple[str, ...]
    codes: dict[str, tuple[float, ...]] = field(default_factory=dict)
    table: DataFrame | None = field(default=None, compare=False)

    def held(self) -> dict[str, tuple[float, ...]]:
        if self.table is not None:
            raise ValueError(f"the codes of {self.variable} are on the cluster")
        return self.codes


@dataclass(frozen=True)
class Layout:
    formula: Formula
    outcomes: tuple[str, ...]
    slots: tuple[Slot, ...]

    @property
    def width(self) -> int:
        return sum(len(s.names) for s in self.slots)

    @property
    def dims(self) -> int:
        return self.width * len(self.outcomes)

    def category(self, outcome: str) -> int:
        return self.outcomes.index(outcome) if outcome in self.outcomes else -1


def make_layout(formula: Formula, schema: Schema, coded: dict[str, tuple[tuple[str, ...], dict[str, tuple[float, ...]] | DataFrame]] | None = None) -> Layout:
    """coded: variable -> (code names, level -> codes or a table of them) for those that impact codes replace."""
    slots, at = [], 0
    todo = [("", "const", ("",), {})] if formula.intercept else []
    todo += [(v, "numeric", ("",), {}) for v in schema.numeric]
    for v, levels in schema.levels.items():
        names, codes = (coded or {}).get(v, (None, None))
        todo.append((v, "levels", levels, {}) if codes is None else (v, "codes", names, codes))
    for v, kind, names, codes in todo:
        slots.append(Slot(v, kind, at, tuple(names), codes) if isinstance(codes, dict) else Slot(v, kind, at, tuple(names), {}, codes))
        at += len(names)
    return Layout(formula, schema.outcomes, tuple(slots))


def layout_table(spark: SparkSession, layout: Layout) -> DataFrame:
    rows = [(s.variable, KIND[s.kind], n, s.start + i) for s in layout.slots for i, n in enumerate(s.names)]
    return spark.createDataFrame(rows, "variable string, kind string, level string, idx int")


def _lookup(df: DataFrame, variable: str, table: list[tuple], level: str, column: str, kind: str) -> DataFrame:
    small = df.sparkSession.createDataFrame(table, f"`{level}` string, `{column}` {kind}")
    values = sum(len(r[1]) if isinstance(r[1], list) else 1 for r in table)
    return _joined(df, variable, F.broadcast(small) if values <= BROADCAST_VALUES else small, level)


def _joined(df: DataFrame, variable: str, table: DataFrame, level: str) -> DataFrame:
    return df.join(table, text(variable) == F.col(level), "left").drop(level)


def join_effects(df: DataFrame, layout: Layout, x, slot: Slot, level: str, column: str) -> DataFrame:
    """df with `column`, the array of the outcomes' effects of the level that slot's variable has; null for an unknown one."""
    table = slot_effects(df.sparkSession, layout, x, slot).select(F.col("level").alias(level), F.col("effect").alias(column))
    known = slot.names if slot.kind == "levels" else slot.codes
    return _joined(df, slot.variable, F.broadcast(table) if slot.table is None and len(known) * len(layout.outcomes) <= BROADCAST_VALUES else table, level)


def encode(df: DataFrame, layout: Layout, weight_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """category (-1: unknown), weight, num (dense values: intercept, numbers, codes), cat (column of each level, -1: unknown).

    Incomplete rows are left out.  The `num` values stand for the layout's
    dense columns in order (`dense_columns`).
    """
    f = layout.formula
    rows = df.where(complete(f.variables))
    level, *found_in = unused(df.columns, ["level", *(f"c{i}" for i in range(len(layout.slots)))])
    num: list[Column] = []
    cat: list[Column] = []
    for i, s in enumerate(layout.slots):
        if s.kind == "const":
            num.append(F.array(F.lit(1.0)))
        elif s.kind == "numeric":
            num.append(F.array(F.coalesce(number(s.variable, df), F.lit(0.0))))
        elif s.table is not None:
            rows = _joined(rows, s.variable, s.table.select(F.col("level").alias(level), F.col("codes").alias(found_in[i])), level)
            num.append(F.coalesce(F.col(found_in[i]), F.array(*[F.lit(0.0)] * len(s.names)).cast("array<double>")))
        elif s.kind == "levels":
            rows = _lookup(rows, s.variable, [(n, s.start + j) for j, n in enumerate(s.names)], level, found_in[i], "int")
            cat.append(F.coalesce(F.col(found_in[i]), F.lit(-1)))
        else:
            rows = _lookup(rows, s.variable, [(n, list(v)) for n, v in s.codes.items()], level, found_in[i], "array<double>")
            num.append(F.coalesce(F.col(found_in[i]), F.array(*[F.lit(0.0)] * len(s.names)).cast("array<double>")))
    found = F.lit(-1)
    if f.outcome in df.columns:
        for c, o in enumerate(layout.outcomes):
            found = F.when(text(f.outcome) == o, c).otherwise(found)
    flat = F.flatten(F.array(*num)) if num else F.array().cast("array<double>")
    cats = F.array(*cat) if cat else F.array().cast("array<int>")
    return rows.select(*(keep or []), found.cast("int").alias("category"), weight(weight_col, df).alias("weight"), flat.alias("num"), cats.alias("cat"))


def dense_columns(layout: Layout) -> list[int]:
    return [s.start + j for s in layout.slots if s.kind != "levels" for j in range(len(s.names))]


def encode_long(df: DataFrame, layout: Layout, key: str) -> DataFrame:
    """(key, idx, val) of every non-zero feature."""
    rows = encode(df, layout, keep=[key])
    dense = F.transform(F.array(*map(F.lit, dense_columns(layout))), lambda i, p: F.struct(i.cast("int").alias("idx"), F.get("num", p).alias("val")))
    marks = F.transform("cat", lambda i: F.struct(i.alias("idx"), F.lit(1.0).alias("val")))
    return rows.select(key, F.explode(F.concat(dense, marks)).alias("e")).select(key, "e.idx", "e.val").where("idx >= 0 and val <> 0")


def solution_rows(layout: Layout, x) -> list[tuple]:
    """(outcome, outcomegroup, variable, kind, level, value) of every coefficient."""
    d = layout.width
    return [(o, c, s.variable, KIND[s.kind], n, float(x[c * d + s.start + i])) for c, o in enumerate(layout.outcomes) for s in layout.slots for i, n in enumerate(s.names)]


def format_solution(spark: SparkSession, layout: Layout, x) -> DataFrame:
    return spark.createDataFrame(solution_rows(layout, x), "outcome string, outcomegroup int, variable string, kind string, level string, value double")


def effects(layout: Layout, x, detailed: bool = False) -> list[tuple[str, int, str, float]]:
    """(variable, category, level, effect); detailed: also each code's part, as `<level>_<code>`."""
    out, d = [], layout.width
    for c in range(len(layout.outcomes)):
        for s in layout.slots:
            b = x[c * d + s.start : c * d + s.start + len(s.names)]
            if s.kind != "codes":
                out += [(s.variable, c, n, float(v)) for n, v in zip(s.names, b, strict=True)]
                continue
            for level, codes in s.held().items():
                parts = [float(v * w) for v, w in zip(codes, b, strict=True)]
                out.append((s.variable, c, f"{level}_effect" if detailed else level, sum(parts)))
                if detailed:
                    out += [(s.variable, c, f"{level}_{n}", p) for n, p in zip(s.names, parts, strict=True)]
    return out


def slot_effects(spark: SparkSession, layout: Layout, x, slot: Slot) -> DataFrame:
    """(level, effect): of each level of a categorical the effects on all outcomes, as an array."""
    b = np.asarray(x, float).reshape(len(layout.outcomes), layout.width)[:, slot.start : slot.start + len(slot.names)]
    if slot.table is not None:
        dot = lambda row: F.aggregate(F.zip_with("codes", F.array(*map(F.lit, row)), lambda a, c: a * c), F.lit(0.0), lambda a, c: a + c)
        return slot.table.select("level", F.array(*map(dot, b.tolist())).alias("effect"))
    if slot.kind == "levels":
        levels, effect = slot.names, b.T
    else:
        levels, effect = list(slot.codes), np.array([[sum(v * w for v, w in zip(codes, row, strict=True)) for row in b.tolist()] for codes in slot.codes.values()])
    at = pa.array(np.arange(len(levels) + 1) * len(b), pa.int32())
    table = pa.table({"level": pa.array(levels, pa.string()), "effect": pa.ListArray.from_arrays(at, pa.array(np.ravel(effect).astype(float), pa.float64()))})
    return spark.createDataFrame(table, "level string, effect array<double>")


def effect_of(layout: Layout, x, variable: str, value: str | None, category: int = 0) -> float:
    """Contribution of one seen value; an unknown level has none."""
    for s in layout.slots:
        if s.variable == variable:
            b = x[category * layout.width + s.start :]
            if s.kind == "const":
                return float(b[0])
            if s.kind == "numeric":
                return float(b[0]) * float(value)
            if s.kind == "levels":
                return float(b[s.names.index(value)]) if value in s.names else 0.0
            return float(sum(v * w for v, w in zip(s.held().get(value, ()), b, strict=False)))
    return 0.0
