"""Schema inference: kinds of variables, outcomes, levels, and keyed sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import complete, number, text, weight
from ..functions.formula import Formula


@dataclass(frozen=True)
class Schema:
    """Name-sorted outcomes, numeric variables, and the sorted levels of each categorical."""

    outcomes: tuple[str, ...]
    numeric: tuple[str, ...]
    levels: dict[str, tuple[str, ...]]

    def copy(self) -> Schema:
        return Schema(self.outcomes, self.numeric, dict(self.levels))


def complete_rows(df: DataFrame, formula: Formula) -> DataFrame:
    return df.where(complete(formula.variables))


def infer_kinds(df: DataFrame, formula: Formula) -> DataFrame:
    """(variable, kind): numeric unless a complete row holds something else; forced kinds stand."""
    rows = complete_rows(df, formula)
    one = rows.agg(*[F.coalesce(F.bool_and(number(v, df).isNotNull()), F.lit(True)).alias(v) for v in formula.variables])
    kind = lambda v: "numeric" if v in formula.numeric else "categorical" if v in formula.categorical else None
    structs = [F.struct(F.lit(v).alias("variable"), F.lit(kind(v)).alias("kind") if kind(v) else F.when(F.col(f"`{v}`"), "numeric").otherwise("categorical").alias("kind")) for v in formula.variables]
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.variable", "s.kind")


def outcome_levels(df: DataFrame, formula: Formula) -> DataFrame:
    return complete_rows(df, formula).select(text(formula.outcome).alias("outcome")).where("length(outcome) > 0").distinct()


def outcome_index(df: DataFrame, formula: Formula) -> DataFrame:
    """(outcome, category): name-sorted from 0."""
    return outcome_levels(df, formula).select("outcome", (F.row_number().over(Window.orderBy("outcome")) - 1).cast("int").alias("category"))


def level_counts(df: DataFrame, formula: Formula, variables: list[str]) -> DataFrame:
    """(variable, level, n) over complete rows; one pass for all variables."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), text(v).alias("level")) for v in variables])).alias("p")
    rows = complete_rows(df, formula).select(pairs).select("p.variable", "p.level")
    return rows.where("length(level) > 0").groupBy("variable", "level").agg(F.count("*").alias("n"))


def trim_stuck(levels: DataFrame) -> DataFrame:
    """Levels of the variables that have two or more."""
    more = levels.groupBy("variable").agg(F.count("*").alias("n_levels")).where("n_levels > 1").select("variable")
    return levels.join(more, "variable", "left_semi")


def merge_levels(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("variable", "level").agg(F.sum("n").alias("n"))


def merge_kinds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Categorical wins over numeric; min() of the names has that effect."""
    return a.union(b).groupBy("variable").agg(F.min("kind").alias("kind"))


def schema_scan(df: DataFrame, formula: Formula, most: int | None = None) -> Schema:
    """Two scans: kinds, then levels.  The result is as large as the level tables.

    most: a variable of more levels than that has none here, its level table stays on the cluster.
    """
    df = df.select(*[f"`{t}`" for t in formula.terms()])
    kinds = {r[0]: r[1] for r in infer_kinds(df, formula).collect()}
    cat = sorted(v for v, k in kinds.items() if k == "categorical")
    outcomes = tuple(sorted(r[0] for r in outcome_levels(df, formula).collect()))
    levels: dict[str, list[str]] = {}
    if cat:
        counts = trim_stuck(level_counts(df, formula, cat))
        wide = [] if most is None else [r[0] for r in high_card(counts, most).collect()]
        levels = {v: [] for v in wide}
        for r in (counts.where(~F.col("variable").isin(wide)) if wide else counts).collect() if len(wide) < len(cat) else []:
            levels.setdefault(r[0], []).append(r[1])
    return Schema(outcomes, tuple(sorted(v for v, k in kinds.items() if k == "numeric")), {v: tuple(sorted(x)) for v, x in sorted(levels.items())})


def schema_report(schema: Schema, limit: int = 10) -> str:
    """Tab-separated text: outcome, categoric (the first levels) and numeric lines."""
    cut = lambda x: "\t".join([*x[:limit], *(["..."] if len(x) > limit else [])])
    lines = ["outcome\t" + cut(schema.outcomes)] + [f"categoric\t{v}\t{cut(x)}" for v, x in schema.levels.items()] + [f"numeric\t{v}" for v in schema.numeric]
    return "\n".join(lines)


def positive_weight(df: DataFrame, name: str | None) -> DataFrame:
    return df.where(weight(name, df) > 0)


def known_outcome(df: DataFrame, formula: Formula, outcomes) -> DataFrame:
    return df.where(F.coalesce(text(formula.outcome).isin(*outcomes), F.lit(False)))


def stat_map(df: DataFrame, key: str, x: Column, w: Column) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.sum(w).alias("weight"), F.sum(w * x).alias("total"))


def count_map(df: DataFrame, key: str, delta: Column) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.sum(delta).alias("count")).orderBy("key")


def count_map_v(df: DataFrame, key: str, index: str, slots: list, delta: Column) -> DataFrame:
    """A column of counts for each slot of index."""
    return df.groupBy(F.col(key).alias("key")).agg(*[F.sum(F.when(F.col(index) == s, delta).otherwise(0)).alias(f"slot_{s}") for s in slots])


def sum_reducer(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Keyed sums without those that are 0."""
    return df.groupBy(F.col(key).alias("key")).agg(F.sum(value).alias("total")).where("total <> 0")


def high_card(levels: DataFrame, limit: int = 100) -> DataFrame:
    return levels.groupBy("variable").agg(F.count("*").alias("n_levels")).where(F.col("n_levels") > limit)


def reservoir(df: DataFrame, key: str, n: int) -> DataFrame:
    """A uniform sample of n rows at most: those of least md5 of the key."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)
