"""Column expressions that every operator shares."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: What counts as a number; suffixes such as 1d that a cast would take do not.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def number(name: str, df: DataFrame | None = None) -> Column:
    """The column as a finite double, or null; where df tells that it is numeric no text is parsed."""
    if df is not None and isinstance(df.schema[name].dataType, NumericType):
        d = F.col(f"`{name}`").cast("double")
        return F.when(F.abs(d) < float("inf"), d)  # NaN is above infinity
    d = text(name).try_cast("double")
    return F.when(text(name).rlike(NUMBER) & (F.abs(d) < float("inf")), d)


def complete(names: Sequence[str]) -> Column:
    """Every column is there and not blank."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.length(F.trim(text(n))) > 0, F.lit(False)) for n in names], F.lit(True))


def weight(name: str | None, df: DataFrame | None = None) -> Column:
    """A row's weight; 1 without a column, or where it holds no number."""
    return F.lit(1.0) if name is None else F.coalesce(number(name, df), F.lit(1.0))


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.transform(F.array(value), then)[0]


def exp_scale(scores: Column) -> Column:
    """Softmax of an array of scores; the largest score and the sum are evaluated once."""
    shifted = _let(F.struct(scores.alias("s"), F.array_max(scores).alias("m")), lambda r: F.transform(r["s"], lambda s: F.exp(s - r["m"])))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return _let(shifted, lambda e: _let(F.struct(e.alias("e"), total(e).alias("t")), lambda r: F.transform(r["e"], lambda x: x / r["t"])))


def softmax(df: DataFrame, scores: Sequence[str], probabilities: Sequence[str], total: str) -> DataFrame:
    """The columns of scores become columns of probabilities, each step a projection of its own.

    Plain columns stay within generated code, and no step is repeated in the next one.
    """
    most = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    df = df.withColumn(total, most).withColumns({s: F.exp(F.col(s) - F.col(total)) for s in scores})
    df = df.withColumn(total, reduce(lambda a, b: a + b, map(F.col, scores)))
    return df.withColumns({p: F.col(s) / F.col(total) for s, p in zip(scores, probabilities, strict=True)}).drop(total, *(s for s in scores if s not in probabilities))


def unused(columns: Sequence[str], names: Sequence[str]) -> list[str]:
    """The names, behind as many underscores as none of the columns begins with (whatever their case)."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in columns):
        mark += "_"
    return [mark + n for n in names]


def argmax(values: Column) -> Column:
    """Index of the largest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def map_of(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
