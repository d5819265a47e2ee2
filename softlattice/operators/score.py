"""Scoring and evaluation: one lazy projection of built-in expressions, in batch and in streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import complete, number, softmax, text, unused, weight
from .layout import Layout, join_effects


def _probabilities(df: DataFrame, layout: Layout, x) -> tuple[DataFrame, list[str]]:
    """The complete rows with a column of probability for each outcome, and these columns' names, which df does not have."""
    k, d, columns = len(layout.outcomes), layout.width, df.columns
    level, total, *names = unused(columns, ["level", "total", *(f"p{c}" for c in range(k)), *(f"e{i}" for i in range(len(layout.slots)))])
    probs, effect = names[:k], names[k:]
    df = df.where(complete(layout.formula.variables))
    scores = [F.lit(0.0)] * k
    for i, s in enumerate(layout.slots):
        if s.kind == "const":
            scores = [t + float(x[c * d + s.start]) for c, t in enumerate(scores)]
        elif s.kind == "numeric":
            scores = [t + F.coalesce(number(s.variable, df), F.lit(0.0)) * float(x[c * d + s.start]) for c, t in enumerate(scores)]
        else:
            df = join_effects(df, layout, x, s, level, effect[i])
            scores = [t + F.coalesce(F.get(effect[i], F.lit(c)), F.lit(0.0)) for c, t in enumerate(scores)]
    df = df.select(*[f"`{c}`" for c in columns], *[t.alias(p) for t, p in zip(scores, probs, strict=True)])
    return softmax(df, probs, probs, total), probs


def predict(df: DataFrame, layout: Layout, x, column: str = "_p") -> DataFrame:
    """Adds `column`, the array of probabilities; an input column of that name is replaced."""
    rows, probs = _probabilities(df, layout, x)
    return rows.withColumn(column, F.array(*probs)).drop(*probs)


def score(df: DataFrame, layout: Layout, x, prefix: str = "model.predict") -> DataFrame:
    """A probability column an outcome, the chosen outcome and its probability, then the input columns; incomplete rows are left out."""
    y = layout.formula.outcome
    rows, probs = _probabilities(df, layout, x)
    (best,) = unused(rows.columns, ["best"])
    rows = rows.withColumn(best, F.greatest(*probs) if len(probs) > 1 else F.col(probs[0]))
    chosen = F.lit(layout.outcomes[-1])
    for p, o in reversed(list(zip(probs, layout.outcomes, strict=True))):  # the first of equals
        chosen = F.when(F.col(p) == F.col(best), o).otherwise(chosen)
    named = [F.col(p).alias(f"{prefix}.{y}.{o}") for p, o in zip(probs, layout.outcomes, strict=True)]
    return rows.select(*named, chosen.alias("model.chosen.Outcome"), F.col(best).alias(f"{prefix}.Outcome"), *[f"`{c}`" for c in df.columns])


def score_by_key(df: DataFrame, layout: Layout, x, key: str) -> DataFrame:
    """`File.Offset` (the key, an integer, padded to 12 digits and never cut), the chosen outcome, its probability, all probabilities and the input, in key order."""
    y = layout.formula.outcome
    s = score(df, layout, x)
    digits = F.col(f"`{key}`").cast("long").cast("string")
    at = F.concat(F.lit("Offset."), F.when(F.length(digits) < 12, F.lpad(digits, 12, "0")).otherwise(digits)).alias("File.Offset")
    probs = [F.col(f"`model.predict.{y}.{o}`").alias(f"predict.{y}.{o}.score") for o in layout.outcomes]
    out = s.orderBy(F.col(f"`{key}`").cast("long"))
    return out.select(at, F.col("`model.chosen.Outcome`").alias(f"predict.{y}"), F.col("`model.predict.Outcome`").alias(f"predict.{y}.score"), *probs, *[f"`{c}`" for c in df.columns])


def _judged(scored: DataFrame, layout: Layout, weight_col: str | None = None) -> DataFrame:
    y = text(layout.formula.outcome)
    rows = scored.where(F.coalesce(y.isin(*layout.outcomes), F.lit(False))).where(weight(weight_col, scored) > 0)
    return rows.select(F.col("`model.chosen.Outcome`").alias("predicted"), y.alias("actual"))


def accuracy(scored: DataFrame, layout: Layout, weight_col: str | None = None) -> DataFrame:
    """n_right, n and accuracy over rows of known outcome (and of a weight above 0); NaN without any."""
    n, right = F.count("*"), F.coalesce(F.count_if(F.col("predicted") == F.col("actual")), F.lit(0))
    return _judged(scored, layout, weight_col).agg(right.alias("n_right"), n.alias("n"), F.when(n > 0, right / n).otherwise(float("nan")).alias("accuracy"))


def confusion_matrix(scored: DataFrame, layout: Layout) -> DataFrame:
    """(predicted, actual, n) for all pairs of outcomes, zeros included.

    Pairs that no row has are added as rows of 0 to the counts, not joined: a join
    would have Spark test the chosen outcome for null below the scores.
    """
    none = [(a, b, 0) for a in layout.outcomes for b in layout.outcomes]
    cells = scored.sparkSession.createDataFrame(none, "predicted string, actual string, n long")
    return marginals(scored, layout).union(cells).groupBy("predicted", "actual").agg(F.sum("n").alias("n"))


def marginals(scored: DataFrame, layout: Layout) -> DataFrame:
    return _judged(scored, layout).groupBy("predicted", "actual").agg(F.count("*").alias("n"))
