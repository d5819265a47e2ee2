"""Command line: `fit` a model of a delimited file, and `apply` one to a file or a database table."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.score import accuracy, confusion_matrix, score
from .train import METHODS, train, train_plus


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="softlattice")
    sub = top.add_subparsers(dest="command", required=True)
    t = sub.add_parser("fit")
    t.add_argument("--data", required=True, help="delimited file with a header line")
    t.add_argument("--sep", default="\t")
    t.add_argument("--formula", required=True)
    t.add_argument("--weight")
    t.add_argument("--model", required=True, help="folder to write")
    t.add_argument("--plus", action="store_true", help="impact-code variables of many levels")
    t.add_argument("--strength", type=float, default=1e-5, help="of the penalty")
    t.add_argument("--rounds", type=int, default=10)
    t.add_argument("--mask", choices=("all_but_const", "none"), default="all_but_const", help="which coefficients the penalty leaves free")
    t.add_argument("--method", choices=METHODS)
    s = sub.add_parser("apply")
    source = s.add_mutually_exclusive_group(required=True)
    source.add_argument("--data")
    source.add_argument("--jdbc", help="url; needs --table")
    s.add_argument("--table")
    s.add_argument("--sep", default="\t")
    s.add_argument("--model", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--offsets", action="store_true", help="lead each row with its offset in the file, in that order")
    return top


def parse(argv: list[str]) -> argparse.Namespace:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "apply" and bool(a.jdbc) != bool(a.table):
        p.error("--jdbc and --table go together")
    if a.command == "apply" and a.offsets and not a.data:
        p.error("--offsets are those of a file")
    return a


def fit_job(spark: SparkSession, a: argparse.Namespace) -> float:
    """Header, schema scans, fit, saved model; the accuracy on the rows it was fitted on."""
    from ..sources import io

    df = io.read_delimited(spark, a.data, a.sep)
    fit = train_plus if a.plus else train
    model = fit(df, a.formula, a.weight, strength=a.strength, max_rounds=a.rounds, mask=a.mask, method=a.method)
    io.save_model(spark, model, a.model)
    return accuracy(score(df, model.layout, model.x), model.layout, a.weight).first()["accuracy"]


def apply_job(spark: SparkSession, a: argparse.Namespace) -> float | None:
    """Scored rows in delimited files; the accuracy where the outcome is known."""
    from ..sources import io

    model = io.load_model(spark, a.model)
    if a.offsets:
        df = io.line_burst(io.read_offsets(spark, a.data), io.read_header(spark, a.data, a.sep), a.sep)
        io.write_scored_keyed(df, model, a.out, "offset", a.sep)
    else:
        df = io.read_delimited(spark, a.data, a.sep) if a.data else io.read_jdbc(spark, a.jdbc, a.table, model.layout.formula)
        io.write_scored(df, model, a.out, a.sep)
    if model.layout.formula.outcome not in df.columns:
        return None
    scored = score(df, model.layout, model.x)
    confusion_matrix(scored, model.layout).orderBy("predicted", "actual").show(1000, truncate=False)
    return accuracy(scored, model.layout).first()["accuracy"]


def main(argv: list[str], spark: SparkSession | None = None) -> float | None:
    a = parse(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    got = fit_job(spark, a) if a.command == "fit" else apply_job(spark, a)
    print("accuracy:", got)
    return got


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
