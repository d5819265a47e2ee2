"""Sources and sinks."""

from __future__ import annotations

import base64
import gzip
import math
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import Formula
from ..operators.layout import Layout, solution_rows
from ..operators.score import score, score_by_key
from ..plans.train import Model


#: Least and greatest bytes of a text split.
SPLIT = (4 << 10, 4 << 20)


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", split_bytes: int | None = None) -> DataFrame:
    """Header line and rows of text; blank lines are dropped.  split_bytes: the size of a task's input, see `read_offsets`."""
    if split_bytes:
        header = read_header(spark, path, sep)
        return line_burst(read_offsets(spark, path, split_bytes), header, sep)
    return spark.read.option("header", True).option("sep", sep[0]).option("inferSchema", False).csv(path)


def read_header(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    row = spark.read.text(path).first()
    return row[0].split(sep) if row else []


def read_offsets(spark: SparkSession, path: str, split_bytes: int = SPLIT[1]) -> DataFrame:
    """(offset, value): every line and the byte of its file at which it begins.

    Only Hadoop's line reader knows offsets, so this one source is an RDD; its
    splits are of split_bytes, held between 4 KB and 4 MB, and no session setting
    is changed.
    """
    size = str(min(max(split_bytes, SPLIT[0]), SPLIT[1]))
    name = "mapreduce.input.fileinputformat.split."
    lines = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text",
        conf={name + "maxsize": size, name + "minsize": str(SPLIT[0])}, batchSize=1000,
    )
    return spark.createDataFrame(lines, "offset long, value string")


def line_burst(lines: DataFrame, header: list[str], sep: str = "\t") -> DataFrame:
    """Lines of a `value` column into named fields, with an `offset` column if there is one; the header line and blank lines are left out."""
    parts = F.split("value", sep if sep == "\t" else f"\\Q{sep}\\E", -1)
    rows = lines.where((F.length(F.trim("value")) > 0) & (F.col("value") != sep.join(header)))
    key = [c for c in lines.columns if c == "offset" and c not in header]
    return rows.select(*key, *[F.get(parts, F.lit(i)).alias(h) for i, h in enumerate(header)])


def read_jdbc(spark: SparkSession, url: str, table: str, formula: Formula, weight_col: str | None = None, **options) -> DataFrame:
    """A database table, only the formula's columns (and the weight's).

    options are Spark's; partitionColumn, lowerBound, upperBound and numPartitions
    split the read into as many tasks, else it is one.
    """
    cols = [*formula.terms(), *([weight_col] if weight_col else [])]
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*cols)


def memory_source(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def gen_synthetic(spark: SparkSession, n: int = 1_000_000, variables: int = 10, levels: int = 10, seed: int = 1) -> DataFrame:
    """id, Result and V0.. with gaussian level effects, a threshold and gaussian noise.

    Every number is drawn from the md5 of seed, use and row (or variable and
    level), so rows are the same however they are partitioned or computed again.
    """
    draw = lambda *of: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *of).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    gauss = lambda *of: F.sqrt(-2 * F.log(draw(F.lit("r"), *of))) * F.cos(2 * math.pi * draw(F.lit("a"), *of))
    rows = spark.range(n).select("id", *[F.floor(draw(F.lit("v"), F.lit(i), "id") * levels).cast("int").alias(f"i{i}") for i in range(variables)])
    table = spark.range(variables * levels).select((F.col("id") % variables).cast("int").alias("v"), F.floor(F.col("id") / variables).cast("int").alias("l"))
    effects = table.select("v", "l", gauss(F.lit("e"), "v", "l").alias("e")).orderBy("v", "l").collect()  # variables x levels numbers
    of = [F.array(*[F.lit(r.e) for r in effects if r.v == i])[F.col(f"i{i}")] for i in range(variables)]
    names = [F.concat(F.lit(f"V{i}L"), F.col(f"i{i}").cast("string")).alias(f"V{i}") for i in range(variables)]
    total = sum(of[1:], of[0]) + 0.5 * gauss(F.lit("n"), "id")
    return rows.select("id", (total > 0).cast("int").cast("string").alias("Result"), *names)


def _text_rows(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_scored(df: DataFrame, model: Model, path: str, sep: str = "\t") -> None:
    _text_rows(score(df, model.layout, model.x)).write.mode("overwrite").option("sep", sep).option("header", True).option("emptyValue", "").csv(path)


def write_scored_keyed(df: DataFrame, model: Model, path: str, key: str, sep: str = "\t") -> None:
    _text_rows(score_by_key(df, model.layout, model.x, key)).write.mode("overwrite").option("sep", sep).option("header", True).option("emptyValue", "").csv(path)


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """JSON, one text file in the folder; any file system that Spark writes."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Model:
    return Model.from_json(spark.read.text(path, wholetext=True).first()[0])


def encode_state(data: bytes) -> str:
    return base64.b64encode(gzip.compress(data, mtime=0)).decode()


def decode_state(text: str) -> bytes:
    return gzip.decompress(base64.b64decode(text))


def write_vec(x) -> bytes:
    return struct.pack(f">i{len(x)}d", len(x), *x)


def read_vec(data: bytes) -> list[float]:
    (n,) = struct.unpack_from(">i", data)
    return list(struct.unpack_from(f">{n}d", data, 4))


def solution_report(layout: Layout, x) -> str:
    head = "outcome\toutcomegroup\tvariable\tkind\tlevel\tvalue"
    return "\n".join([head, *["\t".join(map(str, r)) for r in sorted(solution_rows(layout, x))]])
