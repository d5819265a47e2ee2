"""Scoring of streams: the batch projection as it is, since it keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.score import score
from ..plans.train import Model


def score_stream(stream: DataFrame, model: Model) -> DataFrame:
    return score(stream, model.layout, model.x)


def start(stream: DataFrame, model: Model, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append scored rows to Parquet files."""
    writer = score_stream(stream, model).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
