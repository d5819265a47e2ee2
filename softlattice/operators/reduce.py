"""Reductions by user code: one state a partition, states merged in a tree on the cluster."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_tree(parts: DataFrame, groups: int, add: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows (part, ...) merged by `add` in `groups` tasks, then in one; each sees its rows in the order of `part`.

    The last step is dealt without a key, so that no setting can make it more than one task.
    """
    for n in sorted({groups, 1}, reverse=True):
        parts = (parts.repartition(n, F.col("part")) if n > 1 else parts.repartition(1)).sortWithinPartitions("part").mapInArrow(add, parts.schema)
    return parts


def reduce_parallel(df: DataFrame, start: Callable[[], object], observe: Callable, merge: Callable):
    """The state after all rows: `observe(state, batch)` of Arrow batches in a partition, `merge(a, b)` of two states.

    Both return the new state.  `merge` must be commutative and associative, and
    `start()` its neutral element, which is also the result of an empty table.  A
    task holds two states, the driver gets one: a state must not grow with the
    rows.  What built-in aggregates can say is faster by them.
    """

    def row(part: int, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(state)], pa.binary())], names=["part", "state"])

    def run(batches):
        from pyspark import TaskContext

        state, seen = start(), False
        for b in batches:
            if b.num_rows:
                state, seen = observe(state, b), True
        if seen:
            yield row(TaskContext.get().partitionId(), state)

    def add(batches):
        first, total = None, None
        for b in batches:
            for part, packed in zip(b.column("part").to_pylist(), b.column("state"), strict=True):
                state = pickle.loads(packed.as_py())
                first, total = (part, state) if first is None else (first, merge(total, state))
        if first is not None:
            yield row(first, total)

    groups = math.isqrt(max(df.rdd.getNumPartitions(), 1))
    got = in_tree(df.mapInArrow(run, "part int, state binary"), groups, add).first()
    return start() if got is None else pickle.loads(bytes(got["state"]))
