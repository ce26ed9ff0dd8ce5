"""Sums of many small arrays, one from each task, as a tree of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Arrays that one task adds up at a time.
FAN_IN = 64
#: Arrays that the driver adds up.
LAST = 8


def _packed(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.record_batch([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["part"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for part in batch.column(0):
            own = np.frombuffer(part.as_py())
            total = own.copy() if total is None else total + own
    yield from _packed(total)


def tree_sum(df: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all batches of df of make(batch), an array of `size` floats.

    Each task gives one array; these are added up on executors, FAN_IN to a task, until at most LAST
    are left for the driver. An empty table sums to zeros."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = make(batch)
                total = own if total is None else total + own
        yield from _packed(total)

    width = df.rdd.getNumPartitions()
    parts = df.mapInArrow(run, "part binary")
    while width > LAST:
        width = -(-width // FAN_IN)
        parts = parts.repartition(width).mapInArrow(_add, "part binary")
    out = np.zeros(size)
    for part in parts.toArrow()["part"]:
        out += np.frombuffer(part.as_py())
    return out
