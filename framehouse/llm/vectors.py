"""What the operators on vectors share: usable vectors as whole numbers, and sums of arrays over all partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024


def usable(vectors: DataFrame, column: str, largest: float) -> Column:
    """Neither null nor empty, and every entry a finite number of less than ``largest`` in magnitude."""
    return F.coalesce((F.size(column) > 0) & F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < largest, F.lit(False))), F.lit(False))


def commonest_size(vectors: DataFrame, column: str) -> int | None:
    """The length that most vectors have, the larger of equals; None without vectors."""
    found = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found and found["d"]


def whole(column: pa.Array, d: int) -> np.ndarray:
    """Lists of d numbers as rows of floor(SCALE * entry)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values.reshape(len(column), d)).astype(np.int64)


def tree_sum(rows: DataFrame, run, kind: str) -> np.ndarray | None:
    """The sum of the arrays that ``run`` makes, one of each partition: by as many tasks as their number's root, then here.

    run takes the partition's record batches and gives an array of numpy type ``kind``, or None of an empty partition.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = run(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(found, kind).tobytes()], pa.binary())], ["data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                x = np.frombuffer(data, kind)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    parts = rows.mapInArrow(each, "data binary")
    fewer = parts.repartition(max(1, math.isqrt(rows.rdd.getNumPartitions()))).mapInArrow(add, "data binary")
    arrays = [np.frombuffer(r.data, kind) for r in fewer.collect()]
    return sum(arrays[1:], arrays[0]) if arrays else None
