"""Matrices of vectors in tasks, and sums of integers of any size over a cluster."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1
#: A term of a sum: two numbers that tell what it is of, its multiples of 2**60, and the rest.
TERMS = "i int, j int, high decimal(38,0), low long"
_FIELDS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", pa.decimal128(38, 0)), ("low", pa.int64())])


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of dims doubles or floats, none null, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def terms(sums: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    """What a task has summed, in TERMS; sums of up to 180 bits."""
    if sums:
        columns = [[i for i, _ in sums], [j for _, j in sums], [Decimal(x >> 60) for x in sums.values()], [x & (1 << 60) - 1 for x in sums.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)


def collected(parts: DataFrame) -> dict[tuple[int, int], int]:
    """The sums of all tasks' TERMS, exactly. The caller knows that the pairs (i, j) are few."""
    rows = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    return {(r.i, r.j): (int(r.high) << 60) + int(r.low) for r in rows}
