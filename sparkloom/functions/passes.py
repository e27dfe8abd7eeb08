"""Sums of numpy arrays over a table's batches; on a large cluster in two steps, so that the driver doesn't gather one array a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType

TYPES = {"double": DoubleType(), "int": IntegerType(), "boolean": BooleanType(), "array<double>": ArrayType(DoubleType())}


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """(columns, rows) of a batch of doubles, nulls as NaN."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])


def summed(df: DataFrame, columns: list[Column], f: Callable[[np.ndarray], np.ndarray], ways: int = 16) -> np.ndarray:
    """The sum over all batches of ``f`` of their (columns, rows); ``f`` gives an array of one shape whatever the rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = np.asarray(f(matrix(b)), float)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0):
                v = np.frombuffer(x.as_buffer())
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    cols = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    sums = cols.mapInArrow(partial, "part binary")
    if df.sparkSession.sparkContext.defaultParallelism > 4 * ways:
        sums = sums.repartition(ways).mapInArrow(join, "part binary")
    parts = [np.frombuffer(r[0]) for r in sums.collect()]
    shape = np.asarray(f(np.zeros((len(columns), 0)))).shape
    return np.sum(parts, axis=0).reshape(shape) if parts else np.zeros(shape)


def mapped(df: DataFrame, columns: list[Column], out: list[tuple[str, str]], f: Callable[[np.ndarray], list]) -> DataFrame:
    """``df`` with the columns ``out`` (name, type) that ``f`` gives of the (columns, rows) of a batch."""
    names, kinds = [c for c, _ in out], {"double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}
    kept, width = [c for c in df.columns if c not in names], len(columns)
    rows = df.select(*kept, F.struct(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns))).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(b.num_columns - 1)
            x = np.stack([s.field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)])
            cells = [pa.array(v.tolist() if getattr(v, "ndim", 1) > 1 else v, kinds[k]) for v, (_, k) in zip(f(x), out, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cells], [*kept, *names])

    schema = type(df.schema)([f for f in df.schema.fields if f.name in kept])
    for c, k in out:
        schema = schema.add(c, TYPES[k])
    return rows.mapInArrow(run, schema)
