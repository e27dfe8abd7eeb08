"""Shared pieces of the text operators: forests of links, batches of rows, names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from sparkloom.operators.components import connected_components
from sparkloom.storage import materialize, new_path, shared_dir

__all__ = ["NULL_ID", "connected_components", "forest", "materialize", "new_path", "partitions", "shared_dir", "sliced", "unused", "utf8"]

#: Stands for a null id where an id must be ordered or joined; it sorts below every other id.
NULL_ID = -(2**63)


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that none of the columns has, in either case."""
    taken = {c.lower() for c in columns}
    return next(x for x in (f"_{name}{i}" for i in range(len(taken) + 1)) if x not in taken)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that Python objects of only a few rows exist at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges a-b: each node that is not its tree's smallest, with that smallest node.

    Larger roots are hooked to smaller ones until no edge joins two trees; paths are halved in between.
    """
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = inverse[: len(a)], inverse[len(a) :], np.arange(len(nodes))
    while len(x):
        p, q = root[x], root[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]
