"""Reproducible shuffle: a Feistel permutation with cycle walking over global row numbers.

Row numbers follow a stated order of the rows, so they do not depend on partitions: rows are range-partitioned
and sorted by that order, partition sizes are summed, and a row's number is its partition's offset plus its place.
A row whose permuted number is p goes to shard p mod n at slot p div n. The permutation and its inverse need only
the row count and the seed, so shard and slot of a row number, and the row number at a shard and slot, can be
computed without a look at the data.

Defined results: null keys sort first; rows equal in every order column may exchange their places, which changes
nothing if they are equal; columns of the input pass through, but one named like an output column gives way to it
(after ordering by it, if it is an order column); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, partitions

ROUNDS = 6
#: Modulus and multiplier of the round keys and of the round function; products stay below 2**62.
PRIME, STEP = 2_147_483_647, 48_271


def round_keys(seed: int) -> list[tuple[int, int]]:
    keys, x = [], (seed * 2 + 1) % PRIME or 1
    for _ in range(ROUNDS):
        a = x = x * STEP % PRIME
        b = x = x * STEP % PRIME
        keys.append((a, b))
    return keys


class Feistel:
    """Permutation of 0 .. n-1."""

    def __init__(self, n: int, seed: int = 0):
        if n > 2**60:
            raise ValueError("at most 2**60 rows")
        self.n = n
        self.half = max(1, -(-max(1, n - 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        self.keys = round_keys(seed)

    def _round(self, r: np.ndarray, a: int, b: int) -> np.ndarray:
        x = (r * a + b) % PRIME
        x = (x ^ (x >> 15)) * STEP % PRIME
        return (x ^ (x >> 13)) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        if back:
            for a, b in reversed(self.keys):
                left, right = right ^ self._round(left, a, b), left
        else:
            for a, b in self.keys:
                left, right = right, left ^ self._round(right, a, b)
        return (left << self.half) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.int64), back)
        while (far := x >= self.n).any():
            x = x.copy()
            x[far] = self._once(x[far], back)
        return x

    def permute(self, rows) -> np.ndarray:
        """Places of row numbers; a place outside 0 .. n-1 is walked on along its cycle."""
        return self._walk(rows, False)

    def invert(self, places) -> np.ndarray:
        """Row numbers at places."""
        return self._walk(places, True)

    def locate(self, rows, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """(shard, slot) of row numbers."""
        p = self.permute(rows)
        return p % shards, p // shards

    def row_at(self, shard, slot, shards: int) -> np.ndarray:
        """Row numbers at (shard, slot)."""
        return self.invert(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64))


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with row_number (from 0, in ``order``) and the row count.

    Equal keys are dealt over partitions by a last key of their place in the scan, so no key fills one task. The
    sorted rows are written once, which settles the places of rows that are equal in every order column.
    """
    spark = df.sparkSession
    ways = partitions(spark)
    dealt = df.withColumn("_scan", F.monotonically_increasing_id()).repartitionByRange(ways, *order, "_scan").sortWithinPartitions(*order, "_scan").drop("_scan")
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["count"]) for r in placed.groupBy(part.alias("p")).count().collect())
    start, offsets = 0, []
    for p, size in sizes:
        offsets += [F.lit(p), F.lit(start)]
        start += size
    if not start:
        return placed.select(*df.columns, F.col("_at").alias("row_number")), 0
    at = F.create_map(*offsets)[part] + F.col("_at").bitwiseAND(2**33 - 1)
    return placed.select(*df.columns, at.cast("long").alias("row_number")), start


def shard(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with row_number, shard int and slot long; shard sizes differ by at most one row and slots have no gaps."""
    taken = {c.lower() for c in df.columns}
    keys = [next(f"order_{i}_{j}" for j in range(len(taken) + 1) if f"order_{i}_{j}" not in taken) for i in range(len(order))]
    df = df.withColumns({k: F.col(c) for k, c in zip(keys, order, strict=True)}).drop(*(c for c in df.columns if c.lower() in {"row_number", "shard", "slot", "_scan", "_at"}))
    rows, n = number_rows(df, keys)
    rows = rows.drop(*keys)
    walk, names = Feistel(n, seed), [*rows.columns, "shard", "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, slot = walk.locate(b.column(b.num_columns - 1).to_numpy(), shards)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.int32()), pa.array(slot, pa.int64())], names)

    return rows.mapInArrow(run, type(rows.schema)([*rows.schema.fields]).add("shard", "integer").add("slot", "long"))


def op1_sharding(spark, sf_dir: str, shards: int = 24, seed: int = 20) -> DataFrame:
    """Every document's shard and slot under the law ``rows``; rows are numbered by doc_id, size and checksum."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard(rows, ["doc_id", "size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

