"""Column builders and order helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10


def present(c: str | Column) -> Column:
    """A number, with NaN as null: the engine's missing value is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def safe_div(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def last_argmax(p: Column) -> Column:
    """Index (from 0) of the largest element; of equal ones the last."""
    return (F.size(p) - F.array_position(F.reverse(p), F.array_max(p))).cast("int")


def md5_key(seed: int, ids: list[str]) -> Column:
    """The engine's random order: rows sorted by this key, then by id."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(c).cast("string") for c in ids)))


def ten_bins(x: Column, low: Column, high: Column) -> Column:
    """Ten equal-width bins, 0 to 9, by truncation."""
    return F.least(F.floor((x - low) / F.greatest(high - low, F.lit(EPS)) * 10.0), F.lit(9)).cast("int")


def global_rank(df: DataFrame, key: str, ids: list[str], out: str = "rn", by: list[str] | None = None) -> DataFrame:
    """``df`` with the rank (from 0) of each row by an md5 ``key``, then ``ids``, within ``by``.

    md5 keys spread evenly over their first three digits, so ranks are counted in 4,096 slices: a row's rank is
    its slice's offset plus its place there, and no task sorts the whole table. The offsets are 4,096 rows for
    each ``by`` group.
    """
    by = by or []
    sliced = df.withColumn("_s", F.substring(key, 1, 3))
    sizes = sliced.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_s") if by else Window.orderBy("_s")
    start = sizes.withColumn("_o", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    start = start.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col("_s").alias("_t"), "_o")
    on = [F.col("_s") == F.col("_t"), *(F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by))]
    joined = sliced.join(start if by else F.broadcast(start), on)
    place = F.row_number().over(Window.partitionBy(*by, "_s").orderBy(key, *ids))
    return joined.withColumn(out, (F.col("_o") + place - 1).cast("long")).drop("_s", "_t", "_o", *(f"_b{i}" for i in range(len(by))))


def ranges(df: DataFrame) -> int:
    """Into how many ranges a table's values are cut: with the shuffle partitions, from 64 to 1,024."""
    return max(64, min(1024, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def splits(df: DataFrame, key: str, n: int | None = None) -> list:
    """Up to n - 1 cut points of a key's values, by approximate quantiles."""
    n = n or ranges(df)
    found = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], 30 * n)).first()[0]
    return sorted(set(found or []))


def range_of(key: str | Column, cuts: list) -> Column:
    """The number of cut points that are not above the key, by halving; 0 for null."""
    c = F.col(key) if isinstance(key, str) else key

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c < F.lit(cuts[mid]), half(lo, mid)).otherwise(half(mid + 1, hi))

    return F.when(c.isNull(), 0).otherwise(half(0, len(cuts)))


def prefix_sums(df: DataFrame, key: str, cols: list[str], desc: bool = False, by: list[str] | None = None) -> DataFrame:
    """``df`` with cum_<c>: the sum of c over this and all earlier keys (unique within ``by``).

    Keys are cut into ranges at approximate quantiles; a running sum is the ranges' offset plus the running sum
    inside, so the longest window is one range.
    """
    by = by or []
    cuts = splits(df, key)
    part = range_of(key, cuts)
    cut = df.withColumn("_r", -part if desc else part)
    sums = cut.groupBy(*by, "_r").agg(*(F.sum(c).alias(f"_t_{c}") for c in cols))
    w = Window.partitionBy(*by).orderBy("_r")
    start = sums.select(*by, "_r", *((F.sum(f"_t_{c}").over(w) - F.col(f"_t_{c}")).alias(f"_o_{c}") for c in cols))
    inner = Window.partitionBy(*by, "_r").orderBy(F.col(key).desc() if desc else F.col(key)).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(start) if not by else start, [*by, "_r"])
    return out.select(*df.columns, *((F.col(f"_o_{c}") + F.sum(c).over(inner)).alias(f"cum_{c}") for c in cols))
