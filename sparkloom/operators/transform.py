"""Fitted transforms. ``fit`` takes one aggregate over the table; ``transform`` is a projection.

Missing is null (NaN is read as null). Variances are those of the population.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.errors import FitError
from sparkloom.functions.expr import present

EPS = 2.220446049250313e-16


@dataclass
class StandardScaler:
    """(x - mean) / population deviation; a constant column is divided by 1."""

    cols: list[str]
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> StandardScaler:
        r = df.agg(*(f(present(c)) for c in self.cols for f in (F.avg, F.stddev_pop))).first()
        self.stats = {c: (r[2 * i] or 0.0, r[2 * i + 1] or 1.0) for i, c in enumerate(self.cols)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (present(c) - m) / s for c, (m, s) in self.stats.items()})


@dataclass
class MinMaxScaler:
    """(x - min) / (max - min); a range of 0 counts as 1."""

    cols: list[str]
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> MinMaxScaler:
        r = df.agg(*(f(present(c)) for c in self.cols for f in (F.min, F.max))).first()
        for i, c in enumerate(self.cols):
            lo, hi = r[2 * i] or 0.0, r[2 * i + 1] or 0.0
            self.stats[c] = (lo, hi - lo if hi - lo > EPS else 1.0)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (present(c) - lo) / span for c, (lo, span) in self.stats.items()})


@dataclass
class Imputer:
    """Fills missing values by ``mean``, ``median`` (the middle pair's mean) or a constant; a column without values gets 0."""

    cols: list[str]
    how: str | float = "mean"
    stats: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Imputer:
        if isinstance(self.how, str):
            f = {"mean": F.avg, "median": F.median}[self.how]
            r = df.agg(*(f(present(c)) for c in self.cols)).first()
            self.stats = {c: 0.0 if r[i] is None else float(r[i]) for i, c in enumerate(self.cols)}
        else:
            self.stats = dict.fromkeys(self.cols, float(self.how))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(present(c), F.lit(v)) for c, v in self.stats.items()})


@dataclass
class OneHotEncoder:
    """Sorted distinct values of a column as indicators <col>_<value>; an unseen value has none. At most ``limit`` values a column."""

    cols: list[str]
    limit: int = 1000
    values: dict[str, list] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> OneHotEncoder:
        for c in self.cols:
            found = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(self.limit + 1).collect()]
            if len(found) > self.limit:
                raise FitError(f"{c} has more than {self.limit} values")
            self.values[c] = sorted(found)
        return self

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c in self.cols for v in self.values[c]]

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.values:
                out += [F.when(F.col(c) == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for v in self.values[c]]
            else:
                out.append(F.col(c))
        return df.select(*out)

    def transform_sparse(self, df: DataFrame, ids: list[str]) -> DataFrame:
        """(ids, col, value): the indicators that are 1, by their place."""
        at = {n: i for i, n in enumerate(self.names())}
        cells = [F.when(F.col(c) == v, F.lit(at[f"{c}_{v}"])) for c in self.cols for v in self.values[c]]
        return df.select(*ids, F.explode(F.array_compact(F.array(*cells))).alias("col")).withColumn("value", F.lit(1.0))


@dataclass
class LabelEncoder:
    """Codes of labels in their lexicographic order; the classes are a table, so any number will do."""

    col: str
    table: DataFrame | None = None

    def fit(self, df: DataFrame) -> LabelEncoder:
        labels = df.select(F.col(self.col).alias("label")).where("label is not null").distinct()
        first = labels.groupBy(F.substring(F.col("label").cast("string"), 1, 2).alias("_p")).count()
        start = first.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_o"))
        ranked = labels.withColumn("_p", F.substring(F.col("label").cast("string"), 1, 2)).join(start, "_p")
        self.table = ranked.select("label", (F.col("_o") + F.row_number().over(Window.partitionBy("_p").orderBy("label")) - 1).cast("int").alias("code"))
        return self

    def encode(self, df: DataFrame, out: str = "code", strict: bool = True) -> DataFrame:
        """``df`` with the code, null for a null. An unknown label is an error when the rows are read, or null without ``strict``."""
        found = df.join(self.table.select(F.col("label").alias(self.col), F.col("code").alias(out)), self.col, "left")
        if not strict:
            return found
        return found.withColumn(out, F.when(F.col(out).isNull() & F.col(self.col).isNotNull(), F.raise_error(F.concat(F.lit("unknown label "), F.col(self.col).cast("string"))).cast("int")).otherwise(F.col(out)))

    def unknown(self, df: DataFrame) -> DataFrame:
        return df.join(self.table.select(F.col("label").alias(self.col)), self.col, "left_anti")

    def decode(self, df: DataFrame, code: str = "code") -> DataFrame:
        return df.join(self.table.select(F.col("code").alias(code), "label"), code, "left")


def moments(df: DataFrame, cols: list[str], target: str | None = None, weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of weights, means, centred cross-products) of the columns (the target last), in two aggregates over the table."""
    use = [*cols, *([target] if target else [])]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    r = df.agg(F.sum(w), *(F.sum(w * F.col(c)) for c in use)).first()
    n = float(r[0] or 0.0)
    if n <= 0:
        raise FitError("no rows")
    mean = np.array([float(x) / n for x in r[1:]])
    pairs = [(i, j) for i in range(len(use)) for j in range(i, len(use))]
    d = [F.col(c) - F.lit(float(m)) for c, m in zip(use, mean, strict=True)]
    s = df.agg(*(F.sum(w * d[i] * d[j]) for i, j in pairs)).first()
    out = np.zeros((len(use), len(use)))
    for (i, j), v in zip(pairs, s, strict=True):
        out[i, j] = out[j, i] = float(v)
    return n, mean, out


@dataclass
class PCA:
    """Projection of centred columns on the k first eigenvectors of the population covariance; the largest loading is positive."""

    cols: list[str]
    k: int
    mean: np.ndarray | None = None
    vectors: np.ndarray | None = None
    variances: np.ndarray | None = None

    def fit(self, df: DataFrame) -> PCA:
        n, self.mean, s = moments(df, self.cols)
        values, vectors = np.linalg.eigh(s / n)
        order = np.argsort(-values, kind="stable")[: self.k]
        v = vectors[:, order]
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
        self.vectors, self.variances = v, values[order]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        parts = [F.col(c) - float(m) for c, m in zip(self.cols, self.mean, strict=True)]
        out = [sum((p * float(w) for p, w in zip(parts, self.vectors[:, j], strict=True)), F.lit(0.0)).alias(f"PC{j + 1}") for j in range(self.vectors.shape[1])]
        return df.select(*(c for c in df.columns if c not in self.cols), *out)
