"""Feature scores; each gives (feature, score). One aggregate over the table serves all features of a score."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import FitError
from sparkloom.functions.expr import ten_bins


def _frame(df: DataFrame, scores: dict[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, None if v is None else float(v)) for k, v in scores.items()], "feature string, score double")


def variance(df: DataFrame, cols: list[str]) -> DataFrame:
    r = df.agg(*(F.var_pop(c).alias(c) for c in cols)).first()
    return _frame(df, {c: r[c] for c in cols})


def correlation(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Absolute Pearson correlation; 0 if either deviation is below 1e-10."""
    r = df.agg(F.stddev_pop(target), *(x for c in cols for x in (F.stddev_pop(c), F.corr(c, target)))).first()
    return _frame(df, {c: 0.0 if min(r[0], r[1 + 2 * i]) < 1e-10 else abs(r[2 + 2 * i]) for i, c in enumerate(cols)})


def anova_f(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Between-class over within-class mean squares; infinite without variance inside classes, 0 for fewer than 2 classes."""
    rows = df.groupBy(target).agg(F.count("*").alias("n"), *(f(c) for c in cols for f in (F.avg, F.var_pop))).collect()
    n, k = sum(r["n"] for r in rows), len(rows)
    out = {}
    for i, c in enumerate(cols):
        mean = sum(r["n"] * r[2 + 2 * i] for r in rows) / n
        ssb = sum(r["n"] * (r[2 + 2 * i] - mean) ** 2 for r in rows)
        ssw = sum(r["n"] * r[3 + 2 * i] for r in rows)
        out[c] = 0.0 if n <= k or k < 2 else math.inf if ssw < 1e-10 else (ssb / (k - 1)) / (ssw / (n - k))
    return _frame(df, out)


def binned(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with the columns in ten equal-width bins."""
    r = df.agg(*(f(c) for c in cols for f in (F.min, F.max))).first()
    return df.withColumns({c: ten_bins(F.col(c), F.lit(float(r[2 * i])), F.lit(float(r[2 * i + 1]))) for i, c in enumerate(cols)})


def entropy(counts) -> float:
    p = np.asarray(counts, float).ravel()
    p = p[p > 0] / p.sum()
    return float(-(p * np.log(p)).sum())


def _joint(df: DataFrame, sets: list[tuple[str, ...]]) -> list[np.ndarray]:
    """Dense count tables of each set of binned columns, in one pass: each row adds to one cell of every table."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), *(F.col(c).cast("int").alias(f"k{j}") for j, c in enumerate((*s, *[s[-1]] * (3 - len(s)))))) for i, s in enumerate(sets))))
    got = df.select(cells.alias("x")).select("x.*").groupBy("i", "k0", "k1", "k2").count().collect()
    out = [np.zeros((10,) * len(s)) for s in sets]
    for r in got:
        out[r["i"]][tuple(r[f"k{j}"] for j in range(len(sets[r["i"]])))] += r["count"]
    return out


def _info(t: np.ndarray) -> float:
    return entropy(t.sum(1)) + entropy(t.sum(0)) - entropy(t)


def information_gain(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Entropy of the classes less that given the binned feature, at least 0; classes are 0 to 9 or few more."""
    b = binned(df, cols)
    rows = b.select(F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).alias("b")) for c in cols))).alias("x"), F.col(target).alias("y")).groupBy("x.f", "x.b", "y").count().collect()
    classes = sorted({r["y"] for r in rows})
    out = {}
    for c in cols:
        t = np.zeros((10, len(classes)))
        for r in rows:
            if r["f"] == c:
                t[r["b"], classes.index(r["y"])] += r["count"]
        n = t.sum()
        out[c] = max(0.0, entropy(t.sum(0)) - sum(x.sum() / n * entropy(x) for x in t if x.sum()))
    return _frame(df, out)


def mutual_info(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Mutual information of the feature and the target, both in ten bins."""
    b = binned(df, [*cols, target])
    return _frame(df, {c: _info(t) for c, t in zip(cols, _joint(b, [(c, target) for c in cols]), strict=True)})


def greedy(df: DataFrame, cols: list[str], target: str, how: str = "mrmr") -> DataFrame:
    """Greedy selection by ``mrmr``, ``jmi``, ``jmim`` or ``cmim``; the score is the rank from the end, so the first pick has the highest.

    All pair and triple counts come from one pass; the loop runs over ten-bin tables on the driver.
    """
    if how not in ("mrmr", "jmi", "jmim", "cmim"):
        raise FitError(f"no filter {how}")
    b = binned(df, [*cols, target])
    pairs = [(a, c) for i, a in enumerate(cols) for c in cols[i + 1 :]]
    sets = [(c, target) for c in cols] + ([p for p in pairs] if how == "mrmr" else [(*p, target) for p in pairs])
    got = _joint(b, sets)
    rel = {c: _info(got[i]) for i, c in enumerate(cols)}
    two = dict(zip(pairs, got[len(cols) :], strict=True))

    def part(c: str, s: str) -> float:
        t = two[(c, s)] if (c, s) in two else np.swapaxes(two[(s, c)], 0, 1)
        if how == "mrmr":
            return _info(t)
        if how in ("jmi", "jmim"):
            return _info(t.reshape(100, 10))
        return entropy(t.sum(2)) + entropy(t.sum(0)) - entropy(t.sum((0, 2))) - entropy(t)

    left, picked = list(cols), []
    while left:
        def value(c: str) -> float:
            if not picked:
                return rel[c]
            v = [part(c, s) for s in picked]
            return {"mrmr": rel[c] - sum(v) / len(v), "jmi": sum(v), "jmim": min(v), "cmim": min(v)}[how]

        best = max(left, key=lambda c: (value(c), -cols.index(c)))
        left.remove(best)
        picked.append(best)
    return _frame(df, {c: float(len(cols) - i) for i, c in enumerate(picked)})


def select_top(scores: DataFrame, cols: list[str], k: int) -> list[str]:
    """The k best features in column order; ties go to the first column."""
    s = {r["feature"]: r["score"] for r in scores.collect()}
    top = sorted(range(len(cols)), key=lambda i: (-s[cols[i]], i))[:k]
    return [cols[i] for i in sorted(top)]


def cumulative_ranking(frames: dict[str, DataFrame], cols: list[str], top_k: int | None = None, df: DataFrame | None = None, cutoff: float | None = None) -> DataFrame:
    """(feature, rank_sum, place): sums of the ordinal ranks that each filter gives, ties in column order.

    With ``cutoff`` a feature whose absolute correlation with a better placed one that is kept lies above it is dropped;
    ``top_k`` then keeps the first.
    """
    spark = next(iter(frames.values())).sparkSession
    total = dict.fromkeys(cols, 0)
    for f in frames.values():
        s = {r["feature"]: r["score"] for r in f.collect()}
        for i, c in enumerate(sorted(cols, key=lambda c: (-s[c], cols.index(c)))):
            total[c] += i + 1
    ordered = sorted(cols, key=lambda c: (total[c], cols.index(c)))
    if cutoff is not None and df is not None:
        pairs = [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :]]
        found = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first() if pairs else []
        r = {p: abs(v or 0.0) for p, v in zip(pairs, found, strict=True)}
        kept: list[str] = []
        for c in ordered:
            if all(r[k, c] <= cutoff for k in kept):
                kept.append(c)
        ordered = kept
    ordered = ordered[:top_k]
    return spark.createDataFrame([(c, total[c], i + 1) for i, c in enumerate(ordered)], "feature string, rank_sum long, place long")
