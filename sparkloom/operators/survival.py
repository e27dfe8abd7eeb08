"""Survival estimators: Nelson-Aalen, log-rank, concordance, Cox regression.

Times are counted before anything is accumulated, so running sums go over distinct times.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import FitError
from sparkloom.functions.expr import prefix_sums, range_of, splits
from sparkloom.operators.transform import moments
from sparkloom.storage import materialize


def risk_table(df: DataFrame, time: str, event: str) -> DataFrame:
    """(t, d, n_at, at_risk): events and rows at each distinct time, and rows at or after it."""
    g = materialize(df.groupBy(F.col(time).cast("double").alias("t")).agg(F.sum(F.col(event).cast("long")).alias("d"), F.count("*").alias("n_at")), "times")
    return prefix_sums(g, "t", ["n_at"], desc=True).withColumnRenamed("cum_n_at", "at_risk")


def nelson_aalen(df: DataFrame, time: str, event: str) -> DataFrame:
    """(t, d, at_risk, hazard, survival) at event times; hazard is the sum of d / at_risk, survival exp(-hazard)."""
    r = materialize(risk_table(df, time, event).where("d > 0").withColumn("h", F.col("d") / F.col("at_risk").cast("double")), "hazards")
    return prefix_sums(r, "t", ["h"]).select("t", "d", "at_risk", F.col("cum_h").alias("hazard"), F.exp(-F.col("cum_h")).alias("survival"))


def median_survival(curve: DataFrame) -> float | None:
    """The first time at which survival is 0.5 or less."""
    return curve.where("survival <= 0.5").agg(F.min("t")).first()[0]


def survival_at(curve: DataFrame, queries: DataFrame, at: str) -> DataFrame:
    """``queries`` with survival at the last event time not after ``at`` (1 before the first).

    Distinct query times and curve times are merged and filled forward in ranges, so neither side meets the other in a product.
    """
    q = queries.select(F.col(at).cast("double").alias("t")).distinct().select("t", F.lit(None).cast("double").alias("s"))
    both = q.unionAll(curve.select("t", F.col("survival").alias("s"))).groupBy("t").agg(F.max("s").alias("s"))
    step = both.withColumn("k", F.when(F.col("s").isNotNull(), 1).otherwise(0))
    ranked = prefix_sums(step, "t", ["k"])
    values = ranked.where("s is not null").select("cum_k", F.col("s").alias("value"))
    filled = ranked.select("t", "cum_k").join(values, "cum_k", "left").select("t", F.coalesce("value", F.lit(1.0)).alias("survival"))
    return queries.withColumn("_t", F.col(at).cast("double")).join(filled.withColumnRenamed("t", "_t"), "_t", "left").drop("_t")


def log_rank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """(observed, expected, variance, statistic) of the rows whose group is 1, over distinct times with two or more at risk."""
    g = df.groupBy(F.col(time).cast("double").alias("t")).agg(F.sum(F.col(event).cast("long")).alias("d"), F.count("*").alias("c"), F.sum(F.when(F.col(group) == 1, F.col(event).cast("long")).otherwise(0)).alias("d1"), F.sum((F.col(group) == 1).cast("long")).alias("c1"))
    r = prefix_sums(g, "t", ["c", "c1"], desc=True).where("d > 0 and cum_c >= 2")
    n, n1, d = F.col("cum_c").cast("double"), F.col("cum_c1").cast("double"), F.col("d").cast("double")
    s = r.agg(F.sum("d1").alias("observed"), F.sum(d * n1 / n).alias("expected"), F.sum(d * (n1 / n) * (1.0 - n1 / n) * (n - d) / (n - 1.0)).alias("variance"))
    o = F.col("observed") - F.col("expected")
    return s.withColumn("statistic", F.when(F.col("variance") > 0, o * o / F.col("variance")).otherwise(0.0))


def _pairs(t: np.ndarray, e: np.ndarray, r: np.ndarray, zone: np.ndarray | None = None, step: int = 1024) -> tuple[float, float]:
    """Concordant and comparable pairs among rows, with ``zone`` only of rows in different zones. All pairs meet: the plain definition, for small tables and tests."""
    good = total = 0.0
    for lo in range(0, len(t), step):
        a = slice(lo, lo + step)
        for at in range(lo, len(t), step):
            b = slice(at, at + step)
            pair = np.triu(np.ones((len(t[a]), len(t[b])), bool), 1) if at == lo else np.ones((len(t[a]), len(t[b])), bool)
            if zone is not None:
                pair &= zone[a, None] != zone[b]
            first, second = t[a, None], t[b]
            same = (first == second) & ((e[a, None] + e[b]) > 0) & pair
            ok = (first != second) & (np.where(first < second, e[a, None], e[b]) > 0) & pair
            gap = np.where(first < second, r[a, None] - r[b], r[b] - r[a, None])
            total += same.sum() + ok.sum()
            good += 0.5 * same.sum() + ((gap > 1e-10) & ok).sum() + 0.5 * ((np.abs(gap) <= 1e-10) & ok).sum()
    return float(good), float(total)


def _below(rank: np.ndarray, weight: np.ndarray, first: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each query the summed weight of the ``first`` items whose rank is below ``limit``, by the bits of the ranks (a wavelet matrix)."""
    out, lo, hi = np.zeros(len(limit)), np.zeros(len(limit), np.int64), first.astype(np.int64)
    for bit in reversed(range(int(max(rank.max(initial=0), limit.max(initial=0))).bit_length())):
        zero = (rank >> bit) & 1 == 0
        n, w = (np.concatenate([[0], np.cumsum(c)]) for c in (zero, np.where(zero, weight, 0.0)))
        up = (limit >> bit) & 1 == 1
        out += np.where(up, w[hi] - w[lo], 0.0)
        lo, hi = (np.where(up, n[-1] + at - n[at], n[at]) for at in (lo, hi))
        order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        rank, weight = rank[order], weight[order]
    return out


def _counted(t: np.ndarray, n: np.ndarray, d: np.ndarray, r: np.ndarray, same: bool = True) -> tuple[float, float]:
    """Concordant and comparable pairs of n rows, d of them events, at each time and risk; without ``same`` only of rows at different times."""
    order = np.argsort(-t, kind="stable")
    t, n, d, r = (v[order] for v in (t, n, d, r))
    later = np.searchsorted(-t, -t, "left")
    known = ~np.isnan(r)
    kinds = np.unique(r[known])
    # Of the rows at later times those of lower risk, and those of a risk within 1e-10; a missing risk is neither.
    low, high = np.searchsorted(kinds, r - 1e-10, "left"), np.searchsorted(kinds, r + 1e-10, "right")
    low[~known] = high[~known] = 0
    rank, weight = np.where(known, np.searchsorted(kinds, r), 0), np.where(known, n, 0.0)
    use = (d > 0) & (later > 0)
    under, near = (_below(rank, weight, later[use], limit[use]) for limit in (low, high))
    good, total = (d[use] * (under + near)).sum() / 2, (d[use] * np.concatenate([[0.0], np.cumsum(n)])[later[use]]).sum()
    if same:
        start = np.unique(later)
        rows, free = np.add.reduceat(n, start), np.add.reduceat(n - d, start)
        tied = (rows * (rows - 1) - free * (free - 1)).sum() / 2
        good, total = good + tied / 2, total + tied
    return float(good), float(total)


def concordance(df: DataFrame, time: str, event: str, risk: str, size: int = 1000) -> DataFrame:
    """(concordant, comparable, c_index). Pairs at one time, one of them an event, count a half; of others the earlier must be an event.

    Rows are counted by time and risk, and these are cut into ranges of about ``size`` counts, at most 512. Pairs in different ranges of both
    are counted from the numbers of rows in the cells; pairs in one range of time, or in one of risk and different ones of
    time, are counted in that range by sorted ranks, so the work is n * log(n). Risks within 1e-10 are equal only inside a
    range of risk. Rows without a time are in no pair; a missing risk is concordant with none.
    """
    known = F.nanvl(F.col(risk).cast("double"), F.lit(None).cast("double"))
    when = F.nanvl(F.col(time).cast("double"), F.lit(None).cast("double"))
    given = df.select(when.alias("t"), F.coalesce(F.col(event).cast("int"), F.lit(0)).alias("e"), known.alias("r")).where("t is not null")
    rows = materialize(given.groupBy("t", "r").agg(F.count("*").alias("n"), F.sum((F.col("e") > 0).cast("long")).alias("d")), "survival")
    parts = max(1, min(512, rows.count() // size))
    zone = lambda c: range_of(c, splits(rows, c, parts) if parts > 1 else [])
    cut = materialize(rows.withColumns({"tz": zone("t"), "rz": zone("r")}), "ranges")

    def inside(key: str, at: str):
        def run(pdf):
            import pandas as pd

            return pd.DataFrame([_counted(*(pdf[c].to_numpy(float) for c in (at, "n", "d", "r")), at == "t")], columns=["good", "total"])

        return cut.groupBy(key).applyInPandas(run, "good double, total double")

    risky = F.col("r").isNotNull()
    cells = cut.groupBy("tz", "rz").agg(F.sum("n"), F.sum("d"), F.sum(F.when(risky, F.col("n")).otherwise(0)), F.sum(F.when(risky, F.col("d")).otherwise(0))).toArrow()
    n, d, nr, dr = np.zeros((4, parts, parts))
    at = tuple(cells.column(i).to_numpy() for i in range(2))
    for i, m in enumerate((n, d, nr, dr)):
        m[at] = cells.column(2 + i).to_numpy()
    after, after_r = (m.sum(0) - np.cumsum(m, axis=0) for m in (n, nr))
    below = np.cumsum(after_r, axis=1) - after_r
    good, total = float((dr * below).sum()), float((d * (after.sum(1, keepdims=True) - after)).sum())
    s = inside("tz", "t").unionAll(inside("rz", "tz")).agg((F.coalesce(F.sum("good"), F.lit(0.0)) + good).alias("concordant"), (F.coalesce(F.sum("total"), F.lit(0.0)) + total).alias("comparable"))
    return s.withColumn("c_index", F.when(F.col("comparable") > 0, F.col("concordant") / F.col("comparable")).otherwise(0.5))


class Cox:
    """Cox regression: Newton steps on the Breslow partial likelihood of centred covariates, with step halving."""

    def __init__(self, cols: list[str], max_iter: int = 100, tol: float = 1e-9, l2: float = 0.0):
        self.cols, self.max_iter, self.tol, self.l2 = cols, max_iter, tol, l2

    def _terms(self, df: DataFrame, time: str, event: str, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        p = len(self.cols)
        x = [F.col(c) - float(m) for c, m in zip(self.cols, self.mean, strict=True)]
        eta = sum((a * float(b) for a, b in zip(x, beta, strict=True)), F.lit(0.0))
        w = F.exp(eta)
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        e = F.col(event).cast("double")
        g = df.groupBy(F.col(time).cast("double").alias("t")).agg(
            F.sum(e).alias("d"), F.sum(e * eta).alias("le"), *(F.sum(e * x[i]).alias(f"dx{i}") for i in range(p)), F.sum(w).alias("s0"), *(F.sum(w * x[i]).alias(f"s1_{i}") for i in range(p)), *(F.sum(w * x[i] * x[j]).alias(f"s2_{i}_{j}") for i, j in pairs)
        )
        sums = ["s0", *(f"s1_{i}" for i in range(p)), *(f"s2_{i}_{j}" for i, j in pairs)]
        r = prefix_sums(g, "t", sums, desc=True).where("d > 0")
        s0, d = F.col("cum_s0"), F.col("d")
        m = [F.col(f"cum_s1_{i}") / s0 for i in range(p)]
        row = r.agg(F.sum(F.col("le") - d * F.log(s0)), *(F.sum(F.col(f"dx{i}") - d * m[i]) for i in range(p)), *(F.sum(d * (F.col(f"cum_s2_{i}_{j}") / s0 - m[i] * m[j])) for i, j in pairs)).first()
        grad, info = np.array(row[1 : 1 + p], float) - self.l2 * beta, np.zeros((p, p))
        for (i, j), v in zip(pairs, row[1 + p :], strict=True):
            info[i, j] = info[j, i] = v
        return float(row[0]) - 0.5 * self.l2 * float(beta @ beta), grad, info + self.l2 * np.eye(p)

    def fit(self, df: DataFrame, time: str, event: str) -> Cox:
        _, self.mean, _ = moments(df, self.cols)
        beta = np.zeros(len(self.cols))
        like, grad, info = self._terms(df, time, event, beta)
        for _ in range(self.max_iter):
            try:
                step = np.linalg.solve(info, grad)
            except np.linalg.LinAlgError as e:
                raise FitError("singular information matrix") from e
            scale = 1.0
            while True:
                new = beta + scale * step
                got = self._terms(df, time, event, new)
                if got[0] >= like - 1e-12 or scale < 1e-4:
                    break
                scale /= 2
            done = abs(got[0] - like) < self.tol * (abs(like) + self.tol)
            beta, (like, grad, info) = new, got
            if done:
                break
        self.coefficients, self.log_likelihood = beta, like
        self.hazard_ratios = np.exp(beta)
        return self

    def risk(self, df: DataFrame) -> DataFrame:
        eta = sum(((F.col(c) - float(m)) * float(b) for c, m, b in zip(self.cols, self.mean, self.coefficients, strict=True)), F.lit(0.0))
        return df.withColumn("risk", eta)

    def baseline(self, df: DataFrame, time: str, event: str) -> DataFrame:
        """(t, hazard): the Breslow cumulative baseline."""
        g = self.risk(df).groupBy(F.col(time).cast("double").alias("t")).agg(F.sum(F.col(event).cast("double")).alias("d"), F.sum(F.exp("risk")).alias("w"))
        r = prefix_sums(g, "t", ["w"], desc=True).where("d > 0").withColumn("h", F.col("d") / F.col("cum_w"))
        return prefix_sums(r, "t", ["h"]).select("t", F.col("cum_h").alias("hazard"))
