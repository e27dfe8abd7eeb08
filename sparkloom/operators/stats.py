"""Statistical comparison of models. Ranks and counts are taken by Spark, distributions on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.errors import EngineError
from sparkloom.functions.expr import prefix_sums

#: Studentised range quantiles over sqrt(2) at 0.05, for 3 to 10 models.
NEMENYI_Q = {3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution by the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, x = k / 2, x / 2
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        f = -i * (i - a)
        b += 2
        d = f * d + b or 1e-300
        c = b + f / c or 1e-300
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def signed_ranks(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, w_plus, w_minus, ties): rank sums of the non-zero differences; ranks are averaged over equal sizes.

    Sizes are counted first, so ranks come from running sums over distinct sizes, not from a sort of all rows.
    """
    d = df.select((F.col(a) - F.col(b)).alias("d")).where(F.abs("d") > 1e-15)
    g = d.groupBy(F.abs("d").alias("s")).agg(F.count("*").alias("c"), F.sum((F.col("d") > 0).cast("long")).alias("pos"))
    r = prefix_sums(g, "s", ["c"])
    rank = F.col("cum_c") - (F.col("c") - 1) / 2.0
    c = F.col("c").cast("double")
    return r.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(rank * F.col("pos")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(rank * (F.col("c") - F.col("pos"))), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(c * c * c - c), F.lit(0.0)).alias("ties"))


def wilcoxon(df: DataFrame, a: str, b: str) -> dict[str, float]:
    """Two-sided signed-rank test: exact for n up to 100 without ties, else normal with tie and continuity corrections."""
    r = signed_ranks(df, a, b).first()
    n, w = int(r["n"]), min(r["w_plus"], r["w_minus"])
    if n == 0:
        return {"n": 0, "w": 0.0, "p": 1.0}
    if n <= 100 and r["ties"] == 0:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        p = min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    else:
        mean = n * (n + 1) / 4
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - r["ties"] / 48)
        p = min(1.0, 2 * normal_cdf((w - mean + 0.5) / sd)) if sd > 0 else 1.0
    return {"n": n, "w": w, "p": p}


def sign_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """(wins, losses) of a over b."""
    d = F.col(a) - F.col(b)
    return df.agg(F.sum((d > 1e-15).cast("long")).alias("wins"), F.sum((d < -1e-15).cast("long")).alias("losses"))


def sign_test(df: DataFrame, a: str, b: str) -> dict[str, float]:
    r = sign_counts(df, a, b).first()
    n, k = r["wins"] + r["losses"], min(r["wins"], r["losses"])
    p = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
    return {"wins": r["wins"], "losses": r["losses"], "p": p}


def friedman_ranks(scores: DataFrame, block: str, model: str, score: str) -> DataFrame:
    """(block, model, rank): average ranks inside a block, the highest score first."""
    w = Window.partitionBy(block).orderBy(F.col(score).desc())
    ties = Window.partitionBy(block, score)
    return scores.select(block, model, (F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0).alias("rank"))


def friedman(scores: DataFrame, block: str, model: str, score: str) -> DataFrame:
    """(model, mean_rank, statistic, n, k): the tie-corrected chi-square beside each model's mean rank."""
    r = friedman_ranks(scores, block, model, score)
    m = r.groupBy(model).agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n"))
    t = r.groupBy(block, "rank").count().agg(F.sum(F.col("count").cast("double") ** 3 - F.col("count")).alias("ties"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    s = m.agg(F.max("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("mean_rank") * F.col("mean_rank")).alias("sq")).crossJoin(t)
    raw = 12.0 * n / (k * (k + 1)) * (F.col("sq") - k * (k + 1) * (k + 1) / 4.0)
    fix = 1.0 - F.col("ties") / (n * (k * k * k - k))
    s = s.select("n", "k", F.when(fix > 0, raw / fix).otherwise(0.0).alias("statistic"))
    return m.drop("n").crossJoin(s)


def friedman_p(statistic: float, k: int) -> float:
    if k < 3:
        raise EngineError("the Friedman test needs three models or more")
    return chi2_sf(statistic, k - 1)


def nemenyi(ranks: DataFrame, model: str) -> DataFrame:
    """(model_a, model_b, gap, critical, differs) of every pair of models, from :func:`friedman`."""
    q = F.create_map(*[F.lit(x) for kv in NEMENYI_Q.items() for x in kv])
    a = ranks.select(F.col(model).alias("model_a"), F.col("mean_rank").alias("ra"), "n", "k")
    b = ranks.select(F.col(model).alias("model_b"), F.col("mean_rank").alias("rb"))
    k = F.col("k").cast("double")
    cd = F.coalesce(q[F.col("k").cast("int")], F.lit(2.576)) * F.sqrt(k * (k + 1) / (6.0 * F.col("n")))
    return a.join(b, F.col("model_a") < F.col("model_b")).select("model_a", "model_b", F.abs(F.col("ra") - F.col("rb")).alias("gap"), cd.alias("critical"), (F.abs(F.col("ra") - F.col("rb")) > cd).alias("differs"))


def mcnemar(df: DataFrame, a: str, b: str, truth: str) -> DataFrame:
    """(b, c, statistic): rows that only the first, only the second gets right; continuity-corrected."""
    x, y = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    s = df.agg(F.sum((x & ~y).cast("long")).alias("b"), F.sum((~x & y).cast("long")).alias("c"))
    gap = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)).cast("double")
    return s.select("b", "c", F.when(F.col("b") + F.col("c") > 0, gap * gap / (F.col("b") + F.col("c"))).otherwise(0.0).alias("statistic"))


def bootstrap_ci(scores: list[float], confidence: float = 0.95, draws: int = 1000, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of resampled means."""
    import numpy as np

    x = np.asarray(scores, float)
    means = np.sort(np.random.default_rng(seed).choice(x, (draws, len(x))).mean(1))
    low = int((1 - confidence) / 2 * draws)
    return float(means[low]), float(means[min(draws - 1, draws - 1 - low)])


def compare_models(scores: dict[str, list[float]], confidence: float = 0.95, spark=None, maximize: bool = True) -> list[dict]:
    """Mean and interval of each model's scores, the best first. With a session also the signed-rank test of the best against each other and a verdict."""
    rows = [{"model": k, "mean": sum(v) / len(v), "interval": bootstrap_ci(v, confidence)} for k, v in scores.items()]
    rows.sort(key=lambda r: (-r["mean"] if maximize else r["mean"]))
    if spark is None or len(rows) < 2:
        return rows
    best = rows[0]["model"]
    for r in rows[1:]:
        pairs = spark.createDataFrame(list(zip(map(float, scores[best]), map(float, scores[r["model"]]), strict=True)), "a double, b double")
        r["p"] = wilcoxon(pairs, "a", "b")["p"]
        r["verdict"] = f"{best} is better than {r['model']}" if r["p"] < 1 - confidence else f"{best} and {r['model']} don't differ"
    return rows
