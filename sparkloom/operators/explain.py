"""Explanations of any model: permutation importance and Shapley values by permutations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.resample import placed
from sparkloom.storage import materialize
from sparkloom.task import Model, Task


def permutation_importance(model: Model, task: Task, measure: Callable[..., DataFrame], column: str, repeats: int = 5, seed: int = 42, maximize: bool = True) -> DataFrame:
    """(feature, importance, std), the largest first: the score less the mean score with the feature's values dealt anew among the rows.

    Row i gets the value of row (a i + b) modulo n of a random order, with a prime to n drawn for each feature and
    repeat, so a shuffle is a join of two row numbers. All shuffles are predicted and measured together.
    """
    rows = materialize(placed(task.df.select(*task.features, task.target, *task.ids), task.ids, seed, "_rn"), "rows")
    n = rows.count()
    rng = np.random.default_rng(seed)
    base = measure(model.predict(rows), task.target, "predicted").select(column).first()[0]
    parts = None
    for j, f in enumerate(task.features):
        values = rows.select(F.col("_rn").alias("_at"), F.col(f).alias("_v"))
        for r in range(repeats):
            a, b = _prime_to(n, rng), int(rng.integers(max(1, n)))
            at = F.pmod(F.col("_rn") * F.lit(a) + F.lit(b), F.lit(n))
            one = rows.withColumn("_at", at).join(values, "_at").withColumn(f, F.col("_v")).drop("_at", "_v").withColumns({"_feature": F.lit(j), "_repeat": F.lit(r)})
            parts = one if parts is None else parts.unionByName(one)
    scores = measure(model.predict(parts), task.target, "predicted", ["_feature", "_repeat"])
    gap = F.lit(float(base)) - F.col(column) if maximize else F.col(column) - F.lit(float(base))
    out = scores.groupBy("_feature").agg(F.avg(gap).alias("importance"), F.stddev_pop(column).alias("std"))
    names = F.array(*(F.lit(f) for f in task.features))
    return out.select(names[F.col("_feature")].alias("feature"), "importance", "std").orderBy(F.desc("importance"), "feature")


def _prime_to(n: int, rng: np.random.Generator) -> int:
    if n < 3:
        return 1
    while True:
        a = int(rng.integers(1, min(n, 2**31)))
        if np.gcd(a, n) == 1:
            return a


def permutation_shap(model: Model, task: Task, rows: DataFrame, background: int = 10, permutations: int = 4, seed: int = 42, of_class: int | None = None) -> DataFrame:
    """(ids, base, phi_<feature>...) of the rows: mean gains in the prediction as features switch, in random orders, from a background row's values to the row's.

    The gains of a row and a background row sum to f(row) - f(background), so the values sum to f(row) - base exactly.
    ``background`` rows of the task are drawn by hash; each row makes background x permutations x (features + 1)
    predictions, all in one pass. ``of_class`` explains that class's probability.
    """
    features, ids = task.features, task.ids
    p = len(features)
    some = [[float(v) for v in r] for r in task.df.orderBy(F.xxhash64(*ids, F.lit(seed)), *ids).select(*features).limit(background).collect()]
    rng = np.random.default_rng(seed)
    orders = [(b, rng.permutation(p).tolist()) for b in range(len(some)) for _ in range(permutations)]
    # One entry for each step of each order: which features still have the background's value.
    steps = []
    for o, (b, order) in enumerate(orders):
        on = [False] * p
        steps.append((o, 0, -1, b, list(on)))
        for s, f in enumerate(order):
            on[f] = True
            steps.append((o, s + 1, f, b, list(on)))
    plan = rows.sparkSession.createDataFrame(steps, "_o int, _s int, _f int, _b int, _on array<boolean>")
    values = rows.sparkSession.createDataFrame([(i, r) for i, r in enumerate(some)], "_b int, _bg array<double>")
    # The plan's size is that of background, permutations and features, whatever the rows.
    made = rows.select(*ids, *(F.col(c).cast("double").alias(c) for c in features)).crossJoin(F.broadcast(plan.join(values, "_b")))
    made = made.withColumns({c: F.when(F.col("_on")[j], F.col(c)).otherwise(F.col("_bg")[j]) for j, c in enumerate(features)})
    out = model.predict(made).withColumn("_y", F.col("probabilities")[of_class] if of_class is not None else F.col("predicted").cast("double"))
    per = out.groupBy(*ids, "_o").agg(F.sort_array(F.collect_list(F.struct("_s", "_f", "_y"))).alias("_p"))
    phi = lambda j: F.aggregate(F.sequence(F.lit(1), F.lit(p)), F.lit(0.0), lambda a, i: a + F.when(F.element_at("_p", i + 1)["_f"] == j, F.element_at("_p", i + 1)["_y"] - F.element_at("_p", i)["_y"]).otherwise(0.0))
    per = per.select(*ids, F.element_at("_p", 1)["_y"].alias("_base"), *(phi(j).alias(f"_phi{j}") for j in range(p)))
    return per.groupBy(*ids).agg(F.avg("_base").alias("base"), *(F.avg(f"_phi{j}").alias(f"phi_{c}") for j, c in enumerate(features)))


def shap_importance(values: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance): mean absolute Shapley values, the largest first."""
    s = values.agg(*(F.avg(F.abs(F.col(f"phi_{c}"))).alias(c) for c in features)).first()
    return values.sparkSession.createDataFrame(sorted(((c, float(s[c] or 0.0)) for c in features), key=lambda x: -x[1]), "feature string, importance double")
