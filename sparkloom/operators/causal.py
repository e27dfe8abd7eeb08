"""Effects of a binary treatment by meta-learners: fits over arms and pseudo-outcomes, any regression learner inside."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.resample import with_folds
from sparkloom.storage import materialize
from sparkloom.task import Learner, Task, regression

Factory = Callable[[], Learner]


def _predicted(model, df: DataFrame, out: str) -> DataFrame:
    return model.predict(df).withColumnRenamed("predicted", out).drop("probabilities")


def t_learner(task: Task, treatment: str, factory: Factory) -> DataFrame:
    """Rows with estimated: the treated arm's model less the untreated arm's."""
    m0 = factory().fit(task.on(task.df.where(F.col(treatment) == 0)))
    m1 = factory().fit(task.on(task.df.where(F.col(treatment) == 1)))
    return _predicted(m1, _predicted(m0, task.df, "_m0"), "_m1").withColumn("estimated", F.col("_m1") - F.col("_m0")).drop("_m0", "_m1")


def s_learner(task: Task, treatment: str, factory: Factory) -> DataFrame:
    """One model with the treatment as a feature, at 1 less at 0."""
    df = task.df.withColumn(treatment, F.col(treatment).cast("double"))
    m = factory().fit(replace(task, df=df, features=[*task.features, treatment]))
    one = _predicted(m, df.withColumn("_t", F.col(treatment)).withColumn(treatment, F.lit(1.0)), "_m1")
    zero = _predicted(m, one.withColumn(treatment, F.lit(0.0)), "_m0")
    return zero.withColumn(treatment, F.col("_t")).withColumn("estimated", F.col("_m1") - F.col("_m0")).drop("_m0", "_m1", "_t")


def out_of_fold(task: Task, factory: Factory, out: str, k: int = 5, seed: int = 42, train: Column | None = None) -> DataFrame:
    """``task.df`` with predictions of models that did not see the row: of numbers, or of the probability of class 1. ``train`` keeps some rows for training."""
    data = materialize(with_folds(task.df, task.ids, k, seed, "_f"), "folds")
    parts = None
    for f in range(k):
        rest = data.where(F.col("_f") != f)
        one = factory().fit(task.on(rest if train is None else rest.where(train))).predict(data.where(F.col("_f") == f))
        one = one.withColumn(out, F.col("probabilities")[1] if task.kind == "classif" else F.col("predicted")).drop("predicted", "probabilities")
        parts = one if parts is None else parts.unionByName(one)
    return parts.drop("_f")


def out_of_fold_arms(task: Task, treatment: str, factory: Factory, k: int = 5, seed: int = 42) -> DataFrame:
    """``task.df`` with _m0 and _m1: each arm's outcome by models of that arm that did not see the row."""
    df = out_of_fold(task, factory, "_m0", k, seed, F.col(treatment) == 0)
    return out_of_fold(task.on(df), factory, "_m1", k, seed, F.col(treatment) == 1)


def out_of_fold_propensity(task: Task, treatment: str, factory: Factory, out: str = "_e", k: int = 5, seed: int = 42) -> DataFrame:
    """``task.df`` with the probability of treatment, by a classifier or else a regression of the treatment."""
    classes = "C" in factory().properties
    return out_of_fold(Task(task.df, task.features, treatment, task.ids, "classif" if classes else "regress", 2 if classes else 0), factory, out, k, seed)


def dr_pseudo_outcome(df: DataFrame, y: str, t: str, m0: str, m1: str, e: str, clip: float = 1e-3) -> DataFrame:
    """``df`` with pseudo: m1 - m0 + t (y - m1) / e - (1 - t)(y - m0) / (1 - e), e clipped."""
    p = F.least(F.greatest(F.col(e), F.lit(clip)), F.lit(1 - clip))
    out = F.col(m1) - F.col(m0) + F.col(t) * (F.col(y) - F.col(m1)) / p - (1 - F.col(t)) * (F.col(y) - F.col(m0)) / (1.0 - p)
    return df.withColumn("pseudo", out)


def dr_learner(task: Task, treatment: str, outcome: Factory, propensity: Factory, effect: Factory, k: int = 5) -> DataFrame:
    """Doubly robust: pseudo-outcomes from arm models and a propensity model that did not see the row, regressed on the features."""
    df = out_of_fold_propensity(task.on(out_of_fold_arms(task, treatment, outcome, k)), treatment, propensity, "_e", k)
    df = materialize(dr_pseudo_outcome(df, task.target, treatment, "_m0", "_m1", "_e"), "pseudo")
    return _predicted(effect().fit(regression(df, task.features, "pseudo", task.ids)), df, "estimated").drop("_m0", "_m1", "_e", "pseudo")


def x_learner(task: Task, treatment: str, outcome: Factory, effect: Factory, propensity: Factory, clip: float = 1e-3) -> DataFrame:
    """Imputed effects of both arms, blended by the propensity."""
    m0 = outcome().fit(task.on(task.df.where(F.col(treatment) == 0)))
    m1 = outcome().fit(task.on(task.df.where(F.col(treatment) == 1)))
    d1 = _predicted(m0, task.df.where(F.col(treatment) == 1), "_m").withColumn("_d", F.col(task.target) - F.col("_m"))
    d0 = _predicted(m1, task.df.where(F.col(treatment) == 0), "_m").withColumn("_d", F.col("_m") - F.col(task.target))
    t1, t0 = effect().fit(replace(task, df=d1, target="_d")), effect().fit(replace(task, df=d0, target="_d"))
    e = propensity().fit(Task(task.df, task.features, treatment, task.ids, "classif", 2))
    df = _predicted(t0, _predicted(t1, task.df, "_t1"), "_t0")
    df = e.predict(df).withColumn("_g", F.least(F.greatest(F.col("probabilities")[1], F.lit(clip)), F.lit(1 - clip)))
    return df.withColumn("estimated", F.col("_g") * F.col("_t0") + (1.0 - F.col("_g")) * F.col("_t1")).drop("_g", "_t0", "_t1", "predicted", "probabilities")


def r_learner(task: Task, treatment: str, outcome: Factory, propensity: Factory, effect: Factory, k: int = 5, clip: float = 0.05, copies: int = 20) -> DataFrame:
    """Cross-fitted residuals: (y - m) / (t - e) with weights (t - e)^2, rows with a small residual left out.

    An effect learner without weights gets each row 1 to ``copies`` times, in proportion to its weight over the largest.
    """
    df = out_of_fold_propensity(task.on(out_of_fold(task, outcome, "_m", k)), treatment, propensity, "_e", k)
    r = F.col(treatment) - F.col("_e")
    fit = materialize(df.where(F.abs(r) >= max(clip, 1e-8)).withColumns({"_p": (F.col(task.target) - F.col("_m")) / r, "_w": r * r}), "residuals")
    learner = effect()
    if "W" in learner.properties:
        m = learner.fit(replace(task, df=fit, target="_p", weight="_w"))
    else:
        top = fit.agg(F.max("_w")).first()[0]
        times = F.greatest(F.lit(1), F.round(F.col("_w") / float(top) * copies).cast("int"))
        m = learner.fit(replace(task, df=fit.withColumn("_c", F.explode(F.sequence(F.lit(1), times))).drop("_c"), target="_p"))
    return _predicted(m, df, "estimated").drop("_m", "_e")
