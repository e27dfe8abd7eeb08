"""Learners around learners: stacking, bagging, thresholds, costs, transformed targets; and resampled scores of any learner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import FitError
from sparkloom.functions.expr import last_argmax, prefix_sums
from sparkloom.operators.resample import drawn, placed, with_folds, with_holdout
from sparkloom.storage import materialize
from sparkloom.task import Learner, Model, Task

Factory = Callable[[], Learner]


@dataclass
class CostModel(Model):
    base: Model
    costs: list[list[float]]

    def predict(self, df: DataFrame) -> DataFrame:
        return decide(self.base.predict(df), self.costs)


def decide(df: DataFrame, costs: list[list[float]], probs: str = "probabilities") -> DataFrame:
    """``df`` with predicted: the class of the least expected cost, the first of equal ones; costs[i][j] is that of j when i is true."""
    k = len(costs)
    expected = [sum((F.col(probs)[i] * float(costs[i][j]) for i in range(k)), F.lit(0.0)) for j in range(k)]
    e = F.array(*expected)
    return df.withColumn("predicted", (F.array_position(e, F.array_min(e)) - 1).cast("int"))


@dataclass
class CostSensitive(Learner):
    factory: Factory
    costs: list[list[float]]
    id = "cost_sensitive"
    properties = "CPI"

    def _fit(self, task: Task) -> CostModel:
        return CostModel(self.factory().fit(task), self.costs)


def threshold_sweep(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, f1) of every distinct score as a threshold (score >= threshold is positive); counts run over distinct scores."""
    g = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum((F.col(truth) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    c = prefix_sums(g, "threshold", ["pos", "n"], desc=True)
    total = g.agg(F.sum("pos").alias("all"))
    f1 = 2.0 * F.col("cum_pos") / (F.col("cum_n") + F.col("all"))
    return c.crossJoin(F.broadcast(total)).select("threshold", F.when(F.col("cum_n") + F.col("all") > 0, f1).otherwise(0.0).alias("f1"))


@dataclass
class ThresholdModel(Model):
    base: Model
    threshold: float

    def predict(self, df: DataFrame) -> DataFrame:
        return self.base.predict(df).withColumn("predicted", (F.col("probabilities")[1] >= self.threshold).cast("int"))


@dataclass
class Thresholded(Learner):
    """Binary; the smallest threshold with the best F1 on a held-out share."""

    factory: Factory
    share: float = 0.3
    seed: int = 42
    id = "thresholded"
    properties = "CP"

    def _fit(self, task: Task) -> ThresholdModel:
        data = materialize(with_holdout(task.df, task.ids, 1 - self.share, self.seed), "holdout")
        part = self.factory().fit(task.on(data.where("role = 'train'"))).predict(data.where("role = 'test'"))
        best = threshold_sweep(part.withColumn("_s", F.col("probabilities")[1]), task.target, "_s").orderBy(F.desc("f1"), "threshold").first()
        return ThresholdModel(self.factory().fit(task), best["threshold"])


TRANSFORMS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "log": (F.log, F.exp),
    "log1p": (F.log1p, F.expm1),
    "sqrt": (F.sqrt, lambda c: c * c),
}


@dataclass
class TargetModel(Model):
    base: Model
    inverse: Callable[[Column], Column]

    def predict(self, df: DataFrame) -> DataFrame:
        return self.base.predict(df).withColumn("predicted", self.inverse(F.col("predicted")))


@dataclass
class TargetTransform(Learner):
    """A regressor of log, log1p, sqrt or standardised targets; predictions are turned back."""

    factory: Factory
    how: str = "log"
    id = "target_transform"
    properties = "RI"

    def _fit(self, task: Task) -> TargetModel:
        y = F.col(task.target).cast("double")
        if self.how == "standardize":
            m, s = task.df.agg(F.avg(y), F.stddev_pop(y)).first()
            s = s or 1.0
            there, back = (lambda c: (c - m) / s), (lambda c: c * s + m)
        else:
            there, back = TRANSFORMS[self.how]
            low = task.df.agg(F.min(y)).first()[0]
            if low < 0 and self.how == "sqrt" or low <= 0 and self.how == "log" or low <= -1:
                raise FitError(f"{self.how} of {low}")
        df = task.df.withColumn("_y", there(y))
        return TargetModel(self.factory().fit(replace(task, df=df, target="_y")), back)


@dataclass
class StackedModel(Model):
    bases: list[Model]
    meta: Model
    cols: list[list[str]]

    def predict(self, df: DataFrame) -> DataFrame:
        out = df
        for m, cols in zip(self.bases, self.cols, strict=True):
            out = _features(m.predict(out), cols)
        return self.meta.predict(out).drop(*(c for x in self.cols for c in x))


def _features(df: DataFrame, cols: list[str]) -> DataFrame:
    if "probabilities" in df.columns:
        return df.withColumns({c: F.col("probabilities")[i] for i, c in enumerate(cols)}).drop("predicted", "probabilities")
    return df.withColumnRenamed("predicted", cols[0])


@dataclass
class Stacking(Learner):
    """Out-of-fold predictions of the bases are the meta learner's features; bases are then fitted on all rows."""

    bases: list[Factory]
    meta: Factory
    folds: int = 5
    seed: int = 42
    id = "stacking"
    properties = "CRP"

    def _fit(self, task: Task) -> StackedModel:
        data = materialize(with_folds(task.df, task.ids, self.folds, self.seed, "_f"), "stack")
        width = task.n_classes if task.kind == "classif" else 1
        cols = [[f"_b{i}_{j}" for j in range(width)] for i in range(len(self.bases))]
        parts = None
        for f in range(self.folds):
            test = data.where(F.col("_f") == f)
            for factory, c in zip(self.bases, cols, strict=True):
                test = _features(factory().fit(task.on(data.where(F.col("_f") != f))).predict(test), c)
            parts = test if parts is None else parts.unionByName(test)
        meta = self.meta().fit(replace(task, df=materialize(parts, "stacked"), features=[c for x in cols for c in x]))
        return StackedModel([b().fit(task) for b in self.bases], meta, cols)


@dataclass
class BaggedModel(Model):
    models: list[Model]
    kind: str

    def predict(self, df: DataFrame) -> DataFrame:
        out, names = df, []
        for i, m in enumerate(self.models):
            col = "probabilities" if self.kind == "classif" else "predicted"
            out = m.predict(out).withColumnRenamed(col, f"_p{i}").drop("predicted", "probabilities")
            names.append(f"_p{i}")
        n = float(len(names))
        if self.kind == "regress":
            return out.withColumn("predicted", sum((F.col(c) for c in names), F.lit(0.0)) / n).drop(*names)
        p = F.col(names[0])
        for c in names[1:]:
            p = F.zip_with(p, F.col(c), lambda a, b: a + b)
        out = out.withColumn("probabilities", F.transform(p, lambda x: x / n)).drop(*names)
        return out.withColumn("predicted", last_argmax(F.col("probabilities")))


@dataclass
class Bagging(Learner):
    """Copies of a learner on bootstrap draws, given as weights where it takes them, else as repeated rows."""

    factory: Factory
    n_estimators: int = 10
    seed: int = 42
    id = "bagging"
    properties = "CRP"

    def _fit(self, task: Task) -> BaggedModel:
        rows = materialize(placed(task.df, task.ids, self.seed, "rn"), "rows")
        draws = materialize(drawn(rows.sparkSession, rows.count(), self.n_estimators, self.seed), "draws")
        models = []
        for b in range(self.n_estimators):
            learner = self.factory()
            df = rows.join(draws.where(F.col("b") == b).drop("b"), "rn").drop("rn")
            if "W" in learner.properties:
                models.append(learner.fit(replace(task, df=df, weight="mult")))
            else:
                models.append(learner.fit(task.on(df.withColumn("_r", F.explode(F.expr("sequence(1, mult)"))).drop("_r", "mult"))))
        return BaggedModel(models, task.kind)


def resample(task: Task, factory: Factory, measure: Callable[..., DataFrame], k: int = 5, seed: int = 42) -> DataFrame:
    """(fold, score columns) of k-fold cross-validation: every fold fits on the rest and all tests are measured in one pass."""
    data = materialize(with_folds(task.df, task.ids, k, seed), "cv")
    parts = None
    for f in range(k):
        one = factory().fit(task.on(data.where(F.col("fold") != f))).predict(data.where(F.col("fold") == f))
        parts = one if parts is None else parts.unionByName(one)
    return measure(parts, task.target, "predicted", ["fold"])


def benchmark(tasks: dict[str, Task], learners: dict[str, Factory], measure: Callable[..., DataFrame], k: int = 5) -> DataFrame:
    """(task, learner, fold, score columns). Learners that don't fit a kind of task are left out; a fit that fails on a task has one row of null scores."""
    out = failed = None
    for t, task in tasks.items():
        for name, factory in learners.items():
            if ("C" if task.kind == "classif" else "R") not in factory().properties:
                continue
            try:
                s = resample(task, factory, measure, k).select(F.lit(t).alias("task"), F.lit(name).alias("learner"), "*")
            except FitError:
                failed = [*(failed or []), (t, name)]
                continue
            out = s if out is None else out.unionByName(s)
    if failed and out is not None:
        rows = out.sparkSession.createDataFrame(failed, "task string, learner string")
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def benchmark_summary(scores: DataFrame, column: str) -> DataFrame:
    """(task, learner, mean, std) of a score over the folds; the deviation is the population's."""
    return scores.groupBy("task", "learner").agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
