"""Learners made of learners: pipelines, feature elimination, calibration, tuning, chains, dynamic ensembles, deep forests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.errors import FitError, NotSupported
from sparkloom.functions import measures as M
from sparkloom.functions.expr import last_argmax, prefix_sums
from sparkloom.learners.trees import ExtraTrees, RandomForest
from sparkloom.operators.neighbours import knn
from sparkloom.operators.resample import with_folds, with_holdout
from sparkloom.operators.transform import OneHotEncoder
from sparkloom.storage import materialize
from sparkloom.task import Learner, Model, Task

Factory = Callable[[], Learner]


@dataclass
class PipelineModel(Model):
    steps: list
    base: Model

    def predict(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in ("predicted", "probabilities")]
        out = df.withColumns({f"_kept{i}": F.col(c) for i, c in enumerate(kept)})
        for s in self.steps:
            out = s.transform(out)
        out = self.base.predict(out)
        return out.select(*(F.col(f"_kept{i}").alias(c) for i, c in enumerate(kept)), *(c for c in ("predicted", "probabilities") if c in out.columns))

    def importance(self) -> dict[str, float] | None:
        return self.base.importance()


@dataclass
class Pipeline(Learner):
    """Transforms fitted on the training rows, after an optional resampler of them, then a learner.

    A step has ``fit(df)`` and ``transform(df)``; ``fit_supervised(df, target)`` is used where it exists, and ``names()``
    tells a one-hot encoder's columns. Features that a step replaces are replaced in the task. The resampler takes and
    gives a task; it is an error for numbers and for weights.
    """

    steps: list
    factory: Factory
    resampler: Callable[[Task], Task] | None = None
    properties = "CRWPNI"

    @property
    def id(self) -> str:
        return "pipeline(" + "+".join([*(type(s).__name__ for s in self.steps), self.factory().id]) + ")"

    def _fit(self, task: Task) -> PipelineModel:
        if self.resampler is not None:
            if task.kind != "classif" or task.weight:
                raise NotSupported("a resampler takes classes without weights")
            task = self.resampler(task)
        df, features = task.df, list(task.features)
        for s in self.steps:
            s = s.fit_supervised(df, task.target) if hasattr(s, "fit_supervised") else s.fit(df)
            df = s.transform(df)
            if isinstance(s, OneHotEncoder):
                features = [x for f in features for x in ([f"{f}_{v}" for v in s.values[f]] if f in s.values else [f])]
            elif hasattr(s, "outputs"):
                features = s.outputs(features)
        return PipelineModel(self.steps, self.factory().fit(replace(task, df=df, features=features, categories={c: n for c, n in task.categories.items() if c in features})))


@dataclass
class FilterSelector:
    """A pipeline step that keeps the k features of the best scores; ``score(df, features, target)`` gives (feature, score). Ties go to the first column, and without a target the variance decides."""

    features: list[str]
    k: int
    score: Callable[[DataFrame, list[str], str], DataFrame] | None = None
    kept: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> FilterSelector:
        from sparkloom.operators.filters import select_top, variance

        self.kept = select_top(variance(df, self.features), self.features, self.k)
        return self

    def fit_supervised(self, df: DataFrame, target: str) -> FilterSelector:
        from sparkloom.operators.filters import select_top

        if self.score is None:
            return self.fit(df)
        self.kept = select_top(self.score(df, self.features, target), self.features, self.k)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df

    def outputs(self, features: list[str]) -> list[str]:
        return [f for f in features if f in self.kept or f not in self.features]


@dataclass
class RFE:
    """Fits, drops the feature of the least importance (the first of equal ones, the last feature where there is none), until k are left."""

    factory: Factory
    k: int
    task: Task | None = None
    kept: list[str] = field(default_factory=list)

    def select(self, task: Task) -> list[str]:
        left = list(task.features)
        while len(left) > self.k:
            importance = self.factory().fit(task.only(left)).importance()
            left.remove(min(left, key=lambda c: (importance.get(c, 0.0), left.index(c))) if importance else left[-1])
        self.kept = left
        return left

    def fit_supervised(self, df: DataFrame, target: str) -> RFE:
        if self.task is None:
            raise FitError("feature elimination needs its task")
        self.select(self.task.on(df))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df

    def outputs(self, features: list[str]) -> list[str]:
        return [f for f in features if f in self.kept]


# Calibration


def platt(df: DataFrame, score: str, positive: str, max_iter: int = 100) -> tuple[float, float]:
    """(a, b) of p = 1 / (1 + exp(a s + b)) by Newton steps on targets (N+ + 1) / (N+ + 2) and 1 / (N- + 2). One aggregate a step over distinct scores."""
    g = materialize(df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(positive).cast("double")).alias("p"), F.count("*").cast("double").alias("n")), "scores")
    pos, n = g.agg(F.sum("p"), F.sum("n")).first()
    if not n:
        raise FitError("no rows to calibrate on")
    hi, lo = (pos + 1) / (pos + 2), 1 / (n - pos + 2)
    t = F.col("p") * hi + (F.col("n") - F.col("p")) * lo
    a, b = 0.0, float(np.log((n - pos + 1) / (pos + 1)))

    def value(a: float, b: float):
        z = F.col("s") * a + b
        p = 1.0 / (1.0 + F.exp(z))
        # -log p is log(1 + exp(z)), written so that neither side overflows.
        soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        d, h = t - F.col("n") * p, F.col("n") * p * (1.0 - p)
        r = g.agg(F.sum(F.col("n") * soft - (F.col("n") - t) * z), F.sum(d * F.col("s")), F.sum(d), F.sum(h * F.col("s") * F.col("s")), F.sum(h * F.col("s")), F.sum(h)).first()
        return [float(x) for x in r]

    f, ga, gb, haa, hab, hbb = value(a, b)
    for _ in range(max_iter):
        if max(abs(ga), abs(gb)) < 1e-5:
            break
        h = np.array([[haa + 1e-12, hab], [hab, hbb + 1e-12]])
        step = -np.linalg.solve(h, [ga, gb])
        scale = 1.0
        while scale >= 1e-10:
            got = value(a + scale * step[0], b + scale * step[1])
            if got[0] < f + 1e-4 * scale * (ga * step[0] + gb * step[1]) or got[0] <= f:
                break
            scale /= 2
        else:
            break
        a, b = a + scale * step[0], b + scale * step[1]
        done = abs(f - got[0]) < 1e-12 * (1 + abs(f))
        f, ga, gb, haa, hab, hbb = got
        if done:
            break
    return float(a), float(b)


def isotonic(df: DataFrame, score: str, positive: str, points: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Scores and values of the rising step means (adjacent violators pooled). Above ``points`` distinct scores, equal parts of them are pooled first."""
    g = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(positive).cast("double")).alias("p"), F.count("*").cast("double").alias("n"))
    distinct = g.count()
    if distinct > points:
        # Running counts give each score its part, so what comes to the driver is bounded.
        c = prefix_sums(g.withColumn("one", F.lit(1)), "s", ["one"])
        g = c.groupBy(F.floor((F.col("cum_one") - 1) * points / distinct).alias("part")).agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    rows = sorted(tuple(map(float, r)) for r in g.select("s", "p", "n").collect())
    stack: list[list[float]] = []
    for s, p, n in rows:
        stack.append([p, n, s, s])
        while len(stack) > 1 and stack[-2][0] / stack[-2][1] >= stack[-1][0] / stack[-1][1]:
            q = stack.pop()
            stack[-1] = [stack[-1][0] + q[0], stack[-1][1] + q[1], stack[-1][2], q[3]]
    xs, ys = [], []
    for p, n, low, high in stack:
        for x in (low, high) if high > low else (low,):
            xs.append(x)
            ys.append(p / n)
    return np.array(xs), np.array(ys)


@dataclass
class CalibratedModel(Model):
    base: Model
    curves: list
    method: str

    def predict(self, df: DataFrame) -> DataFrame:
        from sparkloom.functions.passes import mapped

        curves, sigmoid = self.curves, self.method == "platt"
        out = self.base.predict(df)
        k = len(curves) if len(curves) > 1 else 2

        def f(x: np.ndarray) -> list:
            # Of two classes the second is calibrated, of more each one against the rest.
            cols = [x[1]] if len(curves) == 1 else list(x)
            p = np.stack([1 / (1 + np.exp(np.clip(c[0] * s + c[1], -700, 700))) if sigmoid else np.interp(s, c[0], c[1]) for s, c in zip(cols, curves, strict=True)], 1)
            p = np.hstack([1 - p, p]) if len(curves) == 1 else p
            total = p.sum(1, keepdims=True)
            p = np.where(total > 0, p / np.where(total > 0, total, 1.0), 1 / k)
            return [k - 1 - p[:, ::-1].argmax(1), p]

        return mapped(out.withColumnRenamed("probabilities", "_p").drop("predicted"), [F.col("_p")[i] for i in range(k)], [("predicted", "int"), ("probabilities", "array<double>")], f).drop("_p")

    def importance(self) -> dict[str, float] | None:
        return self.base.importance()


@dataclass
class Calibrated(Learner):
    """Probabilities mapped by ``platt`` or ``isotonic`` curves learned on a held-out share; the base is then fitted on all rows."""

    factory: Factory
    method: str = "platt"
    share: float = 0.3
    seed: int = 42
    id = "calibrated"
    properties = "CPI"

    def _fit(self, task: Task) -> CalibratedModel:
        data = materialize(with_holdout(task.df, task.ids, 1 - self.share, self.seed, "_role"), "calibration")
        part = self.factory().fit(task.on(data.where("_role = 'train'"))).predict(data.where("_role = 'test'"))
        part = materialize(part.select(F.col(task.target).alias("y"), "probabilities"), "scores")
        curve = platt if self.method == "platt" else isotonic
        classes = [1] if task.n_classes <= 2 else list(range(task.n_classes))
        curves = [curve(part.select(F.col("probabilities")[c].alias("s"), (F.col("y") == c).alias("y")), "s", "y") for c in classes]
        return CalibratedModel(self.factory().fit(task), curves, self.method)


@dataclass
class TunedModel(Model):
    base: Model
    best_params: dict
    best_score: float
    history: list

    def predict(self, df: DataFrame) -> DataFrame:
        return self.base.predict(df)

    def importance(self) -> dict[str, float] | None:
        return self.base.importance()


@dataclass
class AutoTuner(Learner):
    """A search over configurations as a learner: the inner folds choose, and the best is fitted on all rows.

    ``configs`` gives configurations to ``search``, or is a tuner ``(task, make, measure, column, maximize) -> (params, score, history)``.
    """

    make: Callable[[dict], Learner]
    configs: list[dict] | Callable
    measure: Callable[..., DataFrame]
    column: str
    folds: int = 5
    maximize: bool = True
    id = "auto_tuner"

    @property
    def properties(self) -> str:
        return self.make(self.configs[0] if isinstance(self.configs, list) else {}).properties

    def _fit(self, task: Task) -> TunedModel:
        from sparkloom.operators.tuning import search

        if isinstance(self.configs, list):
            params, score, history = search(task, self.make, self.configs, self.measure, self.column, self.folds, self.maximize)
        else:
            params, score, history = self.configs(task, self.make, self.measure, self.column, self.maximize)
        return TunedModel(self.make(params).fit(task), params, score, history)


# Several targets


@dataclass
class ChainModel:
    models: list[Model]
    targets: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with predicted_<target> for each; later models see earlier predictions."""
        out = df
        kept = {t: f"_truth_{t}" for t in self.targets if t in df.columns}
        out = out.withColumnsRenamed(kept)
        for m, t in zip(self.models, self.targets, strict=True):
            out = m.predict(out).drop("probabilities").withColumnRenamed("predicted", f"predicted_{t}").withColumn(t, F.col(f"predicted_{t}").cast("double"))
        return out.drop(*self.targets).withColumnsRenamed({v: k for k, v in kept.items()})


@dataclass
class Chain:
    """Target j has targets 0 to j - 1 as further features: the true ones in training."""

    factory: Factory

    def _fit(self, df: DataFrame, features: list[str], targets: list[str], ids: list[str], kind: str) -> ChainModel:
        models, cols = [], list(features)
        for t in targets:
            n = int(df.agg(F.max(t)).first()[0]) + 1 if kind == "classif" else 0
            inner = df.withColumns({c: F.col(c).cast("double") for c in cols if c in targets}) if cols != features else df
            models.append(self.factory().fit(Task(inner, list(cols), t, ids, kind, max(n, 2) if kind == "classif" else 0)))
            cols.append(t)
        return ChainModel(models, targets)


class ClassifierChain(Chain):
    def fit(self, df: DataFrame, features: list[str], targets: list[str], ids: list[str]) -> ChainModel:
        return self._fit(df, features, targets, ids, "classif")


class RegressorChain(Chain):
    def fit(self, df: DataFrame, features: list[str], targets: list[str], ids: list[str]) -> ChainModel:
        return self._fit(df, features, targets, ids, "regress")


# Dynamic ensembles and cascades


@dataclass
class DynamicModel(Model):
    models: list[Model]
    known: DataFrame
    task: Task
    k: int

    def predict(self, df: DataFrame) -> DataFrame:
        kept, n = df.columns, self.task.n_classes
        out = materialize(df.withColumn("_q", F.monotonically_increasing_id()), "queries")
        near = knn(out, self.known, "_q", self.task.features, self.k, skip_self=False, other_id="_known").join(self.known.select(F.col("_known").alias("id"), "_right"), "id")
        good = near.groupBy(F.col("query").alias("_q")).agg(F.array(*(F.min(F.col("_right")[i].cast("int")) for i in range(len(self.models)))).alias("_use"))
        for i, m in enumerate(self.models):
            out = m.predict(out).withColumnRenamed("predicted", f"_v{i}").drop("probabilities")
        out = out.join(good, "_q", "left").withColumn("_use", F.when(F.array_max("_use") > 0, F.col("_use")).otherwise(F.array(*[F.lit(1)] * len(self.models))))
        votes = [sum((F.when((F.col(f"_v{i}") == c) & (F.col("_use")[i] > 0), 1.0).otherwise(0.0) for i in range(len(self.models))), F.lit(0.0)) for c in range(n)]
        total = sum(votes[1:], votes[0])
        out = out.withColumn("probabilities", F.array(*(v / total for v in votes)))
        return out.select(*kept, last_argmax(F.col("probabilities")).alias("predicted"), "probabilities")


@dataclass
class DynamicEnsemble(Learner):
    """For each row only the bases that are right on all its k nearest held-out rows vote, or all if none is."""

    bases: list[Factory]
    k: int = 7
    share: float = 0.3
    seed: int = 42
    id = "dynamic_ensemble"
    properties = "CP"

    def _fit(self, task: Task) -> DynamicModel:
        data = materialize(with_holdout(task.df, task.ids, 1 - self.share, self.seed, "_role"), "dynamic")
        models = [b().fit(task.on(data.where("_role = 'train'"))) for b in self.bases]
        known = data.where("_role = 'test'").withColumn("_known", F.monotonically_increasing_id())
        right = []
        for i, m in enumerate(models):
            known = m.predict(known).withColumn(f"_r{i}", F.col("predicted") == F.col(task.target)).drop("predicted", "probabilities")
            right.append(F.col(f"_r{i}"))
        known = materialize(known.select("_known", *task.features, F.array(*right).alias("_right")), "known")
        return DynamicModel(models, known, task, min(self.k, known.count()))


@dataclass
class CascadeModel(Model):
    layers: list[list[Model]]
    n_classes: int

    def n_layers(self) -> int:
        return len(self.layers)

    def predict(self, df: DataFrame) -> DataFrame:
        out, made = df, []
        for layer in self.layers:
            cols = []
            for i, m in enumerate(layer):
                out = m.predict(out).drop("predicted").withColumnRenamed("probabilities", f"_c{i}")
                cols.append(f"_c{i}")
            out = out.drop(*made)
            made = [f"_d{i}_{c}" for i in range(len(layer)) for c in range(self.n_classes)]
            mean = F.array(*(sum((F.col(x)[c] for x in cols), F.lit(0.0)) / len(cols) for c in range(self.n_classes)))
            out = out.withColumns({f"_d{i}_{c}": F.col(f"_c{i}")[c] for i in range(len(layer)) for c in range(self.n_classes)}).withColumn("_mean", mean).drop(*cols)
        return out.withColumn("probabilities", F.col("_mean")).withColumn("predicted", last_argmax(F.col("probabilities"))).drop("_mean", *made)


@dataclass
class DeepForest(Learner):
    """A cascade of random and extra forests: each layer gets the out-of-fold probabilities of the one before, until accuracy stops rising by 1e-6."""

    forests: int = 2
    n_estimators: int = 100
    max_depth: int = 10
    folds: int = 3
    max_layers: int = 10
    patience: int = 2
    seed: int = 42
    id = "deep_forest"
    properties = "CP"

    def _fit(self, task: Task) -> CascadeModel:
        k = task.n_classes
        data = materialize(with_folds(task.df, task.ids, self.folds, self.seed, "_f"), "cascade")
        layers, best, best_at, made = [], -1.0, 0, []
        for layer in range(self.max_layers):
            makers = [lambda c=c, s=layer * 100 + i: c(n_estimators=self.n_estimators, max_depth=self.max_depth, seed=self.seed + s) for i in range(self.forests) for c in (RandomForest, ExtraTrees)]
            inner = replace(task, df=data, features=[*task.features, *made])
            parts = None
            for f in range(self.folds):
                test = data.where(F.col("_f") == f)
                for i, make in enumerate(makers):
                    test = make().fit(inner.on(data.where(F.col("_f") != f))).predict(test).drop("predicted").withColumnRenamed("probabilities", f"_c{i}")
                parts = test if parts is None else parts.unionByName(test)
            cols = [f"_c{i}" for i in range(len(makers))]
            mean = F.array(*(sum((F.col(x)[c] for x in cols), F.lit(0.0)) for c in range(k)))
            layers.append([m().fit(inner) for m in makers])
            parts = materialize(parts.withColumn("_right", (last_argmax(mean) == F.col(task.target)).cast("double")), "layer")
            score = parts.agg(F.avg("_right")).first()[0]
            if score > best + 1e-6:
                best, best_at = score, layer
            elif layer - best_at >= self.patience:
                break
            new = {f"_d{i}_{c}": F.col(f"_c{i}")[c] for i in range(len(makers)) for c in range(k)}
            data, made = parts.drop(*made).withColumns(new).drop(*cols, "_right"), list(new)
        return CascadeModel(layers[: best_at + 1], k)
