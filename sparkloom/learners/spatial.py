"""Spatial learners: local boosted models around every point, and kriging of a learner's residuals."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import FitError
from sparkloom.functions.expr import present
from sparkloom.learners.boosting import BoostedModel, Booster
from sparkloom.learners.growth import Growth, Local, Tree, View, binned, grow
from sparkloom.operators.neighbours import knn
from sparkloom.operators.resample import with_folds
from sparkloom.storage import materialize
from sparkloom.task import Learner, Model, Task


def local_store(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: float) -> Local:
    """A store of rows already in memory; x are bins (features, rows)."""
    out = Local.__new__(Local)
    out.view, out.live = View(x, y, w, np.full((1, len(y)), start), np.zeros((0, len(y))), [(0, len(y))]), {}
    return out


def boost_rows(x: np.ndarray, y: np.ndarray, w: np.ndarray, how: Booster) -> tuple[list[np.ndarray], list[Tree], float]:
    """A boosted model of squared errors on a few rows (rows, features), without Spark: cut values, trees, start."""
    cuts = []
    for v in x.T:
        d = np.unique(v[~np.isnan(v)])
        cuts.append((d[1:] + d[:-1]) / 2 if len(d) <= how.n_bins // 2 else np.unique(np.quantile(d, np.linspace(0, 1, how.n_bins)[1:-1])))
    start = float((y * w).sum() / w.sum())
    store, lam, trees = local_store(binned(list(x.T), cuts), y, w, start), how.reg_lambda, []
    growth = Growth(lambda s: 0.5 * s[..., 0] ** 2 / np.maximum(s[..., 1] + lam, 1e-12), lambda s: float(-s[0] / max(s[1] + lam, 1e-12)), how.max_depth, min_weight=min(how.min_child_weight, 1e-3), weight=1)
    for r in range(how.n_estimators):
        t, key = Tree(), (r,)
        store.open(key, t, lambda v, _: ([(v.m[0] - v.y) * v.w, v.w, None], None))
        grow(store, [key], [t], growth, r)
        at = store.close(key)
        t.value = [v * how.learning_rate for v in t.value]
        store.add([(0, t)], [at])
        trees.append(t)
    return cuts, trees, start


def apply_rows(model: tuple, x: np.ndarray) -> np.ndarray:
    cuts, trees, start = model
    b = binned(list(x.T), cuts)
    return start + sum((np.array(t.value)[t.apply(b)] for t in trees), np.zeros(len(x)))


@dataclass
class GeoModel(Model):
    cols: list[str]
    coords: list[str]
    base: BoostedModel
    local: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        """Each row goes to the model of its nearest training point; its prediction is alpha * local + (1 - alpha) * global."""
        kept = [c for c in df.columns if c != "predicted"]
        rows = materialize(self.base.predict(df).withColumnRenamed("predicted", "_g").withColumn("_q", F.monotonically_increasing_id()), "geo")
        near = knn(rows, self.local, "_q", self.coords, 1, skip_self=False, other_id="_s").select(F.col("query").alias("_q"), F.col("id").alias("_s"))
        met = rows.join(near, "_q").join(self.local.select("_s", "alpha", "model"), "_s").withColumn("_x", F.struct(*(present(c).alias(f"f{i}") for i, c in enumerate(self.cols))))
        p, schema = len(self.cols), type(df.schema)([f for f in df.schema.fields if f.name in kept]).add("predicted", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.stack([b["_x"].field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)], 1)
                out = b["_g"].to_numpy(zero_copy_only=False).astype(float).copy()
                alpha = b["alpha"].to_numpy(zero_copy_only=False).astype(float)
                for i, text in enumerate(b["model"].to_pylist()):
                    if text is not None:
                        d = json.loads(text)
                        one = apply_rows(([np.array(c) for c in d["cuts"]], [Tree(**t) for t in d["trees"]], d["start"]), x[i : i + 1])[0]
                        out[i] = alpha[i] * one + (1 - alpha[i]) * out[i]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(out)], [*kept, "predicted"])

        return met.select(*kept, "_g", "_x", "alpha", "model").mapInArrow(run, schema)

    def importance(self) -> dict[str, float]:
        return self.base.importance()

    def local_importances(self) -> DataFrame:
        """(point, feature, importance) of the points that have a model."""
        cols = self.cols

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for s, text in zip(b["_s"].to_pylist(), b["model"].to_pylist(), strict=True):
                    total = np.zeros(len(cols))
                    for t in json.loads(text)["trees"]:
                        for f, g in zip(t["feature"], t["gain"], strict=True):
                            if f >= 0:
                                total[f] += g
                    rows += [(s, c, float(v)) for c, v in zip(cols, total / (total.sum() or 1.0), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["point", "feature", "importance"])

        return self.local.where("model is not null").select("_s", "model").mapInArrow(run, "point long, feature string, importance double")


@dataclass
class GeoXGBoost(Learner):
    """One boosted model of all rows, and one for each point on its ``bandwidth`` nearest others with bi-square weights.

    A point with fewer than three weighted neighbours has the global model only. Without ``alpha`` the share of the local
    model is 1 where its error at the point is not above the global model's out-of-fold error there, else
    1 - (local - global) / local, not below 0. A point's neighbours meet in one task, so work goes with points.
    """

    coords: list[str]
    bandwidth: int = 30
    n_estimators: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    reg_lambda: float = 1.0
    alpha: float | None = None
    folds: int = 5
    seed: int = 42
    id = "geo_xgboost"
    properties = "RI"

    def _booster(self) -> Booster:
        return Booster(n_estimators=self.n_estimators, learning_rate=self.learning_rate, max_depth=self.max_depth, reg_lambda=self.reg_lambda, seed=self.seed)

    def _fit(self, task: Task) -> GeoModel:
        features = [c for c in task.features if c not in self.coords] or task.features
        base = self._booster().fit(task.only(features))
        data = materialize(with_folds(task.df, task.ids, self.folds, self.seed, "_f").withColumn("_s", F.monotonically_increasing_id()), "points")
        parts = None
        for f in range(self.folds):
            one = self._booster().fit(task.only(features).on(data.where(F.col("_f") != f))).predict(data.where(F.col("_f") == f))
            parts = one if parts is None else parts.unionByName(one)
        y = F.col(task.target).cast("double")
        x = F.array(*(F.coalesce(present(c), F.lit(float("nan"))) for c in features))
        own = materialize(parts.select("_s", *self.coords, x.alias("_fx"), y.alias("_fy"), F.abs(y - F.col("predicted")).alias("_fe")), "errors")
        near = knn(data, data, "_s", self.coords, self.bandwidth).join(own.select(F.col("_s").alias("id"), "_fx", "_fy"), "id")
        groups = near.groupBy(F.col("query").alias("_s")).agg(F.collect_list(F.struct("d2", F.col("_fx").alias("x"), F.col("_fy").alias("y"))).alias("_near"))
        rows = own.join(groups, "_s", "left").select("_s", *self.coords, "_fx", "_fy", "_fe", "_near")
        coords, how, fixed, width = self.coords, self._booster(), self.alpha, self.bandwidth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                alphas, models = [], []
                for v, target, e, group in zip(b["_fx"].to_pylist(), b["_fy"].to_pylist(), b["_fe"].to_pylist(), b["_near"].to_pylist(), strict=True):
                    d = np.sqrt([g["d2"] for g in group or []])
                    far = d.max() if len(d) == width or len(d) else 0.0
                    w = np.where(d < far, (1 - (d / far) ** 2) ** 2, 0.0) if far > 0 else np.zeros(len(d))
                    if (w > 0).sum() < 3:
                        alphas.append(0.0)
                        models.append(None)
                        continue
                    keep = w > 0
                    model = boost_rows(np.array([g["x"] for g in group], float)[keep], np.array([g["y"] for g in group], float)[keep], w[keep], how)
                    local = abs(target - apply_rows(model, np.array([v], float))[0])
                    alphas.append(fixed if fixed is not None else 1.0 if local <= e else max(0.0, 1 - (local - e) / local))
                    models.append(json.dumps({"cuts": [c.tolist() for c in model[0]], "trees": [t.__getstate__() for t in model[1]], "start": model[2]}, default=float))
                yield pa.RecordBatch.from_arrays([b["_s"], *(b[c] for c in coords), pa.array(alphas, pa.float64()), pa.array(models, pa.string())], ["_s", *coords, "alpha", "model"])

        schema = "_s long, " + ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in coords) + ", alpha double, model string"
        return GeoModel(features, self.coords, base, materialize(rows.mapInArrow(run, schema), "local"))

    def select_bandwidth(self, task: Task, choices: list[int]) -> tuple[int, list[tuple[int, float]]]:
        """(best, errors): the bandwidth, 30 or more, whose local models have the least mean squared error at their own, left out, points."""
        found = []
        for width in choices:
            if width < 30:
                raise FitError("a bandwidth has 30 points or more")
            self.bandwidth, self.alpha, kept = width, 1.0, (self.bandwidth, self.alpha)
            model = self._fit(task)
            self.bandwidth, self.alpha = kept
            p = model.predict(task.df)
            found.append((width, float(p.agg(F.avg((F.col("predicted") - F.col(task.target)) ** 2)).first()[0])))
        return min(found, key=lambda x: (x[1], x[0]))[0], found


#: Variograms of distance over range, from 0 to 1.
VARIOGRAMS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "spherical": lambda h: np.where(h < 1, 1.5 * h - 0.5 * h**3, 1.0),
    "exponential": lambda h: 1 - np.exp(-h),
    "gaussian": lambda h: 1 - np.exp(-(h**2)),
    "matern32": lambda h: 1 - (1 + math.sqrt(3) * h) * np.exp(-math.sqrt(3) * h),
    "matern52": lambda h: 1 - (1 + math.sqrt(5) * h + 5 * h**2 / 3) * np.exp(-math.sqrt(5) * h),
}


@dataclass
class Variogram:
    model: str
    nugget: float
    sill: float
    range: float
    lags: list[tuple[float, float, int]] = field(default_factory=list)

    def __call__(self, d: np.ndarray) -> np.ndarray:
        return np.where(d > 0, self.nugget + self.sill * VARIOGRAMS[self.model](d / max(self.range, 1e-12)), 0.0)


def empirical(xy: np.ndarray, z: np.ndarray, n_lags: int) -> list[tuple[float, float, int]]:
    """(mean distance, half mean squared difference, pairs) of lags up to half the largest distance."""
    top = float(np.linalg.norm(xy.max(0) - xy.min(0))) / 2
    d_sum, g_sum, n = np.zeros(n_lags), np.zeros(n_lags), np.zeros(n_lags)
    for lo in range(0, len(xy), 512):
        d = np.sqrt(((xy[lo : lo + 512, None] - xy[None]) ** 2).sum(2))
        use = (np.arange(lo, lo + len(d))[:, None] < np.arange(len(xy))) & (d < top)
        at = np.minimum((d[use] / top * n_lags).astype(int), n_lags - 1) if top > 0 else np.zeros(0, int)
        gap = (z[lo : lo + 512, None] - z[None])[use] ** 2
        d_sum += np.bincount(at, d[use], n_lags)
        g_sum += np.bincount(at, gap, n_lags)
        n += np.bincount(at, minlength=n_lags)
    return [(d_sum[i] / n[i], g_sum[i] / (2 * n[i]), int(n[i])) for i in range(n_lags) if n[i]]


def fit_variogram(lags: list[tuple[float, float, int]], model: str) -> Variogram:
    """Weighted least squares over a grid of ranges and nugget shares, pairs over squared values as weights; sills follow in closed form."""
    if not lags:
        return Variogram(model, 0.0, 0.0, 1.0, lags)
    d, g, n = (np.array(c, float) for c in zip(*lags, strict=True))
    best = (math.inf, Variogram(model, 0.0, float(g.mean()), float(d.max()), lags))
    for reach in np.linspace(d.max() / 20, 1.5 * d.max(), 40):
        shape = VARIOGRAMS[model](d / reach)
        for share in np.linspace(0, 0.9, 19):
            unit = share + (1 - share) * shape
            total = float((n * unit * g).sum() / max((n * unit * unit).sum(), 1e-300))
            for _ in range(3):
                w = n / np.maximum(total * unit, 1e-12) ** 2
                total = float((w * unit * g).sum() / max((w * unit * unit).sum(), 1e-300))
            error = float((n * (g / np.maximum(total * unit, 1e-12) - 1) ** 2).sum())
            if error < best[0]:
                best = (error, Variogram(model, total * share, total * (1 - share), float(reach), lags))
    return best[1]


@dataclass
class KrigingModel(Model):
    base: Model
    coords: list[str]
    residuals: DataFrame
    variogram_fit: Variogram
    neighbours: int

    def predict(self, df: DataFrame) -> DataFrame:
        """The base's prediction plus the residual kriged from the nearest training points."""
        kept = [c for c in df.columns if c != "predicted"]
        rows = materialize(self.base.predict(df).withColumnRenamed("predicted", "_b").withColumn("_q", F.monotonically_increasing_id()), "kriging")
        near = knn(rows, self.residuals, "_q", self.coords, self.neighbours, skip_self=False, other_id="_s").join(self.residuals.select(F.col("_s").alias("id"), F.array(*(F.col(c).cast("double") for c in self.coords)).alias("xy"), "z"), "id")
        group = near.groupBy(F.col("query").alias("_q")).agg(F.collect_list(F.struct("xy", "z")).alias("near"))
        met = rows.join(group, "_q", "left").withColumn("_xy", F.array(*(F.col(c).cast("double") for c in self.coords)))
        gamma, schema = self.variogram_fit, type(df.schema)([f for f in df.schema.fields if f.name in kept]).add("predicted", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for base, at, group in zip(b["_b"].to_pylist(), b["_xy"].to_pylist(), b["near"].to_pylist(), strict=True):
                    out.append(base + (krige(gamma, np.array([g["xy"] for g in group], float), np.array([g["z"] for g in group], float), np.array(at, float)) if group else 0.0))
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(out, pa.float64())], [*kept, "predicted"])

        return met.select(*kept, "_b", "_xy", "near").mapInArrow(run, schema)


def krige(gamma: Variogram, xy: np.ndarray, z: np.ndarray, at: np.ndarray) -> float:
    """Ordinary kriging: weights that sum to 1."""
    n = len(z)
    a = np.ones((n + 1, n + 1))
    a[:n, :n] = gamma(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)))
    a[n, n] = 0.0
    b = np.append(gamma(np.sqrt(((xy - at) ** 2).sum(1))), 1.0)
    try:
        w = np.linalg.solve(a + 1e-10 * np.diag([1.0] * n + [0.0]), b)[:n]
    except np.linalg.LinAlgError:
        w = np.full(n, 1.0 / n)
    return float(w @ z)


@dataclass
class KrigingHybrid(Learner):
    """A learner plus ordinary kriging of its residuals; points at one place are merged to their mean.

    The empirical variogram is of at most ``sample`` points, drawn by hash: its pairs would grow with their square.
    """

    factory: Callable[[], Learner]
    coords: list[str]
    variogram: str = "spherical"
    n_lags: int = 15
    n_neighbors: int = 20
    sample: int = 3000
    seed: int = 42
    id = "kriging_hybrid"
    properties = "R"

    def _fit(self, task: Task) -> KrigingModel:
        if self.variogram not in VARIOGRAMS:
            raise FitError(f"no variogram {self.variogram}")
        base = self.factory().fit(task)
        z = F.col(task.target).cast("double") - F.col("predicted")
        places = base.predict(task.df).groupBy(*self.coords).agg(F.avg(z).alias("z")).withColumn("_s", F.monotonically_increasing_id())
        places = materialize(places, "residuals")
        some = np.array(places.orderBy(F.xxhash64(*self.coords, F.lit(self.seed))).select(*(F.col(c).cast("double") for c in self.coords), "z").limit(self.sample).collect(), float)
        fitted = fit_variogram(empirical(some[:, :-1], some[:, -1], self.n_lags), self.variogram)
        return KrigingModel(base, self.coords, places, fitted, min(self.n_neighbors, max(1, places.count())))


