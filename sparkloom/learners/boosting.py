"""Gradient boosting on binned features, with growth by level, by leaf or by oblivious levels.

Stores and growth are those of ``growth``: trees ask for sums of gradients, hessians and counts. Row samples are given by
seed, round and place in a block, so they are the same wherever the rows are. An eval set has a store of its own whose
margins follow the trees; its loss decides when to stop.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import FitError, NotSupported
from sparkloom.functions.expr import md5_key, prefix_sums
from sparkloom.learners.growth import Far, Growth, Tree, View, bin_edges, grow, grow_leaves, grow_oblivious, importances, pack, scored, store_of
from sparkloom.storage import materialize
from sparkloom.task import Learner, Model, Task

__all__ = ["BoostedModel", "Booster", "CatBooster", "Objective", "Tree", "catboost", "ebm", "gradient_boosting", "lightgbm", "quantile_gb", "xgboost"]


@dataclass(frozen=True)
class Objective:
    """Gradients and hessians of the margin; ``outputs`` margins a row."""

    name: str = "squared"
    outputs: int = 1
    delta: float = 1.0
    tau: float = 0.5

    def start(self, mean: float, quantile: float, shares: list[float] | None = None) -> list[float]:
        if self.name == "softmax":
            return [math.log(max(s, 1e-15)) for s in shares or [1.0] * self.outputs]
        if self.name == "logistic":
            p = min(max(mean, 1e-6), 1 - 1e-6)
            return [math.log(p / (1 - p))]
        if self.name == "poisson":
            return [math.log(max(mean, 1e-9))]
        return [quantile if self.name == "quantile" else mean]

    def gradients(self, y: np.ndarray, m: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
        """Of the margin k; margins are (outputs, rows). A hessian of None is 1 for every row."""
        if self.name == "softmax":
            e = np.exp(m - m.max(0))
            p = e[k] / e.sum(0)
            return p - (y == k), np.maximum(p * (1 - p), 1e-15)
        e = m[0] - y
        if self.name == "logistic":
            p = 1 / (1 + np.exp(-m[0]))
            return p - y, p * (1 - p)
        if self.name == "huber":
            return np.clip(e, -self.delta, self.delta), None
        if self.name == "poisson":
            mu = np.exp(np.minimum(m[0], 30))
            return mu - y, mu
        if self.name == "quantile":
            return np.where(e < 0, -self.tau, 1 - self.tau), None
        return e, None

    def loss(self, y: np.ndarray, m: np.ndarray) -> np.ndarray:
        if self.name == "softmax":
            top = m.max(0)
            return top + np.log(np.exp(m - top).sum(0)) - np.take_along_axis(m, y.astype(int)[None], 0)[0]
        e = m[0] - y
        if self.name == "logistic":
            return np.logaddexp(0, m[0]) - y * m[0]
        if self.name == "huber":
            return np.where(np.abs(e) <= self.delta, e * e / 2, self.delta * (np.abs(e) - self.delta / 2))
        if self.name == "poisson":
            return np.exp(np.minimum(m[0], 30)) - y * m[0]
        if self.name == "quantile":
            return np.where(e < 0, -self.tau * e, (1 - self.tau) * e)
        return e * e

    def response(self, m: np.ndarray) -> np.ndarray:
        return np.exp(np.minimum(m[0], 30)) if self.name == "poisson" else m[0]

    def probabilities(self, m: np.ndarray) -> np.ndarray:
        """(rows, classes)."""
        if self.outputs == 1:
            p = 1 / (1 + np.exp(-m[0]))
            return np.stack([1 - p, p], 1)
        e = np.exp(m - m.max(0))
        return (e / e.sum(0)).T


@dataclass
class Booster(Learner):
    """Newton boosting: leaf = -soft(G, alpha) / (H + lambda), gain by the usual second-order formula less gamma.

    ``growth``: level (all nodes of a depth), leaf (best leaf first, up to ``leaves``) or oblivious (one split for a depth).
    ``subsample`` and ``colsample`` are shares of the rows of a round and of the features of a tree. With ``other_rate``
    above 0 and ``top_rate`` below 1 a round takes that share of the rows with the largest gradients and that share of the
    rest, whose gradients are amplified (one-side sampling; the cut lies on a histogram of 4,096 bins). ``plain`` grows on
    squared errors of the gradients and fits the leaves by a Newton step afterwards. ``eval_set`` has the task's columns;
    after ``early_stopping`` rounds without an improvement above 1e-10 of its loss the trees after the best round go.
    ``single`` lets the trees of a round have one feature each, in turn.
    """

    n_estimators: int = 100
    learning_rate: float = 0.3
    max_depth: int | None = 6
    reg_lambda: float = 1.0
    alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    min_split: int = 2
    min_leaf: int = 1
    n_bins: int = 254
    growth: str = "level"
    leaves: int = 31
    objective: str = ""
    tau: float = 0.5
    subsample: float = 1.0
    colsample: float = 1.0
    top_rate: float = 1.0
    other_rate: float = 0.0
    plain: bool = False
    single: bool = False
    early_stopping: int = 0
    eval_set: DataFrame | None = None
    seed: int = 42
    monotone: dict[str, int] = field(default_factory=dict)
    local_cells: int = 50_000_000
    id = "xgboost"
    properties = "CRWPNKI"

    def _fit(self, task: Task) -> BoostedModel:
        if self.early_stopping and self.eval_set is None:
            raise FitError("early stopping needs an eval set")
        if self.single and task.kind == "classif" and task.n_classes > 2:
            raise NotSupported(f"{self.id} doesn't fit more than two classes")
        name = self.objective or ("squared" if task.kind == "regress" else "logistic" if task.n_classes <= 2 else "softmax")
        obj = Objective(name, task.n_classes if name == "softmax" else 1, tau=self.tau)
        cuts = bin_edges(task.df, task.features, min(self.n_bins, 254), task.categories)
        y = F.col(task.target).cast("double")
        w = F.col(task.weight).cast("double") if task.weight else F.lit(1.0)
        rows = task.df.select(y.alias("y"), w.alias("w")).where("w > 0")
        classes = [F.sum(F.when(F.col("y") == k, F.col("w")).otherwise(0.0)) / F.sum("w") for k in range(obj.outputs)] if name == "softmax" else []
        quantile = F.percentile_approx("y", self.tau, 100_000) if name == "quantile" else F.lit(0.0)
        n, mean, q, *shares = rows.agg(F.count("*"), F.sum(F.col("w") * F.col("y")) / F.sum("w"), quantile, *classes).first()
        if not n:
            raise FitError("no rows")
        start = obj.start(float(mean), float(q), shares)
        blocks = lambda df: pack(df, task.features, cuts, y, w, start)
        # Squared errors have gradients that are linear in the target; draws are of single rows.
        drawn = self.subsample < 1 or (self.top_rate < 1 and self.other_rate > 0)
        store = store_of(pack(task.df, task.features, cuts, y, w, start, merge="features" if name == "squared" and not drawn else "rows"), self.local_cells)
        watch = store_of(blocks(self.eval_set), self.local_cells) if self.early_stopping else None
        p, weighted, rng = len(cuts), task.weight is not None, np.random.default_rng(self.seed)
        how = self._how(task, cuts, obj)
        trees: list[tuple[int, Tree]] = []
        best, best_at, rounds = math.inf, 0, 0
        for r in range(self.n_estimators * (p if self.single else 1)):
            take = self._sampled(store, r, obj, weighted)
            how.allowed = None
            if self.single:
                how.allowed = np.arange(p) == r % p
            elif self.colsample < 1:
                how.allowed = np.isin(np.arange(p), rng.choice(p, max(1, round(self.colsample * p)), replace=False))
            grown, leaves = [], []
            for k in range(obj.outputs):
                t, key = Tree(), (r, k)
                # A tree over Spark grows from one job's sums where its features have few combinations of bins.
                near = store.combined(key, take, cuts, how.allowed) if isinstance(store, Far) else None
                place, channels = near or (store, take)
                place.open(key, t, channels)
                if self.growth == "leaf":
                    grow_leaves(place, key, t, how, self.leaves, r)
                elif self.growth == "oblivious":
                    grow_oblivious(place, key, t, how, r)
                else:
                    grow(place, [key], [t], how, r)
                at = place.close(key) if place is store else None
                if self.plain and name != "squared":
                    self._refit(store, t, obj, k, weighted)
                t.value = [float(v) * self.learning_rate for v in t.value]
                grown.append((k, t))
                leaves.append(at)
            store.add(grown, leaves if leaves[0] is not None else None)
            trees += grown
            rounds += 1
            if watch is not None:
                watch.add(grown)
                total, weight = watch.total(lambda v: np.array([(obj.loss(v.y, v.m) * v.w).sum(), v.w.sum()]))
                if best - total / weight > 1e-10:
                    best, best_at = total / weight, rounds
                elif rounds - best_at >= self.early_stopping:
                    break
        if watch is not None:
            trees = trees[: best_at * obj.outputs]
        return BoostedModel(task.features, cuts, trees, obj, start, task.kind)

    def _how(self, task: Task, cuts: list, obj: Objective) -> Growth:
        lam, alpha = self.reg_lambda, self.alpha

        def leaf(s: np.ndarray) -> float:
            g = math.copysign(max(abs(s[0]) - alpha, 0.0), s[0])
            return float(-g / (s[1] + lam)) if s[1] + lam > 0 else 0.0

        return Growth(
            score=(lambda s: 0.5 * s[..., 0] ** 2 / (s[..., 1] + lam)) if lam else (lambda s: 0.5 * s[..., 0] ** 2 / np.maximum(s[..., 1], 1e-12)),
            leaf=leaf,
            max_depth=self.max_depth,
            min_split=self.min_split,
            min_leaf=self.min_leaf,
            min_weight=0.0 if self.plain else self.min_child_weight,
            weight=1,
            gamma=self.gamma,
            categories=tuple(i for i, c in enumerate(cuts) if c is None),
            monotone=np.array([self.monotone.get(c, 0) for c in task.features]),
        )

    def _sampled(self, store, r: int, obj: Objective, weighted: bool):
        """Channels (g, h, count) of a round, and which rows it takes."""
        seed, sub, plain = self.seed, self.subsample, self.plain
        one_sided, amplify, cut = self.top_rate < 1 and self.other_rate > 0, 1.0, 0.0
        if one_sided:
            size = lambda v: sum(np.abs(obj.gradients(v.y, v.m, k)[0] * (v.w if v.c is None else v.w / v.c)) for k in range(obj.outputs))
            top, counts = _spread(store, size)
            above = np.cumsum(counts[::-1])[::-1]
            whole = above[0]
            at = int(np.argmin(np.abs(above - self.top_rate * whole)))
            cut, rest = at * top / 4096, whole - above[at]
            share = min(1.0, self.other_rate * whole / rest) if rest else 0.0
            amplify = 1 / share if share else 1.0

        def channels(v: View, key: tuple) -> tuple[list, np.ndarray | None]:
            g, h = obj.gradients(v.y, v.m, key[1])
            if plain:
                h = None
            scale, rows, n = v.w if weighted or v.c is not None else None, None, v.c
            if one_sided:
                large = size(v) >= cut
                if n is None:
                    rows = large | (v.random(seed, r, 1) < share)
                else:
                    n = np.where(large, n, v.binomial(n, share, seed, r, 1))
                scale = np.where(large, 1.0, amplify) * (1.0 if scale is None else scale)
            if sub < 1 and n is None:
                drawn = v.random(seed, r, 0) < sub
                rows = drawn if rows is None else rows & drawn
            elif sub < 1:
                n = v.binomial(n, sub, seed, r, 0)
            if n is not v.c:
                # Of equal rows each is drawn by itself.
                rows, scale = n > 0, scale * (n / v.c)
            return [g if scale is None else g * scale, scale if h is None else h if scale is None else h * scale, n], rows

        return channels

    @staticmethod
    def _refit(store, t: Tree, obj: Objective, k: int, weighted: bool) -> None:
        """Leaves by a Newton step over all rows."""
        n = len(t.feature)

        def leaf_sums(v: View) -> np.ndarray:
            at = t.apply(v.x)
            g, h = obj.gradients(v.y, v.m, k)
            h = np.ones(v.n) if h is None else h
            return np.stack([np.bincount(at, g * v.w, n), np.bincount(at, h * v.w, n)]).ravel()

        g, h = np.asarray(store.total(leaf_sums)).reshape(2, n)
        scale = (obj.outputs - 1) / obj.outputs if obj.outputs > 1 else 1.0
        t.value = [float(-scale * a / b) if b > 1e-12 else 0.0 for a, b in zip(g, h, strict=True)]


def _spread(store, size) -> tuple[float, np.ndarray]:
    """The least power of two above ``size`` of all rows, and counts of 4,096 equal bins below it.

    One request has both where the power is that of the round before.
    """
    for guess in (store.top, None):
        guess = store.top if guess is None else guess

        def f(v: View, guess=guess) -> np.ndarray:
            s = size(v)
            powers = np.bincount(np.clip(np.frexp(np.maximum(s, 1e-300))[1] + 1024, 0, 2047), minlength=2048)
            bins = np.minimum(s * (4096 / guess), 4095).astype(np.int64) if guess else np.zeros(0, np.int64)
            return np.concatenate([powers, np.bincount(bins, v.c if guess else None, 4096)])

        got = np.asarray(store.total(f))
        powers = np.flatnonzero(got[:2048])
        store.top = float(2.0 ** (int(powers.max()) - 1024)) if len(powers) else 0.0
        if store.top == guess:
            break
    return store.top, got[2048:] if store.top > 0 else np.ones(4096)


@dataclass
class BoostedModel(Model):
    cols: list[str]
    cuts: list[np.ndarray | None]
    trees: list[tuple[int, Tree]]
    objective: Objective
    start: list[float]
    kind: str

    def importance(self) -> dict[str, float]:
        return importances(self.cols, [t for _, t in self.trees])

    def predict(self, df: DataFrame) -> DataFrame:
        classes = self.kind == "classif"

        def f(model, x: np.ndarray) -> list:
            trees, obj, start = model
            m = np.repeat(np.array(start, float)[:, None], x.shape[1], axis=1)
            for k, t in trees:
                m[k] += np.array(t.value)[t.apply(x)]
            if not classes:
                return [obj.response(m)]
            p = obj.probabilities(m)
            return [p.shape[1] - 1 - p[:, ::-1].argmax(1), p]

        out = [("predicted", "int"), ("probabilities", "array<double>")] if classes else [("predicted", "double")]
        return scored(df, self.cols, self.cuts, out, f, (self.trees, self.objective, self.start))


@dataclass
class CatModel(Model):
    base: BoostedModel
    tables: dict[str, DataFrame]
    prior: list[float]

    def importance(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for c, v in self.base.importance().items():
            c = c.split("\0")[0].removeprefix("_ts_")
            out[c] = out.get(c, 0.0) + v
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        names = df.columns
        out = df
        for c, t in self.tables.items():
            keys = [x for x in t.columns if x != "_key"]
            out = out.withColumn("_key", F.col(c).cast("string")).join(F.broadcast(t) if t.count() <= 200_000 else t, "_key", "left").drop("_key")
            # An unseen category has the prior; a missing one stays missing.
            out = out.withColumns({k: F.when(F.col(c).isNotNull(), F.coalesce(F.col(f"`{k}`"), F.lit(p))) for k, p in zip(keys, self.prior, strict=True)})
        out = self.base.predict(out)
        return out.select(*(n for n in names if n not in ("predicted", "probabilities")), *(c for c in ("predicted", "probabilities") if c in out.columns))


def ordered_statistic(df: DataFrame, ids: list[str], category: str, targets: list, prior: list[float], names: list[str], a: float = 1.0, seed: int = 42) -> DataFrame:
    """``df`` with (sum of the targets of the category's earlier rows + a prior) / (their number + a); null for a missing category.

    Rows go in the order of 60 bits of the md5 of seed and ids. Running sums inside a category are taken by ranges of that
    order, so a category that fills a third of the rows is no single window.
    """
    order = F.conv(F.substring(md5_key(seed, ids), 1, 15), 16, 10).cast("long")
    sums = [f"_s{k}" for k in range(len(targets))]
    one = df.withColumns({"_key": F.col(category).cast("string"), "_o": order, "_n": F.lit(1), **dict(zip(sums, targets, strict=True))})
    before = prefix_sums(one.withColumn("_key", F.coalesce("_key", F.lit(""))), "_o", [*sums, "_n"], by=["_key"])
    stat = [F.when(F.col(category).isNotNull(), (F.col(f"cum_{s}") - F.col(s) + a * p) / (F.col("cum__n") - 1 + a)).alias(n) for s, n, p in zip(sums, names, prior, strict=True)]
    return before.select(*df.columns, *stat)


@dataclass
class CatBooster(Booster):
    """Oblivious trees; ``cat_features`` are replaced by ordered target statistics.

    See ``ordered_statistic``; the prior is the target's mean. Predictions use the statistics of all training rows. With more than two classes each class has a statistic.
    """

    learning_rate: float = 0.1
    growth: str = "oblivious"
    n_bins: int = 64
    cat_features: list[str] = field(default_factory=list)
    prior_strength: float = 1.0
    id = "catboost"

    def _fit(self, task: Task) -> Model:
        if not self.cat_features:
            return super()._fit(task)
        a = self.prior_strength
        many = task.kind == "classif" and task.n_classes > 2
        y = F.col(task.target).cast("double")
        targets = [(y == k).cast("double") for k in range(task.n_classes)] if many else [y]
        prior = [float(v or 0.0) for v in task.df.agg(*(F.avg(t) for t in targets)).first()]
        df = materialize(task.df, "catboost")
        tables, features = {}, [c for c in task.features if c not in self.cat_features]
        for c in self.cat_features:
            names = [f"_ts_{c}" if not many else f"_ts_{c}_{k}" for k in range(len(targets))]
            df = ordered_statistic(df, task.ids, c, targets, prior, names, a, self.seed)
            one = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("_key"), *(t.alias(f"_s{k}") for k, t in enumerate(targets)))
            tables[c] = materialize(one.groupBy("_key").agg(*(((F.sum(f"_s{k}") + a * p) / (F.count("*") + a)).alias(n) for k, (n, p) in enumerate(zip(names, prior, strict=True)))), "statistics")
            features += names
        df = materialize(df, "catboost")
        base = super()._fit(replace(task, df=df, features=features, categories={}))
        return CatModel(base, tables, prior)


def xgboost(**options) -> Booster:
    return Booster(**options)


def lightgbm(**options) -> Booster:
    b = Booster(**({"learning_rate": 0.1, "growth": "leaf", "reg_lambda": 0.0, "max_depth": None} | options))
    b.id = "lightgbm"
    return b


def catboost(**options) -> CatBooster:
    return CatBooster(**options)


def gradient_boosting(**options) -> Booster:
    b = Booster(**({"learning_rate": 0.1, "max_depth": 3, "reg_lambda": 0.0, "plain": True} | options))
    b.id = "gradient_boosting"
    return b


def quantile_gb(tau: float = 0.5, **options) -> Booster:
    b = Booster(**({"learning_rate": 0.1, "max_depth": 3, "reg_lambda": 0.0, "objective": "quantile", "tau": tau} | options))
    b.id, b.properties = "quantile_gb", "RNI"
    return b


def ebm(**options) -> Booster:
    """Additive trees of one feature each, in turn: ``n_estimators`` rounds over all features."""
    b = Booster(**({"learning_rate": 0.01, "max_depth": 3, "reg_lambda": 0.0, "min_leaf": 2, "plain": True, "single": True} | options))
    b.id, b.properties = "ebm", "CRPNI"
    return b
