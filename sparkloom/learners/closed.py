"""Learners from sufficient statistics: least squares and its penalised forms, Gaussian naive Bayes, logistic regression.

What leaves the executors is of the size of the features squared; predictions are Column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import FitError
from sparkloom.functions.expr import last_argmax
from sparkloom.operators.resample import with_folds
from sparkloom.operators.transform import moments
from sparkloom.storage import materialize
from sparkloom.task import Learner, Model, Task


def linear(cols: list[str], bias: float, weights) -> Column:
    return sum((F.col(c) * float(w) for c, w in zip(cols, weights, strict=True)), F.lit(float(bias)))


@dataclass
class LinearModel(Model):
    cols: list[str]
    bias: float
    weights: np.ndarray

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("predicted", linear(self.cols, self.bias, self.weights))

    def importance(self) -> dict[str, float]:
        return {c: abs(float(w)) for c, w in zip(self.cols, self.weights, strict=True)}


@dataclass
class Ridge(Learner):
    """Least squares with alpha on the squared weights, the bias free; alpha 0 is plain least squares."""

    alpha: float = 1.0
    id = "ridge"
    properties = "RWI"

    def _fit(self, task: Task) -> LinearModel:
        n, mean, s = moments(task.df, task.features, task.target, task.weight)
        p = len(task.features)
        a = s[:p, :p] + self.alpha * np.eye(p)
        if np.linalg.matrix_rank(a) < p:
            raise FitError("singular cross-products")
        w = np.linalg.solve(a, s[:p, p])
        return LinearModel(task.features, float(mean[p] - mean[:p] @ w), w)


@dataclass
class LinearRegression(Ridge):
    alpha: float = 0.0
    id = "linear_regression"


@dataclass
class ElasticNet(Learner):
    """Coordinate descent on the cross-products: squared errors over 2n plus alpha (l1 |w| + (1 - l1) w^2 / 2)."""

    alpha: float = 1.0
    l1_ratio: float = 0.5
    max_iter: int = 1000
    tol: float = 1e-6
    id = "elastic_net"
    properties = "RWI"

    def _fit(self, task: Task) -> LinearModel:
        n, mean, s = moments(task.df, task.features, task.target, task.weight)
        p = len(task.features)
        g, c = s[:p, :p] / n, s[:p, p] / n
        w = np.zeros(p)
        for _ in range(self.max_iter):
            move = 0.0
            for j in range(p):
                if g[j, j] <= 0:
                    continue
                r = c[j] - g[j] @ w + g[j, j] * w[j]
                new = math.copysign(max(abs(r) - self.alpha * self.l1_ratio, 0.0), r) / (g[j, j] + self.alpha * (1 - self.l1_ratio))
                move = max(move, abs(new - w[j]))
                w[j] = new
            if move < self.tol:
                break
        return LinearModel(task.features, float(mean[p] - mean[:p] @ w), w)


@dataclass
class Lasso(ElasticNet):
    l1_ratio: float = 1.0
    id = "lasso"


def softmax(scores: list[Column]) -> Column:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    e = [F.exp(s - top) for s in scores]
    total = sum(e[1:], e[0])
    return F.array(*(x / total for x in e))


@dataclass
class NaiveBayesModel(Model):
    cols: list[str]
    rows: list[dict]
    n_classes: int

    def predict(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_nb", F.array(*nb_scores(self.cols, self.rows, self.n_classes))).withColumn("predicted", last_argmax(F.col("_nb")))
        return out.withColumn("probabilities", softmax([F.col("_nb")[i] for i in range(self.n_classes)])).drop("_nb")


def nb_scores(cols: list[str], rows: list[dict], n_classes: int) -> list[Column]:
    """Log posterior of each class from (y, n, mean_j, var_j); a class without rows can't win."""
    total = sum(r["n"] for r in rows)
    by = {r["y"]: r for r in rows}
    out = []
    for k in range(n_classes):
        r = by.get(k)
        if r is None:
            out.append(F.lit(-1e300))
            continue
        s = F.lit(math.log(r["n"] / total))
        for j, c in enumerate(cols):
            m, v = float(r[f"m{j}"]), max(float(r[f"v{j}"]), 1e-9)
            d = F.col(c) - m
            s = s - 0.5 * (d * d / v + math.log(v) + math.log(2 * math.pi))
        out.append(s)
    return out


@dataclass
class GaussianNB(Learner):
    """Class means and population variances (at least 1e-9), empirical priors; ties go to the last class."""

    id = "gaussian_nb"
    properties = "CP"

    def _fit(self, task: Task) -> NaiveBayesModel:
        rows = task.df.groupBy(F.col(task.target).alias("y")).agg(F.count("*").alias("n"), *(x for j, c in enumerate(task.features) for x in (F.avg(c).alias(f"m{j}"), F.var_pop(c).alias(f"v{j}")))).collect()
        return NaiveBayesModel(task.features, [r.asDict() for r in rows], task.n_classes)


def nb_cross_validation(task: Task, k: int, seed: int = 42) -> DataFrame:
    """(row columns, fold, predicted): every row under the naive Bayes of the other folds.

    Counts, sums and sums of squares are taken once for each fold and class; a training set is all less its fold,
    so k fits cost one pass, and one more pass predicts. Folds are dealt once and written.
    """
    data = materialize(with_folds(task.df, task.ids, k, seed), "folds")
    p = len(task.features)
    s = data.groupBy("fold", F.col(task.target).alias("y")).agg(F.count("*").alias("n"), *(x for j, c in enumerate(task.features) for x in (F.sum(F.col(c)).alias(f"s{j}"), F.sum(F.col(c) * F.col(c)).alias(f"q{j}")))).collect()
    per_fold = []
    for f in range(k):
        rows = []
        for y in range(task.n_classes):
            use = [r for r in s if r["y"] == y and r["fold"] != f]
            n = sum(r["n"] for r in use)
            if n:
                row = {"y": y, "n": n}
                for j in range(p):
                    m = sum(r[f"s{j}"] for r in use) / n
                    row[f"m{j}"], row[f"v{j}"] = m, sum(r[f"q{j}"] for r in use) / n - m * m
                rows.append(row)
        per_fold.append(nb_scores(task.features, rows, task.n_classes))
    scores = F.coalesce(*(F.when(F.col("fold") == f, F.array(*per_fold[f])) for f in range(k)))
    return data.withColumn("predicted", last_argmax(scores))


@dataclass
class LogisticModel(Model):
    cols: list[str]
    coefs: list[tuple[float, np.ndarray]]

    def predict(self, df: DataFrame) -> DataFrame:
        p = [1.0 / (1.0 + F.exp(-linear(self.cols, b, w))) for b, w in self.coefs]
        if len(p) == 1:
            return df.withColumn("probabilities", F.array(1.0 - p[0], p[0])).withColumn("predicted", (F.col("probabilities")[1] >= 0.5).cast("int"))
        total = sum(p[1:], p[0])
        return df.withColumn("probabilities", F.array(*(x / total for x in p))).withColumn("predicted", last_argmax(F.col("probabilities")))

    def importance(self) -> dict[str, float]:
        return {c: float(np.mean([abs(w[j]) for _, w in self.coefs])) for j, c in enumerate(self.cols)}


@dataclass
class LogisticRegression(Learner):
    """Binary or one-against-rest maximum likelihood by Newton steps on standardised features; one aggregate a step serves all classes."""

    max_iter: int = 50
    tol: float = 1e-6
    id = "logistic_regression"
    properties = "CPWI"

    def _fit(self, task: Task) -> LogisticModel:
        n, mean, s = moments(task.df, task.features, None, task.weight)
        sd = np.sqrt(np.diag(s) / n)
        sd[sd == 0] = 1.0
        p = len(task.features) + 1
        x = [F.lit(1.0), *((F.col(c) - float(m)) / float(d) for c, m, d in zip(task.features, mean, sd, strict=True))]
        w = F.col(task.weight).cast("double") if task.weight else F.lit(1.0)
        classes = [1] if task.n_classes <= 2 else list(range(task.n_classes))
        beta, pairs = np.zeros((len(classes), p)), [(i, j) for i in range(p) for j in range(i, p)]
        rows = materialize(task.df.select(*(e.alias(f"x{i}") for i, e in enumerate(x)), w.alias("w"), F.col(task.target).alias("y")), "logistic")
        live = set(range(len(classes)))
        for _ in range(self.max_iter):
            aggs, order = [], sorted(live)
            for k in order:
                q = 1.0 / (1.0 + F.exp(-sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta[k])), F.lit(0.0))))
                e = F.col("w") * ((F.col("y") == classes[k]).cast("double") - q)
                h = F.col("w") * q * (1.0 - q)
                aggs += [F.sum(e * F.col(f"x{i}")) for i in range(p)] + [F.sum(h * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]
            got = np.array(rows.agg(*aggs).first(), float).reshape(len(order), -1)
            for k, r in zip(order, got, strict=True):
                grad, hess = r[:p], np.zeros((p, p))
                for (i, j), v in zip(pairs, r[p:], strict=True):
                    hess[i, j] = hess[j, i] = v
                step = np.linalg.solve(hess + 1e-9 * n * np.eye(p), grad)
                beta[k] += np.clip(step, -5, 5)
                if np.abs(grad).max() / n < self.tol:
                    live.discard(k)
            if not live:
                break
        coefs = [(float(b[0] - (b[1:] / sd) @ mean), b[1:] / sd) for b in beta]
        return LogisticModel(task.features, coefs)
