"""Operators against plain numpy, and their error paths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.errors import FitError, NotSupported, TaskError
from sparkloom.functions import expr as E
from sparkloom.functions import measures as M
from sparkloom.learners import boosting as B
from sparkloom.learners import closed as L
from sparkloom.learners import wrappers as W
from sparkloom.operators import conformal as C
from sparkloom.operators import filters as S
from sparkloom.operators import neighbours as N
from sparkloom.operators import resample as R
from sparkloom.operators import stats
from sparkloom.operators import survival as V
from sparkloom.operators import transform as T
from sparkloom.task import classification, regression


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = 3 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=200)
    return spark.createDataFrame([(i, *map(float, r), float(v), int(v > 0), 1 + i % 3) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double, k int, w int").cache()


def test_last_argmax_and_missing(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], float("nan")), ([2.0, 1.0, 1.0], 5.0)], "p array<double>, v double")
    assert [r[0] for r in df.select(E.last_argmax(F.col("p"))).collect()] == [2, 0]
    assert df.agg(F.avg(E.present("v"))).first()[0] == 5.0


def test_global_rank_is_the_order(spark):
    df = spark.range(500).withColumn("k", E.md5_key(1, ["id"]))
    got = {r["id"]: r["rn"] for r in E.global_rank(df, "k", ["id"]).collect()}
    want = [r["id"] for r in df.orderBy("k", "id").collect()]
    assert [got[i] for i in want] == list(range(500))


@pytest.mark.parametrize("desc", [False, True])
def test_prefix_sums(spark, desc):
    df = spark.createDataFrame([(float(i * i % 101), i) for i in range(101) if (i * i % 101) >= 0], "t double, n int").groupBy("t").agg(F.sum("n").alias("n"))
    rows = sorted(((r["t"], r["n"]) for r in df.collect()), reverse=desc)
    total, want = 0, {}
    for t, n in rows:
        total += n
        want[t] = total
    assert {r["t"]: r["cum_n"] for r in E.prefix_sums(df, "t", ["n"], desc).collect()} == want


def test_scalers_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    z = T.StandardScaler(["a", "b"]).fit(df).transform(df).collect()
    assert z[0]["a"] == pytest.approx((1 - 7 / 3) / 1.2472191, abs=1e-6) and z[0]["b"] == 0
    assert [r["b"] for r in T.MinMaxScaler(["a", "b"]).fit(df).transform(df).collect()] == [0, 0, 0]


def test_imputer_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "a double")
    assert [r["a"] for r in T.Imputer(["a"], "median").fit(df).transform(df).collect()] == [0.0, 0.0]


def test_encoders(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    assert T.OneHotEncoder(["s"]).fit(df).names() == ["s_a", "s_b"]
    e = T.LabelEncoder("s").fit(df)
    new = spark.createDataFrame([("z",), ("a",)], "s string")
    assert e.unknown(new).count() == 1
    assert {r["s"]: r["code"] for r in e.encode(new, strict=False).collect()} == {"z": None, "a": 0}
    assert {r["s"]: r["code"] for r in e.encode(df).collect()} == {"a": 0, "b": 1, None: None}
    with pytest.raises(Exception, match="unknown label z"):
        e.encode(new).collect()


def test_pca_matches_numpy(numbers):
    p = T.PCA(["a", "b", "c"], 2).fit(numbers)
    x = np.array(numbers.select("a", "b", "c").collect())
    assert p.variances == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:2])
    assert p.transform(numbers).columns == ["id", "y", "k", "w", "PC1", "PC2"]


def test_folds_partition(spark):
    df = spark.range(23)
    folds = R.kfold(df, ["id"], 4, 1).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [5, 5, 5, 8]
    with pytest.raises(TaskError):
        R.kfold(df, ["id"], 30)
    with pytest.raises(TaskError):
        R.holdout(spark.range(1), ["id"], 0.5)


def test_bootstrap_counts(spark):
    b = R.bootstrap(spark.range(50), ["id"], 2, 9)
    got = {r["fold"]: (r["n"], r["rows"]) for r in b.groupBy("fold").agg(F.sum(F.when(F.col("role") == "train", F.col("mult")).otherwise(0)).alias("n"), F.count("*").alias("rows")).collect()}
    assert got == {0: (50, 50), 1: (50, 50)}


def test_weights_are_copies(numbers):
    t = regression(numbers, ["a", "b", "c"], "y", ["id"])
    copies = numbers.withColumn("r", F.explode(F.expr("sequence(1, w)")))
    for learner in (L.LinearRegression(), L.Ridge(2.0), L.Lasso(0.01)):
        a, b = learner.fit(t.with_weights("w")), learner.fit(regression(copies, ["a", "b", "c"], "y", ["id"]))
        assert a.weights == pytest.approx(b.weights, abs=1e-6 if isinstance(learner, L.Lasso) else 1e-9)


def test_ols_and_logistic(numbers):
    m = L.LinearRegression().fit(regression(numbers, ["a", "b", "c"], "y", ["id"]))
    x, y = np.array(numbers.select("a", "b", "c").collect()), np.array(numbers.select("y").collect())[:, 0]
    want = np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)[0]
    assert [m.bias, *m.weights] == pytest.approx(want)
    p = L.LogisticRegression().fit(classification(numbers, ["a", "b"], "k", ["id"])).predict(numbers)
    assert M.accuracy(p, "k").first()[0] >= 0.9


def test_learner_contract(spark, numbers):
    c, r = classification(numbers, ["a"], "k", ["id"]), regression(numbers, ["a"], "y", ["id"])
    with pytest.raises(NotSupported):
        L.GaussianNB().fit(r)
    with pytest.raises(NotSupported):
        L.Ridge().fit(c)
    with pytest.raises(NotSupported):
        L.GaussianNB().fit(c.with_weights("w"))
    with pytest.raises(TaskError):
        classification(numbers.limit(0), ["a"], "k", ["id"])
    with pytest.raises(FitError):
        L.LinearRegression().fit(regression(numbers.withColumn("d", F.col("a") * 2), ["a", "d"], "y", ["id"]))


@pytest.mark.parametrize("make", [B.xgboost, B.lightgbm, B.catboost, B.gradient_boosting])
def test_boosting_in_memory_and_over_spark_agree(numbers, make):
    t = regression(numbers.withColumn("c", F.when(F.col("id") % 5 != 0, F.col("c"))), ["a", "b", "c"], "y", ["id"])
    near = make(n_estimators=3, leaves=4, max_depth=2).fit(t)
    far = make(n_estimators=3, leaves=4, max_depth=2, local_cells=0).fit(t)
    p, q = ({r["id"]: r["predicted"] for r in m.predict(t.df).collect()} for m in (near, far))
    assert p == pytest.approx(q)
    assert sum(near.importance().values()) == pytest.approx(1.0)


def test_boosting_classes_and_monotone(numbers):
    t = classification(numbers, ["a", "b"], "k", ["id"])
    assert M.accuracy(B.xgboost(n_estimators=10, max_depth=3).fit(t).predict(numbers), "k").first()[0] > 0.95
    m = B.xgboost(n_estimators=5, monotone={"a": 1}).fit(regression(numbers, ["a"], "y", ["id"])).predict(numbers)
    v = [r["predicted"] for r in m.orderBy("a").collect()]
    assert all(x <= y + 1e-12 for x, y in zip(v, v[1:], strict=False))


def test_wrappers(numbers):
    t = classification(numbers, ["a", "b"], "k", ["id"])
    assert M.accuracy(W.Thresholded(L.GaussianNB).fit(t).predict(numbers), "k").first()[0] > 0.8
    assert M.accuracy(W.Bagging(L.GaussianNB, 2).fit(t).predict(numbers), "k").first()[0] > 0.8
    with pytest.raises(FitError):
        W.TargetTransform(L.LinearRegression, "log").fit(regression(numbers, ["a"], "y", ["id"]))


def test_knn_and_dbscan_match_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 2)), 2)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, x double, y double")
    got = {(r["query"], r["place"]): r["id"] for r in N.knn(df, df, "id", ["x", "y"], 3, leaf=17).collect()}
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for i in range(120):
        assert [got[i, k] for k in (1, 2, 3)] == sorted(range(120), key=lambda j: (d[i, j], j))[:3]
    near = np.sqrt(((x[:, None] - x) ** 2).sum(2)) <= 0.25
    core = near.sum(1) >= 4
    want, n = np.full(120, -1), 0
    for i in range(120):
        if core[i] and want[i] < 0:
            todo, want[i] = [i], n
            while todo:
                j = todo.pop()
                if core[j]:
                    for m in np.flatnonzero(near[j] & (want < 0)):
                        want[m] = n
                        todo.append(m)
            n += 1
    assert [r["label"] for r in N.dbscan(df, "id", "x", "y", 0.25, 4).orderBy("id").collect()] == want.tolist()


def test_conformal_rank_past_the_end(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.5)], "p double, y double")
    assert C.quantile(df, F.abs(F.col("p") - F.col("y")), 0.05) == math.inf


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (3.0, 2.5), (4.0, 5.0), (5.0, 3.0)], "a double, b double")
    w = stats.wilcoxon(df, "a", "b")
    assert w["n"] == 5 and 0 < w["p"] <= 1
    assert stats.sign_test(df, "a", "b")["wins"] == 4
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.normal_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)


def test_cox_gradient_vanishes(spark):
    random.seed(2)
    df = spark.createDataFrame([(random.random(), random.random() < 0.7, random.gauss(0, 1)) for _ in range(60)], "t double, e boolean, x double")
    m = V.Cox(["x"]).fit(df, "t", "e")
    assert abs(m._terms(df, "t", "e", m.coefficients)[1][0]) < 1e-5


def test_filters_greedy_orders_all(numbers):
    for how in ("mrmr", "jmi", "jmim", "cmim"):
        assert sorted(r["score"] for r in S.greedy(numbers, ["a", "b", "c"], "y", how).collect()) == [1, 2, 3]
    assert S.select_top(S.variance(numbers, ["a", "b", "c"]), ["a", "b", "c"], 2)
