"""Trees, composed and online learners, explanations and tuning against plain versions and small known cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import prediction as P
from sparkloom import registry
from sparkloom.errors import EngineError, FitError, NotSupported, TaskError
from sparkloom.functions import measures as M
from sparkloom.learners import boosting as B
from sparkloom.learners import closed as L
from sparkloom.learners import composed as C
from sparkloom.learners import kernels as K
from sparkloom.learners import spatial as G
from sparkloom.learners import trees as T
from sparkloom.operators import balance as A
from sparkloom.operators import causal as E
from sparkloom.operators import explain as X
from sparkloom.operators import neighbours as N
from sparkloom.operators import survival as V
from sparkloom.operators import tuning as U
from sparkloom.operators.resample import with_folds
from sparkloom.operators.transform import StandardScaler
from sparkloom.streaming import online as O
from sparkloom.streaming import trainers as S
from sparkloom.task import classification, regression


@pytest.fixture(scope="module")
def blobs(spark):
    """Two classes of 40 rows, one value missing nowhere; y is a sum with a step, c a code."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(80):
        k = i % 2
        a, b = rng.normal(2.5 * k, 0.7), rng.normal(-1.5 * k, 0.7)
        rows.append((i, float(a), float(b), k, float(3 * a - b + 2 * k), i % 3))
    return spark.createDataFrame(rows, "id long, a double, b double, k int, y double, c int").cache()


SMALL = {"random_forest": {"n_estimators": 5}, "extra_trees": {"n_estimators": 5}, "oblique_forest": {"n_estimators": 3, "pool": 6}, "oblique_tree": {"pool": 6}, "quantile_forest": {"n_estimators": 5}, "adaboost": {"n_estimators": 5}, "elm": {"n_hidden": 10}, "ridge": {}, "lasso": {"alpha": 0.01}, "elastic_net": {"alpha": 0.01}, "gaussian_process": {"alpha": 1e-6}, "mondrian_forest": {"n_trees": 2}, "adaptive_random_forest": {"n_trees": 3, "grace": 10, "delta": 0.3}, "hoeffding_tree": {"grace": 20, "delta": 0.3}} | {n: {"n_estimators": 5} for n in ("gradient_boosting", "xgboost", "lightgbm", "catboost", "quantile_gb")} | {"ebm": {"n_estimators": 5, "learning_rate": 0.3}}


@pytest.mark.parametrize("name", registry.registered_learner_ids())
def test_contract(blobs, name):
    """A learner does what its properties say and refuses the rest; rows and columns come out as they went in."""
    learner = registry.learner_from_id(name, **SMALL.get(name, {}))
    assert learner.id == name
    c, r = classification(blobs, ["a", "b"], "k", ["id"]), regression(blobs, ["a", "b"], "y", ["id"])
    for letter, task in (("C", c), ("R", r)):
        if letter not in learner.properties:
            with pytest.raises(NotSupported):
                learner.fit(task)
            continue
        out = learner.fit(task).predict(blobs)
        assert set(blobs.columns) <= set(out.columns) and ("probabilities" in out.columns) == (letter == "C" and "P" in learner.properties)
        rows = out.collect()
        assert sorted(x["id"] for x in rows) == list(range(80)) and all(x["predicted"] is not None for x in rows)
        if letter == "C":
            assert sum(x["predicted"] == x["k"] for x in rows) >= 56
            if "P" in learner.properties:
                assert all(sum(x["probabilities"]) == pytest.approx(1.0) for x in rows)
        else:
            gap = np.mean([(x["predicted"] - x["y"]) ** 2 for x in rows])
            assert gap < np.var([x["y"] for x in rows])
    if "W" not in learner.properties:
        with pytest.raises(NotSupported):
            learner.fit((c if "C" in learner.properties else r).with_weights("c"))
    if "I" in learner.properties:
        assert set(learner.fit(c if "C" in learner.properties else r).importance()) == {"a", "b"}


def test_registry_knows_what_it_has():
    assert registry.learner_properties("gaussian_nb") == {"classification", "probabilities"}
    with pytest.raises(EngineError):
        registry.learner_from_id("nothing")


def plain_tree(x, y, depth, k):
    """Class shares of each row's leaf, by exact splits at midpoints."""
    counts = np.bincount(y, minlength=k)
    leaf = np.tile(counts / counts.sum(), (len(y), 1))
    if depth == 0 or len(set(y.tolist())) == 1:
        return leaf
    best = (1e-9, None)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in (v[1:] + v[:-1]) / 2:
            low = x[:, f] < t
            score = sum((np.bincount(y[s], minlength=k) ** 2).sum() / s.sum() for s in (low, ~low)) - (counts**2).sum() / len(y)
            if score > best[0] + 1e-9:
                best = (score, (f, t))
    if best[1] is None:
        return leaf
    low = x[:, best[1][0]] < best[1][1]
    for s in (low, ~low):
        leaf[s] = plain_tree(x[s], y[s], depth - 1, k)
    return leaf


@pytest.mark.parametrize("cells", [10**6, 0])
def test_decision_tree_is_that_of_exact_splits(spark, blobs, cells):
    df = blobs.withColumn("k3", F.col("id").cast("int") % 3)
    rows = df.orderBy("id").collect()
    x, y = np.array([[r["a"], r["b"]] for r in rows]), np.array([r["k3"] for r in rows])
    got = T.DecisionTree(max_depth=3, local_cells=cells).fit(classification(df, ["a", "b"], "k3", ["id"])).predict(df).orderBy("id").collect()
    assert np.allclose([r["probabilities"] for r in got], plain_tree(x, y, 3, 3))


@pytest.mark.parametrize("make", [lambda **o: T.RandomForest(n_estimators=3, max_depth=3, **o), lambda **o: T.ExtraTrees(n_estimators=3, max_depth=3, **o), lambda **o: T.AdaBoost(n_estimators=3, **o), lambda **o: B.lightgbm(n_estimators=2, top_rate=0.3, other_rate=0.3, subsample=0.9, **o), lambda **o: B.gradient_boosting(n_estimators=2, **o)])
def test_in_memory_and_over_spark_agree(blobs, make):
    t = classification(blobs, ["a", "b"], "k", ["id"])
    p, q = ({r["id"]: r["probabilities"] for r in make(local_cells=n).fit(t).predict(blobs).collect()} for n in (10**7, 0))
    assert all(p[i] == pytest.approx(q[i]) for i in p)


def test_weights_are_copies(blobs):
    t = classification(blobs.withColumn("w", (F.col("id") % 3 + 1).cast("int")), ["a", "b"], "k", ["id"])
    copies = t.df.withColumn("r", F.explode(F.sequence(F.lit(1), F.col("w"))))
    for learner in (T.DecisionTree(max_depth=2), B.xgboost(n_estimators=2, max_depth=2)):
        a, b = learner.fit(t.with_weights("w")).predict(blobs), learner.fit(t.on(copies)).predict(blobs)
        assert [r["probabilities"] for r in a.orderBy("id").collect()] == [pytest.approx(r["probabilities"]) for r in b.orderBy("id").collect()]


def test_early_stopping_keeps_the_best(blobs):
    t = regression(blobs, ["a", "b"], "y", ["id"])
    watch = blobs.where("id % 4 = 0")
    m = B.xgboost(n_estimators=60, early_stopping=3, eval_set=watch).fit(t.rows("id % 4 <> 0"))
    assert 0 < len(m.trees) < 60
    loss = lambda k: M.regression(B.BoostedModel(m.cols, m.cuts, m.trees[:k], m.objective, m.start, m.kind).predict(watch), "y").first()["rmse"]
    assert loss(len(m.trees)) <= min(loss(k) for k in range(1, len(m.trees)))
    with pytest.raises(FitError):
        B.xgboost(early_stopping=3).fit(t)


def test_categories_and_statistics(spark):
    rows = [(i, i % 5, f"c{i % 5}" if i % 11 else None, float((i % 5 in (0, 3)) * 10 + i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, c int, s string, y double")
    t = regression(df, ["c"], "y", ["id"]).with_categories(["c"])
    m = B.xgboost(n_estimators=1, max_depth=1, learning_rate=1.0, reg_lambda=0.0).fit(t)
    got = {r["c"]: round(r["predicted"], 3) for r in m.predict(df).collect()}
    assert got[0] == got[3] and got[1] == got[2] == got[4] and got[0] - got[1] == pytest.approx(10, abs=0.1)
    again = T.DecisionTree(max_depth=1).fit(t).predict(df).collect()
    assert {r["c"]: round(r["predicted"], 3) for r in again} == got
    m = B.catboost(n_estimators=10, cat_features=["s"]).fit(regression(df, ["s", "c"], "y", ["id"]))
    out = m.predict(df.union(spark.createDataFrame([(1000, 1, "new", 0.0)], df.schema)))
    assert out.count() == 101 and set(m.importance()) == {"s", "c"}


def test_quantile_forest_pools_leaves(spark):
    df = spark.createDataFrame([(i, float(i % 2), float(i)) for i in range(40)], "id long, a double, y double")
    m = T.QuantileForest(n_estimators=1, bootstrap=False, max_depth=1).fit(regression(df, ["a"], "y", ["id"]))
    got = {(r["a"], r["q_0.5"], r["q_0.1"]) for r in m.predict_quantile(df, 0.5, 0.1).collect()}
    assert got == {(0.0, 18.0, 2.0), (1.0, 19.0, 3.0)}
    assert m.predict_interval(df, 0.2).where("low > high").count() == 0


def test_causal_forest_finds_the_effect(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x := rng.uniform(-1, 1)), float(rng.normal()), int(t := rng.integers(2)), float(t * (4.0 if x > 0 else 1.0) + rng.normal() * 0.3)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, a double, b double, t int, y double")
    task = regression(df, ["a", "b"], "y", ["id"])
    f = T.CausalForest(n_estimators=20)
    e = f.estimate(task, "t").join(df, "id").groupBy((F.col("a") > 0).alias("up")).agg(F.avg("estimated").alias("e"), F.min("se").alias("se")).collect()
    got = {r["up"]: r["e"] for r in e}
    assert got[True] == pytest.approx(4, abs=0.5) and got[False] == pytest.approx(1, abs=0.5) and min(r["se"] for r in e) >= 0
    with pytest.raises(FitError):
        T.CausalForest(n_estimators=3).fit(task, "t")


def test_survival_forest_orders_risks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x := rng.uniform(0, 1)), float(rng.normal()), float(rng.exponential(np.exp(-3 * x)) + 0.01), int(rng.random() < 0.8)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, t double, e int")
    f = T.SurvivalForest(n_estimators=10, max_depth=4)
    m = f.fit(df, ["a", "b"], "t", "e")
    assert V.concordance(f.out_of_bag(m, df, "t", "e"), "time", "event", "mortality").first()["c_index"] > 0.6
    h = m.predict(df).first()["hazards"]
    assert all(a <= b for a, b in zip(h, h[1:], strict=False))


def test_concordance_by_ranges_is_that_of_pairs(spark):
    rng = np.random.default_rng(0)
    t, e, r = rng.integers(1, 60, 500).astype(float), rng.integers(0, 2, 500), np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, r, strict=True)], "t double, e int, r double")
    want = V._pairs(t, e.astype(float), r)
    for size in (500, 60):
        assert V.concordance(df.repartition(3), "t", "e", "r", size=size).first()[:2] == want


def test_pipeline_resampler_and_elimination(blobs):
    t = classification(blobs.where("k = 0 or id % 4 = 1"), ["a", "b"], "k", ["id"])
    balanced = lambda t: t.on(A.smote(t.df, "id", t.features, t.target))
    p = C.Pipeline([StandardScaler(["a", "b"])], L.GaussianNB, balanced)
    out = p.fit(t).predict(blobs)
    assert p.id == "pipeline(StandardScaler+gaussian_nb)" and out.select("a").orderBy("id").first() == blobs.select("a").orderBy("id").first()
    assert M.accuracy(out, "k").first()[0] > 0.9
    with pytest.raises(NotSupported):
        C.Pipeline([], L.LinearRegression, balanced).fit(regression(blobs, ["a"], "y", ["id"]))
    noisy = blobs.withColumns({"n": F.rand(1), "m": F.rand(2)})
    assert C.RFE(L.LinearRegression, 2).select(regression(noisy, ["n", "a", "m", "b"], "y", ["id"])) == ["a", "b"]
    chosen = C.Pipeline([C.FilterSelector(["a", "b"], 1)], L.LinearRegression).fit(regression(blobs, ["a", "b"], "y", ["id"]))
    assert len(chosen.importance()) == 1


def test_calibration(spark, blobs):
    rng = random.Random(1)
    rows = [(s := rng.random(), int(rng.random() < s * s)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "s double, y int").withColumn("y", F.col("y") == 1)
    a, b = C.platt(df, "s", "y")
    assert a < 0 and 1 / (1 + np.exp(a * 0.9 + b)) == pytest.approx(0.81, abs=0.08)
    for points in (5000, 100):
        x, v = C.isotonic(df, "s", "y", points)
        assert (np.diff(v) >= 0).all() and np.interp(0.5, x, v) == pytest.approx(0.25, abs=0.08)
    t = classification(blobs.withColumn("k3", F.col("id").cast("int") % 3), ["a", "b"], "k3", ["id"])
    for method in ("platt", "isotonic"):
        out = C.Calibrated(L.GaussianNB, method).fit(t).predict(t.df).collect()
        assert all(sum(r["probabilities"]) == pytest.approx(1) for r in out)


def test_chains_and_frames(spark, blobs):
    m = C.RegressorChain(L.LinearRegression).fit(blobs, ["a"], ["b", "y"], ["id"])
    out = m.predict(blobs)
    assert set(out.columns) == {*blobs.columns, "predicted_b", "predicted_y"} and m.models[1].cols == ["a", "b"]
    two = blobs.withColumn("k2", (F.col("k") == 0).cast("int"))
    out = C.ClassifierChain(L.GaussianNB).fit(two, ["a", "b"], ["k", "k2"], ["id"]).predict(two)
    assert out.where("predicted_k + predicted_k2 <> 1").count() <= 2
    p = P.regression(blobs, ["id"], "y")
    assert p.n_samples() == 80 and p.with_truth("classif", blobs, "k") is p and p.with_truth("regress", blobs, "a").truth == "truth"
    with pytest.raises(TaskError):
        p.with_truth("regress", blobs.union(blobs), "a")


def test_repeated_ids_stay_rows(spark):
    df = spark.createDataFrame([(i // 2, float(i), float(2 * i)) for i in range(40)], "id long, a double, y double")
    assert with_folds(df, ["id"], 4).count() == 40
    assert E.out_of_fold(regression(df, ["a"], "y", ["id"]), L.LinearRegression, "p", 4).where("abs(p - y) < 1e-6").count() == 40


def test_effects_are_cross_fitted(spark):
    rows = [(i, float(i % 10), i % 2, float(i % 10 + 3 * (i % 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, t int, y double")
    task = regression(df, ["x"], "y", ["id"])
    ols = L.LinearRegression
    for out in (E.dr_learner(task, "t", ols, L.LogisticRegression, ols, 3), E.r_learner(task, "t", ols, L.LogisticRegression, ols, 3), E.r_learner(task, "t", ols, L.LogisticRegression, lambda: K.GaussianProcess(alpha=0.1), 3)):
        assert out.count() == 60 and out.agg(F.avg("estimated")).first()[0] == pytest.approx(3, abs=0.6)


def test_importance_and_shapley(blobs):
    t = regression(blobs, ["a", "b"], "y", ["id"])
    m = L.LinearRegression().fit(t)
    got = X.permutation_importance(m, t, M.regression, "rmse", 3, maximize=False).collect()
    assert got[0]["feature"] == "a" and got[0]["importance"] > got[1]["importance"] > 0
    phi = X.permutation_shap(m, t, blobs.where("id < 5"), 4, 2)
    for r in m.predict(blobs).join(phi, "id").collect():
        assert r["base"] + r["phi_a"] + r["phi_b"] == pytest.approx(r["predicted"])
    of = dict(zip(m.cols, m.weights, strict=True))
    a = {r["id"]: r["phi_a"] for r in phi.collect()}
    x = {r["id"]: r["a"] for r in blobs.collect()}
    assert a[1] - a[0] == pytest.approx(of["a"] * (x[1] - x[0]))
    assert X.shap_importance(phi, t.features).first()["feature"] == "a"


def test_guided_searches(blobs):
    t = regression(blobs, ["a", "b"], "y", ["id"])
    make = lambda p: L.Ridge(p["alpha"])
    best, score, tried = U.TPE({"alpha": U.Uniform(1e-3, 1e4, log=True)}, n_iter=7, n_random=3).tune(t, make, M.regression, "rmse", maximize=False, k=2)
    assert len(tried) == 7 and score == min(s for _, s in tried) and 1e-3 <= best["alpha"] <= 1e4
    h = U.Hyperband({"alpha": [0.1, 1e5]}, max_folds=3)
    assert h.brackets() == [[(3, 2), (1, 3)], [(2, 3)]]
    assert h.tune(t, make, M.regression, "rmse", maximize=False)[0]["alpha"] == 0.1
    with pytest.raises(FitError):
        U.acyclic([U.Dependency("a", "b", (1,)), U.Dependency("b", "a", (1,))])
    p = U.Progress([1.0, 2.0])
    assert U.any_of(U.max_evals(5), U.target_score(2.0))(p) and not U.all_of(U.max_evals(5), U.target_score(2.0))(p)
    many = U.search_many(t, make, U.grid({"alpha": [0.1, 1e3]}), M.regression, {"rmse": False, "r2": True}, 2)
    assert [q["alpha"] for q, _ in many] == [0.1]


def test_general_front(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 8, (300, 3)).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "id long, a double, b double, c double").repartition(3)
    sign = np.array([1, 1, -1])
    want = {i for i, r in enumerate(v * sign) if not ((v * sign >= r).all(1) & (v * sign > r).any(1)).any()}
    assert {r["id"] for r in U.pareto_front(df, ["id"], ["a", "b"], ["c"]).collect()} == want
    met = U._meet(df.select(F.col("a").alias("o0"), F.col("b").alias("o1"), F.col("c").alias("o2")).distinct(), ["o0", "o1", "o2"], sign.astype(float))
    assert {tuple(r) for r in met.collect()} == {tuple(v[i]) for i in want}


@pytest.mark.parametrize("leaf", [20, 3000])
def test_neighbours_are_those_of_brute_force(spark, leaf):
    x = np.round(np.random.default_rng(8).normal(size=(400, 3)), 1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = {}
    for r in N.knn(df.where("id % 4 = 0"), df, "id", ["a", "b", "c"], 6, leaf=leaf, sample=150).collect():
        got.setdefault(r["query"], []).append((r["place"], r["id"]))
    for q in range(0, 400, 4):
        d = np.round(((x[q] - x) ** 2).sum(1), 9)
        d[q] = np.inf
        assert sorted(d[i] for _, i in got[q]) == pytest.approx(sorted(d)[:6])
    assert N.knn(df, df.limit(0), "id", ["a"], 3).count() == 0


def test_dbscan_of_dense_cells(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 0.02, (300, 2)), rng.normal(1, 0.02, (200, 2)), rng.uniform(-1, 2, (40, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = {r["id"]: r["label"] for r in N.dbscan(df, "id", "a", "b", 0.05, 5).collect()}
    near = np.sqrt(((x[:, None] - x) ** 2).sum(2)) <= 0.05
    core, label, n = near.sum(1) >= 5, np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = n
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = n
                    todo.append(j)
            n += 1
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    assert [got[i] for i in range(len(x))] == label.tolist()


def test_kmeans_takes_the_best_start(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.05, (50, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    centres, out = N.kmeans(df, ["a", "b"], 4, n_init=5)
    assert sorted(np.round(c).tolist() for c in np.array(centres)) == [[0, 0], [0, 5], [5, 0], [5, 5]]
    assert {r["count"] for r in out.groupBy("label").count().collect()} == {50}


def test_balanced_rows(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(rng.normal(i % 6 == 0)), float(rng.normal()), int(i % 6 == 0)) for i in range(120)], "id long, a double, b double, k int")
    for out in (A.smote(df, "id", ["a", "b"], "k"), A.spatial_smote(df, "id", ["a"], ["b"], "k", 5.0)):
        assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {0: 100, 1: 100}
    low, high = df.where("k = 1").agg(F.min("a"), F.max("a")).first()
    made = A.adasyn(df, "id", ["a", "b"], "k").where("id is null")
    assert made.count() == A.adasyn_counts(df, "id", ["a", "b"], "k", 1).agg(F.sum("samples")).first()[0] and made.where((F.col("a") < low) | (F.col("a") > high)).count() == 0


def test_kernels_against_numpy(spark, blobs):
    rows = blobs.orderBy("id").collect()
    x, y = np.array([[r["a"], r["b"]] for r in rows]), np.array([r["y"] for r in rows])
    m = K.GaussianProcess(length_scale=1.5, alpha=0.1).fit(regression(blobs, ["a", "b"], "y", ["id"]))
    k = np.exp(-((x[:, None] - x) ** 2).sum(2) / (2 * 1.5**2))
    want = k @ np.linalg.solve(k + 0.1 * np.eye(80), y)
    out = m.predict_with_std(blobs).orderBy("id").collect()
    assert [r["predicted"] for r in out] == pytest.approx(want.tolist())
    assert [r["std"] ** 2 for r in out] == pytest.approx((1 - np.einsum("ij,jk,ki->i", k, np.linalg.inv(k + 0.1 * np.eye(80)), k)).tolist(), abs=1e-6)
    with pytest.raises(FitError):
        K.GaussianProcess(max_rows=10).fit(regression(blobs, ["a"], "y", ["id"]))
    ring = spark.createDataFrame([(i, float(np.cos(i) * (1 + i % 2)), float(np.sin(i) * (1 + i % 2)), i % 2) for i in range(80)], "id long, a double, b double, k int")
    t = classification(ring, ["a", "b"], "k", ["id"])
    assert M.accuracy(K.KernelSVM(c=10.0).fit(t).predict(ring), "k").first()[0] > 0.95
    d = [r["decisions"][0] for r in K.KernelSVM(kernel="linear").fit(classification(blobs, ["a", "b"], "k", ["id"])).decision_function(blobs).orderBy("id").collect()]
    assert np.mean((np.array(d) > 0) == np.array([r["k"] for r in rows])) > 0.95


def test_logistic_regression_is_at_the_maximum(blobs):
    df = blobs.withColumn("k", F.when(F.col("id") % 10 == 0, 1 - F.col("k")).otherwise(F.col("k")))
    out = L.LogisticRegression().fit(classification(df, ["a", "b"], "k", ["id"])).predict(df).collect()
    gap = np.array([r["k"] - r["probabilities"][1] for r in out])
    assert abs(gap.sum()) < 1e-3 and abs((gap * [r["a"] for r in out]).sum()) < 1e-3


def test_kriging_and_local_models(spark):
    rows = [(i, float(i % 9), float(i // 9), float(np.sin(i % 9) + np.cos(i // 9))) for i in range(81)]
    df = spark.createDataFrame(rows, "id long, x double, y double, v double")
    t = regression(df, ["x", "y"], "v", ["id"])
    m = G.KrigingHybrid(L.LinearRegression, ["x", "y"]).fit(t)
    assert all(r["predicted"] == pytest.approx(r["v"], abs=1e-3) for r in m.predict(df).collect())
    assert m.variogram_fit.sill > 0 and len(m.variogram_fit.lags) <= 15
    with pytest.raises(FitError):
        G.KrigingHybrid(L.LinearRegression, ["x", "y"], "none").fit(t)
    g = G.GeoXGBoost(["x", "y"], n_estimators=3, max_depth=2, folds=2).fit(t)
    out = g.predict(df)
    assert out.count() == 81 and out.columns == [*df.columns, "predicted"] and g.local_importances().select("point").distinct().count() == 81


def test_online_learners():
    rng = random.Random(1)
    rows = [((a, b), int(a > 0.5)) for a, b in ((rng.random(), rng.random()) for _ in range(2500))]
    h, m, f = O.HoeffdingTree(2, 2), O.MondrianTree(2, 2), O.AdaptiveTree(2, 2, 0)
    assert h.probabilities([0.0, 0.0]) == [0.5, 0.5] and h.predict_one([0.0, 0.0]) == 1
    for i, (x, y) in enumerate(rows):
        h.partial_fit(x, y)
        f.partial_fit(x, y if i < 1200 else 1 - y)
        if i < 600:
            m.partial_fit(x, y)
    for tree in (O.HoeffdingTree.of(h.state()), O.MondrianTree.of(m.state())):
        assert sum(tree.predict_one(x) == y for x, y in rows) > 0.95 * len(rows)
    again = O.AdaptiveTree.of(f.state())
    assert again.drifts >= 1 and sum(again.predict_one(x) == 1 - y for x, y in rows[-300:]) > 270
    a = O.Adwin(0.002)
    assert not any(a.add(0.0) for _ in range(150)) and any(a.add(1.0) for _ in range(60)) and a.mean() > 0.5


def test_stream_learns_what_a_table_does(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random()) for i in range(900)]
    df = spark.createDataFrame([(i, a, b, int(a > 0.4)) for i, a, b in rows], "id long, a double, b double, y int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    how = S.adaptive_random_forest(2, rate=2.0)
    how.order = ["id"]
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = how.stream(stream, ["a", "b"], "y", 2, ["id"])
    q = out.writeStream.outputMode("update").format("memory").queryName("trees").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = S.model_of(spark.table("trees"), "adaptive", ["a", "b"], 2)
    batch = how.fit(classification(df, ["a", "b"], "y", ["id"]))
    assert streamed.states == batch.states
    assert M.accuracy(streamed.predict(df), "y").first()[0] > 0.8


def test_models_as_files(spark, blobs, tmp_path):
    from sparkloom.sources import tables

    c, r = classification(blobs, ["a", "b"], "k", ["id"]), regression(blobs, ["a", "b"], "y", ["id"])
    fitted = [L.GaussianNB().fit(c), K.LinearSVM().fit(c), K.KernelSVM().fit(c), T.AdaBoost(n_estimators=2).fit(c), T.RandomForest(n_estimators=2, max_depth=2).fit(c), B.lightgbm(n_estimators=2).fit(c), S.hoeffding_tree(grace=20).fit(c), K.ELM(n_hidden=5).fit(r), K.GaussianProcess(alpha=0.1).fit(r), T.QuantileForest(n_estimators=2, max_depth=2).fit(r), T.ObliqueTree(pool=4, max_depth=2).fit(r)]
    for m in fitted:
        again = tables.from_json(tables.to_json(m))
        assert [x["predicted"] for x in again.predict(blobs).orderBy("id").collect()] == [x["predicted"] for x in m.predict(blobs).orderBy("id").collect()]
    tables.save(spark, fitted[0], str(tmp_path / "m"))
    assert tables.load(spark, str(tmp_path / "m")).rows == fitted[0].rows
    with pytest.raises(EngineError):
        tables.to_json(C.DynamicModel([], blobs, c, 1))
    with pytest.raises(EngineError):
        tables.from_json('{"format_version": 2, "model": {"kind": "Path", "fields": {}}}')


def test_learners_have_parameters(blobs):
    ridge = L.Ridge(2.0)
    assert ridge.get_params() == {"alpha": 2.0} and ridge.set_params(alpha=3.0).alpha == 3.0
    with pytest.raises(TaskError):
        ridge.set_params(beta=1)
    t = regression(blobs, ["a", "b"], "y", ["id"])
    out = L.LinearRegression().fit(t.rows("id % 2 = 0")).conformal_predict(t.rows("id % 4 = 1"), blobs, 0.2)
    assert out.where("y < lower or y > upper").count() <= 30
