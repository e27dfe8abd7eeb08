"""Loaders, model files, tuning, balancing."""

import numpy as np
import pytest

from sparkloom.errors import EngineError, TaskError
from sparkloom.functions import measures as M
from sparkloom.learners import boosting as B
from sparkloom.learners import closed as L
from sparkloom.operators import balance as A
from sparkloom.operators import tuning as T
from sparkloom.sources import tables as S
from sparkloom.task import regression


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    return spark.createDataFrame([(i, float(a), float(b), float(2 * a - b)) for i, (a, b) in enumerate(x)], "id long, a double, b double, y double")


def test_model_files(spark, line, tmp_path):
    t = regression(line, ["a", "b"], "y", ["id"])
    for i, m in enumerate((L.LinearRegression().fit(t), B.xgboost(n_estimators=3).fit(t))):
        S.save(spark, m, str(tmp_path / f"m{i}"))
        again = S.load(spark, str(tmp_path / f"m{i}"))
        assert [r["predicted"] for r in again.predict(line).collect()] == [r["predicted"] for r in m.predict(line).collect()]
    with pytest.raises(EngineError):
        S.from_json('{"model": {}}')


def test_csv_types(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c\n1,x,\n?,y,2\n 3 ,NA,2\n")
    df, numeric = S.read_csv(spark, str(tmp_path / "x.csv"))
    assert numeric == {"a": True, "b": False, "c": True}
    assert [tuple(r) for r in df.collect()] == [(1.0, "x", None), (None, "y", 2.0), (3.0, None, 2.0)]
    with pytest.raises(TaskError):
        S.class_target(df, "a", True)
    with pytest.raises(TaskError):
        S.number_target(df, "c")


def test_grid_dependencies_and_search(line):
    space = {"kind": ["plain", "ridge"], "alpha": [1.0, 10.0]}
    g = T.grid(space, [T.Dependency("alpha", "kind", ("ridge",))])
    assert len(g) == 3
    t = regression(line, ["a", "b"], "y", ["id"])
    best, score, history = T.search(t, lambda p: L.Ridge(p.get("alpha", 0.0)), g, M.regression, "rmse", 3, maximize=False)
    assert best == {"kind": "plain"} and score < 1e-6 and len(history) == 3
    assert len(list(T.draws({"x": T.Uniform(1, 10, log=True), "k": [1, 2]}, 4))) == 4
    p = T.Progress([1.0, 2.0, 2.0, 2.0])
    assert T.stagnation(2)(p) and T.max_evals(4)(p) and not T.target_score(3)(p)


def test_fronts_agree(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(np.round(rng.random((200, 2)), 2))], "id long, up double, down double")
    a = sorted(map(tuple, T.pareto_front(df, ["id"], ["up"], ["down"]).collect()))
    assert a == sorted(map(tuple, T.front_of_two(df, ["id"], "up", "down").collect())) and a


def test_relief_matches_numpy(line):
    x = np.array(line.orderBy("id").select("a", "b", "y").collect())
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    d = ((x[:, None, :2] - x[None, :, :2]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    c, a, b = 0.0, np.zeros(2), np.zeros(2)
    for i in range(60):
        k = np.argsort(d[i], kind="stable")[:10]
        w = np.exp(-d[i, k] / d[i, k[-1]])
        w /= w.sum()
        dy, dx = np.abs(x[k, 2] - x[i, 2]), np.abs(x[k, :2] - x[i, :2])
        c += w @ dy
        a += w @ dx
        b += (w * dy) @ dx
    got = {r["feature"]: r["score"] for r in A.relief(line, "id", ["a", "b"], "y").collect()}
    assert [got["a"], got["b"]] == pytest.approx(list(b / c - (a - b) / (60 - c)))


def test_smote_balances(spark, line):
    df = line.selectExpr("id", "a", "b", "case when id % 7 = 0 then 1 else 0 end as k")
    out = A.smote(df, "id", ["a", "b"], "k")
    assert {r[0]: r[1] for r in out.groupBy("k").count().collect()} == {0: 51, 1: 51}
    alone = df.where("k = 0 or id = 7")
    assert A.smote(alone, "id", ["a", "b"], "k").where("k = 1").count() == 51
