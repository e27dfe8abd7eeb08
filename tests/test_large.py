"""What larger or odd tables showed: ties, tables beyond the driver's memory, many rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.learners import boosting as B
from sparkloom.learners import growth as G
from sparkloom.learners import trees as T
from sparkloom.plans import catalogue
from sparkloom.streaming import online as O
from sparkloom.streaming import trainers as S
from sparkloom.task import classification, regression


def against_sql(spark, name, d, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, d)
    return sorted(map(tuple, df.collect())), sorted(c.execute(f"select {', '.join(df.columns)} from ({catalogue.oracle_sql()[name]})").fetchall())


def test_ranks_tie_at_the_digits_of_the_scores(spark, tmp_path):
    """The variances of discount and tax differ, but not in six digits."""
    rows = [(float(i % 50), 100.0 * (i * 7 % 90), 0.0006 * (i % 2), 0.0008 * (i % 2), "ANR"[i % 3]) for i in range(300)]
    spark.createDataFrame(rows, "l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = against_sql(spark, "cumulative_ranking", str(tmp_path), "lineitem")
    assert got == want


def test_equal_rows_are_one_in_the_store(spark):
    """Rows that learners can't tell apart are not held one by one, and the trees stay the same."""
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(8)), float(rng.integers(3)) if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame([(i, a, b, float(np.round(rng.normal(a, 2.0))), int(a + rng.normal() > 4)) for i, a, b in rows], "id long, a double, b double, y double, k int").cache()
    cuts, one = G.bin_edges(df, ["a", "b"], 254), F.lit(1.0)
    counts = {}
    for merge in (None, "rows", "features"):
        b = G.pack(df, ["a", "b"], cuts, F.col("y"), one, [0.0], merge=merge)
        v = G.Local(b).view
        counts[merge] = v.n
        assert np.isclose((v.w * v.y).sum(), df.agg(F.sum("y")).first()[0]) and v.w.sum() == 3000 and (v.c is None or v.c.sum() == 3000)
    assert counts[None] == 3000 and counts["features"] == 32 < counts["rows"] < 1500
    price, kind = regression(df, ["a", "b"], "y", ["id"]), classification(df, ["a", "b"], "k", ["id"])
    for make, t in ((lambda n: B.lightgbm(n_estimators=4, leaves=6, local_cells=n), price), (lambda n: T.DecisionTree(max_depth=4, local_cells=n), price), (lambda n: T.DecisionTree(max_depth=4, local_cells=n), kind), (lambda n: B.xgboost(n_estimators=3, local_cells=n), kind)):
        want = plain(make(10**7), t)
        for n in (10**7, 0):
            got = [r["predicted"] for r in make(n).fit(t).predict(df).orderBy("id").collect()]
            assert np.allclose(got, want)
    drawn = [make(10**7).fit(price).predict(df) for make in (lambda n: B.lightgbm(n_estimators=30, top_rate=0.2, other_rate=0.1, subsample=0.8),)]
    whole = B.lightgbm(n_estimators=30).fit(price).predict(df)
    gap = [d.agg(F.avg((F.col("y") - F.col("predicted")) ** 2)).first()[0] for d in (*drawn, whole)]
    assert abs(gap[0] - gap[1]) < 0.05 * gap[1]


def plain(learner, t):
    """Predictions by rows that are kept one by one."""
    pack = G.pack
    with pytest.MonkeyPatch.context() as m:
        for module in (B, T):
            m.setattr(module, "pack", lambda *a, merge=None, **k: pack(*a, **k))
        return [r["predicted"] for r in learner.fit(t).predict(t.df).orderBy("id").collect()]


def test_the_driver_holds_blocks_by_their_bytes(spark):
    """A feature of a byte has 24 bytes of target, weight and margin beside it; these counted for nothing."""
    df = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("a"), F.rand(1).alias("y"))
    b = G.pack(df, ["a"], G.bin_edges(df, ["a"], 254), F.col("y"), F.lit(1.0), [0.0])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(G, "LOCAL", 40_000)
        assert isinstance(G.store_of(b, 10**7), G.Far)
    assert isinstance(G.store_of(b, 10**7), G.Local)


def test_survival_sums_by_codes(spark):
    """Trees from sums by code are those of a channel for each time."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b), float(np.round(rng.exponential(1 + a), 1)), int(rng.random() < 0.7)) for a, b in rng.integers(0, 9, (800, 2))], "a double, b double, t double, e int").cache()
    near, far = (T.SurvivalForest(n_estimators=3, max_depth=3, local_cells=n).fit(df, ["a", "b"], "t", "e") for n in (10**7, 0))
    times, q = near.times, len(near.times)
    for a, b in zip(near.trees, far.trees, strict=True):
        assert a.feature == b.feature and a.bin == b.bin and np.allclose(np.array(a.value), np.array(b.value))
    v = G.Local(G.pack(df, ["a", "b"], near.cuts, F.col("t"), F.lit(1.0), [], [F.col("e").cast("double")])).view
    tree, n = near.trees[0], v.poisson(1.0, 42, 0)
    for leaf in (i for i, f in enumerate(tree.feature) if f < 0):
        at = tree.apply(v.x) == leaf
        d, r = np.zeros(q), np.zeros(q)
        for yi, ei, ni in zip(v.y[at], v.e[0][at], n[at], strict=True):
            k = min(np.searchsorted(times, yi, "left"), q - 1)
            d[k] += ni * ei
            r[: k + 1 if ei else np.searchsorted(times, yi, "right")] += ni
        assert np.allclose(tree.value[leaf], np.cumsum(np.log((r + 0.5) / (r - d + 0.5))))


def test_online_trees_learn_many_rows_at_once(spark):
    """Rows learned together leave the state that they leave one by one, over drifts, and are scored together."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.random(4000), rng.integers(24, size=4000).astype(float)], 1)
    y = (x[:, 0] > 0.4).astype(int) ^ (np.arange(4000) // 1300 % 2) ^ (rng.random(4000) < 0.05)
    rows, kinds = x.tolist(), y.tolist()
    one, many = O.AdaptiveTree(2, 2, 0, rate=2.0, grace=20, delta=0.3), O.AdaptiveTree(2, 2, 0, rate=2.0, grace=20, delta=0.3)
    for v, k in zip(rows, kinds, strict=True):
        one.partial_fit(v, k)
    for at in (0, 1, 700, 3999):
        many.learn(rows[at : {0: 1, 1: 700, 700: 3999}.get(at)], kinds[at : {0: 1, 1: 700, 700: 3999}.get(at)])
    assert one.state() == many.state() and one.drifts >= 2
    df = spark.createDataFrame([(i, *v, k) for i, (v, k) in enumerate(zip(rows, kinds, strict=True))], "id long, a double, b double, y int").repartition(3)
    how = S.adaptive_random_forest(3, rate=2.0, grace=20, delta=0.3)
    how.order = ["id"]
    m = how.fit(classification(df, ["a", "b"], "y", ["id"]))
    assert m.states[0] == one.state()
    trees = [O.AdaptiveTree.of(s) for s in m.states]
    want = [float(np.mean([t.predict_one(v) for t in trees])) for v in rows]
    got = m.predict(df).orderBy("id").collect()
    assert [r["probabilities"][1] for r in got] == want and [r["predicted"] for r in got] == [int(w >= 0.5) for w in want]


def test_leaves_of_rows_come_from_bits():
    """Bits of possible leaves lead where the walk from the root does, with missing values, categories and beyond 64 leaves."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (5, 3000)).astype(np.uint8)
    for n in (1, 2, 31, 32, 33, 64, 65, 150):
        t, open_ = G.Tree(), [0]
        while len(open_) < n:
            bins = sorted(rng.choice(255, 40, replace=False).tolist()) if rng.random() < 0.3 else None
            left, right = t.split(open_.pop(rng.integers(len(open_))), G.Split(1.0, int(rng.integers(5)), int(rng.integers(1, 254)), bool(rng.integers(2)), bins, None, None))
            open_ += [left, right]
            t.apply(x[:, :1])
        want = []
        for row in x.T:
            i = 0
            while t.feature[i] >= 0:
                i = t.left[i] if t.goes_left(i)[row[t.feature[i]]] else t.right[i]
            want.append(i)
            if len(want) == 300:
                break
        assert (t.masks() is None) == (n > 64) and t.apply(x)[:300].tolist() == want


def test_leaf_growth_over_spark_asks_for_many_leaves_at_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b), float(np.sin(5 * a) + b * b + 0.1 * rng.normal())) for i, (a, b) in enumerate(rng.random((1500, 2)))]
    t = regression(spark.createDataFrame(rows, "id long, a double, b double, y double"), ["a", "b"], "y", ["id"])
    asked = []
    plain_ = G.Far.histograms
    monkeypatch.setattr(G.Far, "histograms", lambda self, asks: asked.append(len(asks)) or plain_(self, asks))
    for options in ({}, {"max_depth": 3}, {"top_rate": 0.3, "other_rate": 0.3}):
        asked.clear()
        far = B.lightgbm(n_estimators=1, leaves=16, local_cells=0, **options).fit(t).trees[0][1]
        assert 1 < len(asked) <= 9
        if "top_rate" not in options:
            near = B.lightgbm(n_estimators=1, leaves=16, **options).fit(t).trees[0][1]
            assert (far.feature, far.bin, far.left, far.right) == (near.feature, near.bin, near.left, near.right) and np.allclose(far.value, near.value)


def test_trees_over_spark_grow_from_sums_by_combinations_of_bins(spark):
    """A round of a table in Spark took a job for each few splits; rows of equal bins are now summed in one, and the trees stay the same."""
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.integers(9)) if i % 13 else None, float(rng.integers(20)) if i % 7 else float("nan"), int(rng.integers(5))) for i in range(3000)]
    df = spark.createDataFrame([(i, a, b, c, float((a or 3) + rng.normal()), int((a or 3) + c + rng.normal() > 6)) for i, a, b, c in rows], "id long, a double, b double, c int, y double, k int").cache()
    price, kind = regression(df, ["a", "b", "c"], "y", ["id"]), classification(df, ["a", "b"], "k", ["id"])
    drawn = {"n_estimators": 3, "leaves": 6, "top_rate": 0.2, "other_rate": 0.1, "subsample": 0.8, "colsample": 0.7}
    for make, t in (
        (lambda n: B.lightgbm(**drawn, local_cells=n), price),
        (lambda n: B.xgboost(n_estimators=2, max_depth=3, subsample=0.7, local_cells=n), regression(df, ["a", "c"], "y", ["id"]).with_categories(["c"])),
        (lambda n: B.catboost(n_estimators=2, max_depth=3, subsample=0.7, local_cells=n), price),
        (lambda n: B.gradient_boosting(n_estimators=2, subsample=0.7, local_cells=n), kind),
    ):
        want = make(10**7).fit(t)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(G.Far, "histograms", None)
            far = make(0).fit(t)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(G, "COMBINED", 1)
            by_jobs = make(0).fit(t)
        for got in (far, by_jobs):
            for (_, a), (_, b) in zip(want.trees, got.trees, strict=True):
                assert a.feature == b.feature and a.bin == b.bin and a.missing_left == b.missing_left and np.allclose(a.value, b.value)
        assert len(want.trees[0][1].feature) > 3
    # Doubles are read from their own columns, with nulls, NaN and infinities.
    one = want.predict(df).orderBy("id").select("predicted", "probabilities").collect()
    two = want.predict(df.withColumns({c: F.col(c).cast("float") for c in ("a",)})).orderBy("id").select("predicted", "probabilities").collect()
    assert one == two
