"""Trees, composed and online learners, explanations and spatial models over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import prediction as P
from sparkloom.functions import measures as M
from sparkloom.learners import boosting as B
from sparkloom.learners import closed as L
from sparkloom.learners import composed as C
from sparkloom.learners import kernels as K
from sparkloom.learners import spatial as G
from sparkloom.learners import trees as T
from sparkloom.learners.neighbours import KNN
from sparkloom.operators import balance as A
from sparkloom.operators import explain as X
from sparkloom.operators import survival as V
from sparkloom.operators import tuning as U
from sparkloom.operators.resample import with_folds
from sparkloom.operators.transform import StandardScaler
from sparkloom.plans import more, preparation
from sparkloom.plans.ensembles import boosted, price_task
from sparkloom.plans.learning import LINE_KEY, flag_task, lines
from sparkloom.plans.measures import rounded
from sparkloom.plans.preparation import POINTS, points, table
from sparkloom.sources import tables as S
from sparkloom.storage import new_path
from sparkloom.streaming import trainers as O
from sparkloom.task import Task, classification, regression


def flag_by_quantity(spark: SparkSession, d: str) -> Task:
    return flag_task(spark, d).only(["l_quantity"])


def quality(spark: SparkSession, d: str) -> Task:
    """Labelled documents: quality by length, digits, capitals and lines."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    t = F.coalesce("text", F.lit(""))
    f = {"n": F.length(t), "digits": F.length(F.regexp_replace(t, "[^0-9]", "")), "capitals": F.length(F.regexp_replace(t, "[^A-Z]", "")), "lines": F.size(F.split(t, "\n"))}
    return classification(docs.where("quality is not null").select("doc_id", *(c.cast("double").alias(n) for n, c in f.items()), F.col("quality").cast("int").alias("y")), list(f), "y", ["doc_id"])


def place_task(spark: SparkSession, d: str) -> Task:
    """A smooth surface over the points plus a part of the third component."""
    e = table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "z"))))
    return regression(e.withColumn("v", F.sin(F.col("x") * 12.0) + F.cos(F.col("y") * 9.0) + 2.0 * F.col("z")), ["x", "y", "z"], "v", ["vec_id"])


def customers(spark: SparkSession, d: str) -> Task:
    """Treatment by parity; its effect on the outcome grows with the balance."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("b"), F.col("c_nationkey").cast("double").alias("n"), (F.col("c_custkey") % 2).cast("double").alias("t"))
    return regression(c.withColumn("o", F.col("n") + F.col("t") * F.when(F.col("b") > 4500, 10.0).otherwise(2.0)), ["b", "n"], "o", ["c_custkey"])


def accuracy(spark: SparkSession, make, task, digits: int = 3) -> DataFrame:
    return M.accuracy(make().fit(task).predict(task.df), task.target).select(F.round("accuracy", digits).alias("accuracy"))


def r2(spark: SparkSession, make, task, digits: int = 3) -> DataFrame:
    return M.regression(make().fit(task).predict(task.df), task.target).select(F.round("r2", digits).alias("r2"))


def by_quantity(model, task: Task, *cols) -> DataFrame:
    q = task.df.select("l_quantity").distinct()
    return model.predict(q).select("l_quantity", *cols)


def gini_stump(spark: SparkSession, d: str) -> DataFrame:
    t = flag_by_quantity(spark, d)
    return by_quantity(T.DecisionTree(max_depth=1).fit(t), t, "predicted", F.round(F.col("probabilities")[0], 6).alias("p0"))


def adaboost_stump(spark: SparkSession, d: str) -> DataFrame:
    t = flag_by_quantity(spark, d)
    return by_quantity(T.AdaBoost(n_estimators=1).fit(t), t, "predicted")


def tree_depth_two(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    return by_quantity(T.DecisionTree(max_depth=2).fit(t), t, F.round("predicted", 3).alias("predicted"))


def two_stumps(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    return by_quantity(B.xgboost(n_estimators=2, max_depth=1).fit(t), t, F.round("predicted", 3).alias("predicted"))


def statistic(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    prior = float(p.agg(F.avg("p_retailprice")).first()[0])
    return rounded(B.ordered_statistic(p, ["p_partkey"], "p_brand", [F.col("p_retailprice")], [prior], ["ts"]).select("p_partkey", "ts"), "p_partkey")


def stopped(spark: SparkSession, d: str) -> DataFrame:
    """Rounds kept of 100 with an eval set of every fifth line."""
    t = price_task(spark, d)
    m = B.xgboost(early_stopping=5, eval_set=t.df.where("l_partkey % 5 = 0")).fit(t.rows("l_partkey % 5 <> 0"))
    return spark.createDataFrame([(len(m.trees),)], "rounds long")


def cat_brand(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    t = regression(p, ["p_brand", "p_type", "p_size"], "p_retailprice", ["p_partkey"])
    return r2(spark, lambda: B.catboost(cat_features=["p_brand", "p_type"]), t)


def categories(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the nation as a category."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("n"), F.col("c_acctbal").alias("b"))
    t = regression(c, ["n"], "b", ["c_custkey"]).with_categories(["n"])
    m = B.xgboost(n_estimators=1, max_depth=1, learning_rate=1.0, reg_lambda=0.0).fit(t)
    return m.predict(c.select("n").distinct()).select("n", F.round("predicted", 4).alias("predicted"))


def pipeline_ols(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    m = C.Pipeline([StandardScaler(["l_quantity"])], L.LinearRegression).fit(t)
    return m.predict(t.df.select("l_quantity").distinct()).select("l_quantity", F.round("predicted", 3).alias("predicted"))


def frame(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("guess"), (F.col("c_custkey") % 3).cast("int").alias("real"))
    p = P.classification(c, ["c_custkey"], "guess").with_truth("classif", c, "real").with_truth("regress", c, "guess")
    return M.confusion(p.df)


def chain(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    m = C.RegressorChain(L.LinearRegression).fit(t.df, ["l_quantity"], ["l_extendedprice", "l_discount"], LINE_KEY)
    return m.predict(t.df.select("l_quantity").distinct()).select("l_quantity", F.round("predicted_l_extendedprice", 3).alias("price"), F.round("predicted_l_discount", 6).alias("discount"))


def class_chain(spark: SparkSession, d: str) -> DataFrame:
    t = flag_task(spark, d).df.withColumn("big", (F.col("l_quantity") > 25).cast("int"))
    m = C.ClassifierChain(L.GaussianNB).fit(t, ["l_extendedprice", "l_tax"], ["big", "y"], LINE_KEY)
    return m.predict(t).groupBy("predicted_big").agg(F.count("*").alias("n"))


def eliminated(spark: SparkSession, d: str) -> DataFrame:
    kept = C.RFE(lambda: L.Ridge(1.0), 2).select(price_task(spark, d))
    return spark.createDataFrame([(c,) for c in kept], "feature string")


def importance(spark: SparkSession, d: str) -> DataFrame:
    t = price_task(spark, d)
    return X.permutation_importance(L.LinearRegression().fit(t), t, M.regression, "rmse", maximize=False).select("feature", F.round("importance", 1).alias("importance"))


def shapley(spark: SparkSession, d: str) -> DataFrame:
    """Largest gap between a row's values with the base and its prediction."""
    t = customers(spark, d)
    m = L.LinearRegression().fit(t)
    phi = X.permutation_shap(m, t, t.df)
    total = sum((F.col(f"phi_{c}") for c in t.features), F.col("base"))
    return m.predict(t.df).join(phi, "c_custkey").agg(F.round(F.max(F.abs(total - F.col("predicted"))), 6).alias("gap"), F.count("*").alias("n"))


def effects(spark: SparkSession, d: str) -> DataFrame:
    t = customers(spark, d)
    e = T.CausalForest().estimate(t, "t").join(t.df.select(F.col("c_custkey").alias("id"), (F.col("b") > 4500).alias("rich")), "id")
    return e.groupBy("rich").agg(F.round(F.avg("estimated"), 0).alias("effect"))


def survival_forest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "value", (F.col("event_type") != "error").cast("int").alias("e"), (F.col("user_id") % 7).cast("double").alias("a"), F.log(F.col("value") + 5.0).alias("b"), F.hour("ts").cast("double").alias("h"))
    how = T.SurvivalForest(n_estimators=20, max_depth=5)
    m = how.fit(e, ["a", "b", "h"], "value", "e")
    return V.concordance(how.out_of_bag(m, e, "value", "e"), "time", "event", "mortality").select((F.col("c_index") > 0.8).alias("ordered"))


def pinball(spark: SparkSession, d: str) -> DataFrame:
    """Share of the prices below the forest's quantiles."""
    t = price_task(spark, d)
    m = T.QuantileForest(n_estimators=20, max_depth=8).fit(t)
    return m.predict_quantile(t.df, 0.1, 0.9).agg(*(F.round(F.avg((F.col("l_extendedprice") <= F.col(f"`q_{q}`")).cast("double")), 1).alias(f"below_{n}") for q, n in (("0.1", "low"), ("0.9", "high"))))


def gp(spark: SparkSession, d: str) -> DataFrame:
    t = place_task(spark, d)
    m = K.GaussianProcess(length_scale=0.5, alpha=1e-4).fit(t)
    return M.regression(m.predict_with_std(t.df), "v").select((F.col("r2") > 0.5).alias("good"))


def tuned(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    m = C.AutoTuner(lambda p: L.Ridge(p["alpha"]), U.grid({"alpha": [1.0, 1e6, 1e9]}), M.regression, "rmse", 3, maximize=False).fit(t)
    return spark.createDataFrame([(float(m.best_params["alpha"]),)], "alpha double")


def guided(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    best, _, tried = U.TPE({"alpha": U.Uniform(1.0, 1e9, log=True)}, n_iter=8).tune(t, lambda p: L.Ridge(p["alpha"]), M.regression, "rmse", maximize=False, k=3)
    return spark.createDataFrame([(len(tried), float(best["alpha"]) < 1e7)], "tried long, small boolean")


def bracketed(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    best, _, tried = U.Hyperband({"alpha": [1.0, 10.0, 1e9]}, max_folds=3).tune(t, lambda p: L.Ridge(p["alpha"]), M.regression, "rmse", maximize=False)
    return spark.createDataFrame([(float(best["alpha"]) < 1e9,)], "small boolean")


def online(make):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "events").select("event_id", "ts", F.col("value"), F.hour("ts").cast("double").alias("h"), (F.col("value") > 100).cast("int").alias("y"))
        t = classification(e, ["value", "h"], "y", ["ts", "event_id"])
        return M.accuracy(make().fit(t).predict(e), "y").select((F.col("accuracy") > 0.8).alias("good"))

    return run


def adasyn_rows(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("k", (F.col("vec_id") % 5 == 0).cast("int"))
    return A.adasyn(p, "vec_id", ["x", "y"], "k").groupBy("k").agg(F.count("*").alias("n"))


def near_smote(spark: SparkSession, d: str) -> DataFrame:
    p = place_task(spark, d).df.withColumn("k", (F.col("vec_id") % 5 == 0).cast("int"))
    return A.spatial_smote(p, "vec_id", ["z"], ["x", "y"], "k", 0.2).groupBy("k").agg(F.count("*").alias("n"))


def csv_regression(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "csv")
    table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "?").otherwise(F.col("c_nationkey").cast("string")).alias("n"), "c_acctbal").write.option("header", True).csv(path)
    df, _ = S.read_csv(spark, path)
    t = regression(S.number_target(df, "c_acctbal"), ["n"], "c_acctbal", ["c_custkey"])
    return t.df.groupBy(F.col("n").cast("long").alias("n")).agg(F.count("*").alias("rows"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


def parquet_regression(spark: SparkSession, d: str) -> DataFrame:
    df, numeric = S.read_parquet(spark, f"{d}/part.parquet")
    t = regression(S.number_target(df, "p_retailprice"), [c for c in ("p_size", "p_partkey") if numeric[c]], "p_retailprice", ["p_partkey"])
    return t.df.agg(F.count("*").alias("rows"), F.round(F.sum("p_size"), 2).alias("sizes"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


def subsets(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns of a task, its weights and names."""
    t = flag_task(spark, d).rows("l_quantity > 10").only(["l_tax"]).with_class_names(["A", "N", "R"]).with_weights("l_quantity")
    names = F.array(*(F.lit(n) for n in t.class_names))
    return t.df.groupBy(names[F.col(t.target)].alias("name")).agg(F.round(F.sum(t.weight), 2).alias("weight"), F.round(F.sum(t.features[0]), 4).alias("tax"))


def fold_rows(spark: SparkSession, d: str) -> DataFrame:
    """Folds in the frame: every row is in one, repeated keys too."""
    return with_folds(table(spark, d, "lineitem"), LINE_KEY, 5).groupBy("fold").agg(F.count("*").alias("n"))


QUERIES = {
    "tree_gini_stump": gini_stump,
    "tree_depth_two": tree_depth_two,
    "adaboost_stump": adaboost_stump,
    "boosting_two_stumps": two_stumps,
    "ordered_statistic": statistic,
    "categorical_split": categories,
    "early_stopping": stopped,
    "catboost_categories": cat_brand,
    "decision_tree_fit": lambda s, d: accuracy(s, lambda: T.DecisionTree(max_depth=6), quality(s, d)),
    "random_forest_fit": lambda s, d: accuracy(s, lambda: T.RandomForest(max_depth=8), quality(s, d), 2),
    "extra_trees_fit": lambda s, d: accuracy(s, lambda: T.ExtraTrees(max_depth=8), quality(s, d), 2),
    "oblique_forest_fit": lambda s, d: accuracy(s, lambda: T.ObliqueForest(n_estimators=20, max_depth=8), quality(s, d), 2),
    "oblique_tree_fit": lambda s, d: accuracy(s, lambda: T.ObliqueTree(max_depth=6), quality(s, d)),
    "quantile_forest_fit": pinball,
    "adaboost_fit": lambda s, d: accuracy(s, T.AdaBoost, quality(s, d)),
    "deep_forest_fit": lambda s, d: accuracy(s, lambda: C.DeepForest(forests=1, n_estimators=5, max_layers=1, folds=2), quality(s, d), 1),
    "ebm_fit": lambda s, d: accuracy(s, lambda: B.ebm(learning_rate=0.1, n_estimators=20), quality(s, d), 2),
    "quantile_gb_fit": lambda s, d: B.quantile_gb(0.9).fit(price_task(s, d)).predict(price_task(s, d).df).agg(F.round(F.avg((F.col("l_extendedprice") <= F.col("predicted")).cast("double")), 1).alias("below")),
    "goss_fit": boosted(B.lightgbm, n_estimators=30, top_rate=0.2, other_rate=0.1, subsample=0.8, colsample=0.75),
    "linear_svm_fit": lambda s, d: accuracy(s, K.LinearSVM, quality(s, d)),
    "kernel_svm_fit": lambda s, d: accuracy(s, K.KernelSVM, quality(s, d), 2),
    "elm_fit": lambda s, d: accuracy(s, K.ELM, quality(s, d), 2),
    "gaussian_process_fit": gp,
    "knn_learner": lambda s, d: r2(s, lambda: KNN(5), place_task(s, d)),
    "dynamic_ensemble": lambda s, d: accuracy(s, lambda: C.DynamicEnsemble([L.GaussianNB, T.AdaBoost]), quality(s, d), 2),
    "calibrated_platt": lambda s, d: M.logloss(C.Calibrated(L.GaussianNB).fit(quality(s, d)).predict(quality(s, d).df), "y").select(F.round("logloss", 3).alias("logloss")),
    "calibrated_isotonic": lambda s, d: M.logloss(C.Calibrated(L.GaussianNB, "isotonic").fit(quality(s, d)).predict(quality(s, d).df), "y").select(F.round("logloss", 3).alias("logloss")),
    "pipeline_ols": pipeline_ols,
    "prediction_frame": frame,
    "regressor_chain": chain,
    "classifier_chain": class_chain,
    "rfe": eliminated,
    "permutation_importance": importance,
    "shap_efficiency": shapley,
    "causal_forest": effects,
    "survival_forest": survival_forest,
    "auto_tuner": tuned,
    "tpe_search": guided,
    "hyperband_search": bracketed,
    "hoeffding_tree": online(O.hoeffding_tree),
    "adaptive_forest": online(lambda: O.adaptive_random_forest(4, rate=2.0)),
    "mondrian_forest": online(lambda: O.mondrian_forest(3, lifetime=0.5)),
    "geo_xgboost_fit": lambda s, d: r2(s, lambda: G.GeoXGBoost(["x", "y"], n_estimators=10, max_depth=3), place_task(s, d), 1),
    "kriging_hybrid_fit": lambda s, d: r2(s, lambda: G.KrigingHybrid(L.LinearRegression, ["x", "y"]), place_task(s, d)),
    "adasyn_rows": adasyn_rows,
    "spatial_smote": near_smote,
    "csv_regression": csv_regression,
    "parquet_regression": parquet_regression,
    "task_subsets": subsets,
    "fold_rows": fold_rows,
}

_y = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
_stump = f"""WITH g AS (SELECT l_quantity AS x, count(*) FILTER ({_y} = 0) AS a, count(*) FILTER ({_y} = 1) AS b, count(*) FILTER ({_y} = 2) AS c, count(*) AS n FROM lineitem GROUP BY 1),
 t AS (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(n) AS n FROM g), l AS (SELECT x, sum(a) OVER (ORDER BY x)::DOUBLE AS a, sum(b) OVER (ORDER BY x)::DOUBLE AS b, sum(c) OVER (ORDER BY x)::DOUBLE AS c, sum(n) OVER (ORDER BY x)::DOUBLE AS n, lead(x) OVER (ORDER BY x) AS nx FROM g),
 s AS (SELECT l.x, (l.a * l.a + l.b * l.b + l.c * l.c) / l.n + ((t.a - l.a) * (t.a - l.a) + (t.b - l.b) * (t.b - l.b) + (t.c - l.c) * (t.c - l.c)) / (t.n - l.n) AS score FROM l, t WHERE nx IS NOT NULL), k AS (SELECT x FROM s ORDER BY score DESC, x LIMIT 1),
 p AS (SELECT g.x <= k.x AS low, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(n) AS n FROM g, k GROUP BY 1),
 r AS (SELECT g.x AS l_quantity, CASE WHEN p.c >= p.a AND p.c >= p.b THEN 2 WHEN p.b >= p.a THEN 1 ELSE 0 END::INT AS predicted, round(p.a / p.n::DOUBLE, 6) AS p0 FROM g, k, p WHERE p.low = (g.x <= k.x))"""
_near_t = "b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts), s AS (SELECT vec_id, (x - x0) / greatest(x1 - x0, 1e-10) AS u, (y - y0) / greatest(y1 - y0, 1e-10) AS v, (x * 2.0::DOUBLE - x0 * 2.0::DOUBLE) / greatest(x1 * 2.0::DOUBLE - x0 * 2.0::DOUBLE, 1e-10) AS t FROM pts, b)"
_nation = "SELECT c_nationkey AS n, sum(c_acctbal) AS s, count(*) AS c FROM customer GROUP BY 1"
ORACLES = {
    # Values and base sum to the prediction.
    "shap_efficiency": "SELECT 0.0::DOUBLE AS gap, count(*) AS n FROM customer",
    "tree_gini_stump": _stump + " SELECT l_quantity, predicted, p0 FROM r",
    "adaboost_stump": _stump + " SELECT l_quantity, predicted FROM r",
    "tree_depth_two": """WITH g AS (SELECT l_quantity AS x, sum(l_extendedprice) AS s, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), a AS (SELECT x, sum(s) OVER (ORDER BY x) AS ls, sum(n) OVER (ORDER BY x) AS ln, sum(s) OVER () AS ts, sum(n) OVER () AS tn, lead(x) OVER (ORDER BY x) AS nx FROM g),
 k AS (SELECT x FROM a WHERE nx IS NOT NULL ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC, x LIMIT 1), h AS (SELECT g.x, g.s, g.n, g.x <= k.x AS low FROM g, k),
 b AS (SELECT x, low, sum(s) OVER (PARTITION BY low ORDER BY x) AS ls, sum(n) OVER (PARTITION BY low ORDER BY x) AS ln, sum(s) OVER (PARTITION BY low) AS ts, sum(n) OVER (PARTITION BY low) AS tn, lead(x) OVER (PARTITION BY low ORDER BY x) AS nx FROM h),
 c AS (SELECT low, x AS cut FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC, x) AS r FROM b WHERE nx IS NOT NULL) WHERE r = 1),
 l AS (SELECT h.x, h.s, h.n, h.low, coalesce(h.x <= c.cut, true) AS side FROM h LEFT JOIN c USING (low)) SELECT x AS l_quantity, round(sum(s) OVER (PARTITION BY low, side) / sum(n) OVER (PARTITION BY low, side), 3) AS predicted FROM l""",
    "boosting_two_stumps": """WITH g AS (SELECT l_quantity AS x, sum(l_extendedprice) AS s, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), f AS (SELECT x, s, n, sum(s) OVER () / sum(n) OVER () AS f0 FROM g),
 a AS (SELECT x, sum(n * f0 - s) OVER (ORDER BY x) AS lg, sum(n) OVER (ORDER BY x) AS lh, sum(n * f0 - s) OVER () AS tg, sum(n) OVER () AS th, lead(x) OVER (ORDER BY x) AS nx FROM f), k AS (SELECT x AS cut FROM a WHERE nx IS NOT NULL ORDER BY lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) DESC, x LIMIT 1),
 w AS (SELECT x <= cut AS low, -sum(n * f0 - s) / (sum(n) + 1) * 0.3::DOUBLE AS w FROM f, k GROUP BY 1), f1 AS (SELECT x, s, n, f0 + w AS f1 FROM f, k, w WHERE low = (x <= cut)),
 b AS (SELECT x, sum(n * f1 - s) OVER (ORDER BY x) AS lg, sum(n) OVER (ORDER BY x) AS lh, sum(n * f1 - s) OVER () AS tg, sum(n) OVER () AS th, lead(x) OVER (ORDER BY x) AS nx FROM f1), k2 AS (SELECT x AS cut FROM b WHERE nx IS NOT NULL ORDER BY lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) DESC, x LIMIT 1),
 w2 AS (SELECT x <= cut AS low, -sum(n * f1 - s) / (sum(n) + 1) * 0.3::DOUBLE AS w FROM f1, k2 GROUP BY 1) SELECT x AS l_quantity, round(f1 + w, 3) AS predicted FROM f1, k2, w2 WHERE low = (x <= cut)""",
    "ordered_statistic": "WITH p AS (SELECT p_partkey, p_brand, p_retailprice AS y, substr(md5('42-' || p_partkey::VARCHAR), 1, 15) AS o, avg(p_retailprice) OVER () AS prior FROM part) SELECT p_partkey, round((coalesce(sum(y) OVER w, 0) + prior) / (count(*) OVER w + 1), 6) AS ts FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    # Categories in the order of their mean: that of g / h falls as the mean rises.
    "categorical_split": f"""WITH g AS ({_nation}), o AS (SELECT n, s, c, sum(s) OVER w AS ls, sum(c) OVER w AS lc, sum(s) OVER () AS ts, sum(c) OVER () AS tc, row_number() OVER w AS r, count(*) OVER () AS m FROM g WINDOW w AS (ORDER BY s / c DESC, n)),
 k AS (SELECT r FROM o WHERE r < m ORDER BY ls * ls / lc + (ts - ls) * (ts - ls) / (tc - lc) DESC, r LIMIT 1) SELECT n::INT AS n, round(sum(s) OVER (PARTITION BY o.r <= k.r) / sum(c) OVER (PARTITION BY o.r <= k.r), 4) AS predicted FROM o, k""",
    "pipeline_ols": "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS w, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) SELECT DISTINCT l_quantity, round(b + w * l_quantity, 3) AS predicted FROM lineitem, m",
    "prediction_frame": "SELECT (c_custkey % 3)::INT AS truth, (c_nationkey % 3)::INT AS predicted, count(*) AS n FROM customer GROUP BY 1, 2",
    "regressor_chain": """WITH m AS (SELECT avg(l_quantity) AS q, avg(l_extendedprice) AS p, avg(l_discount) AS d, var_pop(l_quantity) AS qq, var_pop(l_extendedprice) AS pp, covar_pop(l_quantity, l_extendedprice) AS qp, covar_pop(l_quantity, l_discount) AS qd, covar_pop(l_extendedprice, l_discount) AS pd FROM lineitem),
 w AS (SELECT *, (pp * qd - qp * pd) / (qq * pp - qp * qp) AS a, (qq * pd - qp * qd) / (qq * pp - qp * qp) AS b FROM m) SELECT DISTINCT l_quantity, round(p + qp / qq * (l_quantity - q), 3) AS price, round(d + a * (l_quantity - q) + b * (qp / qq * (l_quantity - q)), 6) AS discount FROM lineitem, w""",
    "adasyn_rows": f"WITH c AS ({more.ORACLES['adasyn_counts']}), p AS (SELECT (vec_id % 5 = 0)::INT AS k FROM embeddings) SELECT k, (count(*) + CASE WHEN k = 1 THEN (SELECT sum(samples) FROM c) ELSE 0 END)::BIGINT AS n FROM p GROUP BY 1",
    "csv_regression": "SELECT CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey END::BIGINT AS n, count(*) AS rows, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1",
    "parquet_regression": "SELECT count(*) AS rows, round(sum(p_size::DOUBLE), 2) AS sizes, round(avg(p_retailprice), 4) AS mean FROM part",
    "task_subsets": "SELECT l_returnflag AS name, round(sum(l_quantity), 2) AS weight, round(sum(l_tax), 4) AS tax FROM lineitem WHERE l_quantity > 10 GROUP BY 1",
    "fold_rows": "WITH n AS (SELECT count(*) AS n FROM lineitem) SELECT k::INT AS fold, CASE WHEN k < 4 THEN n // 5 ELSE n - 4 * (n // 5) END::BIGINT AS n FROM n, range(5) AS k(k)",
    "filter_relief": f"""WITH {POINTS}, {_near_t}, n AS (SELECT a.vec_id AS q, b.vec_id AS i, (a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v) AS d2, abs(a.u - b.u) AS du, abs(a.v - b.v) AS dv, abs(a.t - b.t) AS dy, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v), b.vec_id) AS r FROM s a JOIN s b ON a.vec_id <> b.vec_id),
 f AS (SELECT *, max(d2) OVER (PARTITION BY q) AS s2 FROM n WHERE r <= 10), w AS (SELECT *, CASE WHEN s2 > 0 THEN exp(-d2 / s2) ELSE 1.0::DOUBLE END AS w FROM f), z AS (SELECT *, w / sum(w) OVER (PARTITION BY q) AS w1 FROM w),
 g AS (SELECT (SELECT count(*) FROM pts)::DOUBLE AS n, sum(w1 * dy) AS c, sum(w1 * du) AS au, sum(w1 * dv) AS av, sum(w1 * dy * du) AS bu, sum(w1 * dy * dv) AS bv FROM z)
 SELECT 'x' AS feature, round(bu / c - (au - bu) / (n - c), 6) AS score FROM g UNION ALL SELECT 'y', round(bv / c - (av - bv) / (n - c), 6) FROM g""",
    "cumulative_ranking": "WITH " + ", ".join(f"{k} AS (SELECT feature, row_number() OVER (ORDER BY score DESC, list_position({preparation.LINE}, feature)) AS r FROM ({preparation.ORACLES[q]}))" for k, q in (("a", "filter_variance"), ("b", "filter_infogain"), ("c", "filter_anova"))) + f", t AS (SELECT feature, (a.r + b.r + c.r)::BIGINT AS rank_sum FROM a JOIN b USING (feature) JOIN c USING (feature)) SELECT feature, rank_sum, row_number() OVER (ORDER BY rank_sum, list_position({preparation.LINE}, feature)) AS place FROM t",
}
