"""Boosting, decisions and benchmarks over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import measures as M
from sparkloom.learners import boosting as B
from sparkloom.learners import closed as L
from sparkloom.learners import wrappers as W
from sparkloom.plans.learning import flag_task, lines
from sparkloom.plans.measures import rounded
from sparkloom.plans.preparation import table
from sparkloom.task import Task, regression


def price_task(spark: SparkSession, d: str) -> Task:
    li = table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return regression(li.select(*keys, "l_quantity", "l_discount", "l_tax", F.dayofyear("l_shipdate").cast("double").alias("day"), "l_extendedprice"), ["l_quantity", "l_discount", "l_tax", "day"], "l_extendedprice", keys)


def boosted(make, **options):
    """R2 of a boosted model, at the learner's defaults, on its own rows."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        t = price_task(spark, d)
        m = make(**options).fit(t)
        # Keys needn't go through Python.
        return M.regression(m.predict(t.df.select(*t.features, t.target)), t.target).select(F.round("r2", 3).alias("r2"))

    return run


def root_split(spark: SparkSession, d: str) -> DataFrame:
    """The first cut by squared error of price on quantity: every distinct value is a bin."""
    t = lines(spark, d)
    m = B.Booster(n_estimators=1, learning_rate=1.0, max_depth=1, reg_lambda=0.0).fit(t)
    tree = m.trees[0][1]
    left, right = tree.value[tree.left[0]] + m.start[0], tree.value[tree.right[0]] + m.start[0]
    return spark.createDataFrame([(float(m.cuts[0][tree.bin[0] - 1]), round(float(left), 4), round(float(right), 4))], "cut double, left_mean double, right_mean double")


def costs(spark: SparkSession, d: str) -> DataFrame:
    t = flag_task(spark, d).df.withColumn("probabilities", F.array(F.col("l_quantity") / 100.0, F.col("l_discount") * 4.0, 1.0 - F.col("l_quantity") / 100.0 - F.col("l_discount") * 4.0))
    return W.decide(t, [[0.0, 1.0, 5.0], [2.0, 0.0, 1.0], [1.0, 4.0, 0.0]]).groupBy("y", "predicted").agg(F.count("*").alias("n"))


def sweep(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("event_type") == "error").cast("int").alias("y"), F.floor("value").cast("double").alias("s"))
    return rounded(W.threshold_sweep(e, "y", "s"), "threshold")


def target_log(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    m = W.TargetTransform(L.LinearRegression, "log").fit(t)
    return m.predict(t.df).groupBy("l_quantity").agg(F.round(F.avg("predicted"), 3).alias("predicted"))


def table_of_scores(spark: SparkSession, d: str) -> DataFrame:
    s = W.benchmark({"price": lines(spark, d)}, {"ols": L.LinearRegression, "ridge": lambda: L.Ridge(1000.0)}, M.regression, 3)
    return s.select("task", "learner", "fold", F.round("rmse", 3).alias("rmse"))


def stacked(spark: SparkSession, d: str) -> DataFrame:
    t = price_task(spark, d)
    m = W.Stacking([L.LinearRegression, lambda: L.Ridge(1e6)], L.LinearRegression, 3).fit(t)
    return M.regression(m.predict(t.df), t.target).select(F.round("r2", 3).alias("r2"))


def bagged(spark: SparkSession, d: str) -> DataFrame:
    t = price_task(spark, d)
    m = W.Bagging(L.LinearRegression, 3).fit(t)
    return M.regression(m.predict(t.df), t.target).select(F.round("r2", 3).alias("r2"))


QUERIES = {
    "xgboost_fit": boosted(B.xgboost),
    "lightgbm_fit": boosted(B.lightgbm),
    "catboost_fit": boosted(B.catboost),
    "gradient_boosting_fit": boosted(B.gradient_boosting),
    "gbt_root_split": root_split,
    "cost_sensitive": costs,
    "threshold_sweep": sweep,
    "target_log": target_log,
    "benchmark_table": table_of_scores,
    "stacking_fit": stacked,
    "bagging_fit": bagged,
}

_folds = "f AS (SELECT l_quantity AS x, l_extendedprice AS y, least((row_number() OVER (ORDER BY md5(concat_ws('-', '42', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR)), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) - 1) // ((SELECT count(*) FROM lineitem) // 3), 2)::INT AS fold FROM lineitem), s AS (SELECT k, covar_pop(x, y) AS c, var_pop(x) AS v, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM f, range(3) AS k(k) WHERE fold <> k GROUP BY 1), w AS (SELECT k, 'ols' AS learner, c / v AS w, mx, my FROM s UNION ALL SELECT k, 'ridge', c * n / (v * n + 1000), mx, my FROM s)"
ORACLES = {
    "gbt_root_split": "WITH g AS (SELECT l_quantity AS x, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(s) OVER (ORDER BY x) AS ls, sum(n) OVER (ORDER BY x) AS ln, (SELECT sum(s) FROM g) AS ts, (SELECT sum(n) FROM g) AS tn FROM g), r AS (SELECT *, ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) AS gain FROM c WHERE nx IS NOT NULL) SELECT (x + nx) / 2 AS cut, round(ls / ln, 4) AS left_mean, round((ts - ls) / (tn - ln), 4) AS right_mean FROM r ORDER BY gain DESC, x LIMIT 1",
    "cost_sensitive": "WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, l_quantity / 100.0::DOUBLE AS a, l_discount * 4.0::DOUBLE AS b, 1.0::DOUBLE - l_quantity / 100.0::DOUBLE - l_discount * 4.0::DOUBLE AS c FROM lineitem), e AS (SELECT y, [a * 0.0::DOUBLE + b * 2.0::DOUBLE + c * 1.0::DOUBLE, a * 1.0::DOUBLE + b * 0.0::DOUBLE + c * 4.0::DOUBLE, a * 5.0::DOUBLE + b * 1.0::DOUBLE + c * 0.0::DOUBLE] AS e FROM p) SELECT y, (list_position(e, list_min(e)) - 1)::INT AS predicted, count(*) AS n FROM e GROUP BY 1, 2",
    "threshold_sweep": "WITH g AS (SELECT floor(value) AS threshold, count(*) FILTER (event_type = 'error') AS pos, count(*) AS n FROM events GROUP BY 1), c AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS p, sum(n) OVER (ORDER BY threshold DESC) AS n, (SELECT sum(pos) FROM g) AS a FROM g) SELECT threshold, round(2.0::DOUBLE * p / (n + a), 6) AS f1 FROM c",
    "target_log": "WITH m AS (SELECT regr_slope(ln(l_extendedprice), l_quantity) AS w, regr_intercept(ln(l_extendedprice), l_quantity) AS b FROM lineitem) SELECT DISTINCT l_quantity, round(exp(b + w * l_quantity), 3) AS predicted FROM lineitem, m",
    "benchmark_table": f"WITH {_folds} SELECT 'price' AS task, learner, fold, round(sqrt(avg((y - (my + w * (x - mx))) * (y - (my + w * (x - mx))))), 3) AS rmse FROM f JOIN w ON k = fold GROUP BY 1, 2, 3",
}
