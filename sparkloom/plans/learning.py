"""Learners, neighbours, clusters and effects over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import measures as M
from sparkloom.learners import closed as L
from sparkloom.operators import causal as C
from sparkloom.operators import neighbours as N
from sparkloom.plans.measures import rounded
from sparkloom.plans.preparation import POINTS, points, table
from sparkloom.task import Task, classification, regression

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def flag_task(spark: SparkSession, d: str) -> Task:
    li = table(spark, d, "lineitem")
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return classification(li.select(*LINE_KEY, *FEATURES, y.alias("y")), FEATURES, "y", LINE_KEY)


def nb_cv(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy in each of five folds of naive Bayes for the return flag; sums are of whole cents and hundredths."""
    t = flag_task(spark, d)
    whole = t.df.withColumns({"l_extendedprice": F.round(F.col("l_extendedprice") * 100), "l_discount": F.round(F.col("l_discount") * 100), "l_tax": F.round(F.col("l_tax") * 100)})
    return rounded(M.accuracy(L.nb_cross_validation(t.on(whole), 5), "y", "predicted", ["fold"]), "fold")


def nb_sql() -> str:
    cols = ["a", "b", "c", "d"]
    stats = ", ".join(f"sum({c})::DOUBLE / sum(n) AS m{c}, greatest(sum(q{c})::DOUBLE / sum(n) - (sum({c})::DOUBLE / sum(n)) * (sum({c})::DOUBLE / sum(n)), 1e-9) AS v{c}" for c in cols)
    return f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, l_quantity::BIGINT AS a, round(l_extendedprice * 100)::BIGINT AS b, round(l_discount * 100)::BIGINT AS c, round(l_tax * 100)::BIGINT AS d FROM lineitem),
 f AS (SELECT *, row_number() OVER () AS rn, least((row_number() OVER (ORDER BY md5(concat_ws('-', '42', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR)), l_orderkey, l_linenumber, l_partkey, l_suppkey, a, b, c, d, y) - 1) // ((SELECT count(*) FROM x) // 5), 4)::INT AS fold FROM x),
 g AS (SELECT fold, y, count(*) AS n, {', '.join(f'sum({c}) AS {c}, sum({c} * {c}) AS q{c}' for c in cols)} FROM f GROUP BY 1, 2),
 s AS (SELECT k.k AS fold, y, sum(n) AS n, {stats} FROM g, range(5) AS k(k) WHERE g.fold <> k.k GROUP BY 1, 2), p AS (SELECT *, ln(n::DOUBLE / sum(n) OVER (PARTITION BY fold)) AS prior FROM s),
 r AS (SELECT f.fold, f.y AS truth, p.y, prior {''.join(f"- 0.5::DOUBLE * ((f.{c} - m{c}) * (f.{c} - m{c}) / v{c} + ln(v{c}) + ln(2 * pi()))" for c in cols)} AS score, f.rn FROM f JOIN p USING (fold)),
 w AS (SELECT fold, truth, arg_max(y, score) AS y FROM r GROUP BY fold, truth, rn) SELECT fold, round(avg((truth = y)::INT::DOUBLE), 6) AS accuracy FROM w GROUP BY 1"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("vec_id % 20 = 0")


def lines(spark: SparkSession, d: str) -> Task:
    return regression(table(spark, d, "lineitem").select(*LINE_KEY, "l_quantity", "l_extendedprice", "l_discount", (F.col("l_orderkey") % 2).cast("int").alias("t")), ["l_quantity"], "l_extendedprice", LINE_KEY)


def coefficients(model: L.LinearModel, spark: SparkSession, digits: int = 4) -> DataFrame:
    return spark.createDataFrame([("bias", round(model.bias, digits)), *((c, round(float(w), digits)) for c, w in zip(model.cols, model.weights, strict=True))], "feature string, weight double")


def t_learner(spark: SparkSession, d: str) -> DataFrame:
    out = C.t_learner(lines(spark, d), "t", L.LinearRegression)
    return out.groupBy("l_quantity").agg(F.round(F.avg("estimated"), 3).alias("estimated"))


def s_learner(spark: SparkSession, d: str) -> DataFrame:
    out = C.s_learner(lines(spark, d), "t", L.LinearRegression)
    return out.agg(F.round(F.avg("estimated"), 3).alias("ate"))


def dr_pseudo(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 2).cast("double").alias("t"), (F.col("c_acctbal") * 0.5).alias("m0"), (F.col("c_acctbal") * 0.75 + 1.0).alias("m1"), ((F.col("c_custkey") % 10) / 10.0).alias("e"))
    return rounded(C.dr_pseudo_outcome(c, "c_acctbal", "t", "m0", "m1", "e").select("c_custkey", "pseudo"), "c_custkey")


def effect_curve(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = lines(spark, d)
        ols, logit = L.LinearRegression, L.LogisticRegression
        if name == "dr":
            out = C.dr_learner(t, "t", ols, logit, ols)
        elif name == "x":
            out = C.x_learner(t, "t", ols, ols, logit)
        else:
            out = C.r_learner(t, "t", ols, ols, ols)
        return out.groupBy("l_quantity").agg(F.round(F.avg("estimated"), 2).alias("estimated"))

    return run


def clusters(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return N.dbscan(p, "vec_id", "x", "y", 0.015, 4)


QUERIES = {
    "nb_cv": nb_cv,
    "ols_fit": lambda s, d: coefficients(L.LinearRegression().fit(lines(s, d)), s),
    "ridge_fit": lambda s, d: coefficients(L.Ridge(1000.0).fit(lines(s, d)), s),
    "lasso_fit": lambda s, d: coefficients(L.Lasso(500.0).fit(lines(s, d)), s),
    "elastic_net_fit": lambda s, d: coefficients(L.ElasticNet(100.0, 0.5).fit(lines(s, d)), s),
    "logistic_fit": lambda s, d: rounded(M.logloss(L.LogisticRegression().fit(flag_task(s, d)).predict(flag_task(s, d).df), "y")),
    "knn_classif": lambda s, d: N.knn_classify(asked(s, d), vectors(s, d), "vec_id", "embedding", "label", 10, 5).select(F.col("query").alias("vec_id"), "predicted"),
    "knn_regress": lambda s, d: rounded(N.knn_regress(asked(s, d), vectors(s, d).withColumn("y", (F.col("vec_id") % 17).cast("double")), "vec_id", "embedding", "y", 5), "query"),
    "dbscan": clusters,
    "silhouette": lambda s, d: rounded(N.silhouette(points(s, d).join(vectors(s, d).select("vec_id", "label"), "vec_id"), "vec_id", ["x", "y"], "label")),
    "kmeans_step": lambda s, d: rounded(N.kmeans_step(points(s, d), ["x", "y"], [[-0.1, -0.1], [0.1, 0.1], [0.1, -0.1]]), "cluster", "n"),
    "kmeans": lambda s, d: N.kmeans(points(s, d), ["x", "y"], 4)[1].groupBy("label").agg(F.count("*").alias("n")),
    "t_learner": t_learner,
    "s_learner": s_learner,
    "dr_pseudo_outcome": dr_pseudo,
    "dr_learner": effect_curve("dr"),
    "x_learner": effect_curve("x"),
    "r_learner": effect_curve("r"),
}

_near = "q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), n AS (SELECT q, vec_id, label, row_number() OVER (PARTITION BY q ORDER BY list_sum(list_transform(range(1, 65), lambda i: (e[i]::DOUBLE - embedding[i]::DOUBLE) * (e[i]::DOUBLE - embedding[i]::DOUBLE))), vec_id) AS r FROM q JOIN embeddings ON q <> vec_id)"
ORACLES = {
    "nb_cv": nb_sql(),
    "ols_fit": "SELECT 'bias' AS feature, round(regr_intercept(l_extendedprice, l_quantity), 4) AS weight FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem",
    "ridge_fit": "WITH m AS (SELECT covar_pop(l_quantity, l_extendedprice) * count(*) / (var_pop(l_quantity) * count(*) + 1000) AS w, avg(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem) SELECT 'bias' AS feature, round(y - w * x, 4) AS weight FROM m UNION ALL SELECT 'l_quantity', round(w, 4) FROM m",
    "lasso_fit": "WITH m AS (SELECT sign(covar_pop(l_quantity, l_extendedprice)) * greatest(abs(covar_pop(l_quantity, l_extendedprice)) - 500, 0) / var_pop(l_quantity) AS w, avg(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem) SELECT 'bias' AS feature, round(y - w * x, 4) AS weight FROM m UNION ALL SELECT 'l_quantity', round(w, 4) FROM m",
    "elastic_net_fit": "WITH m AS (SELECT sign(covar_pop(l_quantity, l_extendedprice)) * greatest(abs(covar_pop(l_quantity, l_extendedprice)) - 50, 0) / (var_pop(l_quantity) + 50) AS w, avg(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem) SELECT 'bias' AS feature, round(y - w * x, 4) AS weight FROM m UNION ALL SELECT 'l_quantity', round(w, 4) FROM m",
    "knn_classif": f"WITH {_near}, v AS (SELECT q, label, count(*) AS c FROM n WHERE r <= 5 GROUP BY 1, 2) SELECT q AS vec_id, arg_max(label, c * 100 + label)::INT AS predicted FROM v GROUP BY 1",
    "knn_regress": f"WITH {_near} SELECT q AS query, round(avg((vec_id % 17)::DOUBLE), 6) AS predicted FROM n WHERE r <= 5 GROUP BY 1",
    "dbscan": f"WITH RECURSIVE {POINTS}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM pts a JOIN pts b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.015::DOUBLE), c AS (SELECT a FROM p GROUP BY 1 HAVING count(*) >= 4), e AS (SELECT a, b FROM p WHERE a IN (SELECT a FROM c) AND b IN (SELECT a FROM c)), r AS (SELECT a AS n, a AS l FROM c UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.n), m AS (SELECT n, min(l) AS l FROM r GROUP BY 1), k AS (SELECT n, dense_rank() OVER (ORDER BY l) - 1 AS k FROM m), o AS (SELECT p.a AS n, min(k) AS k FROM p JOIN k ON k.n = p.b GROUP BY 1) SELECT vec_id AS id, coalesce(k.k, o.k, -1)::INT AS label FROM pts LEFT JOIN k ON k.n = vec_id LEFT JOIN o ON o.n = vec_id",
    "silhouette": f"WITH {POINTS}, v AS (SELECT vec_id, x, y, label FROM pts JOIN embeddings USING (vec_id)), s AS (SELECT a.vec_id, a.label AS l, b.label AS m, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS t, count(*) AS c FROM v a JOIN v b ON true GROUP BY 1, 2, 3), w AS (SELECT vec_id, max(t / greatest(c - 1, 1)) FILTER (l = m) AS o, min(t / c) FILTER (l <> m) AS n, max(c) FILTER (l = m) AS c FROM s GROUP BY 1) SELECT round(avg(CASE WHEN c = 1 THEN 0 ELSE (n - o) / greatest(n, o) END), 6) AS silhouette FROM w",
    "kmeans_step": f"WITH {POINTS}, d AS (SELECT x, y, [(x + 0.1::DOUBLE) * (x + 0.1::DOUBLE) + (y + 0.1::DOUBLE) * (y + 0.1::DOUBLE), (x - 0.1::DOUBLE) * (x - 0.1::DOUBLE) + (y - 0.1::DOUBLE) * (y - 0.1::DOUBLE), (x - 0.1::DOUBLE) * (x - 0.1::DOUBLE) + (y + 0.1::DOUBLE) * (y + 0.1::DOUBLE)] AS d FROM pts) SELECT (list_position(d, list_min(d)) - 1)::INT AS cluster, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM d GROUP BY 1",
    "t_learner": "WITH m AS (SELECT l_orderkey % 2 AS t, regr_slope(l_extendedprice, l_quantity) AS w, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY 1) SELECT DISTINCT l_quantity, round((SELECT b + w * l_quantity FROM m WHERE t = 1) - (SELECT b + w * l_quantity FROM m WHERE t = 0), 3) AS estimated FROM lineitem",
    "s_learner": "WITH x AS (SELECT l_extendedprice AS y, l_quantity AS q, (l_orderkey % 2)::DOUBLE AS t FROM lineitem), c AS (SELECT var_pop(q) AS qq, var_pop(t) AS tt, covar_pop(q, t) AS qt, covar_pop(q, y) AS qy, covar_pop(t, y) AS ty FROM x) SELECT round((qq * ty - qt * qy) / (qq * tt - qt * qt), 3) AS ate FROM c",
    "dr_pseudo_outcome": "WITH c AS (SELECT c_custkey, c_acctbal AS y, (c_custkey % 2)::DOUBLE AS t, c_acctbal * 0.5::DOUBLE AS m0, c_acctbal * 0.75::DOUBLE + 1 AS m1, least(greatest((c_custkey % 10) / 10.0::DOUBLE, 0.001::DOUBLE), 0.999::DOUBLE) AS e FROM customer) SELECT c_custkey, round(m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e), 6) + 0.0::DOUBLE AS pseudo FROM c",
}
