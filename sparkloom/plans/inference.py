"""Tests, conformal sets and survival curves over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import conformal as C
from sparkloom.operators import stats as S
from sparkloom.operators import survival as V
from sparkloom.plans.measures import rounded
from sparkloom.plans.preparation import table


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean price by priority and week, as if priorities were models and weeks folds; only weeks with all five."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), F.date_trunc("week", "o_orderdate").cast("date").alias("fold"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    g = o.groupBy("fold", "model").agg((F.sum("c").cast("double") / F.count("*")).alias("score"))
    full = g.groupBy("fold").count().where("count = 5").select("fold")
    return g.join(full, "fold")


SCORES = "g AS (SELECT date_trunc('week', o_orderdate)::DATE AS fold, o_orderpriority AS model, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) AS score FROM orders GROUP BY 1, 2), s AS (SELECT * FROM g WHERE fold IN (SELECT fold FROM g GROUP BY 1 HAVING count(*) = 5)), r AS (SELECT fold, model, rank() OVER (PARTITION BY fold ORDER BY score DESC) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0::DOUBLE AS rank FROM s), m AS (SELECT model, avg(rank) AS mean_rank, count(*) AS n FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM r GROUP BY fold, rank)), f AS (SELECT max(n) AS n, count(*) AS k, 12.0::DOUBLE * max(n) / (count(*) * (count(*) + 1)) * (sum(mean_rank * mean_rank) - count(*) * (count(*) + 1) * (count(*) + 1) / 4.0::DOUBLE) AS raw FROM m)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_quantity") * 2).alias("a"), F.floor(F.col("l_extendedprice") / 1000.0).cast("double").alias("b"))


def right_wrong(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("a"), (F.col("l_discount") > 0.05).cast("int").alias("b"), (F.col("l_tax") > 0.04).cast("int").alias("t"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("y"), (F.col("p_size") * 20.0 + 700.0).alias("p"))


def classes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a = (F.col("l_quantity") / 100.0).alias("p0")
    t = F.when(F.col("l_returnflag") == "A", 0).otherwise(1)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", t.alias("truth"), a, F.array(F.col("l_quantity") / 100.0, 1.0 - F.col("l_quantity") / 100.0).alias("probabilities"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("value").alias("t"), (F.col("event_type") != "error").alias("e"), (F.col("user_id") % 2).cast("int").alias("g"), (F.col("user_id") % 11).cast("double").alias("risk"))


EVENTS = "v AS (SELECT event_id, value AS t, (event_type <> 'error')::INT AS e, (user_id % 2)::INT AS g, (user_id % 11)::DOUBLE AS risk FROM events)"


def curve(spark: SparkSession, d: str) -> DataFrame:
    return V.nelson_aalen(events(spark, d), "t", "e")


def lookup(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3.7).alias("at"))
    return rounded(V.survival_at(curve(spark, d), q, "at"), "s_suppkey")


QUERIES = {
    "wilcoxon_w": lambda s, d: S.signed_ranks(pairs(s, d), "a", "b"),
    "sign_counts": lambda s, d: S.sign_counts(pairs(s, d), "a", "b"),
    "friedman": lambda s, d: rounded(S.friedman(scores(s, d), "fold", "model", "score"), "model", "n", "k"),
    "nemenyi": lambda s, d: rounded(S.nemenyi(S.friedman(scores(s, d), "fold", "model", "score"), "model"), "model_a", "model_b", "differs"),
    "mcnemar": lambda s, d: rounded(S.mcnemar(right_wrong(s, d), "a", "b", "t"), "b", "c"),
    "conformal_split": lambda s, d: rounded(C.split_intervals(prices(s, d).where("p_partkey % 2 = 0"), prices(s, d), "p", "y"), "p_partkey"),
    "conformal_coverage": lambda s, d: rounded(C.coverage(C.split_intervals(prices(s, d).where("p_partkey % 2 = 0"), prices(s, d), "p", "y"), "y")),
    "conformal_class": lambda s, d: C.label_sets(classes(s, d).where("l_orderkey % 2 = 0"), classes(s, d), "probabilities", "truth", 0.2).groupBy("truth", F.concat_ws(",", F.transform("label_set", lambda i: i.cast("string"))).alias("label_set")).agg(F.count("*").alias("n")),
    "cqr": lambda s, d: rounded(C.cqr(prices(s, d).withColumns({"lo": F.col("p") - 100, "hi": F.col("p") + 100}).where("p_partkey % 2 = 0"), prices(s, d).withColumns({"lo": F.col("p") - 100, "hi": F.col("p") + 100}), "lo", "hi", "y"), "p_partkey"),
    "nelson_aalen": lambda s, d: rounded(curve(s, d), "d", "at_risk"),
    "survival_at": lookup,
    "logrank": lambda s, d: rounded(V.log_rank(events(s, d), "t", "e", "g"), "observed"),
    "cindex": lambda s, d: rounded(V.concordance(events(s, d), "t", "e", "risk")),
    "cox_fit": lambda s, d: s.createDataFrame([(c, round(float(b), 6)) for c, b in zip(["x1", "x2"], V.Cox(["x1", "x2"]).fit(events(s, d).select("t", "e", F.col("g").cast("double").alias("x1"), (F.col("risk") / 11.0).alias("x2")), "t", "e").coefficients, strict=True)], "feature string, coefficient double"),
}

_split = "WITH p AS (SELECT p_partkey, p_retailprice AS y, p_size * 20.0::DOUBLE + 700.0::DOUBLE AS p FROM part), c AS (SELECT abs(y - p) AS s FROM p WHERE p_partkey % 2 = 0), k AS (SELECT s, row_number() OVER (ORDER BY s) AS r, ceil(round((count(*) OVER () + 1) * 0.9::DOUBLE, 9)) AS w FROM c), q AS (SELECT s AS q FROM k WHERE r = w)"
ORACLES = {
    "wilcoxon_w": "WITH d AS (SELECT l_quantity * 2 - floor(l_extendedprice / 1000.0::DOUBLE) AS d FROM lineitem), z AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE abs(d) > 1e-15), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM z GROUP BY abs(d))) SELECT count(*) AS n, sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus, (SELECT ties FROM t) AS ties FROM z",
    "sign_counts": "WITH d AS (SELECT l_quantity * 2 - floor(l_extendedprice / 1000.0::DOUBLE) AS d FROM lineitem) SELECT count(*) FILTER (d > 1e-15) AS wins, count(*) FILTER (d < -1e-15) AS losses FROM d",
    "friedman": f"WITH {SCORES} SELECT model, round(mean_rank, 6) AS mean_rank, f.n, f.k, round(raw / (1 - ties / (f.n * (f.k * f.k * f.k - f.k))), 6) AS statistic FROM m, f, t",
    "nemenyi": f"WITH {SCORES}, c AS (SELECT 2.728::DOUBLE * sqrt(k * (k + 1) / (6.0::DOUBLE * n)) AS cd FROM f) SELECT a.model AS model_a, b.model AS model_b, round(abs(a.mean_rank - b.mean_rank), 6) AS gap, round(cd, 6) AS critical, abs(a.mean_rank - b.mean_rank) > cd AS differs FROM m a JOIN m b ON a.model < b.model, c",
    "mcnemar": "WITH x AS (SELECT ((l_quantity > 25) = (l_tax > 0.04::DOUBLE)) AS a, ((l_discount > 0.05::DOUBLE) = (l_tax > 0.04::DOUBLE)) AS b FROM lineitem), s AS (SELECT count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c FROM x) SELECT b, c, round(power(greatest(abs(b - c) - 1, 0)::DOUBLE, 2) / (b + c), 6) AS statistic FROM s",
    "conformal_split": _split + " SELECT p_partkey, round(y, 6) AS y, round(p, 6) AS p, round(p - q, 6) AS lower, round(p + q, 6) AS upper FROM p, q",
    "conformal_coverage": _split + " SELECT round(avg((y >= p - q AND y <= p + q)::INT::DOUBLE), 6) AS coverage, round(avg(p + q - (p - q)), 6) AS width FROM p, q",
    "conformal_class": "WITH x AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS truth, l_quantity / 100.0::DOUBLE AS p FROM lineitem), c AS (SELECT 1 - CASE truth WHEN 0 THEN p ELSE 1 - p END AS s FROM x WHERE l_orderkey % 2 = 0), k AS (SELECT s, row_number() OVER (ORDER BY s) AS r, ceil(round((count(*) OVER () + 1) * 0.8::DOUBLE, 9)) AS w FROM c), q AS (SELECT s AS q FROM k WHERE r = w) SELECT truth::INT AS truth, concat_ws(',', CASE WHEN 1 - p <= q THEN '0' END, CASE WHEN 1 - (1 - p) <= q THEN '1' END) AS label_set, count(*) AS n FROM x, q GROUP BY 1, 2",
    "cqr": "WITH p AS (SELECT p_partkey, p_retailprice AS y, p_size * 20.0::DOUBLE + 700.0::DOUBLE AS p FROM part), c AS (SELECT greatest(p - 100 - y, y - (p + 100)) AS s FROM p WHERE p_partkey % 2 = 0), k AS (SELECT s, row_number() OVER (ORDER BY s) AS r, ceil(round((count(*) OVER () + 1) * 0.9::DOUBLE, 9)) AS w FROM c), q AS (SELECT s AS q FROM k WHERE r = w) SELECT p_partkey, round(y, 6) AS y, round(p, 6) AS p, round(p - 100, 6) AS lo, round(p + 100, 6) AS hi, round(p - 100 - q, 6) AS lower, round(p + 100 + q, 6) AS upper, round(p, 6) AS point FROM p, q",
    "nelson_aalen": f"WITH {EVENTS}, g AS (SELECT t, sum(e)::BIGINT AS d, count(*) AS c FROM v GROUP BY 1), r AS (SELECT t, d, sum(c) OVER (ORDER BY t DESC)::BIGINT AS at_risk FROM g), h AS (SELECT t, d, at_risk, sum(d / at_risk::DOUBLE) OVER (ORDER BY t) AS h FROM r WHERE d > 0) SELECT round(t, 6) AS t, d, at_risk, round(h, 6) AS hazard, round(exp(-h), 6) AS survival FROM h",
    "survival_at": f"WITH {EVENTS}, g AS (SELECT t, sum(e) AS d, count(*) AS c FROM v GROUP BY 1), r AS (SELECT t, d, sum(c) OVER (ORDER BY t DESC) AS n FROM g), h AS (SELECT t, sum(d / n::DOUBLE) OVER (ORDER BY t) AS h FROM r WHERE d > 0), q AS (SELECT s_suppkey, s_suppkey * 3.7::DOUBLE AS a FROM supplier) SELECT s_suppkey, round(a, 6) AS at, round(coalesce(exp(-h), 1.0::DOUBLE), 6) AS survival FROM q ASOF LEFT JOIN h ON q.a >= h.t",
    "logrank": f"WITH {EVENTS}, g AS (SELECT t, sum(e) AS d, count(*) AS c, sum(e) FILTER (g = 1) AS d1, count(*) FILTER (g = 1) AS c1 FROM v GROUP BY 1), r AS (SELECT d::DOUBLE AS d, coalesce(d1, 0) AS d1, (sum(c) OVER (ORDER BY t DESC))::DOUBLE AS n, (sum(c1) OVER (ORDER BY t DESC))::DOUBLE AS n1 FROM g), s AS (SELECT sum(d1)::BIGINT AS o, sum(d * n1 / n) AS e, sum(d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)) AS v FROM r WHERE d > 0 AND n >= 2) SELECT o AS observed, round(e, 6) AS expected, round(v, 6) AS variance, round((o - e) * (o - e) / v, 6) AS statistic FROM s",
    "cindex": f"WITH {EVENTS}, p AS (SELECT CASE WHEN a.t = b.t THEN 0.5::DOUBLE WHEN a.risk > b.risk THEN 1.0::DOUBLE WHEN a.risk = b.risk THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS g FROM v a JOIN v b ON (a.t < b.t AND a.e = 1) OR (a.t = b.t AND a.event_id < b.event_id AND a.e + b.e > 0)) SELECT sum(g) AS concordant, count(*)::DOUBLE AS comparable, round(sum(g) / count(*), 6) AS c_index FROM p",
}
