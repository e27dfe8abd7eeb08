"""Measures over predictions made by fixed rules on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import measures as M


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else (F.round(c, 6) + 0.0).alias(c) for c in df.columns))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """Return flags as classes 0, 1, 2 and a rule of quantity and discount as their prediction, with probabilities."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    truth = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    pred = F.when(F.col("l_quantity") <= 15, 0).when(F.col("l_discount") <= 0.05, 1).otherwise(2)
    a, b = F.col("l_quantity") / 100.0, F.col("l_discount") * 4.0
    return li.select(truth.cast("int").alias("truth"), pred.cast("int").alias("predicted"), F.array(a, b, 1.0 - a - b).alias("probabilities"), a.alias("p0"), b.alias("p1"))


FLAGS = """flags AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS truth,
 CASE WHEN l_quantity <= 15 THEN 0 WHEN l_discount <= 0.05::DOUBLE THEN 1 ELSE 2 END AS predicted,
 l_quantity / 100.0::DOUBLE AS p0, l_discount * 4.0::DOUBLE AS p1, 1.0::DOUBLE - l_quantity / 100.0::DOUBLE - l_discount * 4.0::DOUBLE AS p2 FROM lineitem)"""
LABELS = FLAGS + """, lab AS (SELECT label, sum(tp) AS tp, sum(t) AS t, sum(p) AS p FROM (
 SELECT truth AS label, count(*) FILTER (truth = predicted) AS tp, count(*) AS t, 0 AS p FROM flags GROUP BY 1
 UNION ALL SELECT predicted, 0, 0, count(*) FROM flags GROUP BY 1) GROUP BY 1)"""


def _prices(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_retailprice").alias("truth"), (F.col("p_size") * 20.0 + 700.0).alias("predicted"))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("event_type") == "error").cast("int").alias("truth"), F.col("value").alias("score"))


def _effects(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select((F.col("o_totalprice") / 100.0).alias("true_effect"), (F.col("o_totalprice") / 110.0 + (F.col("o_custkey") % 7)).alias("estimated"))


def _sets(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    t = F.array(*((F.col(c) > v).cast("int") for c, v in (("l_quantity", 25), ("l_discount", 0.05), ("l_tax", 0.04))))
    p = F.array(*((F.col(c) > v).cast("int") for c, v in (("l_quantity", 20), ("l_discount", 0.04), ("l_extendedprice", 30000))))
    return li.select(t.alias("truth"), p.alias("predicted"))


QUERIES = {
    "measure_confusion": lambda s, d: M.confusion(_flags(s, d)),
    "measure_accuracy": lambda s, d: rounded(M.accuracy(_flags(s, d)).crossJoin(M.balanced_accuracy(_flags(s, d)))),
    "measure_macro_prf": lambda s, d: rounded(M.macro_prf(_flags(s, d))),
    "measure_kappa_mcc": lambda s, d: rounded(M.kappa_mcc(_flags(s, d))),
    "measure_logloss": lambda s, d: rounded(M.logloss(_flags(s, d))),
    "measure_brier": lambda s, d: rounded(M.brier(_flags(s, d))),
    "measure_auc": lambda s, d: rounded(M.auc(_errors(s, d))),
    "measure_auc_ovr": lambda s, d: rounded(M.auc_ovr(_flags(s, d).select("truth", F.array(F.round("p0", 2), F.round("p1", 2), F.round(1.0 - F.col("p0") - F.col("p1"), 2)).alias("probabilities")), 3)),
    "measure_regression": lambda s, d: rounded(M.regression(_prices(s, d))),
    "measure_effects": lambda s, d: rounded(M.effects(_effects(s, d))),
    "measure_label_sets": lambda s, d: rounded(M.label_sets(_sets(s, d))),
    "measure_mean_rmse": lambda s, d: rounded(M.mean_rmse(s.read.parquet(f"{d}/part.parquet").select(F.col("p_retailprice").alias("a"), F.lit(1000.0).alias("b"), F.col("p_size").cast("double").alias("c"), F.lit(25.0).alias("e")), [("a", "b"), ("c", "e")])),
}

ORACLES = {
    "measure_confusion": f"WITH {FLAGS} SELECT truth, predicted, count(*) AS n FROM flags GROUP BY 1, 2",
    "measure_accuracy": f"WITH {LABELS} SELECT round((SELECT avg((truth = predicted)::INT::DOUBLE) FROM flags), 6) AS accuracy, round((SELECT avg(tp::DOUBLE / t) FROM lab WHERE t > 0), 6) AS balanced_accuracy",
    "measure_macro_prf": f"WITH {LABELS}, s AS (SELECT CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 0.0::DOUBLE END AS pr, CASE WHEN t > 0 THEN tp::DOUBLE / t ELSE 0.0::DOUBLE END AS re FROM lab) SELECT round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0::DOUBLE END), 6) AS f1 FROM s",
    "measure_kappa_mcc": f"WITH {LABELS}, s AS (SELECT sum(tp::DOUBLE) AS c, sum(t::DOUBLE) AS n, sum(t::DOUBLE * p) AS tp, sum(t::DOUBLE * t) AS tt, sum(p::DOUBLE * p) AS pp FROM lab) SELECT round((c / n - tp / (n * n)) / (1 - tp / (n * n)), 6) AS kappa, round((c * n - tp) / sqrt((n * n - pp) * (n * n - tt)), 6) AS mcc FROM s",
    "measure_logloss": f"WITH {FLAGS} SELECT round(avg(-ln(least(greatest(CASE truth WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-15), 1 - 1e-15))), 6) AS logloss FROM flags",
    "measure_brier": f"WITH {FLAGS} SELECT round(avg(power(p0 - (truth = 0)::INT, 2) + power(p1 - (truth = 1)::INT, 2) + power(p2 - (truth = 2)::INT, 2)), 6) AS brier FROM flags",
    "measure_auc": "WITH s AS (SELECT value AS s, count(*) FILTER (event_type = 'error') AS pos, count(*) FILTER (event_type <> 'error') AS neg FROM events GROUP BY 1), c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) AS cn FROM s) SELECT round(sum(pos::DOUBLE * (2 * cn - neg)) / 2.0::DOUBLE / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc FROM c",
    "measure_auc_ovr": f"WITH {FLAGS}, l AS (SELECT truth, 0 AS k, round(p0, 2) AS s FROM flags UNION ALL SELECT truth, 1, round(p1, 2) FROM flags UNION ALL SELECT truth, 2, round(1.0::DOUBLE - p0 - p1, 2) FROM flags), s AS (SELECT k, s, count(*) FILTER (truth = k) AS pos, count(*) FILTER (truth <> k) AS neg FROM l GROUP BY 1, 2), c AS (SELECT k, pos, neg, sum(neg) OVER (PARTITION BY k ORDER BY s) AS cn FROM s), a AS (SELECT k, sum(pos::DOUBLE * (2 * cn - neg)) / 2.0::DOUBLE / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS a FROM c GROUP BY 1) SELECT round(avg(a), 6) AS auc FROM a",
    "measure_regression": "WITH p AS (SELECT p_retailprice AS t, p_size * 20.0::DOUBLE + 700.0::DOUBLE AS y FROM part) SELECT round(sqrt(avg((t - y) * (t - y))), 6) AS rmse, round(avg(abs(t - y)), 6) AS mae, round(1 - avg((t - y) * (t - y)) / var_pop(t), 6) AS r2, round(avg(abs((t - y) / t)), 6) AS mape FROM p",
    "measure_effects": "WITH e AS (SELECT o_totalprice / 100.0::DOUBLE AS t, o_totalprice / 110.0::DOUBLE + (o_custkey % 7) AS y FROM orders) SELECT round(sqrt(avg((y - t) * (y - t))), 6) AS pehe, round(abs(avg(y) - avg(t)), 6) AS ate_bias FROM e",
    "measure_label_sets": "WITH x AS (SELECT ((l_quantity > 25) = (l_quantity > 20))::INT AS a, ((l_discount > 0.05::DOUBLE) = (l_discount > 0.04::DOUBLE))::INT AS b, ((l_tax > 0.04::DOUBLE) = (l_extendedprice > 30000))::INT AS c FROM lineitem) SELECT round(avg((a * b * c)::DOUBLE), 6) AS subset_accuracy, round(sum(a + b + c)::DOUBLE / (3 * count(*)), 6) AS hamming_score FROM x",
    "measure_mean_rmse": "SELECT round((sqrt(avg((p_retailprice - 1000.0) * (p_retailprice - 1000.0))) + sqrt(avg((p_size::DOUBLE - 25.0) * (p_size::DOUBLE - 25.0)))) / 2.0::DOUBLE, 6) AS mean_rmse FROM part",
}
