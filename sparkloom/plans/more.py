"""Loaders, balancing, anomalies and fronts over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import balance as A
from sparkloom.operators import tuning as T
from sparkloom.plans.measures import rounded
from sparkloom.plans.preparation import points, table
from sparkloom.sources import tables as L
from sparkloom.storage import new_path


def csv_load(spark: SparkSession, d: str) -> DataFrame:
    """Customers through a CSV file with missing tokens, types inferred, the segment encoded."""
    path = new_path(spark, "csv")
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, " NA ").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"), "c_mktsegment")
    c.write.option("header", True).csv(path)
    df, numeric = L.read_csv(spark, path)
    return L.encoded(df, [x for x, n in numeric.items() if not n]).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_acctbal", "c_mktsegment")


def parquet_load(spark: SparkSession, d: str) -> DataFrame:
    df, numeric = L.read_parquet(spark, f"{d}/part.parquet", ("p_size",))
    return L.class_target(df, "p_brand", numeric["p_brand"]).groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("largest"))


def adasyn(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("k", (F.col("vec_id") % 5 == 0).cast("int"))
    return rounded(A.adasyn_counts(p, "vec_id", ["x", "y"], "k", 1, 5), "id", "samples")


def smote_counts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"), F.when(F.col("label") < 3, 0).otherwise(1).alias("k"))
    return A.smote(v, "vec_id", ["a", "b"], "k").groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("vec_id").isNull().cast("long")).alias("made"))


QUERIES = {
    "csv_load": csv_load,
    "parquet_load": parquet_load,
    "adasyn_counts": adasyn,
    "smote_counts": smote_counts,
    "filter_relief": lambda s, d: rounded(A.relief(points(s, d).withColumn("t", F.col("x") * 2.0), "vec_id", ["x", "y"], "t"), "feature"),
    "iforest_labels": lambda s, d: A.isolation_forest(points(s, d), "vec_id", ["x", "y"]).groupBy("label").agg(F.count("*").alias("n")),
    "iforest_threshold": lambda s, d: A.with_threshold(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), 0.1),
    "pareto_front": lambda s, d: T.front_of_two(table(s, d, "part"), ["p_partkey"], "p_retailprice", "p_size"),
}

_near = "pts AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, (vec_id % 5 = 0)::INT AS k FROM embeddings), n AS (SELECT a.vec_id AS q, b.k, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.vec_id) AS r FROM pts a JOIN pts b ON a.vec_id <> b.vec_id WHERE a.k = 1)"
ORACLES = {
    "csv_load": "SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS c_acctbal, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS c_mktsegment FROM customer",
    "parquet_load": "WITH b AS (SELECT (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS p_brand, p_size::VARCHAR AS s FROM part) SELECT p_brand, count(*) AS n, max(s) AS largest FROM b GROUP BY 1",
    "adasyn_counts": f"WITH {_near}, r AS (SELECT q AS id, avg((k <> 1)::INT::DOUBLE) AS ratio FROM n WHERE r <= 5 GROUP BY 1) SELECT id, round(ratio, 6) AS ratio, round(ratio / (SELECT sum(ratio) FROM r) * (SELECT count(*) FILTER (k = 0) - count(*) FILTER (k = 1) FROM pts))::BIGINT AS samples FROM r",
    "smote_counts": "WITH c AS (SELECT CASE WHEN label < 3 THEN 0 ELSE 1 END AS k, count(*) AS c FROM embeddings GROUP BY 1) SELECT k::INT AS k, (SELECT max(c) FROM c) AS n, (SELECT max(c) FROM c) - c AS made FROM c",
    "iforest_threshold": "WITH t AS (SELECT c_acctbal AS t, row_number() OVER (ORDER BY c_acctbal DESC) AS r FROM customer) SELECT c_custkey AS id, c_acctbal AS score, (c_acctbal >= (SELECT t FROM t WHERE r = ceil(round((SELECT count(*) FROM customer) * 0.1::DOUBLE, 9))))::INT AS label FROM customer",
    "pareto_front": "SELECT p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice >= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size < a.p_size))",
}
