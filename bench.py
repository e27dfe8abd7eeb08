"""Times the headline queries and prints one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: threads of the local master."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sparkloom.learners.boosting import xgboost
from sparkloom.plans import catalogue
from sparkloom.plans.ensembles import price_task

HEADLINES = (
    "nb_cv", "measure_macro_prf", "measure_kappa_mcc", "measure_auc", "measure_regression", "scaler_standard", "imputer_median", "onehot", "filter_anova", "filter_infogain",
    "filter_mi", "cv_kfold", "cv_stratified", "cv_bootstrap", "ols_fit", "logistic_fit", "knn_classif", "dbscan", "nelson_aalen", "logrank", "conformal_split", "wilcoxon_w",
    "t_learner", "threshold_sweep", "gbt_root_split", "xgboost_fit", "lightgbm_fit", "catboost_fit", "random_forest_fit", "tree_depth_two", "cindex", "silhouette",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    found = catalogue.queries()
    took = {}
    for name in HEADLINES:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    # Three rounds over tables of blocks, as tables too large for one memory are fitted.
    t = price_task(spark, sf_dir)
    began = time.perf_counter()
    xgboost(n_estimators=3, local_cells=0).fit(t)
    took["xgboost_over_spark_3"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
