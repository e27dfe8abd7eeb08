"""All registered queries with their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this folder that hold QUERIES (name -> function) and ORACLES (name -> SQL).
MODULES: tuple[str, ...] = ("measures", "preparation", "inference", "learning", "ensembles", "more", "models")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"sparkloom.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"sparkloom.plans.{m}").ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated accuracy of naive Bayes for the return flag."""
    return queries()["nb_cv"](spark, sf_dir)
