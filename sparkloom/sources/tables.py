"""CSV and Parquet tables as tasks, and models as files.

A CSV column is numeric if every present value parses; else its codes follow the lexicographic order of its values.
Missing tokens, in any case and trimmed: the empty string, ?, na, nan, null, n/a.
"""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.errors import EngineError, TaskError
from sparkloom.operators.transform import LabelEncoder
from sparkloom.task import Model

#: Fixed value: the tokens that mean a missing cell.
MISSING_TOKENS = ("", "?", "na", "nan", "null", "n/a")
FORMAT_VERSION = 2
LARGEST_MODEL = 100 * 2**20


def read_csv(spark: SparkSession, path: str, sep: str = ",", categorical: tuple[str, ...] = (), max_rows: int | None = None) -> tuple[DataFrame, dict[str, bool]]:
    """The table with numbers as doubles and categories as strings, and which columns are numeric. Types take one aggregate."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    if max_rows is not None:
        raw = raw.limit(max_rows)
    clean = raw.select(*(F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin(*MISSING_TOKENS), F.trim(F.col(f"`{c}`"))).alias(c) for c in raw.columns))
    # A cell that does not parse has to be told from a missing one.
    test = [F.coalesce(F.bool_and(F.col(f"`{c}`").isNull() | F.expr(f"try_cast(`{c}` as double)").isNotNull()), F.lit(True)) for c in clean.columns]
    numeric = dict(zip(clean.columns, clean.agg(*test).first(), strict=True))
    numeric = {c: v and c not in categorical for c, v in numeric.items()}
    return clean.select(*(F.expr(f"try_cast(`{c}` as double)").alias(c) if numeric[c] else F.col(f"`{c}`") for c in clean.columns)), numeric


def read_parquet(spark: SparkSession, path: str, categorical: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, bool]]:
    """Numbers and booleans as doubles, NaN as null; other types are categories."""
    df = spark.read.parquet(path)
    plain = {"double", "float", "decimal", "byte", "short", "integer", "long", "boolean"}
    numeric = {f.name: f.dataType.typeName().split("(")[0] in plain and f.name not in categorical for f in df.schema.fields}
    cols = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) if n else F.col(f"`{c}`").cast("string").alias(c) for c, n in numeric.items()]
    return df.select(*cols), numeric


def encoded(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with category columns replaced by their codes as doubles."""
    for c in cols:
        df = LabelEncoder(c).fit(df).encode(df, "_code").withColumn(c, F.col("_code").cast("double")).drop("_code")
    return df


def class_target(df: DataFrame, target: str, numeric: bool) -> DataFrame:
    """``df`` with the target as integers from 0: whole numbers as they are, others encoded; a missing one is an error."""
    if df.where(F.col(target).isNull()).limit(1).count():
        raise TaskError(f"{target} is missing in some rows")
    if numeric:
        if df.where((F.col(target) < 0) | (F.col(target) != F.floor(F.col(target)))).limit(1).count():
            raise TaskError(f"{target} holds values that are no classes")
        return df.withColumn(target, F.col(target).cast("int"))
    return LabelEncoder(target).fit(df).encode(df, "_code").withColumn(target, F.col("_code")).drop("_code")


def number_target(df: DataFrame, target: str) -> DataFrame:
    """``df`` if every target is a finite number."""
    if df.where(F.col(target).isNull() | F.isnan(target) | (F.abs(target) == float("inf"))).limit(1).count():
        raise TaskError(f"{target} is missing or not finite in some rows")
    return df


def _kinds() -> dict[str, type]:
    """Models that have a file format, by the name of their class."""
    from sparkloom.learners import kernels, trees
    from sparkloom.learners.boosting import BoostedModel, Objective
    from sparkloom.learners.closed import LinearModel, LogisticModel, NaiveBayesModel
    from sparkloom.learners.growth import Tree
    from sparkloom.streaming.trainers import OnlineModel

    found = (LinearModel, LogisticModel, NaiveBayesModel, BoostedModel, Objective, Tree, OnlineModel, trees.ForestModel, trees.QuantileForestModel, trees.ProjectedModel, trees.StumpModel, trees.EffectForest, trees.SurvivalForestModel, kernels.MarginModel, kernels.HiddenModel, kernels.ProcessModel, kernels.KernelModel)
    return {k.__name__: k for k in found}


def _out(v: object) -> object:
    if isinstance(v, np.ndarray):
        return {"array": [_out(x) for x in v.tolist()], "type": v.dtype.str, "shape": list(v.shape)}
    if isinstance(v, np.generic):
        return v.item()
    if is_dataclass(v):
        name = type(v).__name__
        if name not in _kinds():
            raise EngineError(f"{name} has no file format")
        return {"kind": name, "fields": {f.name: _out(getattr(v, f.name)) for f in fields(v)}}
    if isinstance(v, dict):
        return {"dict": [[_out(k), _out(x)] for k, x in v.items()]}
    if isinstance(v, tuple):
        return {"tuple": [_out(x) for x in v]}
    return [_out(x) for x in v] if isinstance(v, list) else v


def _in(v: object) -> object:
    if isinstance(v, list):
        return [_in(x) for x in v]
    if not isinstance(v, dict):
        return v
    if "array" in v:
        return np.array(v["array"], v["type"]).reshape(v["shape"])
    if "tuple" in v:
        return tuple(_in(x) for x in v["tuple"])
    if "dict" in v:
        return {_in(k): _in(x) for k, x in v["dict"]}
    if v.get("kind") not in _kinds():
        raise EngineError(f"no model kind {v.get('kind')}")
    return _kinds()[v["kind"]](**{k: _in(x) for k, x in v["fields"].items()})


def to_json(model: Model) -> str:
    """Fields by name, arrays with their type and shape; only the kinds listed can be written or read."""
    return json.dumps({"format_version": FORMAT_VERSION, "model": _out(model)})


def from_json(text: str) -> Model:
    if len(text) > LARGEST_MODEL:
        raise EngineError("the model file is too large")
    d = json.loads(text)
    if d.get("format_version") != FORMAT_VERSION:
        raise EngineError(f"format version {d.get('format_version')}")
    return _in(d["model"])


def save(spark: SparkSession, model: Model, path: str) -> None:
    """One JSON file in a folder of any file system that Spark writes to."""
    spark.createDataFrame([(to_json(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Model:
    return from_json(spark.read.text(path).first()[0])
