"""Conformal prediction. The calibration rank is ceil((n + 1)(1 - alpha)); beyond n the quantile is infinite."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.expr import prefix_sums


def quantile(df: DataFrame, score: Column, alpha: float, past: float = math.inf) -> float:
    """The score at the calibration rank; distinct scores are counted first, so only those are ranked."""
    s = df.select(score.alias("s")).where("s is not null").groupBy("s").agg(F.count("*").alias("c"))
    n = s.agg(F.sum("c")).first()[0] or 0
    rank = math.ceil(round((n + 1) * (1 - alpha), 9))
    if rank > n or not n:
        return past
    return prefix_sums(s, "s", ["c"]).where(F.col("cum_c") >= rank).agg(F.min("s")).first()[0]


def split_intervals(calibration: DataFrame, df: DataFrame, pred: str, truth: str, alpha: float = 0.1) -> DataFrame:
    """``df`` with lower and upper: the prediction plus and minus the quantile of absolute residuals."""
    q = quantile(calibration, F.abs(F.col(truth) - F.col(pred)), alpha)
    return df.withColumns({"lower": F.col(pred) - q, "upper": F.col(pred) + q})


def label_sets(calibration: DataFrame, df: DataFrame, probs: str, truth: str, alpha: float = 0.1) -> DataFrame:
    """``df`` with label_set: the classes whose 1 - p is at most the quantile of 1 - p(truth)."""
    q = quantile(calibration, 1.0 - F.element_at(F.col(probs), F.col(truth).cast("int") + 1), alpha, 1.0)
    keep = F.filter(F.transform(probs, lambda p, i: F.when(1.0 - p <= q, i)), lambda i: i.isNotNull())
    return df.withColumn("label_set", keep)


def cqr(calibration: DataFrame, df: DataFrame, low: str, high: str, truth: str, alpha: float = 0.1) -> DataFrame:
    """``df`` with lower, upper and point: quantile predictions widened by the quantile of max(low - y, y - high)."""
    q = quantile(calibration, F.greatest(F.col(low) - F.col(truth), F.col(truth) - F.col(high)), alpha)
    return df.withColumns({"lower": F.col(low) - q, "upper": F.col(high) + q, "point": (F.col(low) + F.col(high)) / 2.0})


def coverage(df: DataFrame, truth: str) -> DataFrame:
    inside = (F.col(truth) >= F.col("lower")) & (F.col(truth) <= F.col("upper"))
    return df.agg(F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("width"))
