"""Nearest neighbours as a learner."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.expr import last_argmax
from sparkloom.operators.neighbours import knn
from sparkloom.storage import materialize
from sparkloom.task import Learner, Model, Task


@dataclass
class KNNModel(Model):
    rows: DataFrame
    task: Task
    k: int

    def predict(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in ("predicted", "probabilities")]
        asked = materialize(df.withColumn("_q", F.monotonically_increasing_id()), "queries")
        near = knn(asked, self.rows, "_q", self.task.features, self.k, skip_self=False, other_id="_s").join(self.rows.select(F.col("_s").alias("id"), "_y"), "id")
        if self.task.kind == "regress":
            found = near.groupBy(F.col("query").alias("_q")).agg(F.avg("_y").alias("predicted"))
            return asked.join(found, "_q", "left").select(*kept, "predicted")
        shares = F.array(*(F.avg((F.col("_y") == c).cast("double")) for c in range(self.task.n_classes)))
        found = near.groupBy(F.col("query").alias("_q")).agg(shares.alias("probabilities"))
        return asked.join(found, "_q", "left").select(*kept, last_argmax(F.col("probabilities")).alias("predicted"), "probabilities")


@dataclass
class KNN(Learner):
    """The k nearest training rows by Euclidean distance, ties in the rows' order: class shares or means. k is at most the number of rows."""

    k: int = 5
    id = "knn"
    properties = "CRP"

    def _fit(self, task: Task) -> KNNModel:
        rows = materialize(task.df.select(*task.features, F.col(task.target).alias("_y"), *(c for c in task.ids if c not in task.features)).orderBy(*task.ids).withColumn("_s", F.monotonically_increasing_id()), "known")
        return KNNModel(rows, task, min(self.k, rows.count()))
