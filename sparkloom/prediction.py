"""Prediction frames: row ids, predicted values and, where known, the truth."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import TaskError
from sparkloom.functions.expr import last_argmax


@dataclass(frozen=True)
class Predictions:
    """``df`` has ids and predicted; classes may have probabilities, effects have estimated instead. ``truth`` is a column, or None."""

    df: DataFrame
    ids: list[str]
    kind: str
    truth: str | None = None

    def with_truth(self, kind: str, truths: DataFrame, column: str) -> Predictions:
        """The truth attached by ids, which must not repeat in ``truths``; of another kind the predictions stay as they are."""
        if kind != self.kind:
            return self
        if truths.groupBy(*self.ids).count().where("count > 1").limit(1).count():
            raise TaskError("ids repeat, so the truth can't be attached by them")
        rest = self.df.drop("truth")
        return replace(self, df=rest.join(truths.select(*self.ids, F.col(column).alias("truth")), self.ids, "left"), truth="truth")

    def n_samples(self) -> int:
        return self.df.count()


def classification(df: DataFrame, ids: list[str], predicted: str | None = None, probabilities: str | None = None, truth: str | None = None) -> Predictions:
    """Labels, or the last largest of the probabilities where there are no labels."""
    if predicted is None and probabilities is None:
        raise TaskError("predictions need labels or probabilities")
    label = F.col(predicted).cast("int") if predicted else last_argmax(F.col(probabilities))
    more = [F.col(probabilities).alias("probabilities")] if probabilities else []
    return Predictions(df.select(*ids, label.alias("predicted"), *more, *([F.col(truth).alias("truth")] if truth else [])), ids, "classif", "truth" if truth else None)


def regression(df: DataFrame, ids: list[str], predicted: str, truth: str | None = None) -> Predictions:
    return Predictions(df.select(*ids, F.col(predicted).cast("double").alias("predicted"), *([F.col(truth).cast("double").alias("truth")] if truth else [])), ids, "regress", "truth" if truth else None)


def causal_effect(df: DataFrame, ids: list[str], estimated: str, truth: str | None = None) -> Predictions:
    return Predictions(df.select(*ids, F.col(estimated).cast("double").alias("estimated"), *([F.col(truth).cast("double").alias("truth")] if truth else [])), ids, "effect", "truth" if truth else None)
