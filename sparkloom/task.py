"""Tasks, learners and models: DataFrames with named roles of columns."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field, fields, is_dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import NotSupported, TaskError


@dataclass(frozen=True)
class Task:
    """A table with features, a target, unique ids and, if any, weights and category counts.

    Class labels are integers from 0; ``n_classes`` is fixed at creation and kept for every fold.
    """

    df: DataFrame
    features: list[str]
    target: str
    ids: list[str]
    kind: str = "regress"
    n_classes: int = 0
    weight: str | None = None
    categories: dict[str, int] = field(default_factory=dict)
    class_names: tuple[str, ...] | None = None
    types: dict[str, str] = field(default_factory=dict)

    def on(self, df: DataFrame) -> Task:
        """The same task over other rows."""
        return replace(self, df=df)

    def only(self, features: list[str]) -> Task:
        return replace(self, features=features)

    def with_weights(self, col: str) -> Task:
        """Frequency weights: finite, not negative, not all 0."""
        bad, total = self.df.agg(F.sum((F.col(col).isNull() | F.isnan(F.col(col).cast("double")) | (F.col(col) < 0)).cast("long")), F.sum(col)).first()
        if bad or not total:
            raise TaskError(f"{col} can't be a weight")
        return replace(self, weight=col)

    def with_class_names(self, names: list[str]) -> Task:
        if len(names) != self.n_classes:
            raise TaskError(f"{len(names)} names for {self.n_classes} classes")
        return replace(self, class_names=tuple(names))

    def with_types(self, types: dict[str, str]) -> Task:
        """Kinds of features, such as numeric, categorical or text; they go with the task to its folds."""
        if unknown := types.keys() - set(self.features):
            raise TaskError(f"no features {sorted(unknown)}")
        return replace(self, types=types)

    def rows(self, condition) -> Task:
        """The task over the rows that meet a condition; class counts and names stay."""
        return self.on(self.df.where(condition))

    def with_categories(self, cols: list[str]) -> Task:
        """Marks columns of integer codes; the count is the largest code plus 1."""
        r = self.df.agg(*(x for c in cols for x in (F.max(c), F.bool_and((F.col(c) == F.floor(F.col(c))) & (F.col(c) >= 0))))).first()
        for i, c in enumerate(cols):
            if not r[2 * i + 1]:
                raise TaskError(f"{c} holds values that are no codes")
        return replace(self, categories={c: int(r[2 * i]) + 1 for i, c in enumerate(cols)})


def classification(df: DataFrame, features: list[str], target: str, ids: list[str]) -> Task:
    top, low, n = df.agg(F.max(target), F.min(target), F.count("*")).first()
    if not n or not features:
        raise TaskError("a task needs rows and features")
    if top is None or low < 0 or df.schema[target].dataType.typeName() in ("double", "float", "string"):
        raise TaskError(f"{target} must hold integers from 0")
    return Task(df, features, target, ids, "classif", int(top) + 1)


def regression(df: DataFrame, features: list[str], target: str, ids: list[str]) -> Task:
    n, bad = df.agg(F.count("*"), F.sum((F.col(target).isNull() | F.isnan(F.col(target).cast("double"))).cast("long"))).first()
    if not n or not features:
        raise TaskError("a task needs rows and features")
    if bad:
        raise TaskError(f"{target} is missing in {bad} rows")
    return Task(df, features, target, ids, "regress")


def check_present(df: DataFrame, cols: list[str]) -> None:
    """An error if a value is missing or NaN."""
    bad = df.agg(*(F.max((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")) for c in cols)).first()
    if names := [c for c, b in zip(cols, bad, strict=True) if b]:
        raise TaskError(f"values are missing in {names}")


def check_width(df: DataFrame, cols: list[str]) -> None:
    """An error if a column isn't there."""
    if names := [c for c in cols if c not in df.columns]:
        raise TaskError(f"no columns {names}")


def check_coordinates(df: DataFrame, coords: list[str]) -> None:
    """An error unless there are two columns of finite numbers."""
    if len(coords) != 2:
        raise TaskError("coordinates are two columns")
    check_width(df, coords)
    check_present(df, coords)
    if df.where(" or ".join(f"abs(`{c}`) = double('infinity')" for c in coords)).limit(1).count():
        raise TaskError("coordinates must be finite")


class Model(ABC):
    @abstractmethod
    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with predicted and, for classes with probabilities, probabilities."""

    def importance(self) -> dict[str, float] | None:
        return None

    def permutation_importance(self, task: Task, measure, column: str, **options) -> DataFrame:
        from sparkloom.operators.explain import permutation_importance

        return permutation_importance(self, task, measure, column, **options)

    def shap_values(self, task: Task, rows: DataFrame, **options) -> DataFrame:
        from sparkloom.operators.explain import permutation_shap

        return permutation_shap(self, task, rows, **options)

    def conformal_predict(self, calibration: Task, df: DataFrame, alpha: float = 0.1) -> DataFrame:
        """Intervals, or label sets for classes, from the task's rows."""
        from sparkloom.operators.conformal import label_sets, split_intervals

        known = self.predict(calibration.df)
        if calibration.kind == "classif":
            return label_sets(known, self.predict(df), "probabilities", calibration.target, alpha)
        return split_intervals(known, self.predict(df), "predicted", calibration.target, alpha)


class Learner(ABC):
    #: Id, and capabilities: C classes, R numbers, W weights, P probabilities, N missing values, I importance.
    id = ""
    properties = ""

    def get_params(self) -> dict[str, object]:
        return {f.name: getattr(self, f.name) for f in fields(self)} if is_dataclass(self) else {}

    def set_params(self, **params) -> Learner:
        if unknown := params.keys() - self.get_params().keys():
            raise TaskError(f"{self.id} has no {sorted(unknown)}")
        for k, v in params.items():
            setattr(self, k, v)
        return self

    def fit(self, task: Task) -> Model:
        if missing := [c for c in task.features if c not in task.df.columns]:
            raise TaskError(f"no columns {missing}")
        if ("C" if task.kind == "classif" else "R") not in self.properties:
            raise NotSupported(f"{self.id} doesn't fit {task.kind} tasks")
        if task.weight and "W" not in self.properties:
            raise NotSupported(f"{self.id} takes no weights")
        return self._fit(task)

    @abstractmethod
    def _fit(self, task: Task) -> Model: ...
