"""Learners by id, with default settings, and what each can do."""

from __future__ import annotations

from collections.abc import Callable

from sparkloom.errors import EngineError
from sparkloom.learners import boosting, closed, kernels, neighbours, trees
from sparkloom.streaming import trainers
from sparkloom.task import Learner

LEARNERS: dict[str, Callable[..., Learner]] = {
    "linear_regression": closed.LinearRegression,
    "ridge": closed.Ridge,
    "lasso": closed.Lasso,
    "elastic_net": closed.ElasticNet,
    "logistic_regression": closed.LogisticRegression,
    "gaussian_nb": closed.GaussianNB,
    "linear_svm": kernels.LinearSVM,
    "kernel_svm": kernels.KernelSVM,
    "elm": kernels.ELM,
    "gaussian_process": kernels.GaussianProcess,
    "knn": neighbours.KNN,
    "decision_tree": trees.DecisionTree,
    "random_forest": trees.RandomForest,
    "extra_trees": trees.ExtraTrees,
    "oblique_tree": trees.ObliqueTree,
    "oblique_forest": trees.ObliqueForest,
    "quantile_forest": trees.QuantileForest,
    "adaboost": trees.AdaBoost,
    "gradient_boosting": boosting.gradient_boosting,
    "xgboost": boosting.xgboost,
    "lightgbm": boosting.lightgbm,
    "catboost": boosting.catboost,
    "quantile_gb": boosting.quantile_gb,
    "ebm": boosting.ebm,
    "hoeffding_tree": trainers.hoeffding_tree,
    "adaptive_random_forest": trainers.adaptive_random_forest,
    "mondrian_tree": trainers.mondrian_tree,
    "mondrian_forest": trainers.mondrian_forest,
}

#: What the letters of ``properties`` mean.
PROPERTIES = {"C": "classification", "R": "regression", "W": "weights", "P": "probabilities", "N": "missing values", "K": "categories", "I": "importance"}


def learner_from_id(name: str, **options) -> Learner:
    if name not in LEARNERS:
        raise EngineError(f"no learner {name}; there are {', '.join(sorted(LEARNERS))}")
    return LEARNERS[name](**options)


def learner_properties(name: str) -> set[str]:
    return {PROPERTIES[p] for p in learner_from_id(name).properties if p in PROPERTIES}


def registered_learner_ids() -> list[str]:
    return sorted(LEARNERS)
