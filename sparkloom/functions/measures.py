"""Measures of predictions; each returns one row, all are aggregates over the prediction frame.

Groups of rows are first reduced to confusion counts or distinct scores, so what is shuffled grows with classes
or distinct scores, not with rows. ``by`` computes a measure for each group, such as a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.expr import prefix_sums, safe_div

CLIP = 1e-15


def _agg(df: DataFrame, by: list[str], *cols: Column) -> DataFrame:
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def accuracy(df: DataFrame, truth: str = "truth", pred: str = "predicted", by: list[str] | None = None) -> DataFrame:
    return _agg(df, by or [], F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, truth: str = "truth", pred: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """(truth, predicted, n)."""
    return df.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str = "truth", pred: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """(label, tp, n_true, n_pred) of every label seen in truth or prediction."""
    by = by or []
    c = confusion(df, truth, pred, by)
    one = c.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))).alias("x")).select(*by, "x.*")
    return one.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))


def macro_prf(df: DataFrame, truth: str = "truth", pred: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Macro precision, recall and F1 over the labels seen in truth or prediction; undefined ones are 0."""
    c = per_class(df, truth, pred, by)
    p, r = safe_div(F.col("tp").cast("double"), F.col("n_pred")), safe_div(F.col("tp").cast("double"), F.col("n_true"))
    c = c.select("*", p.alias("p"), r.alias("r"))
    return _agg(c, by or [], F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg(safe_div(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))).alias("f1"))


def balanced_accuracy(df: DataFrame, truth: str = "truth", pred: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Mean recall over the classes in truth."""
    c = per_class(df, truth, pred, by).where("n_true > 0")
    return _agg(c, by or [], F.avg(F.col("tp").cast("double") / F.col("n_true")).alias("balanced_accuracy"))


def kappa_mcc(df: DataFrame, truth: str = "truth", pred: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa (1 if chance agreement is 1) and the multiclass Matthews coefficient (0 if degenerate)."""
    d = lambda c: F.sum(F.col(c).cast("double"))
    x = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b))
    s = _agg(per_class(df, truth, pred, by), by or [], d("tp").alias("c"), d("n_true").alias("n"), x("n_true", "n_pred").alias("tp_"), x("n_true", "n_true").alias("tt"), x("n_pred", "n_pred").alias("pp"))
    pe, po = F.col("tp_") / (F.col("n") * F.col("n")), F.col("c") / F.col("n")
    n2 = F.col("n") * F.col("n")
    low = F.sqrt((n2 - F.col("pp")) * (n2 - F.col("tt")))
    return s.select(*(by or []), F.when(pe == 1.0, F.lit(1.0)).otherwise((po - pe) / (1.0 - pe)).alias("kappa"), safe_div(F.col("c") * F.col("n") - F.col("tp_"), low).alias("mcc"))


def logloss(df: DataFrame, truth: str = "truth", probs: str = "probabilities", by: list[str] | None = None) -> DataFrame:
    p = F.element_at(F.col(probs), F.col(truth).cast("int") + 1)
    return _agg(df, by or [], F.avg(-F.log(F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP)))).alias("logloss"))


def brier(df: DataFrame, truth: str = "truth", probs: str = "probabilities", by: list[str] | None = None) -> DataFrame:
    """Mean over rows of the sum over classes of squared errors; the truth's own term is corrected, so no pass over classes is repeated."""
    p = F.col(probs)
    squares = F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x)
    own = F.element_at(p, F.col(truth).cast("int") + 1)
    return _agg(df, by or [], F.avg(squares - 2.0 * own + 1.0).alias("brier"))


def auc(df: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve of a binary truth (1 positive); ties count half; 0.5 if a class is absent."""
    s = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum((F.col(truth) == 1).cast("long")).alias("pos"), F.sum((F.col(truth) != 1).cast("long")).alias("neg"))
    c = prefix_sums(s, "s", ["neg"])
    t = c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos").cast("double") * (2 * F.col("cum_neg") - F.col("neg"))).alias("a"))
    return t.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("a") / 2.0 / (F.col("p").cast("double") * F.col("n"))).otherwise(F.lit(0.5)).alias("auc"))


def auc_ovr(df: DataFrame, classes: int, truth: str = "truth", probs: str = "probabilities") -> DataFrame:
    """Macro one-against-rest AUC over the classes that have both labels."""
    long = df.select(truth, F.posexplode(probs).alias("k", "s")).where(F.col("k") < classes)
    s = long.groupBy("k", "s").agg(F.sum((F.col(truth) == F.col("k")).cast("long")).alias("pos"), F.sum((F.col(truth) != F.col("k")).cast("long")).alias("neg"))
    c = prefix_sums(s, "s", ["neg"], by=["k"])
    t = c.groupBy("k").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos").cast("double") * (2 * F.col("cum_neg") - F.col("neg"))).alias("a")).where("p > 0 and n > 0")
    return t.agg(F.coalesce(F.avg(F.col("a") / 2.0 / (F.col("p").cast("double") * F.col("n"))), F.lit(0.5)).alias("auc"))


def regression(df: DataFrame, truth: str = "truth", pred: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """RMSE, MAE, R2 (0 if the truth is constant) and MAPE (rows with a truth near 0 count 0 but stay in the mean)."""
    t, e = F.col(truth).cast("double"), F.col(truth).cast("double") - F.col(pred)
    s = _agg(df, by or [], F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(t).alias("v"), F.avg(F.when(F.abs(t) > 2.220446049250313e-16, F.abs(e / t)).otherwise(F.lit(0.0))).alias("mape"))
    return s.select(*(by or []), F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("v") == 0, F.lit(0.0)).otherwise(1.0 - F.col("mse") / F.col("v")).alias("r2"), "mape")


def effects(df: DataFrame, true: str = "true_effect", estimated: str = "estimated") -> DataFrame:
    """PEHE (root mean squared error of effects) and the bias of the average effect."""
    e = F.col(estimated) - F.col(true)
    return df.agg(F.sqrt(F.avg(e * e)).alias("pehe"), F.abs(F.avg(estimated) - F.avg(true)).alias("ate_bias"))


def label_sets(df: DataFrame, truth: str = "truth", pred: str = "predicted") -> DataFrame:
    """Share of rows whose label arrays are equal, and of elements that are."""
    hits = F.aggregate(F.zip_with(truth, pred, lambda a, b: (a == b).cast("double")), F.lit(0.0), lambda a, x: a + x)
    return df.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("subset_accuracy"), (F.sum(hits) / F.sum(F.size(truth))).alias("hamming_score"))


def mean_rmse(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Mean over targets of the RMSE; pairs of (truth, prediction) columns."""
    each = [F.sqrt(F.avg((F.col(t) - F.col(p)) * (F.col(t) - F.col(p)))) for t, p in pairs]
    return df.agg((sum(each[1:], each[0]) / float(len(each))).alias("mean_rmse"))
