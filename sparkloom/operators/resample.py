"""Resampling strategies: frames of (fold, id columns, role).

Random order is the md5 order of ``expr.md5_key``. A training row of k-fold schemes appears once in each fold in
which it is not tested; ``train=False`` leaves those rows out, since they follow from the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.errors import TaskError
from sparkloom.functions.expr import global_rank, md5_key, range_of, splits


def _ranked(df: DataFrame, ids: list[str], seed: int, by: list[str] | None = None) -> DataFrame:
    return global_rank(df.withColumn("_k", md5_key(seed, ids)), "_k", ids, by=by).drop("_k")


def with_train(tests: DataFrame, ids: list[str], folds: int) -> DataFrame:
    """(fold, ids, role) from a frame with each row's test fold."""
    out = tests.select(*ids, "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("f"))
    return out.select(F.col("f").cast("int").alias("fold"), *ids, F.when(F.col("f") == F.col("fold"), "test").otherwise("train").alias("role"))


def kfold(df: DataFrame, ids: list[str], k: int = 5, seed: int = 42, train: bool = False) -> DataFrame:
    """(fold, ids[, role]): equal folds of n div k rows in random order, the last with the rest."""
    n = df.count()
    if k < 2 or n < k:
        raise TaskError(f"{k} folds of {n} rows")
    tests = _ranked(df.select(*ids), ids, seed).select(*ids, F.least(F.floor(F.col("rn") / (n // k)), F.lit(k - 1)).cast("int").alias("fold"))
    return with_train(tests, ids, k) if train else tests.select("fold", *ids)


def placed(df: DataFrame, ids: list[str], seed: int = 42, out: str = "rn") -> DataFrame:
    """``df`` with its rank in random order. Rows of equal ids follow by their other columns, so repeated ids are rows of their own."""
    rest = [f.name for f in df.schema.fields if f.name not in ids and f.dataType.typeName() not in ("map", "variant")]
    return global_rank(df.withColumn("_k", md5_key(seed, ids)), "_k", [*ids, *rest], out=out).drop("_k")


def with_folds(df: DataFrame, ids: list[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """``df`` with its fold, as ``kfold`` deals them, without a join back on the ids."""
    n = df.count()
    if k < 2 or n < k:
        raise TaskError(f"{k} folds of {n} rows")
    return placed(df, ids, seed, "_rn").withColumn(out, F.least(F.floor(F.col("_rn") / (n // k)), F.lit(k - 1)).cast("int")).drop("_rn")


def with_holdout(df: DataFrame, ids: list[str], ratio: float = 0.8, seed: int = 42, out: str = "role") -> DataFrame:
    """``df`` with train or test, as ``holdout`` deals them."""
    n = df.count()
    cut = int(n * ratio)
    if not 0 < ratio < 1 or cut in (0, n):
        raise TaskError(f"a share of {ratio} of {n} rows leaves a side empty")
    return placed(df, ids, seed, "_rn").withColumn(out, F.when(F.col("_rn") < cut, "train").otherwise("test")).drop("_rn")


def drawn(spark, n: int, draws: int, seed: int = 42) -> DataFrame:
    """(b, rn, mult): how often each draw takes each row number; n draws with replacement, by md5 of seed, draw and number."""
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string"))), 1, 15), 16, 10).cast("long"), F.lit(n))
    return spark.range(n).withColumnRenamed("id", "i").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("b", pick.alias("rn")).groupBy("b", "rn").agg(F.count("*").cast("int").alias("mult"))


def holdout(df: DataFrame, ids: list[str], ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """(ids, role): the first share of rows in random order trains."""
    n = df.count()
    cut = int(n * ratio)
    if not 0 < ratio < 1 or cut in (0, n):
        raise TaskError(f"a share of {ratio} of {n} rows leaves a side empty")
    return _ranked(df.select(*ids), ids, seed).select(*ids, F.when(F.col("rn") < cut, "train").otherwise("test").alias("role"))


def repeated_kfold(df: DataFrame, ids: list[str], k: int = 5, repeats: int = 2, seed: int = 42) -> DataFrame:
    """(fold, ids) of repeats of k folds; repeat r has the seed plus r and folds r * k on."""
    out = None
    for r in range(repeats):
        one = kfold(df, ids, k, seed + r).withColumn("fold", (F.col("fold") + r * k).cast("int"))
        out = one if out is None else out.unionByName(one)
    return out


def leave_one_out(df: DataFrame, ids: list[str]) -> DataFrame:
    """(fold, ids): one fold for each row, numbered in the order of ids' md5."""
    return _ranked(df.select(*ids), ids, 0).select(F.col("rn").alias("fold"), *ids)


def bootstrap(df: DataFrame, ids: list[str], draws: int = 3, seed: int = 42) -> DataFrame:
    """(fold, ids, role, mult): n draws with replacement, and the rows not drawn as tests.

    Draw i of fold b takes the row at the number that the md5 of seed, b and i gives, modulo n. Draws are counted
    per row number before they are joined.
    """
    n = df.count()
    rows = _ranked(df.select(*ids), ids, seed)
    taken = drawn(df.sparkSession, n, draws, seed)
    if n <= 30 and n > 1:
        # A draw that leaves no row out is drawn again; of more rows none does.
        for again in range(1, 50):
            full = [r["b"] for r in taken.groupBy("b").count().where(F.col("count") == n).collect()]
            if not full:
                break
            taken = taken.where(~F.col("b").isin(full)).unionByName(drawn(df.sparkSession, n, draws, seed + 1000 * again).where(F.col("b").isin(full)))
    grid = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    out = grid.join(taken, ["b", "rn"], "left")
    return out.select(F.col("b").alias("fold"), *ids, F.when(F.col("mult").isNull(), "test").otherwise("train").alias("role"), F.coalesce("mult", F.lit(1)).alias("mult"))


def stratified(df: DataFrame, ids: list[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(fold, ids): each class dealt in random order, round and round."""
    short = df.groupBy(label).count().where(F.col("count") < k).limit(1).collect()
    if short:
        raise TaskError(f"class {short[0][0]} has fewer rows than {k} folds")
    return _ranked(df.select(*ids, label), ids, seed, by=[label]).select((F.col("rn") % k).cast("int").alias("fold"), *ids)


def grouped(df: DataFrame, ids: list[str], group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(fold, ids): whole groups dealt in random order, round and round."""
    groups = df.select(group).distinct()
    n = groups.count()
    if n < k:
        raise TaskError(f"{n} groups for {k} folds")
    dealt = _ranked(groups, [group], seed).select(group, (F.col("rn") % k).cast("int").alias("fold"))
    return df.select(*ids, group).join(dealt, group).select("fold", *ids)


def spatial_block(df: DataFrame, ids: list[str], x: str, y: str, k: int = 5, size: float | None = None) -> DataFrame:
    """(fold, ids): a grid over the bounding box, of ceil(sqrt(k)) cells a side or of cells of ``size``; cell modulo k."""
    b = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if b[0] is None:
        raise TaskError("no coordinates")
    eps = 2.220446049250313e-16
    side = int(-(-(k**0.5) // 1))
    if size:
        w = h = size
        cols, rows = int((b[1] - b[0]) / size) + 1, int((b[3] - b[2]) / size) + 1
    else:
        w, h, cols, rows = (b[1] - b[0] + eps) / side, (b[3] - b[2] + eps) / side, side, side
    c = F.least(F.floor((F.col(x) - b[0]) / w), F.lit(cols - 1))
    r = F.least(F.floor((F.col(y) - b[2]) / h), F.lit(rows - 1))
    out = df.select(((r * cols + c) % k).cast("int").alias("fold"), *ids)
    if out.select("fold").distinct().count() < 2:
        raise TaskError("all rows lie in one block")
    return out


def spatial_buffer(df: DataFrame, ids: list[str], x: str, y: str, distance: float, k: int = 5, seed: int = 42) -> DataFrame:
    """(fold, ids, role): k folds whose training rows lie ``distance`` or farther from every test row.

    Near pairs meet in cells of that size: each test row visits the nine cells around it.
    """
    rows = df.select(*ids, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    tests = kfold(rows, ids, k, seed).join(rows, ids)
    cell = lambda c: F.floor(F.col(c) / distance)
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a, b))))"))
    seen = tests.select("fold", F.col("_x").alias("tx"), F.col("_y").alias("ty"), around.alias("o")).select("fold", "tx", "ty", (cell("tx") + F.col("o.a")).alias("cx"), (cell("ty") + F.col("o.b")).alias("cy"))
    here = tests.select(F.col("fold").alias("own"), *ids, "_x", "_y", cell("_x").alias("cx"), cell("_y").alias("cy"))
    near = here.join(seen, ["cx", "cy"]).where((F.col("own") != F.col("fold")) & ((F.col("_x") - F.col("tx")) ** 2 + (F.col("_y") - F.col("ty")) ** 2 < distance * distance)).select("fold", *ids).distinct()
    folds = with_train(tests.select(*ids, "fold"), ids, k)
    return folds.join(near, ["fold", *ids], "left_anti")


def spatial_leave_one_out(df: DataFrame, ids: list[str], x: str, y: str, distance: float) -> DataFrame:
    """(fold, ids, role): one fold for each row, whose training rows lie ``distance`` or farther from it."""
    return spatial_buffer(df, ids, x, y, distance, df.count(), 0)


def time_series(df: DataFrame, ids: list[str], order: list[str], horizon: int, min_train: int, step: int | None = None, window: int | None = None, gap: int = 0) -> DataFrame:
    """(fold, origin, train_from, train_to, test_from, test_to): rolling origins over time ranks, ends exclusive.

    The rows of a fold are those whose rank lies in its ranges; ``time_ranks`` gives ranks.
    """
    n = df.count()
    step = step or horizon
    last = n - gap - horizon
    if last < min_train:
        raise TaskError("the series is too short")
    origin = df.sparkSession.range(min_train, last + 1, step).withColumnRenamed("id", "origin")
    start = F.greatest(F.col("origin") - window, F.lit(0)) if window else F.lit(0)
    return origin.select(((F.col("origin") - min_train) / step).cast("int").alias("fold"), "origin", start.cast("long").alias("train_from"), F.col("origin").alias("train_to"), (F.col("origin") + gap).alias("test_from"), (F.col("origin") + gap + horizon).alias("test_to"))


def time_ranks(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with rn, its rank (from 0) in time: ranges of the first order column are ranked apart and offset."""
    kind = df.schema[order[0]].dataType.typeName()
    first = F.col(order[0]).cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col(order[0]).cast("double")
    part = range_of(first, splits(df.select(first.alias("_t")), "_t"))
    cut = df.withColumn("_r", part)
    sizes = cut.groupBy("_r").agg(F.count("*").alias("_n"))
    start = sizes.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_o"))
    return cut.join(F.broadcast(start), "_r").withColumn("rn", F.col("_o") + F.row_number().over(Window.partitionBy("_r").orderBy(*order)) - 1).drop("_r", "_o")
