"""Class balancing: new rows between neighbours of the same class, and relief scores from neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.expr import global_rank, md5_key
from sparkloom.operators.neighbours import knn
from sparkloom.storage import materialize


def needed(df: DataFrame, label: str) -> dict[int, int]:
    """Rows that each class lacks to the largest one."""
    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    return {k: max(n.values()) - v for k, v in n.items()}


def _between(df: DataFrame, made: DataFrame, near: DataFrame, id_col: str, cols: list[str], label: str, c: int) -> DataFrame:
    """New rows of class c from ``made`` (_s, _h, _p, features): at a share given by _h between row _s and its neighbour number _p."""
    share = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(2**32)
    other = df.select(F.col(id_col).cast("long").alias("id"), *(F.col(f).alias(f"_n_{f}") for f in cols))
    joined = made.join(near.select("query", "id", "place"), (F.col("_s") == F.col("query")) & (F.col("_p") == F.col("place"))).join(other, "id")
    return joined.select(F.lit(None).cast("long").alias(id_col), *((F.col(f) + share * (F.col(f"_n_{f}") - F.col(f))).alias(f) for f in cols), F.lit(c).cast(df.schema[label].dataType).alias(label))


def _numbered(rows: DataFrame, id_col: str, cols: list[str], per: str, seed: int) -> DataFrame:
    """(_s, _i, _h, features): ``per`` entries a row, with the md5 of seed, row and number."""
    made = rows.select(F.col(id_col).cast("long").alias("_s"), *cols, F.explode(F.expr(f"sequence(1, {per})")).alias("_i")).withColumn("_i", F.col("_i") - 1)
    return made.withColumn("_h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("_s").cast("string"), F.col("_i").cast("string"))))


def smote(df: DataFrame, id_col: str, features: list[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` (id, features, label) and new rows (null id), so that every class has the largest one's count.

    Each new row lies between a row and one of its k nearest of the class, at a share from the md5 of seed, row and
    number; a class of one row gets copies moved by up to 0.01. Rows that give one more than others, where the count
    does not divide, are the first in md5 order, by rank and not by a sort in one task.
    """
    out = df.select(id_col, *features, label)
    for c, lack in sorted(needed(df, label).items()):
        if not lack:
            continue
        rows = df.where(F.col(label) == c).select(id_col, *features)
        n = rows.count()
        each, more = divmod(lack, n)
        dealt = global_rank(rows.withColumn("_k", md5_key(seed, [id_col])), "_k", [id_col], out="_rn").withColumn("_per", F.lit(each) + (F.col("_rn") < more).cast("int")).where("_per > 0")
        made = _numbered(dealt, id_col, [*features, "_per"], "_per", seed)
        if n == 1:
            share = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(2**32)
            new = made.select(F.lit(None).cast("long").alias(id_col), *((F.col(f) + (share - 0.5) * 0.02).alias(f) for f in features), F.lit(c).cast(df.schema[label].dataType).alias(label))
        else:
            near = knn(rows, rows, id_col, features, min(k, n - 1))
            made = made.withColumn("_p", F.pmod(F.conv(F.substring("_h", 9, 8), 16, 10).cast("long"), F.lit(min(k, n - 1))) + 1)
            new = _between(df, made, near, id_col, features, label, c)
        out = out.unionByName(new)
    return out


def spatial_smote(df: DataFrame, id_col: str, features: list[str], coords: list[str], label: str, max_distance: float, k: int = 5, seed: int = 42, tries: int = 10) -> DataFrame:
    """As ``smote``, between rows of a class that lie within ``max_distance``; coordinates move by the same share.

    A row draws its neighbour among its k nearest by features that are near enough; a row without one gives nothing, and
    others give up to ``tries`` times as many, so a class may stay short.
    """
    cols = [*features, *coords]
    out = df.select(id_col, *cols, label)
    for c, lack in sorted(needed(df, label).items()):
        rows = df.where(F.col(label) == c).select(id_col, *cols)
        n = rows.count()
        if not lack or n < 2:
            continue
        near = knn(rows, rows, id_col, features, min(k, n - 1))
        place = lambda side, tag: rows.select(F.col(id_col).cast("long").alias(side), *(F.col(x).cast("double").alias(f"{tag}{i}") for i, x in enumerate(coords)))
        d2 = sum(((F.col(f"a{i}") - F.col(f"b{i}")) ** 2 for i in range(len(coords))), F.lit(0.0))
        near = near.join(place("query", "a"), "query").join(place("id", "b"), "id").where(d2 <= max_distance**2)
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("place"))).select("query", "id", "place")
        count = near.groupBy(F.col("query").alias("_q")).agg(F.max("place").alias("_near"))
        able = rows.join(count, F.col(id_col).cast("long") == F.col("_q")).drop("_q")
        m = able.count()
        if not m:
            continue
        each, more = divmod(min(lack, tries * m * max(1, -(-lack // max(n, 1)))), m)
        dealt = global_rank(able.withColumn("_k", md5_key(seed, [id_col])), "_k", [id_col], out="_rn").withColumn("_per", F.lit(each) + (F.col("_rn") < more).cast("int")).where("_per > 0")
        made = _numbered(dealt, id_col, [*cols, "_per", "_near"], "_per", seed).withColumn("_p", F.pmod(F.conv(F.substring("_h", 9, 8), 16, 10).cast("long"), F.col("_near")) + 1)
        out = out.unionByName(_between(df, made, near, id_col, cols, label, c))
    return out


def adasyn_counts(df: DataFrame, id_col: str, features: list[str], label: str, minority: int, k: int = 5) -> DataFrame:
    """(id, ratio, samples) of the minority rows: samples in proportion to the share of other classes among the k nearest."""
    lack = needed(df, label)[minority]
    rows = df.where(F.col(label) == minority)
    near = knn(rows, df, id_col, features, k).join(df.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("y")), "id")
    r = near.groupBy("query").agg(F.avg((F.col("y") != minority).cast("double")).alias("ratio"))
    total, n = r.agg(F.sum("ratio"), F.count("*")).first()
    share = F.col("ratio") / float(total) if total and total > 1e-10 else F.lit(1.0 / max(1, n))
    return r.select(F.col("query").alias("id"), "ratio", F.round(share * float(lack)).cast("long").alias("samples"))


def adasyn(df: DataFrame, id_col: str, features: list[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` (id, features, label) and new rows (null id) of every smaller class, as many at each row as ``adasyn_counts`` tells, towards one of its k nearest of the class."""
    out = df.select(id_col, *features, label)
    for c, lack in sorted(needed(df, label).items()):
        rows = df.where(F.col(label) == c).select(id_col, *features)
        n = rows.count()
        if not lack or n < 2:
            continue
        counts = adasyn_counts(df, id_col, features, label, c, k).where("samples > 0").select(F.col("id").alias("_a"), F.col("samples").cast("int").alias("_per"))
        dealt = materialize(rows.join(counts, F.col(id_col).cast("long") == F.col("_a")).drop("_a"), "adasyn")
        made = _numbered(dealt, id_col, [*features, "_per"], "_per", seed).withColumn("_p", F.pmod(F.conv(F.substring("_h", 9, 8), 16, 10).cast("long"), F.lit(min(k, n - 1))) + 1)
        out = out.unionByName(_between(df, made, knn(rows, rows, id_col, features, min(k, n - 1)), id_col, features, label, c))
    return out


def relief(df: DataFrame, id_col: str, features: list[str], target: str, k: int = 10) -> DataFrame:
    """(feature, score): RReliefF over every row's k nearest on features scaled to 0..1, weights falling with distance over the k-th."""
    b = df.agg(F.count("*"), F.min(target), F.max(target), *(f(c) for c in features for f in (F.min, F.max))).first()
    n, y0, y1 = b[0], float(b[1]), float(b[2])
    unit = {c: (F.col(c) - float(b[3 + 2 * j])) / max(float(b[4 + 2 * j]) - float(b[3 + 2 * j]), 1e-10) for j, c in enumerate(features)}
    scaled = df.select(F.col(id_col).cast("long").alias("i"), *(x.alias(c) for c, x in unit.items()), ((F.col(target) - y0) / max(y1 - y0, 1e-10)).alias("_to"))
    near = knn(scaled, scaled, "i", features, min(k, n - 1))
    far = near.groupBy("query").agg(F.max("d2").alias("s2"))
    w = F.when(F.col("s2") > 0, F.exp(-F.col("d2") / F.col("s2"))).otherwise(1.0)
    own = scaled.select(F.col("i").alias("query"), F.col("_to").alias("_from"), *(F.col(c).alias(f"q_{c}") for c in features))
    j = near.join(far, "query").withColumn("w", w).join(own, "query").join(scaled.withColumnRenamed("i", "id"), "id")
    total = j.groupBy("query").agg(F.sum("w").alias("t"))
    j = j.join(total, "query").withColumn("w", F.col("w") / F.col("t"))
    dy = F.abs(F.col("_to") - F.col("_from"))
    s = j.agg(F.sum(F.col("w") * dy).alias("c"), *(x for c in features for x in (F.sum(F.col("w") * F.abs(F.col(c) - F.col(f"q_{c}"))).alias(f"a_{c}"), F.sum(F.col("w") * dy * F.abs(F.col(c) - F.col(f"q_{c}"))).alias(f"b_{c}")))).first()
    out = []
    for c in features:
        pos, eq = s[f"b_{c}"], s[f"a_{c}"] - s[f"b_{c}"]
        out.append((c, float(pos / s["c"] - eq / (n - s["c"])) if 0 < s["c"] < n else 0.0))
    return df.sparkSession.createDataFrame(out, "feature string, score double")


def isolation_forest(df: DataFrame, id_col: str, features: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """(id, score, label): scores 2^(-mean path / c(n)) under trees grown on bounded samples; the share ``contamination`` is labelled 1.

    Each tree draws its own ``sample`` rows of all rows, by hash of row and tree in one pass, so at most
    about 1.5 * trees * sample rows reach the driver, where the trees grow; they go to every executor. Of a table of few
    rows all are drawn from, with replacement.
    """
    n = df.count()
    rng = np.random.default_rng(seed)
    size = min(sample, n)
    if n <= 8 * sample:
        rows = np.array(df.select(*features).orderBy(F.xxhash64(id_col, F.lit(seed))).collect(), float)
        pools = [rows[rng.integers(n, size=size)] for _ in range(trees)]
    else:
        top = int(min(1.0, 1.5 * sample / n) * 2**31)
        drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.col(id_col), t, F.lit(seed)), F.lit(2**31)) < top)
        some = df.select(*features, F.xxhash64(id_col).alias("_h"), F.explode(drawn).alias("_t")).orderBy("_t", "_h").collect()
        found: dict[int, list] = {}
        for r in some:
            found.setdefault(r["_t"], []).append([float(v) for v in r[: len(features)]])
        pools = [np.array(found[t], float)[rng.permutation(len(found[t]))[:size]] for t in range(trees) if t in found]
    cap = int(np.ceil(np.log2(max(2, size)))) + 2

    def c(m: int) -> float:
        return 0.0 if m <= 1 else 1.0 if m == 2 else 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m

    def grow(x: np.ndarray, depth: int):
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
        if depth >= cap or not len(spread):
            return c(len(x)) + depth
        f = int(rng.choice(spread))
        t = rng.uniform(x[:, f].min(), x[:, f].max())
        return f, t, grow(x[x[:, f] < t], depth + 1), grow(x[x[:, f] >= t], depth + 1)

    forest = df.sparkSession.sparkContext.broadcast([grow(p, 0) for p in pools])
    norm = max(c(size), 1e-9)

    def paths(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        out, left = np.empty(len(x)), x[:, tree[0]] < tree[1]
        out[left], out[~left] = paths(tree[2], x[left]), paths(tree[3], x[~left])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], 1)
            s = 2.0 ** (-np.mean([paths(t, x) for t in forest.value], axis=0) / norm)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["id", "score"])

    scored = df.select(F.col(id_col).cast("long").alias("id"), *features).mapInArrow(run, "id long, score double")
    return with_threshold(scored, contamination)


def with_threshold(scored: DataFrame, contamination: float) -> DataFrame:
    """``scored`` with label 1 at or above the score ranked ceil(n * contamination) from the top."""
    from sparkloom.functions.expr import prefix_sums

    g = scored.groupBy("score").agg(F.count("*").alias("c"))
    n = g.agg(F.sum("c")).first()[0] or 0
    rank = int(np.ceil(round(n * contamination, 9)))
    t = prefix_sums(g, "score", ["c"], desc=True).where(F.col("cum_c") >= max(1, rank)).agg(F.max("score")).first()[0]
    return scored.withColumn("label", (F.col("score") >= F.lit(t)).cast("int"))
