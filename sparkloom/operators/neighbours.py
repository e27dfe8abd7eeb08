"""Neighbours: exact top k in blocks, and radius joins over grid cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.expr import last_argmax, prefix_sums
from sparkloom.operators.components import connected_components
from sparkloom.storage import materialize


def floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _tree(sample: np.ndarray, leaf: int) -> list[tuple]:
    """A balanced tree over a sample: (axis, cut, left, right) of inner nodes, (-1, number) of leaves, in an array; boxes cover the whole space."""
    nodes: list[tuple] = []
    leaves = 0

    def build(rows: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(())
        spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(1)
        axis = int(spread.argmax())
        if len(rows) <= leaf or spread[axis] <= 0:
            nodes[at] = (-1, leaves)
            leaves += 1
            return at
        cut = float(np.median(rows[:, axis]))
        low = rows[:, axis] < cut
        if not low.any():
            cut = float(rows[rows[:, axis] > cut, axis].min())
            low = rows[:, axis] < cut
        nodes[at] = (axis, cut, build(rows[low]), build(rows[~low]))
        return at

    build(sample)
    return nodes


def _leaf_of(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int32)
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        n = nodes[at]
        if n[0] < 0:
            out[rows] = n[1]
        elif len(rows):
            low = x[rows, n[0]] < n[1]
            todo += [(n[2], rows[low]), (n[3], rows[~low])]
    return out


def _reached(nodes: list[tuple], x: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf whose box lies within each row's squared radius, by distances to the cuts on the way."""
    rows_out, leaf_out = [], []
    todo = [(0, np.arange(len(x)), np.zeros((len(x), x.shape[1])))]
    while todo:
        at, rows, gap = todo.pop()
        n = nodes[at]
        if not len(rows):
            continue
        if n[0] < 0:
            rows_out.append(rows)
            leaf_out.append(np.full(len(rows), n[1], np.int32))
            continue
        d = x[rows, n[0]] - n[1]
        for child, far in ((n[2], np.maximum(d, 0.0)), (n[3], np.maximum(-d, 0.0))):
            g = gap.copy()
            g[:, n[0]] = np.maximum(g[:, n[0]], far)
            keep = (g**2).sum(1) <= r2[rows]
            todo.append((child, rows[keep], g[keep]))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *rows_out]), np.concatenate([empty.astype(np.int32), *leaf_out])


def knn(queries: DataFrame, rows: DataFrame, id_col: str, features: list[str] | str, k: int, skip_self: bool = True, leaf: int = 2000, sample: int = 50_000, other_id: str | None = None) -> DataFrame:
    """(query, id, d2, place): the k nearest rows of each query by squared distance; ties by id. ``other_id`` names the rows' id column if it is another.

    Rows are dealt to the leaves of a balanced tree that is built on a bounded sample. A query first searches its own
    leaf; the k-th distance found there bounds which other leaves' boxes can hold nearer rows, and it visits only
    those. A leaf above ``leaf`` rows is cut into parts, each searched apart, and only k rows a query and part move on.
    """
    spark = queries.sparkSession
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(c).cast("double") for c in features))
    base = rows.select(F.col(other_id or id_col).cast("long").alias("id"), x.alias("x"))
    n = base.count()
    schema = "query long, id long, d2 double, place int"
    if not n:
        return spark.createDataFrame([], schema)
    # A whole table or a share of it by hash, which doesn't sort it.
    share = int(min(1.0, sample / n) * (2**64 - 1)) - 2**63
    some = base.where(F.xxhash64("id", F.lit(11)) <= min(share, 2**63 - 1)).select("x").limit(2 * sample).toArrow()["x"].to_pylist() or [base.first()["x"]]
    nodes = spark.sparkContext.broadcast(_tree(np.array(some, float), max(16, round(leaf * len(some) / n))))
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(_leaf_of(nodes.value, v))], ["id", "x", "cell"])

    held = materialize(base.mapInArrow(cells, "id long, x binary, cell int"), "cells")
    sizes = materialize(held.groupBy("cell").agg(F.ceil(F.count("*") / (2 * leaf)).cast("int").alias("parts")).where("parts > 1"), "large")
    # At most n / leaf cells are large.
    large = F.broadcast(sizes) if sizes.count() <= 200_000 else sizes
    one = F.coalesce("parts", F.lit(1))
    stored = held.join(large, "cell", "left").select("cell", F.pmod(F.xxhash64("id"), one).cast("int").alias("part"), F.lit(False).alias("ask"), "id", "x", F.lit(None).cast("double").alias("bound"))
    asked = materialize(queries.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).mapInArrow(cells, "id long, x binary, cell int"), "queries")

    def meet(asks: DataFrame) -> DataFrame:
        """(query, id, d2) of the k nearest rows of each part that a query visits."""
        visits = asks.join(large, "cell", "left").select("cell", F.explode(F.sequence(F.lit(0), one - 1)).alias("part"), F.lit(True).alias("ask"), "id", "x", "bound")
        units = stored.join(asks.select("cell").distinct(), "cell", "left_semi").unionAll(visits).repartition(ways, "cell", "part").sortWithinPartitions("cell", "part", "ask")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, ids, xs, qi, qx, qb = None, [], [], [], [], []

            def flush() -> Iterator[pa.RecordBatch]:
                if not ids or not qi:
                    return
                ic, c = np.array(ids, np.int64), np.frombuffer(b"".join(xs)).reshape(len(ids), -1)
                ia, a, bound = np.array(qi, np.int64), np.frombuffer(b"".join(qx)).reshape(len(qi), -1), np.array(qb, float)
                for lo in range(0, len(ia), 256):
                    p, who, most = a[lo : lo + 256], ia[lo : lo + 256], bound[lo : lo + 256]
                    d = np.zeros((len(p), len(c)))
                    for j in range(p.shape[1]):
                        d += (p[:, j, None] - c[None, :, j]) ** 2
                    if skip_self:
                        d[who[:, None] == ic[None, :]] = np.inf
                    d[d > most[:, None]] = np.inf
                    if d.shape[1] > 4 * k:
                        # All at the k-th distance stay, so that ties can go by id.
                        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
                        r, s = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
                    else:
                        r, s = np.nonzero(np.isfinite(d))
                    order = np.lexsort((ic[s], d[r, s], r))
                    r, s = r[order], s[order]
                    first = np.searchsorted(r, np.arange(len(p)))
                    keep = np.arange(len(r)) - first[r] < k
                    r, s = r[keep], s[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(who[r]), pa.array(ic[s]), pa.array(d[r, s])], ["query", "id", "d2"])

            for b in batches:
                for cell, part, ask, i, v, bound in zip(*(b.column(j).to_pylist() for j in range(6)), strict=True):
                    if (cell, part) != unit:
                        yield from flush()
                        unit, ids, xs, qi, qx, qb = (cell, part), [], [], [], [], []
                    if ask:
                        qi.append(i)
                        qx.append(v)
                        qb.append(np.inf if bound is None else bound)
                        if len(qi) >= 4096:
                            yield from flush()
                            qi, qx, qb = [], [], []
                    else:
                        ids.append(i)
                        xs.append(v)
            yield from flush()

        return units.mapInArrow(near, "query long, id long, d2 double")

    w = Window.partitionBy("query").orderBy("d2", "id")
    top = lambda df: df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    first = materialize(top(meet(asked.withColumn("bound", F.lit(None).cast("double")))), "first")
    reach = first.where(F.col("place") == k).select(F.col("query").alias("id"), F.col("d2").alias("bound"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                s = b.slice(lo, 1024)
                v = np.array([np.frombuffer(r) for r in s.column(1).to_pylist()]).reshape(s.num_rows, -1)
                bound = s.column(3).to_numpy(zero_copy_only=False).astype(float)
                far = np.where(np.isnan(bound), np.inf, bound)
                r, cell = _reached(nodes.value, v, far * (1 + 1e-9))
                own = s.column(2).to_numpy()
                r, cell = r[cell != own[r]], cell[cell != own[r]]
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(r)), s.column(1).take(pa.array(r)), pa.array(cell.astype(np.int32)), pa.array(far[r])], ["id", "x", "cell", "bound"])

    more = asked.join(reach, "id", "left").select("id", "x", "cell", "bound").mapInArrow(others, "id long, x binary, cell int, bound double")
    return top(first.select("query", "id", "d2").unionAll(meet(materialize(more, "visits"))))


def knn_classify(queries: DataFrame, rows: DataFrame, id_col: str, features: list[str] | str, label: str, n_classes: int, k: int = 5) -> DataFrame:
    """(query, predicted, probabilities): majority vote; ties go to the last class."""
    near = knn(queries, rows, id_col, features, k).join(rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("y")), "id")
    votes = near.groupBy("query").agg(*(F.avg((F.col("y") == c).cast("double")).alias(f"p{c}") for c in range(n_classes)))
    p = F.array(*(F.col(f"p{c}") for c in range(n_classes)))
    return votes.select("query", last_argmax(p).alias("predicted"), p.alias("probabilities"))


def knn_regress(queries: DataFrame, rows: DataFrame, id_col: str, features: list[str] | str, target: str, k: int = 5) -> DataFrame:
    near = knn(queries, rows, id_col, features, k).join(rows.select(F.col(id_col).cast("long").alias("id"), F.col(target).alias("y")), "id")
    return near.groupBy("query").agg(F.avg("y").alias("predicted"))


def dbscan(df: DataFrame, id_col: str, x: str, y: str, eps: float, min_pts: int) -> DataFrame:
    """(id, label): clusters numbered by their first core row; a border row takes the smallest cluster in reach; noise is -1.

    A neighbourhood holds the row itself. The plane is cut into cells of side eps / sqrt(2), whose rows all reach each
    other; a cell with ``min_pts`` rows has core rows only. So no pairs are kept: rows count their neighbours, cells with
    core rows within reach of each other are linked, and components are those of cells. A cell meets the 20 around it;
    what meets is dealt in parts of bounded size, so a dense cell is no single task.
    """
    side = eps / 2**0.5
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    pts = materialize(rows.where("x is not null and y is not null").select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy")), "points")
    sizes = materialize(pts.groupBy("cx", "cy").agg(F.count("*").alias("n")), "cells")
    around = F.expr("filter(flatten(transform(sequence(-2, 2), i -> transform(sequence(-2, 2), j -> struct(cx + i as cx, cy + j as cy)))), o -> abs(o.cx - cx) + abs(o.cy - cy) between 1 and 3)")


    def met(asks: DataFrame, held: DataFrame, found: str, kind: str, f) -> DataFrame:
        """What ``f`` gives of each cell's asking rows and the held rows of it, part by part."""
        parts = held.groupBy("cx", "cy").agg(F.ceil(F.count("*") / 4000).cast("int").alias("parts"))
        held = held.join(parts, ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("cx", "cy", "part", F.lit(False).alias("ask"), "id", "x", "y", found)
        asks = asks.join(parts, ["cx", "cy"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("cx", "cy", "part", F.lit(True).alias("ask"), "id", "x", "y", F.lit(None).cast("long").alias(found))
        ways = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        units = held.unionAll(asks).repartition(ways, "cx", "cy", "part").sortWithinPartitions("cx", "cy", "part", "ask")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, own, todo = None, [], []

            def flush() -> Iterator[pa.RecordBatch]:
                if own and todo:
                    h, a = np.array([r[1:3] for r in own], float), np.array([r[1:3] for r in todo], float)
                    ids, values = np.array([r[0] for r in todo], np.int64), np.array([r[3] for r in own], np.int64)
                    for lo in range(0, len(a), 512):
                        dx, dy = a[lo : lo + 512, None, 0] - h[None, :, 0], a[lo : lo + 512, None, 1] - h[None, :, 1]
                        near = np.sqrt(dx * dx + dy * dy) <= eps
                        got = f(near, values)
                        keep = near.any(1)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 512][keep]), pa.array(got[keep])], ["id", "found"])

            for b in batches:
                for cx, cy, part, ask, i, u, v, w in zip(*(b.column(j).to_pylist() for j in range(8)), strict=True):
                    if (cx, cy, part) != unit:
                        yield from flush()
                        unit, own, todo = (cx, cy, part), [], []
                    if ask:
                        todo.append((i, u, v, w))
                        if len(todo) >= 4096:
                            yield from flush()
                            todo = []
                    else:
                        own.append((i, u, v, w))
            yield from flush()

        return units.mapInArrow(run, f"id long, found {kind}")

    reach = lambda df: df.withColumn("o", F.explode(around)).select("id", "x", "y", F.col("o.cx").alias("cx"), F.col("o.cy").alias("cy"))
    # Rows of cells that are not core as a whole count their neighbours in the cells around.
    sparse = pts.join(sizes.where(F.col("n") < min_pts), ["cx", "cy"])
    counts = met(reach(sparse), pts.withColumn("one", F.lit(1).cast("long")), "one", "long", lambda near, values: near.sum(1)).groupBy("id").agg(F.sum("found").alias("m"))
    core = sparse.join(counts, "id", "left").where(F.col("n") + F.coalesce("m", F.lit(0)) >= min_pts).select("id", "x", "y", "cx", "cy")
    core = materialize(core.unionAll(pts.join(sizes.where(F.col("n") >= min_pts).select("cx", "cy"), ["cx", "cy"], "left_semi").select("id", "x", "y", "cx", "cy")), "core")
    # A cell's core rows are one node, that of the smallest id; links go from core rows to the nodes of cells around.
    nodes = materialize(core.groupBy("cx", "cy").agg(F.min("id").alias("node")), "nodes")
    held = core.join(nodes, ["cx", "cy"])
    links = met(reach(core), held, "node", "long", lambda near, values: np.where(near, values, np.iinfo(np.int64).max).min(1))
    links = links.join(held.select("id", F.col("node").alias("own")), "id").where("own <> found").select("own", "found").distinct()
    comp = connected_components(links, "own", "found")
    core = materialize(held.join(comp, "node", "left").select("id", "x", "y", "cx", "cy", F.coalesce("component", "node").alias("first")), "labels")
    # Clusters are numbered by ranges of their first rows.
    first = core.select("first").distinct().withColumn("one", F.lit(1))
    number = prefix_sums(first, "first", ["one"]).select("first", (F.col("cum_one") - 1).cast("long").alias("cluster"))
    core = materialize(core.join(number, "first"), "clusters")
    rest = pts.join(core.select("id"), "id", "left_anti")
    both = reach(rest).unionAll(rest.select("id", "x", "y", "cx", "cy"))
    border = met(both, core, "cluster", "long", lambda near, values: np.where(near, values, np.iinfo(np.int64).max).min(1)).groupBy("id").agg(F.min("found").alias("reach"))
    return rows.select("id").join(core.select("id", "cluster"), "id", "left").join(border, "id", "left").select("id", F.coalesce("cluster", "reach", F.lit(-1)).cast("int").alias("label"))


def silhouette(df: DataFrame, id_col: str, features: list[str], label: str) -> DataFrame:
    """(silhouette): mean over rows; a cluster of one counts 0, noise (-1) is left out.

    Every row meets every other, by definition. Rows are dealt into p groups on either side, so a row is sent 2 p times for p * p
    units of work, and a unit gives sums by row and cluster, never pairs. A group has at most about 50,000 rows.
    """
    live = df.where(F.col(label) >= 0)
    sizes = {r[0]: r[1] for r in live.groupBy(label).count().collect()}
    clusters, n = sorted(sizes), sum(sizes.values())
    spark = df.sparkSession
    groups = max(1, min(-(-n // 512), max(int((4 * spark.sparkContext.defaultParallelism) ** 0.5), -(-n // 50_000))))
    rows = live.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("own"), F.array(*(F.col(c).cast("double") for c in features)).alias("x"))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id", "x"), F.lit(groups)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    side = lambda i, j, ask: rows.select(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(ask).alias("ask"), "id", "own", "x")
    units = side("g", "o", True).unionAll(side("o", "g", False)).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(groups * groups, 2000)), "i", "j").sortWithinPartitions("i", "j", "ask")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, asked = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if held and asked:
                v, of = np.array([r[2] for r in held], float), np.array([r[1] for r in held])
                u = np.array([r[2] for r in asked], float)
                total = np.zeros((len(u), len(clusters)))
                for lo in range(0, len(v), 4096):
                    part = v[lo : lo + 4096]
                    d = np.zeros((len(u), len(part)))
                    for k in range(u.shape[1]):
                        gap = u[:, k, None] - part[None, :, k]
                        d += gap * gap
                    d = np.sqrt(d)
                    for c, cluster in enumerate(clusters):
                        total[:, c] += d[:, of[lo : lo + 4096] == cluster].sum(1)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in asked], pa.int64()), pa.array([r[1] for r in asked], pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["id", "own", "sums"])

        for b in batches:
            for i, j, ask, row, own, x in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (i, j) != unit:
                    yield from flush()
                    unit, held, asked = (i, j), [], []
                (asked if ask else held).append((row, own, x))
                if len(asked) >= 512:
                    yield from flush()
                    asked = []
        yield from flush()

    got = units.mapInArrow(sums, "id long, own long, sums array<double>")
    per = got.groupBy("id", "own").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(clusters))))
    own = F.coalesce(*(F.when(F.col("own") == c, F.col(f"s{i}") / float(max(1, sizes[c] - 1))) for i, c in enumerate(clusters)))
    other = F.least(*(F.when(F.col("own") != c, F.col(f"s{i}") / float(sizes[c])) for i, c in enumerate(clusters)))
    alone = F.coalesce(*(F.when(F.col("own") == c, F.lit(sizes[c] == 1)) for c in clusters))
    top = F.greatest(own, other)
    return per.select(F.when(alone | (top == 0), 0.0).otherwise((other - own) / top).alias("s")).agg(F.avg("s").alias("silhouette"))


def kmeans_step(df: DataFrame, features: list[str], centres: list[list[float]]) -> DataFrame:
    """(cluster, n, features...): one Lloyd step, assignments by Column arithmetic and new means by one aggregate."""
    d = [sum(((F.col(c) - float(m)) * (F.col(c) - float(m)) for c, m in zip(features, centre, strict=True)), F.lit(0.0)) for centre in centres]
    own = (F.array_position(F.array(*d), F.array_min(F.array(*d))) - 1).cast("int")
    return df.select(own.alias("cluster"), *features).groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in features))


def kmeans(df: DataFrame, features: list[str], k: int, max_iter: int = 300, tol: float = 1e-9, seed: int = 42, n_init: int = 10, sample: int = 4096) -> tuple[list[list[float]], DataFrame]:
    """Centres and ``df`` with label: the best of ``n_init`` starts by inertia.

    Each start seeds by k-means++ on a bounded sample of its own and takes Lloyd steps over all rows; the steps of all
    starts share a pass, which also sums the inertia and finds each start's farthest row, where an empty cluster begins again.
    """
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in features))
    n = rows.count()
    starts: list[np.ndarray] = []
    for r in range(n_init):
        rng = np.random.default_rng(seed + r)
        share = int(min(1.0, 2 * sample / max(1, n)) * (2**64 - 1)) - 2**63
        h = F.xxhash64(*features, F.lit(seed + r))
        some = np.array(rows.where(h <= min(share, 2**63 - 1)).orderBy(h).limit(sample).collect() or [rows.first()], float)
        centres = [some[rng.integers(len(some))]]
        while len(centres) < min(k, len(some)):
            d = np.min([((some - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(some[rng.choice(len(some), p=d / d.sum())] if d.sum() > 0 else some[rng.integers(len(some))])
        starts.append(np.array(centres))
    live = set(range(n_init))
    inertia = np.full(n_init, np.inf)
    p = len(features)

    def step(order: list[int], centres: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(c), p + 1)) for c in centres]
            cost, far, where = np.zeros(len(centres)), np.full(len(centres), -1.0), np.zeros((len(centres), p))
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.stack([floats(c) for c in b.columns], 1)
                for i, c in enumerate(centres):
                    d = np.stack([((x - m) ** 2).sum(1) for m in c], 1)
                    own = d.argmin(1)
                    near = d[np.arange(len(x)), own]
                    for j in range(p):
                        total[i][:, j] += np.bincount(own, x[:, j], len(c))
                    total[i][:, p] += np.bincount(own, minlength=len(c))
                    cost[i] += near.sum()
                    if near.max() > far[i]:
                        far[i], where[i] = near.max(), x[near.argmax()]
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int32()), pa.array([t.tobytes() for t in total], pa.binary()), pa.array(cost), pa.array(far), pa.array(where.tolist(), pa.list_(pa.float64()))], ["start", "total", "cost", "far", "place"])

        got = rows.mapInArrow(run, "start int, total binary, cost double, far double, place array<double>").collect()
        for i, c in zip(order, centres, strict=True):
            mine = [r for r in got if r["start"] == i]
            total = sum(np.frombuffer(r["total"]).reshape(len(c), p + 1) for r in mine)
            new = np.where(total[:, p :] > 0, total[:, :p] / np.maximum(total[:, p:], 1), c)
            farthest = max(mine, key=lambda r: (r["far"], r["place"]))
            for j in np.flatnonzero(total[:, p] == 0):
                new[j] = farthest["place"]
            yield i, new, sum(r["cost"] for r in mine)

    for _ in range(max_iter):
        order = sorted(live)
        for i, new, cost in step(order, [starts[i] for i in order]):
            moved = float(((new - starts[i]) ** 2).sum(1).max())
            starts[i], inertia[i] = new, cost
            if moved <= tol:
                live.discard(i)
        if not live:
            break
    best = starts[int(inertia.argmin())]
    d = [sum(((F.col(c) - float(m)) * (F.col(c) - float(m)) for c, m in zip(features, centre, strict=True)), F.lit(0.0)) for centre in best]
    return [c.tolist() for c in best], df.withColumn("label", (F.array_position(F.array(*d), F.array_min(F.array(*d))) - 1).cast("int"))
