"""Near-duplicate embeddings over an inverted multi-index.

Vectors are scaled to length 1 and cut into halves. Two independent codebooks, learned by k-means on at most
``sample`` vectors, put each half into a cell, so every vector lies in one cell of the product grid. A vector
visits cells in the order of the sum of both halves' squared distances (multi-sequence traversal) until the
distance above its own cell's passes ``reach``. The reach is calibrated on the sample: each sampled vector is
turned by exactly the threshold's angle in random directions, and the reach is what the share ``recall`` of the
turned copies needs; closer copies need less. Pairs are verified by cosine in double precision.

Equal vectors of a label are one node with a weight, so copies are neither indexed nor compared. A pair counts if
either vector visits the other's cell. Pairs are compared where the visitor meets the cell's members; a unit of work
is a label, a cell and a block of its members and of its visitors, so a cell with very many vectors is many units.
Whether the way back also visits is decided there for the links found, so each link is counted once for each of its
vectors, by the other's weight, and a unit emits counts and a spanning forest, never its pairs. Vectors travel as
they came, single components as four bytes, and are scaled in double precision where they arrive.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing, nor
does one with a null label or of another length than its partner; vectors of an odd length have halves that differ
by one; repeated ids are vectors of their own that share the id (a null id likewise, as the smallest); columns
besides the three are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, connected_components, forest, materialize, partitions


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """At most k centres."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each half to each centre, less the smallest."""
    d = (c**2).sum(1) - 2 * x @ c.T
    return d - d.min(axis=1, keepdims=True)


class MultiIndex:
    """Codebooks of both halves and the calibrated reach."""

    def __init__(self, sample: np.ndarray, threshold: float, recall: float, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        a, b = sample[:, : self.half], sample[:, self.half :]
        self.books = (kmeans(a, size, rng), kmeans(b, size, rng))
        # Small samples are turned more than once.
        sample = np.tile(sample, (-(-4096 // len(sample)), 1))
        n = len(sample)
        noise = rng.standard_normal((n, sample.shape[1]))
        noise -= (noise * sample).sum(1, keepdims=True) * sample
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        turned = threshold * sample + np.sqrt(1 - threshold**2) * noise
        d1, d2 = self.spread(sample)
        i, j = self.cells(turned)
        self.reach = float(np.quantile(d1[np.arange(n), i] + d2[np.arange(n), j], recall)) + 1e-9

    def spread(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d1, d2 = self.spread(x)
        return d1.argmin(1), d2.argmin(1)

    def visited(self, d1: np.ndarray, d2: np.ndarray) -> Iterator[int]:
        """Cells of one vector in the order of their distance, by the multi-sequence algorithm, until the reach is passed."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        width = len(s2)
        heap, pushed = [(s1[0] + s2[0], 0, 0)], {(0, 0)}
        while heap:
            far, i, j = heapq.heappop(heap)
            if far > self.reach:
                return
            yield int(o1[i]) * width + int(o2[j])
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(s1) and q < width and (p, q) not in pushed:
                    pushed.add((p, q))
                    heapq.heappush(heap, (s1[p] + s2[q], p, q))

    def reaches(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether each vector visits the cell beside it."""
        d1, d2 = self.spread(x)
        at, width = np.arange(len(x)), d2.shape[1]
        return d1[at, cell // width] + d2[at, cell % width] <= self.reach


def packed_vectors(df: DataFrame, vec_col: str, kind: str) -> DataFrame:
    """``df`` (id, label, vec_col) with vec, the components of type ``kind`` as bytes; null where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(2).to_pylist():
                v = None
                if x and None not in x:
                    # Zeros of either sign are one zero.
                    v = np.array(x, kind) + np.zeros(1, kind)
                    v = v if np.isfinite(v).all() and v.any() else None
                out.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["id", "label", "vec"])

    return df.select("id", "label", vec_col).mapInArrow(run, "id long, label int, vec binary")


def unit_vectors(blobs: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length 1 in double precision. Each is scaled by its largest component first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *, threshold: float = 0.93, recall: float = 0.995, sample: int = 8192, block: int = 2048, seed: int = 7, broadcast_rows: int = 200_000) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    kind = "<f4" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    vec = F.col(vec_col) if kind == "<f4" else F.col(vec_col).cast("array<double>")
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(label_col).cast("int").alias("label"), vec.alias("_v"))
    flat = materialize(packed_vectors(rows, "_v", kind).withColumn("key", F.unhex(F.md5("vec"))), "vectors")
    live = flat.where("vec is not null and label is not null").groupBy("label", "key").agg(F.first("vec").alias("vec"), F.count("*").alias("m"), F.min("id").alias("least"))
    live = materialize(live.withColumn("dim", F.octet_length("vec")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = counts = None
    for r in live.groupBy("dim").agg(F.count("*").alias("count"), F.approx_count_distinct("label").alias("labels")).collect():
        part = live.where(F.col("dim") == r["dim"]).select("node", "label", "vec", "m")
        pick = unit_vectors([bytes(x[0]) for x in part.orderBy(F.xxhash64("vec", F.lit(seed)), "node").select("vec").limit(sample).collect()], kind)
        found = materialize(_links(part, pick, r["count"] // max(1, r["labels"]), threshold, recall, block, seed, kind), "links")
        edges = found.where("b is not null").select("a", "b") if edges is None else edges.unionAll(found.where("b is not null").select("a", "b"))
        c = found.where("b is null").select("a", "n")
        counts = c if counts is None else counts.unionAll(c)
    shown = lambda c: F.when(c != NULL_ID, c)
    if edges is None:
        return flat.select(shown(F.col("id")).alias("id"), F.lit(0).cast("long").alias("n_links"), shown(F.col("id")).alias("component_id"), F.lit(True).alias("kept"))
    counts = counts.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comp = connected_components(edges, "a", "b")
    nodes = live.select("label", "key", "node", "least", "m").join(counts, "node", "left").join(comp, "node", "left")
    nodes = nodes.select("label", "key", "least", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("group"))
    nodes = nodes.join(nodes.groupBy("group").agg(F.min("least").alias("component")), "group").select("label", "key", "n_links", "component")
    nodes = materialize(nodes, "members")
    out = flat.select("id", "label", "key").join(F.broadcast(nodes) if nodes.count() <= broadcast_rows else nodes, ["label", "key"], "left")
    of = F.coalesce("component", "id")
    return out.select(shown(F.col("id")).alias("id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), shown(of).alias("component_id"), (F.col("id") == of).alias("kept"))


def _links(part: DataFrame, pick: np.ndarray, n: int, threshold: float, recall: float, block: int, seed: int, kind: str) -> DataFrame:
    """(a, b, n): forest edges (n null) and link counts of a node (b null). ``n`` is the mean number of vectors of a label: a cell of one label holds about 64."""
    spark = part.sparkSession
    size = int(np.clip(round((n / 64) ** 0.5), 2, 1024))
    if pick.shape[1] < 2:
        pick = np.pad(pick, ((0, 0), (0, 1)))
    shared = spark.sparkContext.broadcast(MultiIndex(pick, threshold, recall, size, seed))
    pad = pick.shape[1]

    def vectors(blobs: list[bytes]) -> np.ndarray:
        x = unit_vectors(blobs, kind)
        return np.pad(x, ((0, 0), (0, pad - x.shape[1]))) if x.shape[1] < pad else x

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if b.num_rows:
                i, j = m.cells(vectors(b.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((i * len(m.books[1]) + j).astype(np.int32))], ["node", "label", "vec", "m", "own"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                d1, d2 = m.spread(vectors(s.column(2).to_pylist()))
                cells = [list(m.visited(p, q)) for p, q in zip(d1, d2, strict=True)]
                at = pa.array(np.repeat(np.arange(len(cells)), [len(c) for c in cells]))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in s.columns), pa.array([c for x in cells for c in x], pa.int32())], ["node", "label", "vec", "m", "own", "cell"])

    members = materialize(part.mapInArrow(own, "node long, label int, vec binary, m long, own int"), "cells")
    visits = members.mapInArrow(visit, "node long, label int, vec binary, m long, own int, cell int")
    # Cells above the block size are listed: at most n / block of them.
    full = materialize(members.groupBy("label", F.col("own").alias("cell")).count().where(F.col("count") > block).select("label", "cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "full")
    full = F.broadcast(full) if full.count() <= 100_000 else full
    one = F.coalesce("blocks", F.lit(1))
    part_of = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), one).cast("int")
    # A full cell's members go to some blocks, its visitors to as many others; each member block meets each visitor block.
    to_m = members.withColumn("cell", F.col("own")).join(full, ["label", "cell"], "left").select("label", "cell", part_of(1).alias("mblock"), F.explode(F.sequence(F.lit(0), one - 1)).alias("vblock"), F.lit(False).alias("visits"), "node", "own", "m", "vec")
    to_v = visits.join(full, ["label", "cell"], "left").select("label", "cell", F.explode(F.sequence(F.lit(0), one - 1)).alias("mblock"), part_of(2).alias("vblock"), F.lit(True).alias("visits"), "node", "own", "m", "vec")
    units = to_m.unionAll(to_v).repartition(partitions(spark), "label", "cell", "mblock", "vblock").sortWithinPartitions("label", "cell", "mblock", "vblock", "visits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def unit(node: np.ndarray, home: np.ndarray, weight: np.ndarray, x: np.ndarray, visits: np.ndarray) -> tuple[np.ndarray, ...]:
            mem, vis = np.flatnonzero(~visits), np.flatnonzero(visits)
            a, b, times = [], [], np.zeros(len(node), np.int64)
            for lo in range(0, len(vis), 1024):
                v = vis[lo : lo + 1024]
                p, q = np.nonzero(x[v] @ x[mem].T >= threshold)
                p, q = v[p], mem[q]
                keep = node[p] != node[q]
                p, q = p[keep], q[keep]
                if not len(p):
                    continue
                # The visitor counts its link here; the member counts it here if it does not itself visit the visitor's cell.
                only = ~m.reaches(x[q], home[p])
                np.add.at(times, p, weight[q])
                np.add.at(times, q[only], weight[p[only]])
                u, w = forest(node[p], node[q])
                a.append(u)
                b.append(w)
            if not a:
                return ()
            u, w = forest(np.concatenate(a), np.concatenate(b))
            at = np.flatnonzero(times)
            ids, inverse = np.unique(node[at], return_inverse=True)
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, inverse, times[at])
            return u, w, ids, total

        held: list | None = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)] + [np.array(batch.column(8).to_pylist(), object)]
            cols = [np.concatenate([p, q]) for p, q in zip(held, cols, strict=True)] if held is not None else cols
            if not len(cols[0]):
                continue
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            cuts = [0, *new.tolist()]
            yield from emit(cols, cuts, unit)
            held = [c[cuts[-1] :] for c in cols]
        if held is not None and len(held[0]):
            yield from emit(held, [0, len(held[0])], unit)

    def emit(cols, cuts, unit) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            visits = cols[4][lo:hi].astype(bool)
            if visits.all() or not visits.any():
                continue
            if got := unit(*(cols[k][lo:hi].astype(np.int64) for k in (5, 6, 7)), vectors(cols[8][lo:hi].tolist()), visits):
                u, w, ids, times = got
                a += [*u.tolist(), *ids.tolist()]
                b += [*w.tolist(), *[None] * len(ids)]
                n += [*[None] * len(u), *times.tolist()]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return units.mapInArrow(compare, "a long, b long, n long")


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links, component and keep flag of every vector: equal labels, cosine 0.93 or more."""
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumnRenamed("id", "vec_id")


#: What op2_embeddings returns where every link is found, for vectors without nulls.
OP2_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93::DOUBLE),
 r AS (SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT r.n, l.b FROM r JOIN l ON l.a = r.m),
 c AS (SELECT n, min(m) AS component_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
 SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.n = vec_id LEFT JOIN k ON k.a = vec_id"""
