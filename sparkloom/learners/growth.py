"""Trees on binned features: rows in blocks, sums by node, feature and bin, and growth by level, by leaf or by oblivious levels.

Rows are binned once to a byte a feature and packed into blocks. Growing asks one thing of them: the sums of a few
channels (gradients, class weights, counts) for each node, feature and bin. Rows that are equal to the learner are one row
with a count and a summed weight, where that halves them. Two stores answer: one in memory for tables
of up to ``local_cells`` cells and LOCAL bytes, one over Spark, where each task sums its blocks and only nodes x features x bins sums
reach the driver, whatever the number of rows. Of two siblings the smaller is asked for and the other is its parent less
it. Both stores run the same growth code on the same blocks, so the trees are the same. Missing values are the bin 255.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.expr import present
from sparkloom.functions.passes import TYPES
from sparkloom.storage import materialize

MISSING = 255
BLOCKS = "n int, x binary, y binary, w binary, m binary, e binary, c binary"
#: Bytes of blocks that the driver holds, and that a task reads; rows that are summed at a time.
LOCAL, TASK, STEP = 1 << 26, 1 << 25, 1 << 18
#: Bytes of sums that are kept to take siblings from their parents, and that are asked for at a time.
KEPT, ASKED = 1 << 28, 1 << 26
#: Combinations of bins that the rows of a tree are summed to on the driver; so many of them go together over Spark.
COMBINED, CHUNK = 1 << 21, 1 << 14


@dataclass
class Tree:
    """Nodes in arrays: feature (-1 a leaf), bin (lower bins go left), bins (those that go left, for categories), side of missing values, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    bins: list[list[int] | None] = field(default_factory=lambda: [None])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for a, v in ((self.feature, -1), (self.bin, 0), (self.bins, None), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.gain, 0.0)):
            a.append(v)
        return len(self.feature) - 1

    def split(self, node: int, at: Split) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.bins[node], self.missing_left[node], self.gain[node] = at.feature, at.bin, at.bins, at.missing_left, at.gain
        self.left[node], self.right[node] = self.add(), self.add()
        return self.left[node], self.right[node]

    def goes_left(self, node: int | None = None) -> np.ndarray:
        """(nodes, 256) or, of one node, (256): whether a bin goes left."""
        nodes = range(len(self.feature)) if node is None else [node]
        out = np.arange(256) < np.array([self.bin[i] for i in nodes])[:, None]
        for row, i in zip(out, nodes, strict=True):
            if self.bins[i] is not None:
                row[:] = False
                row[self.bins[i]] = True
            row[MISSING] = self.missing_left[i]
        return out if node is None else out[0]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_masks"}

    def masks(self) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]] | None:
        """The leaves from left to right, and for each feature in use the leaves (bits) that each of its bins leaves possible; None beyond 64 leaves.

        A row that goes right at a node can't reach the leaves under its left child. The first leaf that all features leave is the row's.
        """
        n = len(self.feature)
        if getattr(self, "_masks", (0,))[0] != n:
            below, leaves, todo = {}, [], [(0, False)]
            while todo:
                i, done = todo.pop()
                if self.feature[i] < 0:
                    below[i] = 1 << len(leaves)
                    leaves.append(i)
                elif done:
                    below[i] = below[self.left[i]] | below[self.right[i]]
                else:
                    todo += [(i, True), (self.right[i], False), (self.left[i], False)]
            kind = np.uint32 if len(leaves) <= 32 else np.uint64
            table: dict[int, np.ndarray] = {}
            if len(leaves) <= 64:
                every = (1 << kind(0).nbytes * 8) - 1
                go = self.goes_left()
                for i in below:
                    if (f := self.feature[i]) >= 0:
                        part = np.where(go[i], kind(every), kind(every ^ below[self.left[i]]))
                        table[f] = table[f] & part if f in table else part
            self._masks = n, (np.array(leaves, np.int32), sorted(table.items())) if len(leaves) <= 64 else None
        return self._masks[1]

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row of x (features, rows)."""
        if self.feature[0] >= 0 and (found := self.masks()):
            leaves, ((f, t), *more) = found
            left = t[x[f]]
            for f, t in more:
                left &= t[x[f]]
            # The lowest bit is a power of two, whose exponent the floating form holds.
            left &= ~left + left.dtype.type(1)
            place = left.astype(np.float32).view(np.int32) >> 23 if left.dtype == np.uint32 else left.astype(np.float64).view(np.int64) >> 52
            return leaves[place - (127 if left.dtype == np.uint32 else 1023)]
        at = np.zeros(x.shape[1], np.int32)
        feature, left, right, mask = np.array(self.feature), np.array(self.left, np.int32), np.array(self.right, np.int32), self.goes_left()
        live = np.arange(x.shape[1]) if feature[0] >= 0 else np.zeros(0, np.int64)
        while len(live):
            n = at[live]
            n = np.where(mask[n, x[feature[n], live]], left[n], right[n])
            at[live] = n
            live = live[feature[n] >= 0]
        return at

    def depth(self) -> int:
        out = [0] * len(self.feature)
        for i in range(len(self.feature)):
            if self.left[i] >= 0:
                out[self.left[i]] = out[self.right[i]] = out[i] + 1
        return max(out)


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    bins: list[int] | None
    left: np.ndarray
    right: np.ndarray


class View:
    """Binned rows: x (features, rows), y, w, margins m (outputs, rows), extra columns e (columns, rows); parts are (block, rows).

    c is the number of equal rows that a row stands for, None for 1 everywhere; w is then their summed weight.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, m: np.ndarray, e: np.ndarray, parts: list[tuple[int, int]], c: np.ndarray | None = None):
        self.x, self.y, self.w, self.m, self.e, self.parts, self.c = x, y, w, m, e, parts, c
        self.n = len(y)

    @classmethod
    def joined(cls, views: list[View]) -> View:
        if len(views) == 1:
            return views[0]
        join = lambda f: np.concatenate([f(v) for v in views], axis=-1)
        c = None if all(v.c is None for v in views) else join(lambda v: np.ones(v.n) if v.c is None else v.c)
        return cls(join(lambda v: v.x), join(lambda v: v.y), join(lambda v: v.w), join(lambda v: v.m), join(lambda v: v.e), [p for v in views for p in v.parts], c)

    def random(self, *key: int) -> np.ndarray:
        """A share in [0, 1) for each row, given by the key, the row's block and its place there."""
        return np.concatenate([np.zeros(0), *(np.random.default_rng([*key, b]).random(n) for b, n in self.parts)])

    def poisson(self, mean: float, *key: int) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(np.random.default_rng([*key, b]).poisson(mean, n).astype(float) for b, n in self.parts)])

    def binomial(self, of: np.ndarray, share: float, *key: int) -> np.ndarray:
        """Of ``of`` equal rows the number taken if each is taken with ``share``."""
        ends = np.cumsum([n for _, n in self.parts])
        return np.concatenate([np.zeros(0), *(np.random.default_rng([*key, b]).binomial(of[e - n : e].astype(np.int64), share).astype(float) for (b, n), e in zip(self.parts, ends, strict=True))])


@dataclass
class Coded:
    """Channels that are sums over codes 0 to ``size`` - 1 of the rows: weights are summed by code, and the store's ``expand`` gives channels of them."""

    code: np.ndarray
    size: int
    weight: np.ndarray


#: Channels of a view for a tree's key: arrays to sum (None counts rows), the last a count, or codes; and the rows in use, or None for all.
Channels = Callable[[View, tuple], tuple[list[np.ndarray | None] | Coded, np.ndarray | None]]


def view_of(b: pa.RecordBatch, i: int) -> View:
    n = b["n"][i].as_py()
    num = lambda c: np.frombuffer(b[c][i].as_buffer(), np.float64)
    c = num("c")
    return View(np.frombuffer(b["x"][i].as_buffer(), np.uint8).reshape(-1, n), num("y"), num("w"), num("m").reshape(-1, n), num("e").reshape(-1, n), [(b["block"][i].as_py(), n)], c if len(c) else None)


def bin_edges(df: DataFrame, features: list[str], n_bins: int, categories: dict[str, int] | None = None) -> list[np.ndarray | None]:
    """Cut values of each feature: between distinct values if they are few, else approximate quantiles; None for a category, whose bin is its code. One aggregate for all."""
    cats = {c for c, n in (categories or {}).items() if n < MISSING}
    plain = [c for c in features if c not in cats]
    few = df.agg(*(F.approx_count_distinct(present(c)) for c in plain)).first() if plain else []
    small = [c for c, k in zip(plain, few, strict=True) if k <= n_bins // 2]
    large = [c for c in plain if c not in small]
    found = [F.array_sort(F.collect_set(present(c))) for c in small] + [F.percentile_approx(present(c), [i / n_bins for i in range(1, n_bins)], 10 * n_bins) for c in large]
    got = df.agg(*(v.alias(f"e{i}") for i, v in enumerate(found))).first() if found else []
    values = dict(zip([*small, *large], got, strict=True))
    out: list[np.ndarray | None] = []
    for c in features:
        if c in cats:
            out.append(None)
            continue
        v = np.unique(np.array(values[c] or [], float))
        out.append((v[1:] + v[:-1]) / 2 if c in small else v)
    return out


def binned(columns: list[np.ndarray], cuts: list[np.ndarray | None]) -> np.ndarray:
    """(features, rows) of bins; an unknown category is missing."""
    x = np.full((len(cuts), len(columns[0]) if columns else 0), MISSING, np.uint8)
    for row, v, c in zip(x, columns, cuts, strict=True):
        ok = ~np.isnan(v)
        if c is None:
            ok &= (v >= 0) & (v < MISSING)
            row[ok] = v[ok].astype(np.uint8)
        else:
            row[ok] = np.searchsorted(c, v[ok], "right")
    return x


def floats(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def pack(df: DataFrame, features: list[str], cuts: list[np.ndarray | None], y: Column, w: Column, start: list[float], extra: list[Column] | None = None, merge: str | None = None) -> DataFrame:
    """Blocks of binned rows of positive weight, written once; margins begin at ``start``.

    ``merge``: "rows" makes rows of equal features, target and weight one row with their count and the sum of their weights;
    "features" asks for equal features only, and the target becomes the mean by weight, which serves sums that are linear in it.
    Tables where that would not halve the rows stay as they are.
    """
    p, q = len(features), len(extra or [])
    rows = df.select(*(present(c).alias(f"f{i}") for i, c in enumerate(features)), y.cast("double").alias("y"), w.cast("double").alias("w"), *(c.cast("double").alias(f"e{i}") for i, c in enumerate(extra or []))).where("w > 0")
    counted = False
    if merge:
        keys = [*(f"f{i}" for i in range(p)), *(["y", "w"] if merge == "rows" else [])]
        n, kinds = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*(F.coalesce(F.col(k), F.lit(float("nan"))) for k in keys)))).first()
        counted = 2 * kinds <= n
        if counted:
            target = F.col("y") if merge == "rows" else F.sum(F.col("w") * F.col("y")) / F.sum("w")
            one = rows.groupBy(*keys).agg(target.alias("_y"), F.sum("w").alias("_w"), F.count("*").cast("double").alias("c"))
            rows = one.select(*(f"f{i}" for i in range(p)), F.col("_y").alias("y"), F.col("_w").alias("w"), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = binned([floats(b.column(i)) for i in range(p)], cuts)
            m = np.repeat(np.array(start, float)[:, None], n, axis=1)
            e = np.stack([floats(b.column(p + 2 + i)) for i in range(q)]) if q else np.zeros((0, n))
            cells = [x, floats(b.column(p)), floats(b.column(p + 1)), m, e, floats(b.column(p + 2)) if counted else np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], ["n", "x", "y", "w", "m", "e", "c"])

    return materialize(rows.mapInArrow(run, BLOCKS).withColumn("block", F.monotonically_increasing_id()), "blocks")


def sums(x: np.ndarray, node: np.ndarray, nodes: list[int], channels: list[np.ndarray | None] | Coded, rows: np.ndarray | None) -> np.ndarray:
    """(nodes, features, 256, channels or codes) sums of the rows that are in ``nodes``."""
    slot = np.full(max(*nodes, int(node.max()) if len(node) else 0, 0) + 1, -1)
    slot[nodes] = np.arange(len(nodes))
    k = slot[node]
    use = k >= 0
    if rows is not None:
        use &= rows
    at = np.flatnonzero(use)
    k, n = k[at] * 256, len(nodes) * 256
    if isinstance(channels, Coded):
        code, weight, size = channels.code[at], channels.weight[at], channels.size
        return np.stack([np.bincount((k + v[at]) * size + code, weight, n * size).reshape(-1, 256, size) for v in x], 1)
    values = [c if c is None else c[at] for c in channels]
    out = np.zeros((len(nodes), len(x), 256, len(channels)))
    for f in range(len(x)):
        cell = k + x[f, at]
        for j, v in enumerate(values):
            out[:, f, :, j] = np.bincount(cell, v, n).reshape(-1, 256)
    return out


class Local:
    """Rows in memory; each open tree has the rows of its nodes."""

    expand: Callable[[np.ndarray], np.ndarray] | None = None
    #: The power of two above the gradients of the round before.
    top = 0.0

    def __init__(self, blocks: DataFrame | View):
        if isinstance(blocks, View):
            self.view = blocks
        else:
            t = blocks.orderBy("block").toArrow().to_batches()
            self.view = View.joined([view_of(b, i) for b in t for i in range(b.num_rows)])
            self.view.m = self.view.m.copy()
        self.live: dict[tuple, tuple] = {}

    def open(self, key: tuple, tree: Tree, channels: Channels) -> None:
        values, rows = channels(self.view, key)
        self.live[key] = (tree, values, {0: np.arange(self.view.n) if rows is None else np.flatnonzero(rows)}, rows is None)

    def histograms(self, asks: list[tuple[tuple, list[int]]]) -> list[np.ndarray]:
        out = []
        for key, nodes in asks:
            _, values, rows, _ = self.live[key]
            if isinstance(values, Coded):
                h = np.stack([np.stack([np.bincount(x[rows[n]] * np.int64(values.size) + values.code[rows[n]], values.weight[rows[n]], 256 * values.size).reshape(256, -1) for x in self.view.x]) for n in nodes])
                out.append(self.expand(h) if self.expand else h)
                continue
            h = np.zeros((len(nodes), len(self.view.x), 256, len(values)))
            for i, n in enumerate(nodes):
                at = rows[n]
                every = len(at) == self.view.n
                use = [c if c is None or every else c[at] for c in values]
                for f, x in enumerate(self.view.x):
                    x = x if every else x[at]
                    done: dict[int, np.ndarray] = {}
                    for j, v in enumerate(use):
                        if id(v) not in done:
                            done[id(v)] = np.bincount(x, v, 256)
                        h[i, f, :, j] = done[id(v)]
            out.append(h)
        return out

    def split(self, key: tuple, nodes: list[int]) -> None:
        t, _, rows, _ = self.live[key]
        for n in nodes:
            at = rows.pop(n)
            go = t.goes_left(n)[self.view.x[t.feature[n]][at]]
            rows[t.left[n]], rows[t.right[n]] = at[go], at[~go]

    def close(self, key: tuple) -> np.ndarray:
        """The leaf of every row."""
        t, _, rows, every = self.live.pop(key)
        if not every:
            return t.apply(self.view.x)
        at = np.zeros(self.view.n, np.int32)
        for n, r in rows.items():
            at[r] = n
        return at

    def add(self, trees: list[tuple[int, Tree]], leaves: list[np.ndarray] | None = None) -> None:
        """Trees' values join the margins."""
        for i, (k, t) in enumerate(trees):
            self.view.m[k] += np.array(t.value, float)[leaves[i] if leaves else t.apply(self.view.x)]

    def total(self, f: Callable[[View], np.ndarray]) -> np.ndarray:
        """The sum of ``f`` over the blocks."""
        return f(self.view)


class Far:
    """Rows in a table of blocks; trees since the last write join the margins on the fly."""

    expand: Callable[[np.ndarray], np.ndarray] | None = None
    #: The power of two above the gradients of the round before.
    top = 0.0

    def __init__(self, blocks: DataFrame, flush: int = 10):
        # Dealt evenly once: a table of few files would otherwise be a few tasks at every level. A task sends sums of its own, so tasks follow the bytes.
        ways = max(2 * blocks.sparkSession.sparkContext.defaultParallelism, held(blocks)[1] // TASK)
        self.blocks, self.flush = materialize(blocks.repartition(ways), "blocks"), flush
        self.later: list[tuple[int, Tree]] = []
        self.live: dict[tuple, tuple[Tree, Channels]] = {}

    @staticmethod
    def _views(batches: Iterator[pa.RecordBatch], later: list[tuple[int, Tree]]) -> Iterator[View]:
        for b in batches:
            for i in range(b.num_rows):
                v = view_of(b, i)
                if later:
                    v.m = v.m.copy()
                    for k, t in later:
                        v.m[k] += np.array(t.value, float)[t.apply(v.x)]
                yield v

    def open(self, key: tuple, tree: Tree, channels: Channels) -> None:
        self.live[key] = (tree, channels)

    def split(self, key: tuple, nodes: list[int]) -> None:
        pass

    def close(self, key: tuple) -> None:
        del self.live[key]

    def add(self, trees: list[tuple[int, Tree]], leaves: list | None = None) -> None:
        self.later += trees
        if len(self.later) > self.flush:
            later, views = self.later, self._views

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    cols = {c: b[c] for c in b.schema.names}
                    cols["m"] = pa.array([v.m.tobytes() for v in views([b], later)], pa.binary())
                    yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

            self.blocks, self.later = materialize(self.blocks.mapInArrow(run, self.blocks.schema), "blocks"), []

    def total(self, f: Callable[[View], np.ndarray]) -> np.ndarray:
        later, views = self.later, self._views

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for v in views(batches, later):
                part = np.asarray(f(v), float)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        # What f gives is of the size of classes, bins or leaves, and a task sends one of it.
        parts = [np.frombuffer(r[0]) for r in self.blocks.mapInArrow(run, "part binary").collect()]
        return np.sum(parts, axis=0)

    def histograms(self, asks: list[tuple[tuple, list[int]]]) -> list[np.ndarray]:
        later, views = self.later, self._views
        jobs = [(key, *self.live[key], nodes) for key, nodes in asks]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list[np.ndarray] | None = None
            for v in _steps(views(batches, later)):
                part = []
                for key, tree, channels, nodes in jobs:
                    values, rows = channels(v, key)
                    part.append(sums(v.x, tree.apply(v.x), nodes, values, rows))
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            for i, t in enumerate(total or []):
                yield _sparse([i * 2**32 + n for n in range(len(t))], [x.reshape(-1, t.shape[-1]) for x in t])

        found = self._joined(partial, self.width * 256)
        out = [np.stack([found[i * 2**32 + n] for n in range(len(nodes))]).reshape(len(nodes), self.width, 256, -1) for i, (*_, nodes) in enumerate(jobs)]
        return [self.expand(h) for h in out] if self.expand else out

    def combined(self, key: tuple, channels: Channels, cuts: list[np.ndarray | None], allowed: np.ndarray | None = None) -> tuple[Local, Channels] | None:
        """A store in memory of one tree's rows, those of equal bins in the ``allowed`` features summed to one, and its channels.

        A tree asks for sums by these bins only, so it grows from there as from the rows. None where more combinations than rows, or
        than COMBINED, may be.
        """
        use = [f for f in range(len(cuts)) if allowed is None or allowed[f]]
        sizes = [256 if cuts[f] is None else len(cuts[f]) + 2 for f in use]
        if not use or np.prod(sizes, dtype=float) > min(COMBINED, self.rows):
            return None
        whole, later, views = int(np.prod(sizes)), self.later, self._views

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: np.ndarray | None = None
            for v in _steps(views(batches, later)):
                values, rows = channels(v, key)
                at = slice(None) if rows is None else np.flatnonzero(rows)
                code = np.zeros(v.n if rows is None else len(at), np.int64)
                for f, n in zip(use, sizes, strict=True):
                    place = np.minimum(np.arange(256), n - 1)
                    code = code * n + place[v.x[f][at]]
                part = np.stack([np.bincount(code, c if c is None else c[at], whole) for c in values], 1)
                total = part if total is None else total + part
            if total is not None:
                parts = [total[lo : lo + CHUNK] for lo in range(0, whole, CHUNK)]
                yield _sparse(list(range(len(parts))), parts)

        found = self._joined(partial, CHUNK)
        cell = np.concatenate([np.flatnonzero(x[:, -1]) + at * CHUNK for at, x in sorted(found.items())] or [np.zeros(0, np.int64)])
        values = np.concatenate([x[x[:, -1] != 0] for _, x in sorted(found.items())] or [np.zeros((0, 3))])
        x, rest = np.zeros((len(cuts), len(cell)), np.uint8), cell
        for f, n in zip(reversed(use), reversed(sizes), strict=True):
            place = rest % n
            x[f], rest = np.where(place == n - 1, MISSING, place), rest // n
        none = np.zeros(len(cell))
        sums_ = [np.ascontiguousarray(c) for c in values.T]
        return Local(View(x, none, none, none[None], np.zeros((0, len(cell))), [])), lambda v, key: (sums_, None)

    def _joined(self, partial: Callable, cells: int) -> dict[int, np.ndarray]:
        """Sums (cells, channels) by place, of those that tasks send."""

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for at, x in _dense(b, cells):
                    total[at] = total[at] + x if at in total else x
            yield _sparse(list(total), list(total.values()))

        kind = "at long, size int, cell binary, part binary"
        got = self.blocks.mapInArrow(partial, kind).repartition("at").mapInArrow(join, kind).toArrow()
        return dict(x for b in got.to_batches() for x in _dense(b, cells))

    def children(self, key: tuple, splits: dict[int, Split]) -> dict[int, np.ndarray]:
        """For nodes that may be split so, the sums of the smaller side, all in one request."""
        tree, channels = self.live[key]
        ahead = copy.deepcopy(tree)
        ask = []
        for n, s in splits.items():
            left, right = ahead.split(n, s)
            ask.append(left if s.left[-1] <= s.right[-1] else right)
        self.live[key] = (ahead, channels)
        try:
            return dict(zip(splits, self.histograms([(key, ask)])[0], strict=True))
        finally:
            self.live[key] = (tree, channels)

    @property
    def rows(self) -> int:
        if not hasattr(self, "_rows"):
            self._rows = self.blocks.agg(F.sum("n")).first()[0] or 0
        return self._rows

    @property
    def width(self) -> int:
        if not hasattr(self, "_width"):
            r = self.blocks.select("n", F.octet_length("x").alias("b")).first()
            self._width = r["b"] // r["n"]
        return self._width


def _steps(views: Iterator[View]) -> Iterator[View]:
    """Views joined up to STEP rows: sums are laid out once for so many."""
    held_, n = [], 0
    for v in views:
        held_.append(v)
        n += v.n
        if n >= STEP:
            yield View.joined(held_)
            held_, n = [], 0
    if held_:
        yield View.joined(held_)


def _sparse(at: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    """Sums (cells, channels) without the cells that are 0."""
    full = [np.flatnonzero(x.any(1)) for x in sums]
    cell, part = ([c.astype(np.int32).tobytes() for c in full], [x[c].tobytes() for c, x in zip(full, sums, strict=True)])
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([x.shape[1] for x in sums], pa.int32()), pa.array(cell, pa.binary()), pa.array(part, pa.binary())], ["at", "size", "cell", "part"])


def _dense(b: pa.RecordBatch, cells: int) -> Iterator[tuple[int, np.ndarray]]:
    for at, size, cell, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
        out = np.zeros((cells, size))
        out[np.frombuffer(cell.as_buffer(), np.int32)] = np.frombuffer(part.as_buffer()).reshape(-1, size)
        yield at, out


def held(blocks: DataFrame) -> tuple[int, int]:
    """Cells of the features, and bytes of all columns."""
    got = blocks.agg(F.sum(F.octet_length("x")), F.sum(sum((F.octet_length(c) for c in "ywmec"), F.octet_length("x")))).first()
    return got[0] or 0, got[1] or 0


def store_of(blocks: DataFrame, local_cells: int) -> Local | Far:
    cells, size = held(blocks)
    return Local(blocks) if 0 < cells <= local_cells and size <= LOCAL else Far(blocks)


@dataclass
class Growth:
    """How trees grow: ``score`` of sums (its sum over both sides less the whole is the gain), ``leaf`` value of sums, and limits.

    ``second``: where the best cut leaves a side below ``min_leaf`` rows the next best is taken, else the node is a leaf.
    ``picked`` features are drawn for each node; ``random_cut`` draws one cut a feature; ``weight`` is the channel that
    ``min_weight`` bounds and by which a category's first channel is divided.
    """

    score: Callable[[np.ndarray], np.ndarray]
    leaf: Callable[[np.ndarray], object]
    max_depth: int | None = None
    min_split: float = 2
    min_leaf: float = 1
    min_weight: float = 0.0
    weight: int = -1
    gamma: float = 0.0
    second: bool = True
    picked: int | None = None
    random_cut: bool = False
    categories: tuple[int, ...] = ()
    monotone: np.ndarray | None = None
    allowed: np.ndarray | None = None
    custom: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None

    def cuts(self, hist: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
        """Gains (nodes, features, 254 cuts, 2 for missing right or left), the order of each category's bins, and totals."""
        total = hist[:, 0].sum(1)
        order: dict[int, np.ndarray] = {}
        if self.categories:
            hist = hist.copy()
            for f in self.categories:
                h = hist[:, f, :MISSING]
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.where(h[..., -1] > 0, h[..., 0] / h[..., self.weight], np.inf)
                order[f] = np.argsort(ratio, axis=1, kind="stable")
                hist[:, f, :MISSING] = np.take_along_axis(h, order[f][..., None], axis=1)
        c = np.cumsum(hist[:, :, :MISSING], axis=2)[:, :, :-1]
        miss = hist[:, :, MISSING][:, :, None]
        whole = total[:, None, None]
        sides = [c] if not miss[..., -1].any() else [c, c + miss]
        gains = np.full((*c.shape[:3], 2), -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            base = self.score(whole)
            for s, left in enumerate(sides):
                right = whole - left
                gain = (self.custom(left, right, whole) if self.custom else self.score(left) + self.score(right) - base) - self.gamma
                ok = (left[..., -1] > 0) & (right[..., -1] > 0)
                if self.min_weight:
                    ok &= (left[..., self.weight] >= self.min_weight) & (right[..., self.weight] >= self.min_weight)
                if self.second and self.min_leaf > 1:
                    ok &= (left[..., -1] >= self.min_leaf) & (right[..., -1] >= self.min_leaf)
                if self.monotone is not None and self.monotone.any():
                    ok &= self.monotone[None, :, None] * (right[..., 0] / right[..., self.weight] - left[..., 0] / left[..., self.weight]) <= 0
                if s:
                    ok &= miss[..., -1] > 0
                gains[..., s] = np.where(ok & np.isfinite(gain), gain, -np.inf)
        n, p = gains.shape[:2]
        if self.random_cut:
            # One cut between the lowest and the highest bin in use.
            full = hist[:, :, :MISSING, -1] > 0
            low, high = full.argmax(2), MISSING - 1 - full[:, :, ::-1].argmax(2)
            at = np.minimum(low + (rng.random((n, p)) * np.maximum(high - low, 1)).astype(int), 253)
            keep = np.zeros(gains.shape[:3], bool)
            np.put_along_axis(keep, at[..., None], True, axis=2)
            gains[~keep] = -np.inf
        if self.allowed is not None:
            gains[:, ~self.allowed] = -np.inf
        if self.picked is not None and self.picked < p:
            out = rng.random((n, p)).argsort(1).argsort(1) >= self.picked
            gains[out] = -np.inf
        return gains, order, total

    def made(self, hist: np.ndarray, f: int, b: int, side: int, gain: float, order: np.ndarray | None) -> Split:
        """The split of one node's sums (features, 256, channels)."""
        h = hist[f]
        bins = None if order is None else sorted(order[: b + 1].tolist())
        left = (h[: b + 1] if bins is None else h[bins]).sum(0) + (h[MISSING] if side else 0.0)
        return Split(float(gain), f, b + 1, bool(side), bins, left, hist[0].sum(0) - left)

    def best(self, hist: np.ndarray, rng: np.random.Generator) -> list[Split | None]:
        gains, order, total = self.cuts(hist, rng)
        flat = gains.reshape(len(gains), -1)
        top = flat.argmax(1)
        out: list[Split | None] = []
        for i, (k, g) in enumerate(zip(top.tolist(), flat[np.arange(len(flat)), top].tolist(), strict=True)):
            f, b, side = np.unravel_index(k, gains.shape[1:])
            s = self.made(hist[i], int(f), int(b), int(side), g, order[f][i] if f in order else None) if g > 1e-12 else None
            if s is not None and not self.second and min(s.left[-1], s.right[-1]) < self.min_leaf:
                s = None
            out.append(s)
        return out


def grow(store: Local | Far, keys: list[tuple], trees: list[Tree], how: Growth, seed: int = 0) -> None:
    """Trees grow together, level by level: one request serves the nodes of all of them."""
    rng = np.random.default_rng([seed, 17])
    depth, level, each = 0, [(i, (0,), None) for i in range(len(trees))], 1
    while level:
        grown, held, at = [], 0, 0
        while at < len(level):
            take = max(1, ASKED // each)
            part, at = level[at : at + take], at + take
            asks: dict[int, list[int]] = {}
            for i, nodes, parent in part:
                asks.setdefault(i, []).extend(nodes if parent is None else nodes[:1])
            got = store.histograms([(keys[i], n) for i, n in asks.items()])
            found = {(i, n): h for (i, nodes), hs in zip(asks.items(), got, strict=True) for n, h in zip(nodes, hs, strict=True)}
            for i, nodes, parent in part:
                if parent is not None:
                    found[i, nodes[1]] = parent - found[i, nodes[0]]
            order = [(i, n) for i, nodes, _ in part for n in nodes]
            stacked = np.stack([found[o] for o in order])
            each = stacked[0].nbytes * 2
            if depth == 0:
                for (i, n), h in zip(order, stacked, strict=True):
                    trees[i].value[n] = how.leaf(h[0].sum(0))
            moved: dict[int, list[int]] = {}
            if how.max_depth is None or depth < how.max_depth:
                enough = [k for k, h in enumerate(stacked) if h[0, :, -1].sum() >= how.min_split]
                for k, s in zip(enough, how.best(stacked[enough], rng) if enough else [], strict=True):
                    if s is None:
                        continue
                    i, n = order[k]
                    a, b = trees[i].split(n, s)
                    trees[i].value[a], trees[i].value[b] = how.leaf(s.left), how.leaf(s.right)
                    moved.setdefault(i, []).append(n)
                    if how.max_depth is not None and depth + 1 >= how.max_depth:
                        continue
                    # A node below min_split isn't looked at again; its sibling then needs no sums of it.
                    big = [(c, side[-1]) for c, side in ((a, s.left), (b, s.right)) if side[-1] >= how.min_split]
                    if len(big) == 2 and held + stacked[k].nbytes <= KEPT:
                        held += stacked[k].nbytes
                        grown.append((i, tuple(c for c, _ in sorted(big, key=lambda x: x[1])), stacked[k].copy()))
                    elif big:
                        grown.append((i, tuple(c for c, _ in big), None))
            for i, nodes in moved.items():
                store.split(keys[i], nodes)
        depth, level = depth + 1, grown


def grow_leaves(store: Local | Far, key: tuple, tree: Tree, how: Growth, leaves: int, seed: int = 0) -> None:
    """Best leaf first, up to ``leaves``. A store whose requests are jobs is asked at once for the sides of all leaves that may come next."""
    rng = np.random.default_rng([seed, 18])
    hist = {0: store.histograms([(key, [0])])[0][0]}
    tree.value[0] = how.leaf(hist[0][0].sum(0))
    depth = {0: 0}
    best = {0: how.best(hist[0][None], rng)[0]}
    known: dict[int, np.ndarray] = {}
    for done in range(leaves - 1):
        open_ = [n for n, s in best.items() if s is not None]
        if not open_:
            return
        n = max(open_, key=lambda k: (best[k].gain, -k))
        deeper = how.max_depth is None or depth[n] + 1 < how.max_depth
        if isinstance(store, Far) and deeper and n not in known:
            # No more leaves than may still be split, and than there is memory for; the first is n.
            most = max(1, min(leaves - 1 - done, ASKED // hist[n].nbytes))
            next_ = sorted((k for k in open_ if k not in known and (how.max_depth is None or depth[k] + 1 < how.max_depth)), key=lambda k: (-best[k].gain, k))
            known |= store.children(key, {k: best[k] for k in next_[:most]})
        s = best.pop(n)
        a, b = tree.split(n, s)
        tree.value[a], tree.value[b] = how.leaf(s.left), how.leaf(s.right)
        store.split(key, [n])
        whole, depth[a], depth[b] = hist.pop(n), depth[n] + 1, depth[n] + 1
        if how.max_depth is not None and depth[a] >= how.max_depth:
            best[a] = best[b] = None
            continue
        small, large = (a, b) if s.left[-1] <= s.right[-1] else (b, a)
        hist[small] = known.pop(n) if n in known else store.histograms([(key, [small])])[0][0]
        hist[large] = whole - hist[small]
        best[a], best[b] = how.best(np.stack([hist[a], hist[b]]), rng)


def grow_oblivious(store: Local | Far, key: tuple, tree: Tree, how: Growth, seed: int = 0) -> None:
    """One split for a whole depth, by the sum of the nodes' gains; a node with an empty side adds nothing and keeps its rows."""
    rng = np.random.default_rng([seed, 19])
    nodes, hist = [0], store.histograms([(key, [0])])[0]
    tree.value[0] = how.leaf(hist[0, 0].sum(0))
    for depth in range(how.max_depth or 6):
        gains, order, _ = how.cuts(hist, rng)
        whole = np.where(np.isfinite(gains), gains, 0.0).sum(0)
        f, b, side = (int(v) for v in np.unravel_index(whole.argmax(), whole.shape))
        if whole[f, b, side] <= 0:
            return
        children, pairs = [], []
        for i, n in enumerate(nodes):
            s = how.made(hist[i], f, b, side, whole[f, b, side] / len(nodes), order[f][i] if f in order else None)
            if f in order:
                # One set of categories for the depth: that of the sums over all nodes.
                s = how.made(hist[i], f, b, side, s.gain, np.argsort(_ratio(hist[:, f].sum(0), how.weight), kind="stable"))
            a, c = tree.split(n, s)
            tree.value[a], tree.value[c] = (how.leaf(x) if x[-1] > 0 else tree.value[n] for x in (s.left, s.right))
            pairs.append((i, (a, c) if s.left[-1] <= s.right[-1] else (c, a)))
            children += [a, c]
        store.split(key, nodes)
        if depth + 1 == (how.max_depth or 6):
            return
        got = store.histograms([(key, [small for _, (small, _) in pairs])])[0]
        at = {}
        for (i, (small, large)), h in zip(pairs, got, strict=True):
            at[small], at[large] = h, hist[i] - h
        nodes, hist = children, np.stack([at[c] for c in children])


def _ratio(h: np.ndarray, weight: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h[:MISSING, -1] > 0, h[:MISSING, 0] / h[:MISSING, weight], np.inf)


def importances(cols: list[str], trees: list[Tree]) -> dict[str, float]:
    """Gains by feature, their sum 1."""
    total = dict.fromkeys(cols, 0.0)
    for t in trees:
        for f, g in zip(t.feature, t.gain, strict=True):
            if f >= 0:
                total[cols[f]] += float(g)
    whole = sum(total.values()) or 1.0
    return {c: v / whole for c, v in total.items()}


def scored(df: DataFrame, features: list[str], cuts: list[np.ndarray | None], out: list[tuple[str, str]], f: Callable[[object, np.ndarray], list], model: object) -> DataFrame:
    """``df`` with the columns ``out`` (name, type) that ``f`` gives for the model, sent to each executor once, and the bins of a batch."""
    names = [c for c, _ in out]
    df = df.drop(*(c for c in df.columns if c in names and c not in features))
    # Doubles go through Python once; other features are sent as such beside their columns.
    own = {i: df.columns.index(c) for i, c in enumerate(features) if c in df.columns and df.schema[c].dataType == TYPES["double"]}
    rest = {i: k for k, i in enumerate(i for i in range(len(features)) if i not in own)}
    rows = df.select(*df.columns, F.struct(F.lit(0).alias("_"), *(present(features[i]).alias(f"f{i}") for i in rest)).alias("_x"))
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept, kinds = df.columns, {"double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(b.num_columns - 1)
            got = f(sent.value, binned([floats(b.column(own[i]) if i in own else s.field(rest[i] + 1)) for i in range(len(features))], cuts)) if b.num_rows else [[]] * len(out)
            cells = [pa.array(v.tolist() if getattr(v, "ndim", 1) > 1 else v, kinds[k]) for v, (_, k) in zip(got, out, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cells], [*kept, *names])

    schema = type(df.schema)([*df.schema.fields])
    for c, k in out:
        schema = schema.add(c, TYPES[k])
    return rows.mapInArrow(run, schema)
