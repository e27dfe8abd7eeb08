"""Tuning: grids and random draws of parameters scored by cross-validation, stopping rules and the Pareto front."""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import FitError
from sparkloom.learners.wrappers import resample
from sparkloom.task import Learner, Task

Params = dict[str, object]


@dataclass
class Progress:
    scores: list[float] = field(default_factory=list)
    began: float = field(default_factory=time.monotonic)


def max_evals(n: int) -> Callable[[Progress], bool]:
    return lambda p: len(p.scores) >= n


def run_time(seconds: float) -> Callable[[Progress], bool]:
    return lambda p: time.monotonic() - p.began >= seconds


def stagnation(n: int, maximize: bool = True) -> Callable[[Progress], bool]:
    """No better score in the last n."""

    def stop(p: Progress) -> bool:
        s = p.scores if maximize else [-x for x in p.scores]
        return len(s) > n and max(s[-n:]) <= max(s[:-n])

    return stop


def target_score(goal: float, maximize: bool = True) -> Callable[[Progress], bool]:
    return lambda p: any(s >= goal if maximize else s <= goal for s in p.scores)


def any_of(*rules: Callable[[Progress], bool]) -> Callable[[Progress], bool]:
    return lambda p: any(r(p) for r in rules)


def all_of(*rules: Callable[[Progress], bool]) -> Callable[[Progress], bool]:
    return lambda p: all(r(p) for r in rules)


@dataclass(frozen=True)
class Dependency:
    """``name`` only counts where ``parent`` has one of the values."""

    name: str
    parent: str
    values: tuple


def pruned(params: Params, dependencies: list[Dependency]) -> Params:
    """Parameters without those whose condition does not hold, until nothing changes."""
    out = dict(params)
    while True:
        drop = [d.name for d in dependencies if d.name in out and (d.parent not in out or out[d.parent] not in d.values)]
        if not drop:
            return out
        for k in drop:
            del out[k]


def grid(space: dict[str, list], dependencies: list[Dependency] | None = None) -> list[Params]:
    """The product of all values in key order, pruned, each once."""
    keys, seen, out = sorted(space), set(), []
    for values in itertools.product(*(space[k] for k in keys)):
        p = pruned(dict(zip(keys, values, strict=True)), dependencies or [])
        if (mark := repr(sorted(p.items()))) not in seen:
            seen.add(mark)
            out.append(p)
    return out


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def draw(self, rng: np.random.Generator) -> float:
        v = math.exp(rng.uniform(math.log(self.low), math.log(self.high))) if self.log else rng.uniform(self.low, self.high)
        return int(round(v)) if self.whole else float(v)


def draws(space: dict[str, Uniform | list], n: int, seed: int = 42, dependencies: list[Dependency] | None = None) -> Iterator[Params]:
    rng = np.random.default_rng(seed)
    for _ in range(n):
        yield pruned({k: v.draw(rng) if isinstance(v, Uniform) else v[rng.integers(len(v))] for k, v in sorted(space.items())}, dependencies or [])


def search(task: Task, make: Callable[[Params], Learner], configs, measure: Callable[..., DataFrame], column: str, k: int = 5, maximize: bool = True, stop: Callable[[Progress], bool] | None = None, parallel: int = 1) -> tuple[Params, float, list[tuple[Params, float]]]:
    """(best parameters, score, history): each configuration's mean over k folds; of equal scores the first. ``parallel`` configurations run as jobs side by side."""
    progress, history = Progress(), []
    score = lambda p: resample(task, lambda: make(p), measure, k).agg(F.avg(column)).first()[0]
    todo = iter(configs)
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        while part := list(itertools.islice(todo, max(1, parallel))):
            for p, s in zip(part, pool.map(score, part), strict=True):
                history.append((p, s))
                progress.scores.append(s)
            if stop and stop(progress):
                break
    best = max(range(len(history)), key=lambda i: (history[i][1] if maximize else -history[i][1], -i))
    return *history[best], history


def acyclic(dependencies: list[Dependency]) -> None:
    """An error if conditions wait for each other in a circle."""
    parents: dict[str, set[str]] = {}
    for d in dependencies:
        parents.setdefault(d.name, set()).add(d.parent)
    settled: set[str] = set()
    while left := {k: v for k, v in parents.items() if k not in settled}:
        free = {k for k, v in left.items() if not (v & left.keys())}
        if not free:
            raise FitError(f"dependencies go in a circle: {sorted(left)}")
        settled |= free


def search_many(task: Task, make: Callable[[Params], Learner], configs, measure: Callable[..., DataFrame], objectives: dict[str, bool], k: int = 5) -> list[tuple[Params, dict[str, float]]]:
    """Configurations that none dominates over several score columns (True: to raise), in the order tried."""
    tried = []
    for p in configs:
        row = resample(task, lambda p=p: make(p), measure, k).agg(*(F.avg(c).alias(c) for c in objectives)).first()
        tried.append((p, {c: float(row[c]) for c in objectives}))
    sign = {c: 1.0 if up else -1.0 for c, up in objectives.items()}
    better = lambda a, b: all(sign[c] * a[c] >= sign[c] * b[c] for c in objectives) and any(sign[c] * a[c] > sign[c] * b[c] for c in objectives)
    return [(p, s) for p, s in tried if not any(better(other, s) for _, other in tried)]


@dataclass
class TPE:
    """Tree-structured Parzen estimator: random draws first, then the best of ``candidates`` by log l(x) - log g(x).

    l is the density of the best share ``gamma`` of what was tried, g that of the rest: sums of normals with Scott's
    bandwidth for numbers (of logarithms where the space is logarithmic), counts plus one for choices.
    """

    space: dict[str, Uniform | list]
    n_iter: int = 30
    n_random: int = 5
    gamma: float = 0.25
    candidates: int = 24
    seed: int = 42
    dependencies: list[Dependency] = field(default_factory=list)

    def propose(self, history: list[tuple[Params, float]], maximize: bool, rng: np.random.Generator) -> Params:
        order = sorted(history, key=lambda h: -h[1] if maximize else h[1])
        n = max(1, math.ceil(self.gamma * len(order)))
        good, bad = [p for p, _ in order[:n]], [p for p, _ in order[n:]] or [p for p, _ in order]
        best, at = -math.inf, None
        for _ in range(self.candidates):
            one, value = {}, 0.0
            for name, v in sorted(self.space.items()):
                own, rest = [p[name] for p in good if name in p], [p[name] for p in bad if name in p]
                if isinstance(v, Uniform):
                    one[name] = self._near(v, own, rng)
                    value += self._density(v, one[name], own) - self._density(v, one[name], rest)
                else:
                    weight = np.array([1.0 + sum(o == c for o in own) for c in v])
                    one[name] = v[rng.choice(len(v), p=weight / weight.sum())]
                    value += math.log((1.0 + sum(o == one[name] for o in own)) / (len(own) + len(v))) - math.log((1.0 + sum(o == one[name] for o in rest)) / (len(rest) + len(v)))
            if value > best:
                best, at = value, one
        return pruned(at, self.dependencies)

    @staticmethod
    def _line(v: Uniform, x: float) -> float:
        return math.log(x) if v.log else float(x)

    def _width(self, v: Uniform, points: list[float]) -> float:
        spread = self._line(v, v.high) - self._line(v, v.low)
        sd = float(np.std(points)) if len(points) > 1 else spread / 4
        return max(1.06 * (sd or spread / 10) * max(1, len(points)) ** -0.2, spread / 100)

    def _near(self, v: Uniform, own: list, rng: np.random.Generator):
        if not own:
            return v.draw(rng)
        points = [self._line(v, x) for x in own]
        x = float(np.clip(rng.normal(points[rng.integers(len(points))], self._width(v, points)), self._line(v, v.low), self._line(v, v.high)))
        x = math.exp(x) if v.log else x
        return int(round(x)) if v.whole else x

    def _density(self, v: Uniform, x: float, own: list) -> float:
        spread = self._line(v, v.high) - self._line(v, v.low)
        if not own:
            return -math.log(max(spread, 1e-12))
        points = [self._line(v, y) for y in own]
        w = self._width(v, points)
        z = np.exp(-0.5 * ((self._line(v, x) - np.array(points)) / w) ** 2) / (w * math.sqrt(2 * math.pi))
        return math.log(float(z.mean()) + 1e-12)

    def tune(self, task: Task, make: Callable[[Params], Learner], measure: Callable[..., DataFrame], column: str, maximize: bool = True, k: int = 5, stop: Callable[[Progress], bool] | None = None) -> tuple[Params, float, list[tuple[Params, float]]]:
        acyclic(self.dependencies)
        rng, history, progress = np.random.default_rng(self.seed), [], Progress()
        first = draws(self.space, min(self.n_random, self.n_iter), self.seed, self.dependencies)
        for i in range(self.n_iter):
            p = next(first) if i < self.n_random else self.propose(history, maximize, rng)
            s = resample(task, lambda p=p: make(p), measure, k).agg(F.avg(column)).first()[0]
            history.append((p, s))
            progress.scores.append(s)
            if stop and stop(progress):
                break
        best = max(range(len(history)), key=lambda i: (history[i][1] if maximize else -history[i][1], -i))
        return *history[best], history


@dataclass
class Hyperband:
    """Brackets of successive halving; the budget is the number of cross-validation folds, from 2 to ``max_folds``, and the best 1 / eta of a rung go on."""

    space: dict[str, Uniform | list]
    max_folds: int = 5
    eta: int = 3
    seed: int = 42
    dependencies: list[Dependency] = field(default_factory=list)

    def brackets(self) -> list[list[tuple[int, int]]]:
        """(configurations, folds) of every rung of every bracket."""
        top = int(math.log(self.max_folds, self.eta) + 1e-9)
        out = []
        for s in range(top, -1, -1):
            n = math.ceil((top + 1) / (s + 1) * self.eta**s)
            out.append([(max(1, n // self.eta**i), min(self.max_folds, max(2, round(self.max_folds / self.eta ** (s - i))))) for i in range(s + 1)])
        return out

    def tune(self, task: Task, make: Callable[[Params], Learner], measure: Callable[..., DataFrame], column: str, maximize: bool = True) -> tuple[Params, float, list[tuple[Params, float]]]:
        acyclic(self.dependencies)
        history: list[tuple[Params, float]] = []
        known: dict[tuple[str, int], float] = {}
        full: list[int] = []
        for b, rungs in enumerate(self.brackets()):
            live = list(draws(self.space, rungs[0][0], self.seed + b, self.dependencies))
            for n, folds in rungs:
                live, scores = live[:n], []
                for p in live:
                    mark = (repr(sorted(p.items())), folds)
                    if mark not in known:
                        known[mark] = resample(task, lambda p=p: make(p), measure, folds).agg(F.avg(column)).first()[0]
                    history.append((p, known[mark]))
                    scores.append(known[mark])
                    if folds == self.max_folds:
                        full.append(len(history) - 1)
                order = sorted(range(len(live)), key=lambda i: (-scores[i] if maximize else scores[i], i))
                live = [live[i] for i in order]
        # Scores of few folds don't compete with those of all.
        best = max(full or range(len(history)), key=lambda i: (history[i][1] if maximize else -history[i][1], -i))
        return *history[best], history


def pareto_front(df: DataFrame, ids: list[str], maximize: list[str], minimize: list[str]) -> DataFrame:
    """Rows that no row dominates: at least as good in every objective and better in one.

    A vector that is dominated in its own part can't be in the front, so each task keeps the front of the distinct
    vectors it holds, these are dealt by ranges of the first objective and reduced again, and the fronts of the parts
    that are left meet in blocks. Two objectives have a plainer way, see ``front_of_two``.
    """
    from collections.abc import Iterator as Batches

    import pyarrow as pa

    from sparkloom.storage import materialize

    cols = [*maximize, *minimize]
    sign = np.array([1.0] * len(maximize) + [-1.0] * len(minimize))
    names = [f"o{i}" for i in range(len(cols))]
    kind = ", ".join(f"{n} double" for n in names)

    def reduced(x: np.ndarray) -> np.ndarray:
        """The vectors of the front, all objectives to raise."""
        x = np.unique(x, axis=0)[::-1]
        x = x[np.argsort(-x.sum(1), kind="stable")]
        kept = np.zeros((0, x.shape[1]))
        for lo in range(0, len(x), 256):
            part = x[lo : lo + 256]
            every = np.concatenate([kept, part])
            worse = np.array([((every >= v).all(1) & (every > v).any(1)).any() for v in part], bool)
            kept = np.concatenate([kept, part[~worse]])
        return kept

    def run(batches: Batches[pa.RecordBatch]) -> Batches[pa.RecordBatch]:
        kept = np.zeros((0, len(cols)))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], 1)
            kept = reduced(np.concatenate([kept, x * sign]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (kept * sign).T], names)

    vectors = df.select(*(F.col(c).cast("double").alias(n) for c, n in zip(cols, names, strict=True))).dropna().mapInArrow(run, kind)
    front = materialize(vectors.distinct().repartitionByRange(names[0]).mapInArrow(run, kind), "front")
    parts = materialize(front.repartition(1).mapInArrow(run, kind) if front.count() <= 20_000 else _meet(front, names, sign), "front")
    on = [F.col(c).cast("double") == F.col(n) for c, n in zip(cols, names, strict=True)]
    cond = on[0]
    for o in on[1:]:
        cond &= o
    return df.join(parts, cond, "left_semi").select(*ids, *cols)


def _meet(front: DataFrame, names: list[str], sign: np.ndarray) -> DataFrame:
    """A front of very many vectors: every block of them meets every other, and only the numbers of dominated vectors move on."""
    import pyarrow as pa

    rows = front.withColumn("_v", F.monotonically_increasing_id()).withColumn("_b", F.pmod(F.xxhash64(*names), F.lit(64)).cast("int"))
    packed = rows.groupBy("_b").agg(F.collect_list(F.struct("_v", *names)).alias("x"))
    pairs = packed.select(F.col("_b").alias("i"), F.col("x").alias("p")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(63)))).join(packed.select(F.col("_b").alias("j"), F.col("x").alias("q")), "j")

    def run(batches):
        for b in batches:
            for p, q in zip(b["p"].to_pylist(), b["q"].to_pylist(), strict=True):
                a, c = (np.array([[r[n] for n in names] for r in x], float) * sign for x in (p, q))
                worse = [i for i, v in enumerate(a) if ((c >= v).all(1) & (c > v).any(1)).any()]
                yield pa.RecordBatch.from_arrays([pa.array([p[i]["_v"] for i in worse], pa.int64())], ["_v"])

    return rows.join(pairs.mapInArrow(run, "_v long").distinct(), "_v", "left_anti").select(*names)


def front_of_two(df: DataFrame, ids: list[str], maximize: str, minimize: str) -> DataFrame:
    """The front of one objective to raise and one to lower, by ranges: a value survives if no row with a larger first objective is as low.

    Lows are taken per distinct first value, ranges of values get the best low of all higher ranges, and a window runs
    inside a range only.
    """
    from pyspark.sql import Window

    from sparkloom.functions.expr import range_of, splits

    low = df.groupBy(F.col(maximize).alias("m")).agg(F.min(minimize).alias("l"))
    cut = low.withColumn("r", -range_of("m", splits(low, "m")))
    over = cut.groupBy("r").agg(F.min("l").alias("b")).select("r", F.min("b").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)).alias("above"))
    inner = F.min("l").over(Window.partitionBy("r").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, -1))
    best = cut.join(F.broadcast(over), "r").withColumn("before", F.least(inner, "above"))
    front = best.where(F.col("before").isNull() | (F.col("l") < F.col("before"))).select(F.col("m").alias(maximize), F.col("l").alias(minimize))
    return df.join(front, [maximize, minimize], "left_semi").select(*ids, maximize, minimize)
