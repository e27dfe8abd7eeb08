"""Benchmark decontamination by greedy string tiling.

Texts are cut into tokens (runs of letters and digits, lower-cased). Documents and benchmark items that share a
run of ``seed`` tokens are candidates. For a candidate pair, tiles are found as running Karp-Rabin greedy string
tiling does: hashes of windows of a search length are matched and extended, the longest match is marked first, what
it cuts off other matches goes back in line by its own length, and the search length is halved down to ``seed``.
Hashes only propose; a tile is marked after its tokens are compared. Tiles count wherever they lie, so reordered
passages are caught. An item's coverage is the share of its tokens under tiles.

The benchmark's tokens are counted first: up to ``broadcast_tokens`` of them go to every executor and a document
is read once; above that, seeds and texts meet by joins, with equal results. An item whose coverage reaches the
threshold has a least number of its places matched, so that many places less one need no seed: those whose runs
most items share are left out, and a run that is in a third of all items joins nothing unless an item is made of it.

Defined results: null, empty and token-free texts or items match nothing; an item shorter than ``seed`` tokens
must appear whole; a row with a null item_id is an item with a null id; repeated rows are rows of their own;
ties go to the leftmost place in the item, then in the document; columns besides those named are ignored; an
empty table on either side gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, sliced, unused

TOKEN = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Pairs of places that are looked at together.
PAIRS = 1 << 20
#: Cut matches that come up before matches are taken anew.
STALE = 256
OUT = "doc_id long, item_id long, coverage double, n_tiles long, n_tokens long"
Tile = tuple[int, int, int]


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


class Rolling:
    """Karp-Rabin hashes (modulo 2**64) of any windows of codes, from the hashes of all beginnings."""

    powers = np.ones(1, np.uint64)

    def __init__(self, x: np.ndarray):
        n = len(x) + 1
        if len(Rolling.powers) < n:
            Rolling.powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, BASE)]))
        # Scaled so that a window's hash doesn't depend on its place: sum of code * BASE**-place, times BASE**place.
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x + np.uint64(1)) * self.inverse(n)[:-1], dtype=np.uint64)])

    _inverses = np.ones(1, np.uint64)

    @classmethod
    def inverse(cls, n: int) -> np.ndarray:
        if len(cls._inverses) < n:
            cls._inverses = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, np.uint64(pow(int(BASE), -1, 2**64)))]))
        return cls._inverses[:n]

    def at(self, place: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        h = (self.total[place + n] - self.total[place]) * Rolling.powers[place]
        return h ^ (h >> np.uint64(31))


def windows(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n codes."""
    return Rolling(x).at(np.arange(len(x) - n + 1), n) if 0 < n <= len(x) else np.zeros(0, np.uint64)


def runs(free: np.ndarray) -> np.ndarray:
    """For each place the number of free places from there on."""
    at = np.arange(len(free))
    stop = np.where(free, len(free), at)
    return np.minimum.accumulate(stop[::-1])[::-1] - at


def tiles(p: np.ndarray, t: np.ndarray, least: int) -> list[Tile]:
    """Greedy string tiling of codes p against t: (start in p, start in t, length), none shorter than ``least``. Code 0 matches nothing."""
    free_p, free_t = p != 0, t != 0
    rolls = Rolling(p), Rolling(t)
    left, size, out = int(free_p.sum()), max(least, len(p)), []

    def line() -> list[Tile]:
        found = [(-n, i, j) for i, j, n in _matches(p, t, free_p, free_t, size, rolls)]
        heapq.heapify(found)
        return found

    while left >= least:
        queue, stale = line(), 0
        while queue and left >= least:
            if stale > STALE and len(queue) > STALE:
                # Matches taken anew are those that are left, without the many that a tile has cut.
                queue, stale = line(), 0
                continue
            n, i, j = heapq.heappop(queue)
            n = -n
            ok = free_p[i : i + n] & free_t[j : j + n] & (p[i : i + n] == t[j : j + n])
            if ok.all():
                free_p[i : i + n] = free_t[j : j + n] = False
                left -= n
                out.append((i, j, n))
                continue
            stale += 1
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= size:
                    heapq.heappush(queue, (a - b, i + a, j + a))
        if size == least:
            break
        size = max(least, size // 2)
    return sorted(out)


def _matches(p: np.ndarray, t: np.ndarray, free_p: np.ndarray, free_t: np.ndarray, size: int, rolls: tuple[Rolling, Rolling]) -> Iterator[Tile]:
    """Matches of at least ``size`` unmarked codes that can't be extended to either side. Pairs of places are made a bounded number at a time."""
    a, b = runs(free_p), runs(free_t)
    i, j = np.flatnonzero(a >= size), np.flatnonzero(b >= size)
    if not len(i) or not len(j):
        return
    x, y = rolls[0].at(i, size), rolls[1].at(j, size)
    order = np.argsort(x, kind="stable")
    x, i = x[order], i[order]
    lo = np.searchsorted(x, y, "left")
    n = np.searchsorted(x, y, "right") - lo
    j, lo, n = j[n > 0], lo[n > 0], n[n > 0]
    if not len(n):
        return
    cuts = np.flatnonzero(np.diff(np.concatenate([[-1], np.cumsum(n) // PAIRS])))
    for at, end in zip(cuts, [*cuts[1:], len(n)], strict=True):
        k = n[at:end]
        v = np.repeat(j[at:end], k)
        u = i[np.repeat(lo[at:end] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))]
        # A match that goes on to the left is found there.
        inner = (u > 0) & (v > 0) & free_p[u - 1] & free_t[v - 1] & (p[u - 1] == t[v - 1])
        u, v = u[~inner], v[~inner]
        least, most = np.full(len(u), size), np.minimum(a[u], b[v])
        while (least < most).any():
            mid = (least + most + 1) // 2
            same = rolls[0].at(u, mid) == rolls[1].at(v, mid)
            least, most = np.where(same, mid, least), np.where(same, most, mid - 1)
        yield from zip(u.tolist(), v.tolist(), least.tolist(), strict=True)


def cover(p: np.ndarray, t: np.ndarray, seed: int, threshold: float = 0.0) -> tuple[float, int, int]:
    """Coverage, tiles and tokens under them; zeros where seeds alone show that the threshold can't be reached."""
    n = min(seed, len(p))
    near = np.flatnonzero(np.isin(windows(p, n), windows(t, n)))
    mark = np.zeros(len(p) + 1, np.int64)
    np.add.at(mark, near, 1)
    np.add.at(mark, near + n, -1)
    if (np.cumsum(mark[:-1]) > 0).sum() < threshold * len(p):
        return 0.0, 0, 0
    found = tiles(p, t, n)
    n = sum(x[2] for x in found)
    return n / len(p), len(found), n


class Bench:
    """Items as codes of their own vocabulary, with an index of their seeds: hashes in order, and the item of each."""

    def __init__(self, rows: list[tuple[int | None, str | None]], seed: int):
        self.seed = seed
        self.code: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, text in rows:
            if words := tokens(text):
                x = np.array([self.code.setdefault(w, len(self.code) + 1) for w in words], np.uint64)
                n = min(seed, len(x))
                found.setdefault(n, []).append((np.unique(windows(x, n)), len(self.items)))
                self.items.append((i, x))
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, parts in found.items():
            h = np.concatenate([x for x, _ in parts])
            owner = np.concatenate([np.full(len(x), k) for x, k in parts])
            order = np.argsort(h, kind="stable")
            self.index[n] = h[order], owner[order]

    def near(self, t: np.ndarray) -> np.ndarray:
        """Items that share a seed with the codes."""
        out = [np.zeros(0, np.int64)]
        for n, (keys, owner) in self.index.items():
            h = windows(t, n)
            if len(h):
                h = h[keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h]
                h = np.unique(h)
                for lo, hi in zip(np.searchsorted(keys, h, "left").tolist(), np.searchsorted(keys, h, "right").tolist(), strict=True):
                    out.append(owner[lo:hi])
        return np.unique(np.concatenate(out))

    def search(self, text: str | None, threshold: float) -> list[tuple[int | None, float, int, int]]:
        get = self.code.get
        t = np.array([get(w, 0) for w in tokens(text)], np.uint64)
        out = []
        for k in self.near(t).tolist():
            item, p = self.items[k]
            c, n_tiles, n = cover(p, t, self.seed, threshold)
            if n and c >= threshold:
                out.append((item, c, n_tiles, n))
        return out


def contaminated(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, seed: int = 5, threshold: float = 0.5, broadcast_tokens: int = 1_000_000
) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, n_tokens) of every pair whose coverage reaches ``threshold``."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    b = _items(bench, item_col, item_text)
    if _small(b, broadcast_tokens):
        return _broadcast(d, Bench([tuple(r) for r in b.collect()], seed), threshold)
    return _joined(d.withColumn("k", row_key("doc_id", "text")), b, seed, threshold).drop("k")


def _items(bench: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return bench.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")


def _small(items: DataFrame, broadcast_tokens: int) -> bool:
    return (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= 4 * broadcast_tokens


def row_key(id_col: str, text_col: str) -> Column:
    """A 256-bit hash of a row's id and text."""
    return F.sha2(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.col(text_col)), 256)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "coverage", "n_tiles", "n_tokens"])


def _broadcast(d: DataFrame, bench: Bench, threshold: float) -> DataFrame:
    shared = d.sparkSession.sparkContext.broadcast(bench)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield _batch([(i, *x) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in shared.value.search(text, threshold)])

    return d.mapInArrow(run, OUT)


def seeds_of(text: str | None, n: int) -> list[int]:
    """64-bit hashes of the runs of n tokens, by place. They only propose pairs."""
    words = tokens(text)
    return [xxhash.xxh64_intdigest("\x00".join(words[i : i + n])) - 2**63 for i in range(len(words) - n + 1)]


def _joined(d: DataFrame, b: DataFrame, seed: int, threshold: float) -> DataFrame:
    """As _broadcast, with the documents' keys ``k``. Equal keys are equal rows, so pairs meet one of them and are given to all at the end."""
    b = b.withColumn("bk", row_key("item_id", "text"))
    d = d.where("text is not null")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            for bk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(tokens(text))
                if n := min(seed, size):
                    h = seeds_of(text, n)
                    spare = max(0, math.ceil(threshold * size / n) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array([bk] * len(h)), pa.array([n] * len(h), pa.int32()), pa.array(h, pa.int64()), pa.array([spare] * len(h), pa.int32())], ["bk", "n", "h", "spare"])

    rows = materialize(b.select("bk", "text").distinct().mapInArrow(places, "bk string, n int, h long, spare int"), "places")
    lengths = sorted(r[0] for r in rows.select("n").distinct().collect())
    shared = rows.groupBy("n", "h").agg(F.count("*").alias("items"))
    rank = F.row_number().over(Window.partitionBy("bk").orderBy(F.desc("items"), "h"))
    items = rows.join(shared, ["n", "h"]).withColumn("rank", rank).where("rank > spare").select("bk", "n", "h").distinct()

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n in lengths:
                    h = np.unique(np.array(seeds_of(text, n), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(h), pa.string()), pa.array([n] * len(h), pa.int32()), pa.array(h)], ["k", "n", "h"])

    found = d.select("k", "text").distinct().mapInArrow(seeds, "k string, n int, h long")
    pairs = materialize(found.join(items, ["n", "h"]).select("k", "bk").distinct(), "pairs")
    pairs = pairs.join(b.select("bk", "item_id", F.col("text").alias("item")), "bk").join(d.select("k", "doc_id", "text"), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            out, ks = [], []
            for k, i, text, j, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code: dict[str, int] = {}
                p = np.array([code.setdefault(w, len(code) + 1) for w in tokens(item)], np.uint64)
                c, n_tiles, n = cover(p, np.array([code.get(w, 0) for w in tokens(text)], np.uint64), seed, threshold)
                if n and c >= threshold:
                    out.append((i, j, c, n_tiles, n))
                    ks.append(k)
            rest = _batch(out)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), *rest.columns], ["k", *rest.schema.names])

    return pairs.select("k", "doc_id", "text", "item_id", "item").mapInArrow(run, "k string, " + OUT)


def remove(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, seed: int = 5, threshold: float = 0.5, broadcast_tokens: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows that cover any item to ``threshold``; rows keep their columns."""
    b = _items(bench, item_col, item_text)
    if not _small(b, broadcast_tokens):
        at = unused("key", docs.columns)
        keyed = docs.withColumn(at, row_key(id_col, text_col))
        d = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(at).alias("k"))
        found = _joined(d, b, seed, threshold).select(F.col("k").alias(at)).distinct()
        return keyed.join(found, at, "left_anti").select(*docs.columns)
    shared, at = docs.sparkSession.sparkContext.broadcast(Bench([tuple(r) for r in b.collect()], seed)), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array([not shared.value.search(t, threshold) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds half or more."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
