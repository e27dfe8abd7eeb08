"""SimHash near-duplicates, probed by the generalised pigeonhole principle.

A sketch has ``lanes`` words of 64 bits. Each shingle's XXH64 (seed 42) falls into one lane, chosen by the
hash itself, and a bit of the lane is 1 if more than half of the lane's hashes have it. One lane is the plain
SimHash.

Bits that go together are put into the same partition (correlations measured on a bounded sample of sketches).
A pair that differs in at most ``radius`` bits differs in at most ``t_i`` bits of some partition ``i`` if
``sum(t_i + 1) >= radius + 1`` (``t_i = -1`` leaves a partition out). The thresholds come from dynamic
programming over candidate counts estimated on the same sample; the sample decides the cost, never the result.
Equal sketches are one node before anything is compared. Buckets above ``block`` rows are cut into blocks whose
pairs are separate units of work, so no task gathers a bucket, and a unit emits a spanning forest of its links,
never all pairs.

With ``verify``, sketches are of distinct shingles and only propose: inside each component of proposed links every
pair is held against the Jaccard similarity of the shingle sets, and only pairs that reach it are links. Large
components are cut into blocks as buckets are. Sets and texts are told apart by hashes of 128 bits, and each distinct
set gets a number of its own, settled in a written table.

Defined results: a null or empty text has the zero sketch; a text of fewer words than a shingle is one shingle;
a null id counts as the smallest id (its group's component is null); rows with the same id and different texts
are separate nodes that share the id; columns besides id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, connected_components, forest, materialize, partitions, sliced, unused, utf8

#: Shingles of a text that are hashed at once.
CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the k-word shingles, in chunks; words are split at ASCII white space, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return
    k = min(k, len(words))
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin, end = (end - size)[: len(words) - k + 1], end[k - 1 :]
    digest = xxhash.xxh64_digest
    for at in range(0, len(begin), CHUNK):
        spans = zip(begin[at : at + CHUNK].tolist(), end[at : at + CHUNK].tolist(), strict=True)
        yield np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in spans]), dtype=">u8")


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The distinct shingles' hashes in rising order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(h.astype(np.uint64) for h in shingle_hashes(text, k))]))


def sketch(text: bytes | None, k: int, lanes: int = 1) -> bytes:
    """The sketch as 8 * lanes big-endian bytes."""
    return sketch_of(shingle_hashes(text, k), lanes)


def sketch_of(hashes: Iterable[np.ndarray], lanes: int = 1) -> bytes:
    """The sketch of big-endian hashes that come in chunks."""
    ones, n = np.zeros((lanes, 64), np.int64), np.zeros(lanes, np.int64)
    for h in hashes:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        if lanes == 1:
            ones[0] += bits.sum(axis=0, dtype=np.int64)
            n[0] += len(h)
            continue
        lane = ((h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % lanes
        order = np.argsort(lane, kind="stable")
        count = np.bincount(lane, minlength=lanes)
        full = np.flatnonzero(count)
        starts = np.cumsum(count) - count
        ones[full] += np.add.reduceat(bits[order], starts[full], axis=0, dtype=np.int64)
        n += count
    return np.packbits(2 * ones > n[:, None], axis=1).tobytes()


def sketches(df: DataFrame, id_col: str, text_col: str, k: int, lanes: int = 1) -> DataFrame:
    """(id, sketch binary), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(t, k, lanes) for t in utf8(b.column(1))], pa.binary())], ["id", "sketch"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, sketch binary")


def body_key(text_col: str) -> Column:
    """A 128-bit hash of a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def set_sketches(df: DataFrame, id_col: str, text_col: str, k: int, lanes: int) -> DataFrame:
    """(id, sketch binary, same, body), one row per row: the sketch of the distinct shingles, 128-bit hashes of their set and of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            marks, sames = [], []
            for t in utf8(b.column(1)):
                x = shingle_set(t, k)
                marks.append(sketch_of([x.astype(">u8")], lanes))
                sames.append(xxhash.xxh3_128_digest(x.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.binary()), pa.array(sames, pa.binary()), b.column(2)], ["id", "sketch", "same", "body"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), body_key(text_col).alias("body"))
    return rows.mapInArrow(run, "id long, sketch binary, same binary, body binary")


def words_of(blobs: list[bytes], lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=">u8").reshape(-1, lanes).astype(np.uint64)


def part_key(words: np.ndarray, part: tuple[int, ...]) -> np.ndarray:
    """The partition's bits of each sketch as an integer. Bit b is bit b % 64 (from the lowest) of lane b // 64."""
    key = np.zeros(len(words), np.uint64)
    for j, b in enumerate(part):
        key |= ((words[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(j)
    return key


def group_bits(sample: np.ndarray, lane: int, m: int) -> list[tuple[int, ...]]:
    """64 bits of a lane in m partitions; each takes the bits most correlated with those that it has."""
    bits = ((sample[:, lane, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    c = np.zeros((64, 64))
    if len(bits) > 1:
        bits = bits - bits.mean(axis=0)
        sd = np.sqrt((bits**2).mean(axis=0)) + 1e-9
        c = np.abs(bits.T @ bits / len(bits) / np.outer(sd, sd))
    np.fill_diagonal(c, 0)
    left, parts = list(range(64)), []
    for i in range(m):
        width = -(-len(left) // (m - i))
        part = [max(left, key=lambda b: (c[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            nxt = max(left, key=lambda b: (c[b, part].sum(), -b))
            part.append(nxt)
            left.remove(nxt)
        parts.append(tuple(64 * lane + b for b in part))
    return parts


def allocate(cost: list[list[float]], need: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = need and the least total cost; cost[i][t + 1] is partition i's at t."""
    best = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (c, ts) in best.items():
            for t1, x in enumerate(row):
                if have + t1 <= need and (have + t1 not in step or c + x < step[have + t1][0]):
                    step[have + t1] = (c + x, [*ts, t1 - 1])
        best = step
    return best[need]


def plan(sample: np.ndarray, n: int, radius: int, choices: tuple[int, ...]) -> list[tuple[tuple[int, ...], int]]:
    """Partitions and thresholds that guarantee ``radius``, the cheapest among the numbers of partitions a lane in ``choices``."""
    lanes = sample.shape[1]
    found = []
    for m in choices:
        parts = [p for lane in range(lanes) for p in group_bits(sample, lane, m)]
        most = min(radius, 2 if len(parts) <= 4 else 1)
        if len(parts) * (most + 1) < radius + 1:
            continue
        cost = []
        for part in parts:
            key = part_key(sample, part)
            if len(key) > 1:
                d = np.bitwise_count(key[:, None] ^ key[None, :])
                share = [((d <= t).sum() - len(key)) / (len(key) * (len(key) - 1)) for t in range(most + 1)]
            else:
                share = [0.0] * (most + 1)
            floor = [sum(math.comb(len(part), i) for i in range(t + 1)) for t in range(most + 1)]
            cost.append([0.0] + [n * n / 2 * max(s, f / 2 ** len(part)) + 20.0 * n * f for s, f in zip(share, floor, strict=True)])
        found.append((*allocate(cost, radius + 1), parts))
    _, ts, parts = min(found, key=lambda x: x[0])
    return [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0]


def flips(part: tuple[int, ...], t: int) -> np.ndarray:
    """Every mask with at most t of the partition's bits."""
    return np.array([sum(1 << j for j in c) for i in range(t + 1) for c in combinations(range(len(part)), i)], dtype=np.uint64)


def probes(nodes: DataFrame, scheme: list[tuple[tuple[int, ...], int]], lanes: int) -> DataFrame:
    """(bucket, node, sketch): a row for each bucket that a node looks into. A lane without shingles has no buckets if there are others."""
    masks = [flips(p, t) for p, t in scheme]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 512):
            words, blobs = words_of(b.column(1).to_pylist(), lanes), b.column(1)
            for i, (part, _) in enumerate(scheme):
                rows = np.flatnonzero(words[:, part[0] // 64]) if lanes > 1 else np.arange(len(words))
                keys = (part_key(words[rows], part)[:, None] ^ masks[i][None, :]) | np.uint64(i << 32)
                at = pa.array(np.repeat(rows, len(masks[i])))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), b.column(0).take(at), blobs.take(at)], ["bucket", "node", "sketch"])

    return nodes.select("node", "sketch").mapInArrow(run, "bucket long, node long, sketch binary")


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int | list[int], lanes: int) -> Iterator[pa.RecordBatch]:
    """Forest edges of the links inside units; rows come sorted by unit. A unit that straddles batches is carried over.

    ``radius`` shrinks with the lanes in use, or is listed by their number."""
    limits = np.array(radius) if isinstance(radius, list) else None

    def edges(bucket: np.ndarray, x: np.ndarray, y: np.ndarray, block: np.ndarray, node: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        unit = np.cumsum(new)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, d = np.arange(len(unit)), 0
        while len(at):
            d += 1
            at = at[at + d < len(unit)]
            at = at[unit[at] == unit[at + d]]
            for lo in range(0, len(at), 1 << 17):
                i = at[lo : lo + (1 << 17)]
                j = i + d
                i = i[keep := (x[i] == y[i]) | (block[i] != block[j])]
                j = j[keep]
                far = np.bitwise_count(words[i, 0] ^ words[j, 0]).astype(np.int32)
                for lane in range(1, lanes):
                    far += np.bitwise_count(words[i, lane] ^ words[j, lane])
                if lanes == 1:
                    near = far <= radius
                else:
                    used = ((words[i] | words[j]) != 0).sum(axis=1)
                    near = far * lanes <= radius * used if limits is None else far <= limits[used]
                a.append(node[i[near]])
                b.append(node[j[near]])
            if len(a) > 200:
                u, v = forest(np.concatenate(a), np.concatenate(b))
                a, b = [u], [v]
        u, v = forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)] + [words_of(batch.column(5).to_pylist(), lanes)]
        if held is not None:
            cols = [np.concatenate([p, q]) for p, q in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield edges(*[c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield edges(*held)


def similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Forest edges of the pairs of sets, none of them empty, with a Jaccard similarity of ``similarity`` or more: a search in breadth, in which a set meets those not yet reached."""
    size = np.array([len(x) for x in sets], np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
    ends = np.cumsum(size)
    own = [code[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    mine = np.zeros(len(code), bool)
    left, rest, todo, out = np.ones(len(sets), bool), np.arange(len(sets)), [], []
    flat, starts = code, ends - size
    while left.any() or todo:
        if not todo:
            todo.append(int(np.argmax(left)))
            left[todo[0]] = False
        i = todo.pop()
        if 2 * left[rest].sum() <= len(rest) or len(rest) != len(starts):
            rest = rest[left[rest]]
            if not len(rest):
                break
            flat = np.concatenate([own[j] for j in rest.tolist()])
            starts = np.cumsum(size[rest]) - size[rest]
        mine[own[i]] = True
        common = np.add.reduceat(mine[flat], starts, dtype=np.int64)
        mine[own[i]] = False
        for j in rest[left[rest] & (common / (size[rest] + size[i] - common) >= similarity)].tolist():
            left[j] = False
            todo.append(j)
            out.append((i, j))
    return out


def verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Forest edges of the similar sets inside units (columns: three of the unit, node, set); rows come sorted by unit."""

    def edges(node: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = similar(sets, similarity)
        return pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.int64()), pa.array([node[j] for _, j in found], pa.int64())], ["a", "b"])

    unit, node, sets = None, [], []
    for b in batches:
        keys = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
        for i, (key, n) in enumerate(zip(keys, b.column(3).to_pylist(), strict=True)):
            if key != unit:
                if len(sets) > 1:
                    yield edges(node, sets)
                unit, node, sets = key, [], []
            if x := b.column(4)[i].as_py():
                node.append(n)
                sets.append(np.frombuffer(x, "<u8"))
    if len(sets) > 1:
        yield edges(node, sets)


def verify_links(df: DataFrame, text_col: str, marks: DataFrame, proposed: DataFrame, k: int, similarity: float, *, block: int = 64, most: int = 40, unit_bytes: int = 1 << 24, broadcast_rows: int = 500_000) -> DataFrame:
    """Forest edges (a, b) of the pairs inside proposed components (same, node, component) whose shingle sets reach ``similarity``.

    Only texts of proposed nodes are read again. A component of more than ``block`` sets is cut into as many blocks,
    at most ``most`` unless a block would have more than ``unit_bytes``; each pair of blocks is a unit of work.
    """
    spark = df.sparkSession
    proposed = materialize(proposed, "proposed")
    wanted = materialize(marks.join(proposed, "same").groupBy("same").agg(F.min("body").alias("_body")), "wanted")
    bodies = wanted.select("_body").distinct()
    texts = df.select(F.col(text_col).alias("text"), body_key(text_col).alias("_body"))
    texts = texts.join(F.broadcast(bodies) if wanted.count() <= broadcast_rows else bodies, "_body", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            sets = [shingle_set(t, k).astype("<u8").tobytes() for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], ["same", "grams"])

    grams = texts.mapInArrow(run, "same binary, grams binary").groupBy("same").agg(F.first("grams").alias("grams"))
    members = materialize(grams.join(proposed, "same").drop("same"), "members")
    parts = F.greatest(F.least(F.ceil(F.count("*") / block), F.lit(most)), F.ceil(F.sum(F.octet_length("grams")) / unit_bytes)).cast("int")
    sizes = materialize(members.groupBy("component").agg(parts.alias("blocks")).where("blocks > 1"), "blocks")
    units = members.join(F.broadcast(sizes) if sizes.count() <= broadcast_rows else sizes, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    units = units.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    units = units.select("component", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "node", "grams")
    units = units.repartition(partitions(spark), "component", "x", "y").sortWithinPartitions("component", "x", "y")
    return units.mapInArrow(lambda it: verified(it, similarity), "a long, b long")


def grouped(
    df: DataFrame, id_col: str, text_col: str, *, k: int = 3, radius: int | list[int] = 2, lanes: int = 1, choices: tuple[int, ...] = (2, 3, 4), guaranteed: int | None = None, sample: int = 2048, block: int = 4096, verify: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Marks, a row for every row (id, sketch and with ``verify`` body), and nodes (same, least, group); both have the column ``same``.

    Rows of one ``same`` are one node, ``least`` is the node's smallest id (null counts as NULL_ID), ``group`` is common to
    the nodes that links connect. For the options see ``near_groups``.
    """
    spark = df.sparkSession
    if verify is None:
        marks = materialize(sketches(df, id_col, text_col, k, lanes).withColumn("same", F.col("sketch")), "sketches")
    else:
        marks = materialize(set_sketches(df, id_col, text_col, k, lanes), "sketches")
    # A sketch of 64 bits is its own number; other nodes are numbered once, in a written table.
    number = F.conv(F.hex("sketch"), 16, -10).cast("long") if lanes == 1 and verify is None else F.monotonically_increasing_id()
    nodes = marks.groupBy("same").agg(F.min(F.coalesce("id", F.lit(NULL_ID))).alias("least"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.select("sketch", "least", "same", number.alias("node")), "nodes")
    order = F.xxhash64("same") if lanes > 1 else F.col("node")
    some = [bytes(r[0]) for r in nodes.select("sketch").orderBy(order, "same").limit(sample).collect()]
    n = nodes.count()
    scheme = plan(words_of(some, lanes) if some else np.zeros((0, lanes), np.uint64), n, guaranteed if guaranteed is not None else radius if isinstance(radius, int) else max(radius), choices)
    looks = probes(nodes, scheme, lanes)
    hot = materialize(looks.groupBy("bucket").count().where(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot")
    # At most len(scheme) * n / block buckets are hot; a small table of them goes to every executor.
    looks = looks.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, "bucket", "left")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.coalesce("blocks", F.lit(1))).cast("int")
    units = looks.select("bucket", "node", "sketch", mine.alias("block"), F.coalesce("blocks", F.lit(1)).alias("blocks")).select(
        "bucket", "node", "sketch", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    )
    units = units.select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "sketch")
    units = units.repartition(partitions(spark), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "block")
    links = units.mapInArrow(lambda it: bucket_links(it, radius, lanes), "a long, b long")
    comp = connected_components(links, "a", "b")
    if verify is not None:
        comp = connected_components(verify_links(df, text_col, marks, comp.join(nodes.select("node", "same"), "node"), k, verify), "a", "b")
    return marks, nodes.join(comp, "node", "left").select("same", "least", F.coalesce("component", "node").alias("group"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, sketch, component) of every row; component is the smallest id that links reach.

    Links are pairs of sketches that differ in at most ``radius`` bits; of several lanes, only those count in
    which either text has shingles, and the radius shrinks with them. ``guaranteed`` (default: radius) is the
    distance up to which candidate search is certain to find a pair; beyond it a pair is found if it agrees in
    any one partition. ``sample`` bounds the sketches on which partitions and thresholds are planned. With
    ``verify``, such pairs are only proposed (see above); equal shingle sets are one node. A list as ``radius`` has
    the radius for each number of lanes in use.
    """
    marks, nodes = grouped(df, id_col, text_col, **options)
    least = nodes.groupBy("group").agg(F.min("least").alias("component"))
    nodes = nodes.join(least, "group").select("same", F.when(F.col("component") != NULL_ID, F.col("component")).alias("component"))
    return marks.join(nodes, "same").select("id", "sketch", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = 0.8, k: int = 5, lanes: int = 8, parts: int = 6, **options) -> DataFrame:
    """``df`` with one row, that of the smallest id, of each group of near copies; equal rows are one.

    Near copies are texts whose sets of ``k``-word shingles have a Jaccard similarity of ``similarity`` or more, or
    that such pairs connect; each link is verified on the sets. Sketches only propose: the similarity is a cosine of
    2J / (1 + J) and so an expected share of differing bits, and a pair is proposed up to three standard deviations
    beyond it if it agrees in one of ``lanes * parts`` partitions. For a pair at exactly 0.8 with many shingles and
    independent bits that is expected of 998 in 1,000, of more similar ones more often; a test measures it.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    # Few shingles leave lanes empty, and one shingle then decides a lane.
    radius = [math.ceil(64 * u * share + 3 * math.sqrt(64 * u * share * (1 - share))) + 32 * (0 < u < lanes) for u in range(lanes + 1)]
    marks, nodes = grouped(df, id_col, text_col, k=k, radius=radius, lanes=lanes, choices=(parts,), guaranteed=lanes * parts - 1, verify=similarity, **options)
    places = marks.select(F.coalesce("id", F.lit(NULL_ID)).alias("id"), "body", "same").join(nodes.select("same", "group"), "same")
    # Equal rows are counted first, so the next aggregate meets each place once.
    places = places.groupBy("group", "id", "body").agg(F.count("*").alias("n"))
    first = materialize(places.groupBy("group").agg(F.min(F.struct("id", "body", "n")).alias("f")).select("f.*"), "kept")
    at, body = unused("id", df.columns), unused("body", df.columns)
    keyed = df.withColumns({at: F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), body: body_key(text_col)})
    out = keyed.join(first.select(F.col("id").alias(at), F.col("body").alias(body)), [at, body], "left_semi")
    if first.where("n > 1").limit(1).count():
        out = out.dropDuplicates([at, body])
    return out.select(*df.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links at 2 or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_groups(docs, "doc_id", "text", k=3, radius=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("sketch")).alias("fingerprint"), F.col("component").alias("component_id"))
