"""Removal of repeated passages by suffixes that are sampled, range-partitioned and sorted in buckets.

Every byte under a string of ``length`` bytes that also starts earlier (smaller id, or earlier in the same text)
is removed. Sorting a suffix for each byte would move many times the input, so suffixes are sampled by content:
each window of ``length`` bytes has an anchor, the leftmost of its grams (``GRAM`` bytes) with the least hash. Equal
windows have equal anchors, so no repeat is lost, and only about one byte in 35 begins an anchor. Neighbouring
windows with the same anchor are a unit.

1. Units go to buckets by splitters, sampled from the suffixes' leading bytes, their gram and their unit. Before the
   shuffle each task keeps only the earliest of its equal units; later ones are removed as they are
   (pre-aggregation, so a passage in a third of all texts is one unit for each task), and a bucket does the same by
   128 bits of hash. This only prunes: a gram with different units is a repeat that begins or ends there, and one of
   each unit asks its text for its bytes. A gram that very many units share is cut by its units' hashes; each bucket
   beside such a cut takes the gram to have others.
2. Those suffixes are range-partitioned by splitters sampled from whole suffixes, so a hot leading run is cut at deeper
   bytes. A bucket sorts its suffixes by multikey quicksort and takes the common prefixes of neighbours. Windows are
   equal where the common prefix covers what lies right of the anchor and the bytes left of it are equal.
3. A suffix is compared with its bucket's two boundaries. Where it shares with a boundary all that a window has right
   of the anchor, the run of equal suffixes may go on in the next bucket: the earliest of each such window is sent
   off, and the earliest of all buckets stays.
4. Texts meet their removed windows and lose them.

Texts move zstd-compressed, everything else packed, so that rows are few. Memory is bounded by bucket and part
sizes and by the largest text.

Defined results: a null text is empty; texts of fewer than ``length`` bytes lose nothing; a null id is the
smallest; rows with equal id and text are the same place (neither is earlier), rows with equal id and different
texts are ordered by their checksum; columns besides id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, materialize, partitions, sliced, utf8

GRAM = 32
#: Bytes that are hashed at once, and of a piece of a longer text.
CHUNK, PIECE = 1 << 20, 1 << 19
#: Units that a task gathers before it sends them off, and the mean of a bucket.
HELD, BUCKET = 400_000, 300_000
#: Bytes of text of a part, in which texts meet their requests and removals.
PART = 48 << 20

UNIT = np.dtype([("h", "<u8"), ("u", "<u8"), ("doc", "<i8"), ("crc", "<u4"), ("p", "<u4"), ("n", "u1"), ("off", "u1")])
OPEN = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("crc", "<u4"), ("p", "<u4")])
REMOVED = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("p", "<u4"), ("n", "<u4")])
ROWS = "slot int, kind int, doc long, blob binary"

_rng = np.random.default_rng(1234)
TABLE = _rng.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
BASE, BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVERSE2 = np.uint64(pow(int(BASE2), -1, 2**64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))


_powers: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    if not _powers:
        _powers.extend([powers(BASE2, CHUNK + 1), powers(INVERSE2, CHUNK + 1)])
    return _powers


def grams(x: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place."""
    h, n, b = TABLE[x], 1, int(BASE)
    while n < GRAM:
        h = h[:-n] * np.uint64(b) + h[n:]
        n, b = 2 * n, b * b % 2**64
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def units(pieces: list[tuple[int, int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of the pieces (id, checksum, offset, bytes) and the sort keys of their suffixes (leading bytes, the gram's hash, the unit's hash)."""
    x = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    if len(x) < length:
        return np.zeros(0, UNIT), np.zeros(0, "S24")
    size = np.array([len(p[3]) for p in pieces])
    end = np.cumsum(size)
    g = grams(x)
    span = length - GRAM + 1
    # The place in the low bits makes the least value the leftmost of the least hashes.
    low = (g & ~np.uint64(CHUNK * 2 - 1)) | np.arange(len(g), dtype=np.uint64)
    least, width = low, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = (least & np.uint64(CHUNK * 2 - 1)).astype(np.int64)
    whole = (np.repeat(end, size)[: len(anchor)] - np.arange(len(anchor))) >= length
    first = whole.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    p = np.flatnonzero(first)
    if not len(p):
        return np.zeros(0, UNIT), np.zeros(0, "S24")
    stop = np.flatnonzero(np.diff(np.concatenate([whole, [False]]).astype(np.int8)) < 0) + 1
    nxt = np.minimum(np.append(p[1:], len(anchor)), stop[np.searchsorted(stop, p, "right")])
    out = np.zeros(len(p), UNIT)
    out["n"] = nxt - p
    a = anchor[p]
    out["off"] = a - p
    out["h"] = g[a]
    up, down = tables()
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[x] * up[: len(x)], dtype=np.uint64)])
    u = (total[nxt - 1 + length] - total[p]) * down[p]
    out["u"] = (u ^ (u >> np.uint64(31))) * BASE + (out["n"].astype(np.uint64) << np.uint64(8)) + out["off"]
    of = np.searchsorted(end, p, "right")
    out["doc"] = np.array([q[0] for q in pieces], np.int64)[of]
    out["crc"] = np.array([q[1] for q in pieces], np.uint32)[of]
    out["p"] = p - (end - size)[of] + np.array([q[2] for q in pieces], np.int64)[of]
    key = np.empty((len(p), 3), ">u8")
    key[:, 0] = np.ascontiguousarray(x[a[:, None] + np.arange(8)]).view(">u8").ravel()
    key[:, 1], key[:, 2] = out["h"], out["u"]
    return out, key.view("S24").ravel()


def chunks(docs: Iterator[tuple[int, int, bytes]], length: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Pieces of texts, together up to CHUNK bytes. A longer text is cut so that each window lies in one piece."""
    held, size = [], 0
    for doc, crc, text in docs:
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            piece = text[at : at + PIECE + length - 1]
            if len(piece) < length:
                continue
            if size + len(piece) > CHUNK:
                yield held
                held, size = [], 0
            held.append((doc, crc, at, piece))
            size += len(piece)
    if held:
        yield held


def part_of(doc: np.ndarray, crc: np.ndarray, parts: int) -> np.ndarray:
    x = (doc.astype(np.uint64) * BASE) ^ (crc.astype(np.uint64) * BASE2)
    return ((x >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def packed(slots: np.ndarray, data: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(slot, kind, the slot's items)."""
    order = np.argsort(slots, kind="stable")
    slots, data = slots[order], data[order]
    cuts = [0, *(np.flatnonzero(slots[1:] != slots[:-1]) + 1).tolist(), len(slots)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            yield int(slots[lo]), kind, data[lo:hi].tobytes()


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.nulls(len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["slot", "kind", "doc", "blob"])


def earliest(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of each set of equal units, by gram and then unit; and the removed windows of the later ones."""
    found = found[np.lexsort((found["p"], found["crc"], found["doc"], found["u"], found["h"]))]
    again = np.zeros(len(found), bool)
    again[1:] = (found["h"][1:] == found["h"][:-1]) & (found["u"][1:] == found["u"][:-1])
    same = np.zeros(len(found), bool)
    same[1:] = again[1:] & (found["doc"][1:] == found["doc"][:-1]) & (found["crc"][1:] == found["crc"][:-1]) & (found["p"][1:] == found["p"][:-1])
    # A copy of the very first place is that place; any other copy is later.
    head = np.flatnonzero(~again)[np.cumsum(~again) - 1]
    first = (found["doc"] == found["doc"][head]) & (found["crc"] == found["crc"][head]) & (found["p"] == found["p"][head])
    return found[~again], windows(found[again & ~first & ~same])


def windows(found: np.ndarray) -> np.ndarray:
    out = np.zeros(len(found), REMOVED)
    for f in ("doc", "crc", "p", "n"):
        out[f] = found[f]
    return out


def each_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int | None, bytes]]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows by their words, first to last: three-way partitions around a pivot, word by word."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        rows = order[lo:hi]
        if hi - lo <= 48:
            order[lo:hi] = rows[np.lexsort(words[rows, depth:].T[::-1])]
            continue
        key = words[rows, depth]
        pivot = np.sort(key[[0, len(key) // 4, len(key) // 2, 3 * len(key) // 4, -1]])[2]
        less, more = key < pivot, key > pivot
        equal = ~(less | more)
        order[lo:hi] = np.concatenate([rows[less], rows[equal], rows[more]])
        a = lo + int(less.sum())
        b = a + int(equal.sum())
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def aligned(found: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Each unit's bytes with the anchor in column length - GRAM; zeros outside the unit. ``text`` holds the bytes, padded."""
    left = length - GRAM
    out = np.zeros((len(found), left + length), np.uint8)
    cols = np.arange(text.shape[1])
    to = left - found["off"].astype(np.int64)[:, None] + cols
    inside = (cols < (found["n"].astype(np.int64) - 1 + length)[:, None]) & (to < left + length)
    out[np.nonzero(inside)[0], to[inside]] = text[inside]
    return out


def common(rows: np.ndarray, one: bytes | None) -> np.ndarray:
    """How many leading bytes each row has in common with ``one``."""
    if one is None:
        return np.zeros(len(rows), np.int64)
    differ = rows != np.frombuffer(one.ljust(rows.shape[1], b"\0"), np.uint8)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def compared(found: np.ndarray, text: np.ndarray, length: int, low: bytes | None = None, high: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Removed windows among the suffixes of a bucket, and the earliest of those windows that may go on beyond its boundaries."""
    left = length - GRAM
    whole, off = aligned(found, text, length), found["off"].astype(np.int64)
    right = np.zeros((len(found), -(-length // 8) * 8), np.uint8)
    right[:, :length] = whole[:, left:]
    order = multikey_quicksort(right.view(">u8").astype(np.uint64))
    found, whole, off = found[order], whole[order], off[order]
    differ = whole[1:, left:] != whole[:-1, left:]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    edge = np.maximum(common(whole[:, left:], low), common(whole[:, left:], high))
    at = found["p"].astype(np.int64) + off
    rank = np.empty(len(found), np.int64)
    rank[np.lexsort((at, found["crc"], found["doc"]))] = np.arange(len(found))
    n = found["n"].astype(np.int64)
    before = np.zeros(len(found), np.uint64)
    out, ends = [np.zeros(0, REMOVED)], [np.zeros(0, OPEN)]
    for l in range(left + 1):  # noqa: E741
        if l:
            before = before * BASE + TABLE[whole[:, left - l]]
        rows = np.flatnonzero((off >= l) & (off - n < l))
        if not len(rows):
            continue
        run = np.concatenate([[0], np.cumsum(lcp < length - l)])[rows]
        order = np.lexsort((rank[rows], before[rows], run))
        rows, run = rows[order], run[order]
        new = np.ones(len(rows), bool)
        new[1:] = (run[1:] != run[:-1]) | (before[rows][1:] != before[rows][:-1])
        head = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = ~new & (whole[rows, left - l : left] == whole[head, left - l : left]).all(axis=1)
        late &= (found["doc"][rows] != found["doc"][head]) | (found["crc"][rows] != found["crc"][head]) | (at[rows] != at[head])
        gone = windows(found[rows[late]])
        gone["p"] = at[rows[late]] - l
        gone["n"] = 1
        out.append(gone)
        goes_on = rows[new & (edge[rows] >= length - l)]
        if len(goes_on):
            some = np.zeros(len(goes_on), OPEN)
            for f in ("doc", "crc"):
                some[f] = found[f][goes_on]
            some["p"] = at[goes_on] - l
            for k in range(left - l, left - l + length):
                some["a"] = some["a"] * BASE + TABLE[whole[goes_on, k]]
                some["b"] = some["b"] * BASE2 + TABLE[whole[goes_on, k]]
            ends.append(some)
    return np.concatenate(out), np.concatenate(ends)


def later(found: np.ndarray) -> np.ndarray:
    """Removed windows of all but the earliest of equal ones (OPEN)."""
    found = found[np.lexsort((found["p"], found["crc"], found["doc"], found["b"], found["a"]))]
    new = np.ones(len(found), bool)
    new[1:] = (found["a"][1:] != found["a"][:-1]) | (found["b"][1:] != found["b"][:-1])
    head = found[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(found) else found
    gone = found[(found["doc"] != head["doc"]) | (found["crc"] != head["crc"]) | (found["p"] != head["p"])]
    out = np.zeros(len(gone), REMOVED)
    for f in ("doc", "crc", "p"):
        out[f] = gone[f]
    out["n"] = 1
    return out


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 100, sample: int = 1000) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) of every row. ``sample`` bounds the texts on which splitters are chosen; they decide the cost, never the result."""
    if not GRAM < length <= GRAM + 255:
        raise ValueError(f"length must lie above {GRAM} and not above {GRAM + 255}")
    spark = df.sparkSession
    ways = partitions(spark)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for b in sliced(batches, 256):
            for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                yield doc, zlib.crc32(text), text

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(read(batches), length):
            found, keys = units(c, length)
            pick = slice(None, None, max(1, len(keys) // 2000))
            place = {(doc, crc, at): piece for doc, crc, at, piece in c}
            begins: dict[tuple[int, int], list[int]] = {}
            for doc, crc, at in place:
                begins.setdefault((doc, crc), []).append(at)
            ends = []
            for u in found[pick]:
                doc, crc, p = int(u["doc"]), int(u["crc"]), int(u["p"])
                at = max(x for x in begins[doc, crc] if x <= p)
                a = p - at + int(u["off"])
                ends.append(place[doc, crc, at][a : a + min(length, int(u["n"]) - 1 + length - int(u["off"]))])
            yield pa.RecordBatch.from_arrays([pa.array([k.ljust(24, b"\0") for k in keys[pick].tolist()], pa.binary()), pa.array(ends, pa.binary())], ["key", "suffix"])

    share = int(min(1.0, sample / max(1, n)) * (2**64 - 1)) - 2**63
    some = docs.where((F.xxhash64("doc", F.lit(3)) <= min(share, 2**63 - 1)) & (F.octet_length("text") >= length)).mapInArrow(leads, "key binary, suffix binary").limit(100_000).collect()
    # Eight slots or more for each task, so that their hashes even out.
    buckets = max(8 * ways, total // (35 * BUCKET) + 1)
    parts = max(8 * ways, total // PART + 1)

    def cuts(values: list[bytes], kind: str) -> np.ndarray:
        x = np.sort(np.array(values, kind))
        return np.unique(x[np.linspace(0, len(x) - 1, min(buckets, len(x)) + 1).astype(int)[1:-1]]) if len(x) > 1 else x[:0]

    splitters = cuts([bytes(r[0]) for r in some], "S24")
    ranges = cuts([bytes(r[1]) for r in some], f"S{length}")
    # Grams that a boundary cuts.
    cut_grams = np.array([int.from_bytes(k.ljust(24, b"\0")[8:16], "big") for k in splitters.tolist()], np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slots, size = [], [], 0

        def flush() -> pa.RecordBatch:
            found, slot = np.concatenate(held), np.concatenate(slots)
            place = np.lexsort((found["p"], found["crc"], found["doc"], found["u"], found["h"]))
            kept, gone = earliest(found)
            slot = slot[place]
            again = np.zeros(len(found), bool)
            f = found[place]
            again[1:] = (f["h"][1:] == f["h"][:-1]) & (f["u"][1:] == f["u"][:-1])
            # Removed windows pass through the buckets untouched; their slot only deals them out.
            return batch([*packed(slot[~again], kept, 0), *((s % (len(splitters) + 1), 1, b) for s, _, b in packed(part_of(gone["doc"], gone["crc"], parts), gone, 1))])

        for c in chunks(read(batches), length):
            found, keys = units(c, length)
            held.append(found)
            slots.append(np.searchsorted(splitters, keys, "right"))
            size += len(found)
            if size >= HELD:
                yield flush()
                held, slots, size = [], [], 0
        if size:
            yield flush()

    def removals(gone: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        yield from packed(part_of(gone["doc"], gone["crc"], parts), gone, 0)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Removed windows (kind 0) and requests (kind 1), by part."""

        def bucket(blobs: list[bytes]) -> pa.RecordBatch:
            kept, gone = earliest(np.frombuffer(b"".join(blobs), UNIT))
            more = np.zeros(len(kept), bool)
            more[1:] = kept["h"][1:] == kept["h"][:-1]
            more[:-1] |= more[1:]
            ask = kept[more | np.isin(kept["h"], cut_grams)]
            return batch([*removals(gone), *packed(part_of(ask["doc"], ask["crc"], parts), ask, 1)])

        now, blobs = None, []
        for slot, kind, _, blob in each_slot(batches):
            if kind:
                yield batch(list(removals(np.frombuffer(blob, REMOVED))))
                continue
            if slot != now and blobs:
                yield bucket(blobs)
                blobs = []
            now = slot
            blobs.append(blob)
        if blobs:
            yield bucket(blobs)

    by_slot = lambda rows: rows.repartition(ways, "slot").sortWithinPartitions("slot", "kind")
    first = materialize(by_slot(docs.where(F.octet_length("text") >= length).mapInArrow(scan, ROWS)).mapInArrow(resolve, ROWS), "units")

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in sliced(batches, 256):
            doc, text = b.column(0).to_numpy(), utf8(b.column(1))
            crc = np.array([zlib.crc32(t) for t in text], np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(doc, crc, parts), pa.int32()), pa.array([2] * len(text), pa.int32()), b.column(0), pa.array([z.compress(t) for t in text], pa.binary())], ["slot", "kind", "doc", "blob"])

    def met(rows: Iterator[tuple], dtype: np.dtype) -> Iterator[tuple[int, int, int, bytes, np.ndarray]]:
        """(part, id, checksum, text, items of that text) of every text; a part's items come before its texts."""
        z, now, blobs, items, ids = zstandard.ZstdDecompressor(), None, [], None, None
        for slot, kind, doc, blob in rows:
            if slot != now:
                now, blobs, items = slot, [], None
            if kind < 2:
                blobs.append(blob)
                continue
            if items is None:
                items = np.frombuffer(b"".join(blobs), dtype)
                items = items[np.lexsort((items["p"], items["crc"], items["doc"]))]
                # A column of its own: a search in a field of records would copy the field each time.
                ids = np.ascontiguousarray(items["doc"])
                blobs = []
            text = z.decompress(blob)
            crc = zlib.crc32(text)
            own = items[np.searchsorted(ids, doc, "left") : np.searchsorted(ids, doc, "right")]
            yield slot, doc, crc, text, own[own["crc"] == crc]

    bytes_of = np.dtype([*UNIT.descr, ("text", "u1", 2 * length - GRAM)])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Requests with their unit's bytes, by the range of their suffix."""
        held, size = [], 0
        width = 2 * length - GRAM

        def flush() -> pa.RecordBatch:
            out = np.concatenate(held)
            right = np.ascontiguousarray(aligned(out, out["text"], length)[:, length - GRAM :])
            return batch(list(packed(np.searchsorted(ranges, right.view(f"S{length}").ravel(), "right"), out, 0)))

        now, done = None, set()
        for slot, doc, crc, text, own in met(each_slot(batches), UNIT):
            if slot != now:
                now, done = slot, set()
            if not len(own) or (doc, crc) in done:
                continue
            done.add((doc, crc))
            x = np.frombuffer(text + bytes(width), np.uint8)
            out = np.zeros(len(own), bytes_of)
            for f in UNIT.names:
                out[f] = own[f]
            out["text"] = x[own["p"].astype(np.int64)[:, None] + np.arange(width)]
            held.append(out)
            size += len(out)
            if size >= HELD // 8:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Removed windows (kind 0) by part, and windows that go on beyond a bucket (kind 1) by their hash."""

        def bucket(slot: int, blobs: list[bytes]) -> pa.RecordBatch:
            found = np.frombuffer(b"".join(blobs), bytes_of)
            low, high = (bytes(ranges[slot - 1]) if slot else None), (bytes(ranges[slot]) if slot < len(ranges) else None)
            gone, ends = compared(found[list(UNIT.names)], found["text"], length, low, high)
            return batch([*removals(gone), *packed((ends["a"] >> np.uint64(33)).astype(np.int64) % buckets, ends, 1)])

        now, blobs = None, []
        for slot, _, _, blob in each_slot(batches):
            if slot != now and blobs:
                yield bucket(now, blobs)
                blobs = []
            now = slot
            blobs.append(blob)
        if blobs:
            yield bucket(now, blobs)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for slot, _, _, blob in each_slot(batches):
            if slot != now and blobs:
                yield batch(list(removals(later(np.frombuffer(b"".join(blobs), OPEN)))))
                blobs = []
            now = slot
            blobs.append(blob)
        if blobs:
            yield batch(list(removals(later(np.frombuffer(b"".join(blobs), OPEN)))))

    texts = docs.mapInArrow(zipped, ROWS)
    asked = by_slot(first.where("kind = 1").unionAll(docs.where(F.octet_length("text") >= length).mapInArrow(zipped, ROWS)))
    second = materialize(by_slot(asked.mapInArrow(fetch, ROWS)).mapInArrow(compare, ROWS), "boundaries")
    third = by_slot(second.where("kind = 1")).mapInArrow(merge, ROWS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

        for _, doc, _, text, own in met(each_slot(batches), REMOVED):
            spans, kept = 0, text
            if len(own):
                mark = np.zeros(len(text) + 1, np.int32)
                np.add.at(mark, own["p"].astype(np.int64), 1)
                np.add.at(mark, own["p"].astype(np.int64) + own["n"].astype(np.int64) - 1 + length, -1)
                gone = np.cumsum(mark[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((doc if doc != NULL_ID else None, len(text), len(text) - len(kept), spans, kept))
            size += len(kept)
            if len(out) >= 512 or size > 1 << 22:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    gone = first.where("kind = 0").unionAll(second.where("kind = 0")).unionAll(third)
    return by_slot(gone.unionAll(texts)).mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffixes(spark, sf_dir: str) -> DataFrame:
    """What every document keeps after repeats of 100 bytes are removed."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
