"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The tree's leaf i holds the rank of the pair that starts at symbol i; its root is the lowest rank and, among
equals, the leftmost place. A merge changes at most three leaves, each in logarithmic time, so a word of n
symbols takes O(n log n), however long it is. Words that a batch of rows has in common are merged once, and
all of them together: the trees of words of up to WIDE symbols stand in arrays, a row a word, and each step takes
every word's root at a time. Longer words go one by one. The vocabulary file is read on the driver and broadcast; its size
does not depend on the data.

Defined results: a null text is the empty text and has no tokens; rows come out as they go in (repeated rows,
ties and null ids included); columns besides id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from sparkloom.llm.common import sliced

#: From here on a leaf has no pair, or one that has no merge.
NONE = 1 << 62
#: Words of up to so many symbols are merged together.
WIDE = 32
#: Texts that are worked on together.
ROWS = 256


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge(symbols: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Symbols after all merges; ``ranks`` maps a pair to its rank times 2**32, ``merged`` a rank to the new symbol."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    # A leaf is rank * 2**32 + place, so the least leaf is the leftmost one of the lowest rank.
    leaf = [get(p, NONE) + i for i, p in enumerate(zip(symbols, symbols[1:], strict=False))]
    tree = [leaf]
    while len(leaf) > 1:
        if len(leaf) & 1:
            leaf.append(NONE)
        leaf = list(map(min, leaf[::2], leaf[1::2]))
        tree.append(leaf)
    if (root := leaf[0]) >= NONE:
        return symbols
    symbols = symbols[:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    below, top = tree[:-1], tree[-1]

    def put(i: int, value: int) -> None:
        tree[0][i] = value
        for k, level in enumerate(below):
            i |= 1
            a, b = level[i - 1], level[i]
            i >>= 1
            tree[k + 1][i] = a if a < b else b

    while root < NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        symbols[i] = new = merged[root >> 32]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            put(j, NONE)
            put(i, get((new, symbols[k]), NONE) + i)
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            put(h, get((symbols[h], new), NONE) + h)
        root = top[0]
    return [s for s in symbols if s >= 0]


class Vocabulary:
    """A byte-level BPE with word ends in the tokenizers library's JSON format.

    Covered: NFC, white space and lower-case normalisers, a removing Split pattern, ByteLevel, an end-of-word
    suffix, special tokens that are cut out of the raw text first. Other settings are refused.
    """

    def __init__(self, text: str, cache: int = 120_000):
        d = json.loads(text)
        m = d["model"]
        kinds = [x["type"] for x in (d["normalizer"] or {}).get("normalizers", [])]
        split, level = d["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or level["add_prefix_space"] or level["use_regex"] or m["dropout"] or m["unk_token"] or m["byte_fallback"] or d["decoder"]:
            raise ValueError("settings that this encoder doesn't cover")
        if any(x[k] for x in d["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens with settings that this encoder doesn't cover")
        self.suffix = m["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = m["vocab"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): i << 32 for i, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.wide = max(self.vocab.values()) + 1
        keys = np.array([self.vocab[a] * self.wide + self.vocab[b] for a, b in pairs], np.int64)
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys, self.new = keys[self.rank_of], np.array(self.merged, np.int64)
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(split["pattern"]["Regex"])
        chars = byte_symbols()
        self.first = [self.vocab.get(c, -1) for c in chars]
        self.last = [self.vocab.get(c + self.suffix, -1) for c in chars]
        self.whole = min(*self.first, *self.last) >= 0
        self.starts, self.ends = np.array(self.first, np.int64), np.array(self.last, np.int64)
        self.cache, self.known, self.seen = cache, {}, {}

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token; a byte without a symbol is left out."""
        raw = word.encode()
        symbols = [self.first[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        if -1 in symbols:
            symbols = [x for x in symbols if x >= 0]
        return merge(symbols, self.ranks, self.merged)

    def _leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of the pairs a, b at their places."""
        key = a * self.wide + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (a >= 0) & (b >= 0), (self.rank_of[i] << 32) + at, NONE)

    def _together(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of up to ``width`` symbols, a power of 2."""
        n = np.array([len(w) for w in words])
        rows, cols = np.arange(len(words)), np.arange(width)
        sym = np.full((len(words), width + 1), -1, np.int64)
        sym[:, :width][cols < n[:, None]] = self.starts[np.frombuffer(b"".join(words), np.uint8)]
        sym[rows, n - 1] = self.ends[np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)]
        tree = [self._leaves(sym[:, :-1], sym[:, 1:], cols[None, :])]
        while tree[-1].shape[1] > 1:
            tree.append(np.minimum(tree[-1][:, ::2], tree[-1][:, 1::2]))
        after = np.broadcast_to(np.append(cols + 1, width), sym.shape).copy()
        before = np.broadcast_to(np.append(cols - 1, width - 1), sym.shape).copy()

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray | int) -> None:
            tree[0][r, i] = value
            for low, high in zip(tree[:-1], tree[1:], strict=True):
                i = i >> 1
                high[r, i] = np.minimum(low[r, 2 * i], low[r, 2 * i + 1])

        live = rows
        while True:
            root = tree[-1][live, 0]
            live, root = live[root < NONE], root[root < NONE]
            if not len(live):
                break
            i = root & 0xFFFFFFFF
            j = after[live, i]
            new = self.new[root >> 32]
            k = after[live, j]
            sym[live, i], sym[live, j], after[live, i], before[live, k] = new, -1, k, i
            put(live, j, NONE)
            put(live, i, self._leaves(new, np.where(k < width, sym[live, k], -1), i))
            h = before[live, i]
            r = np.flatnonzero(h >= 0)
            put(live[r], h[r], self._leaves(sym[live[r], h[r]], new[r], h[r]))
        ids = sym[:, :width]
        there = ids >= 0
        blob = ids[there].astype("<u4").tobytes()
        end = 4 * np.cumsum(there.sum(1))
        return [blob[x:y] for x, y in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]

    def words_ids(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens."""
        raw = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(words)
        low = 0
        for width in (8, 16, WIDE) if self.whole else ():
            at = [i for i, w in enumerate(raw) if low < len(w) <= width]
            for lo in range(0, len(at), 4096):
                part = at[lo : lo + 4096]
                for i, ids in zip(part, self._together([raw[i] for i in part], width), strict=True):
                    out[i] = ids
            low = width
        for i, w in enumerate(raw):
            if len(w) > low:
                out[i] = np.array(self.word(words[i]), "<u4").tobytes()
        return out

    def _chunks(self, text: str) -> list[str]:
        """Stretches without white space; the normalisers' work and pre-tokens never cross white space. Special tokens stand alone."""
        out: list[str] = []
        for piece in self.cut.split(text) if self.cut and any(x in text for x in self.special) else [text]:
            if piece in self.special:
                out.append(piece)
            else:
                # str.split also splits at the four separator controls, which the patterns don't take as white space.
                out += piece.split() if not any(c in piece for c in "\x1c\x1d\x1e\x1f") else regex.split(r"\s+", piece)
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers; what the texts share is worked out once."""
        if len(self.seen) > self.cache:
            self.seen = {}
        if len(self.known) > self.cache:
            self.known = {}
        chunks = [self._chunks(t) for t in texts]
        seen, known = self.seen, self.known
        fresh: dict[str, list[str]] = {}
        for c in set().union(*chunks) - seen.keys():
            if c in self.special:
                seen[c] = self.special[c].to_bytes(4, "little")
                continue
            piece = c
            if not piece.isascii():
                # Lower-casing goes letter by letter, so a final sigma is an ordinary one.
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            fresh[c] = self.words.findall(piece.lower())
        missing = list(set().union(*fresh.values()) - known.keys())
        known.update(zip(missing, self.words_ids(missing), strict=True))
        for c, found in fresh.items():
            seen[c] = b"".join([known[w] for w in found])
        return [b"".join([seen[c] for c in x]) for x in chunks]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings joined by a space; ids that stand for nothing are left out."""
        get = self.tokens.get
        return " ".join([t for i in np.frombuffer(ids, "<u4").tolist() if (t := get(i)) is not None])


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(shared, key: str) -> Vocabulary:
    """One parsed vocabulary for each worker process."""
    if key not in _loaded:
        _loaded[key] = Vocabulary(shared.value)
    return _loaded[key]


def _share(spark, path: str):
    """The vocabulary's text, broadcast, and a key for the workers' cache."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return spark.sparkContext.broadcast(text), hashlib.sha1(text.encode()).hexdigest()


def encode(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens long and ids binary (little-endian unsigned 32-bit) of every row's whole text."""
    shared, key = _share(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared, key)
        for b in sliced(batches, ROWS):
            ids = v.encode_many([t or "" for t in b.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*keep, "n_tokens", "ids"])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{kept}{', ' * bool(keep)}n_tokens long, ids binary")


def decode(df: DataFrame, path: str) -> DataFrame:
    """``df`` (of :func:`encode`) with the column decoded."""
    shared, key = _share(df.sparkSession, path)
    at = df.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared, key)
        for b in sliced(batches, ROWS):
            text = [v.decode(x or b"") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "decoded"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("decoded", StringType())]))


def round_trip(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What :func:`decode` makes of :func:`encode`, by one worker a task instead of two."""
    shared, key = _share(df.sparkSession, path)
    names = [*keep, "n_tokens", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared, key)
        for b in sliced(batches, ROWS):
            ids = v.encode_many([t or "" for t in b.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([v.decode(x) for x in ids], pa.string())], names)

    kinds = [StructField(c, df.schema[c].dataType) for c in keep]
    return df.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, StructType([*kinds, StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded", StringType())]))


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of every document's ids and of their decoded text."""
    path = path or default_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = round_trip(docs, path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
