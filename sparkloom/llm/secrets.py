"""Secret scans: fixed base patterns, and probabilistic automata inferred from labelled credentials.

A first pass over the whole texts gathers what is learned from: the values of the base spans, labelled by their kind,
and the other candidates as background. Candidates are the pieces of 8 or more characters of ``A-Za-z0-9+/_.=-``
that the base spans leave over; the background has short ones (below 16) and long ones apart. Of each of the five at
most ``train`` or ``plain`` distinct values are kept, those of the least hash, in each task and then of all. From
them a prefix tree with counts is built on the driver and its statistically compatible states are merged (Hoeffding
bound ``alpha``) into a probabilistic automaton.

A second pass scores every candidate: the log-likelihood under the likeliest credential's format less that under the
likelier background. A candidate at ``margin`` or more becomes a span of kind ``format``. Of a value only the first
``longest`` characters are learned; values are scored whole.

Defined results: a null text is the empty text and has no spans; rows come out as they go in (repeated rows and
null ids included); a text without candidates has the base spans only; a kind with fewer than ``least`` labelled
values adds nothing; columns besides id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, sliced

#: Fixed patterns and lengths of the base kinds, in the order in which spans with equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "format")
MIN_ASSIGN, MIN_HEX = 8, 32

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: Candidates of this length or more have a background of their own.
LONG = 16
ALPHABET = 66
ANY = math.log(ALPHABET)
#: Scored candidates that a task remembers.
CACHE = 200_000

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) by start, then kind. Spans are whole matches, in code points, the end exclusive.

    The quantifiers that demand 16 and 32 characters find the same runs as open ones whose short matches are
    dropped. Assignments are matched openly: a match that is dropped still takes its text.
    """
    return spans_and_words(text)[0]


def spans_and_words(text: str) -> tuple[list[Span], list[str]]:
    """The base spans, and the whole tokens of 8 or more characters. Digits in base 16 are token characters, so long runs of them are in long tokens only."""
    out: list[Span] = []
    low, words = text.lower(), CANDIDATE.findall(text)
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if max(map(len, words), default=0) >= MIN_HEX:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out), words


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Pieces of candidate tokens that the base spans leave over, in one sweep over both."""
    out: list[tuple[int, int]] = []
    covered, at = union((s, e) for s, _, e in taken), 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        k = at
        while k < len(covered) and covered[k][0] < end:
            if covered[k][0] - start >= 8:
                out.append((start, covered[k][0]))
            start = max(start, covered[k][1])
            # What joins a piece to the span before it is no part of the piece.
            while start < end and text[start] in "+/_.=-":
                start += 1
            k += 1
        if end - start >= 8:
            out.append((start, end))
    return out


class Automaton:
    """Probabilistic automaton inferred from strings by merging the states of their prefix tree."""

    def __init__(self, words: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.flow: list[dict[str, int]] = [{}]
        self.total, self.final = [0], [0]
        for w in sorted(words):
            q = 0
            for c in w:
                self.total[q] += 1
                self.flow[q][c] = self.flow[q].get(c, 0) + 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.flow.append({})
                    self.total.append(0)
                    self.final.append(0)
                q = self.next[q][c]
            self.total[q] += 1
            self.final[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.log: list[dict[str, tuple[float, int]]] = []
        self.rest: list[float] = []
        for q in range(len(self.next)):
            whole = self.total[q] - self.final[q] + 0.5 * ALPHABET
            self.log.append({c: (math.log((n + 0.5) / whole), self.next[q][c]) for c, n in self.flow[q].items()})
            self.rest.append(math.log(0.5 / whole))
        # Rare states merge whatever their depth, so the length has a distribution of its own: as seen, and a hundred-thousandth geometric.
        self.sizes = Counter(map(len, words))
        self.seen, self.leave = max(1, len(words)), 1 / (1 + sum(map(len, words)) / max(1, len(words)))

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if p == q:
                continue
            n, m = self.total[p], self.total[q]
            if self._differ(self.final[p], n, self.final[q], m):
                return False
            for c in self.flow[p].keys() | self.flow[q].keys():
                if self._differ(self.flow[p].get(c, 0), n, self.flow[q].get(c, 0), m):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to state p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.total[p] += self.total[q]
            self.final[p] += self.final[q]
            for c, n in self.flow[q].items():
                self.flow[p][c] = self.flow[p].get(c, 0) + n
            for c, r in self.next[q].items():
                if c in self.next[p]:
                    todo.append((self.next[p][c], r))
                else:
                    self.next[p][c] = r

    def _merge(self) -> None:
        """Red states are settled; a blue one, their successor, is merged into the first compatible red state or becomes red."""
        red, settled = [0], {0}
        while True:
            blue = next(((q, c, r) for q in red for c, r in sorted(self.next[q].items()) if r not in settled), None)
            if blue is None:
                return
            q, c, b = blue
            into = next((r for r in red if self._compatible(r, b)), None)
            if into is None:
                red.append(b)
                settled.add(b)
            else:
                self.next[q][c] = into
                self._fold(into, b)

    def length(self, n: int) -> float:
        return math.log(0.99999 * self.sizes[n] / self.seen + 0.00001 * self.leave * max((1 - self.leave) ** n, 1e-300))

    def score(self, word: str) -> float:
        """Log-likelihood of the whole word and of its length. Beyond the known transitions each character is one of the alphabet."""
        q, out = 0, self.length(len(word))
        log = self.log
        for i, c in enumerate(word):
            if (known := log[q].get(c)) is None:
                return out + self.rest[q] - (len(word) - i - 1) * ANY
            out += known[0]
            q = known[1]
        return out


def rank(value: str) -> int:
    """A hash of the value; its order is that of signed 64-bit numbers."""
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 5) - 2**63


class Least:
    """The ``size`` distinct values of the least hash among those that it is shown."""

    def __init__(self, size: int):
        self.size, self.kept, self.top = size, {}, 2**63

    def add(self, value: str) -> None:
        h = rank(value)
        if h < self.top:
            self.kept[value] = h
            if len(self.kept) > 2 * self.size:
                self.cut()

    def cut(self) -> list[tuple[str, int]]:
        best = sorted(self.kept.items(), key=lambda x: (x[1], x[0]))[: self.size]
        self.kept = dict(best)
        if len(best) == self.size and best:
            self.top = best[-1][1] + 1
        return best


def learn(df: DataFrame, text_col: str = "text", *, train: int = 300, plain: int = 1200, longest: int = 256) -> list[list[str]]:
    """Values to learn from: of assign, access and hex (at most ``train`` each), then short and long background (``plain`` each)."""
    limits = [train] * 3 + [plain] * 2

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = [Least(n) for n in limits], set()
        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                spans, words = spans_and_words(text)
                for s, k, e in spans:
                    found[k].add((ASSIGN.match(text, s)[2] if k == 0 else text[s:e])[:longest])
                for v in set([text[s:e] for s, e in candidates(text, spans)] if spans else words) - seen:
                    if len(seen) < CACHE and len(v) <= longest:
                        seen.add(v)
                    found[3 + (len(v) >= LONG)].add(v[:longest])
        rows = [(k, v, h) for k, x in enumerate(found) for v, h in x.cut()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["kind", "value", "rank"])

    # A task sends at most so many values of a kind, and the least of those are the least of all.
    values = materialize(df.select(F.col(text_col).cast("string")).mapInArrow(gather, "kind int, value string, rank long"), "secrets")
    return [[r[0] for r in values.where(F.col("kind") == k).select("value", "rank").distinct().orderBy("rank", "value").limit(n).collect()] for k, n in enumerate(limits)]


class Formats:
    """The credentials' automata and those of the background.

    A background holds unlabelled credentials too. Values that a format explains better by ``margin`` leave it, and it
    is inferred anew, until none leave. A sample doesn't have every rare kind of plain value, so one background more,
    at ``rare`` times the likelihood, takes any characters alike at the lengths of the others.
    """

    def __init__(self, values: list[list[str]], least: int = 30, alpha: float = 0.05, margin: float = 4.0, rare: float = 0.05):
        self.formats = [Automaton(v, alpha) for v in values[:3] if len(v) >= least]
        self.margin, self.rare, self.plain, self.secrets, plain = margin, math.log(rare), set(), set(), [v for v in values[3:] if v]
        self.ground = [Automaton(v, alpha) for v in plain] if self.formats else []
        for _ in range(5 if self.formats else 0):
            left = [[x for x in v if self.excess(x) < self.margin] for v in plain]
            if sum(map(len, left)) == sum(map(len, plain)):
                break
            plain = [v for v in left if v]
            self.ground = [Automaton(v, alpha) for v in plain]

    def excess(self, value: str) -> float:
        """Log-likelihood under the likeliest format less that under the likeliest background."""
        best, plain = self._bounds(value)
        return best - max(plain, *(a.score(value) for a in self.ground))

    def _bounds(self, value: str) -> tuple[float, float]:
        """Log-likelihood under the likeliest format, and under the background of any characters alike."""
        n = len(value)
        plain = self.rare + max((a.length(n) for a in self.ground), default=0.0) - n * ANY
        return max(a.score(value) for a in self.formats), plain

    def secret(self, value: str) -> bool:
        if not self.formats or value in self.plain:
            return False
        if value in self.secrets:
            return True
        best, plain = self._bounds(value)
        # The likelier background is no less likely than that of any characters, which most values don't exceed.
        known = best - plain >= self.margin and best - max(plain, *(a.score(value) for a in self.ground)) >= self.margin
        if len(self.plain) + len(self.secrets) < CACHE and len(value) <= 256:
            (self.secrets if known else self.plain).add(value)
        return known

    def spans(self, text: str) -> list[Span]:
        """Base and format spans by start, then kind."""
        base, words = spans_and_words(text)
        # Without base spans the candidates are the whole tokens; where none is a secret, their places needn't be found.
        if not self.formats or (not base and not any(map(self.secret, set(words) - self.plain))):
            return base
        return sorted(base + [(s, 3, e) for s, e in candidates(text, base) if self.secret(text[s:e])])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, train: int = 300, least: int = 30, plain: int = 1200, longest: int = 256, alpha: float = 0.05, margin: float = 4.0) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every row, by start, then kind. A format is learned from
    ``least`` to ``train`` labelled values, each background from at most ``plain``."""
    values = learn(df, text_col, train=train, plain=plain, longest=longest)
    formats = Formats(values, least, alpha, margin)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in sliced(batches):
            out = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in formats.spans(text or "")] for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["id", "spans"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rate, "id long, spans array<struct<kind:string,start:int,end:int>>")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", *, train: int = 300, least: int = 30, plain: int = 1200, longest: int = 256, alpha: float = 0.05, margin: float = 4.0) -> DataFrame:
    """``df`` with every span of the text replaced by ``mark``; spans that overlap or touch are replaced as one. Null texts stay null.

    Spans are found and replaced where the text is, so nothing is joined back.
    """
    values = learn(df, text_col, train=train, plain=plain, longest=longest)
    at, names = df.columns.index(text_col), df.columns
    formats = Formats(values, least, alpha, margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = []
            for text in b.column(at).to_pylist():
                if text and (spans := formats.spans(text)):
                    done, out = 0, []
                    for s, e in union((s, e) for s, _, e in spans):
                        out += [text[done:s], mark]
                        done = e
                    text = "".join([*out, text[done:]])
                texts.append(text)
            cols = b.columns
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, df.schema)


def union(spans) -> list[tuple[int, int]]:
    """Sorted spans of which none overlap or touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts of base spans, their digest and all spans of every document."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "format")
    return out.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
