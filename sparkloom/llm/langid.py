"""Language identification by word-first backoff.

Per language, log frequencies of all words and of all 4-, 3-, 2- and 1-character pieces of words (with word ends
marked) are learned from about ``per_lang`` labelled texts a language, taken whole: those whose id's hash lies below a
bound. That is the only bound of the model.
A text's word that is known in any language scores by its log frequency in each; an unseen word by the mean over
its known 4-character pieces, or if none is known its 3-character pieces, and so on. Word scores are summed over
the whole text. The result's score is the softmax of the summed scores, for texts of more than ``evidence``
words scaled down to that many.

Defined results: ``und`` with score 0 for a null text, one without a letter, or if nothing could be learned; ties
go to the language that comes first in order; rows come out as they go in (repeated rows included); a row with a
null id is not held out and not learned from; columns besides those named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sparkloom.llm.common import sliced

WORD = regex.compile(r"\p{L}+")
ORDERS = (4, 3, 2, 1)
#: Languages, word and piece indexes, and a row of scores for each word and piece.
Model = tuple[list[str], dict[str, int], np.ndarray, dict[str, int], np.ndarray]


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def pieces(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_lang: int = 1000) -> Model:
    """Languages, word scores and piece scores of about ``per_lang`` texts a language; one pass counts the texts, one more the words of all languages."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    # A bound on the hash takes about per_lang texts of a language in one scan, without sorting the corpus.
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(2**63 - 1, int(min(1.0, per_lang / v) * 2**64) - 2**63))]) if n else None
    if share is None:
        return [], {}, np.zeros((0, 0)), {}, np.zeros((0, 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, Counter] = defaultdict(Counter)
        for b in sliced(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tally[lang].update(words(text))
        for lang, c in tally.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    seen = rows.where(F.col("h") <= share[F.col("lang")]).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    known: dict[str, Counter] = defaultdict(Counter)
    for lang, word, times in zip(*(seen[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        known[lang][word] = times
    langs = sorted(known)
    parts: dict[int, dict[str, Counter]] = {k: {x: Counter() for x in langs} for k in ORDERS}
    for x in langs:
        for w, c in known[x].items():
            for k in ORDERS:
                for p in pieces(w, k):
                    parts[k][x][p] += c
    pieces_of = [logs([parts[k][x] for x in langs]) for k in ORDERS]
    index = {g: i for i, g in enumerate(g for keys, _ in pieces_of for g in keys)}
    return langs, *logs([known[x] for x in langs]), index, np.concatenate([t for _, t in pieces_of])


def logs(counts: list[Counter]) -> tuple[dict[str, int], np.ndarray]:
    """Keys and their smoothed log frequencies in each language, as differences from the key's mean."""
    keys = sorted(set().union(*counts)) if counts else []
    table = np.array([[c.get(k, 0) + 0.5 for c in counts] for k in keys], float).reshape(len(keys), len(counts))
    table = np.log(table) - np.array([math.log(sum(c.values()) + 0.5 * len(c) + 1) for c in counts])
    return {k: i for i, k in enumerate(keys)}, table - table.mean(axis=1, keepdims=True) if len(keys) else table


class Scorer:
    """Scores of texts. Stretches between white space are counted and worked out once each, up to ``cache`` are kept."""

    def __init__(self, model: Model, evidence: int = 20, cache: int = 300_000):
        self.langs, self.known, self.word_scores, self.grams, self.gram_scores = model
        self.evidence, self.cache = evidence, cache
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs) + 1))

    def vector(self, word: str) -> np.ndarray:
        if (i := self.known.get(word)) is not None:
            return self.word_scores[i]
        for n in ORDERS:
            if found := [i for p in pieces(word, n) if (i := self.grams.get(p)) is not None]:
                return self.gram_scores[found].sum(axis=0) / len(found)
        return np.zeros(len(self.langs))

    def learn(self, stretches: set[str]) -> None:
        """Rows of the summed scores and the number of words of stretches."""
        if len(self.rows) > self.cache:
            self.rows, self.table = {}, self.table[:0]
        fresh = [c for c in stretches if c not in self.rows]
        new = np.zeros((len(fresh), len(self.langs) + 1))
        get, rows, at = self.known.get, [], []
        for k, c in enumerate(fresh):
            # A known word has letters only, so such a stretch is that word.
            if (i := get(c)) is not None:
                rows.append(k)
                at.append(i)
                continue
            for w in WORD.findall(c):
                if (i := get(w)) is not None:
                    rows.append(k)
                    at.append(i)
                else:
                    new[k, :-1] += self.vector(w)
                    new[k, -1] += 1
        if rows:
            # Known words of all stretches together.
            np.add.at(new[:, :-1], rows, self.word_scores[at])
            np.add.at(new[:, -1], rows, 1)
        self.rows.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh)), strict=True))
        self.table = np.concatenate([self.table, new])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts = [Counter(t.lower().split()) if t else Counter() for t in texts]
        out: list[tuple[str, float]] = []
        for lo in range(0, len(counts), 256):
            part = counts[lo : lo + 256]
            self.learn(set().union(*part))
            for c in part:
                total = np.array(list(c.values()), float) @ self.table[[self.rows[w] for w in c]] if c else np.zeros(1)
                if not total[-1] or not self.langs:
                    out.append(("und", 0.0))
                    continue
                x = total[:-1] * min(1.0, self.evidence / total[-1])
                p = np.exp(x - x.max())
                best = int(np.argmax(x))
                out.append((self.langs[best], float(p[best] / p.sum())))
        return out


def predict(df: DataFrame, model: Model, text_col: str = "text", evidence: int = 20, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the predicted language and its score in the columns ``out``; columns that have those names give way.

    The model's size is that of the vocabulary of the bounded number of texts it learned from, so it is broadcast.
    """
    df = df.drop(*(c for c in df.columns if c.lower() in {x.lower() for x in out} and c != text_col))
    shared, at, names = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col), [*df.columns, *out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, evidence)
        for b in sliced(batches, 256):
            found = scorer.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names)

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out[0], StringType()), StructField(out[1], DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op6_langid(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; the held-out third is never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
