"""Every stage of the corpus pipeline against a plain version, on planted cases."""

import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from sparkloom.llm import bpe

random.seed(5)
LANGS = {"en": ["the", "of", "and", "house", "water", "tree", "stone", "river"], "de": ["der", "und", "haus", "wasser", "baum", "stein", "fluss", "nicht"]}


def text(lang, n=80):
    return " ".join(random.choice(LANGS[lang]) + random.choice(["", "s", "er", "en", "ix", "or", "at"]) for _ in range(n))


def test_stages(spark, tmp_path):
    item = "quartz vexed zebra jumps over dozing foxes while pink llamas hum softly near lakes"
    rows = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    copy = rows[10][1].split()
    copy[40] = "changed"
    rows += [(100, rows[3][1], "en", "s", 0), (101, " ".join(copy), "de", "s", 0), (102, text("en", 20) + " " + item + " " + text("en", 20), "en", "s", 0), (103, text("en") + " token=0123456789abcdef x", None, None, None), (104, "%%% 123", "en", "s", 0), (105, None, "en", "s", None), (None, text("de"), "de", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    one = pipeline.language(spark, docs, str(tmp_path))
    kept = {r["doc_id"]: r for r in one.collect()}
    assert set(kept) == {r[0] for r in rows} - {104, 105}
    assert kept[103]["lang"] == "en" and one.columns == docs.columns
    two = pipeline.near_copies(spark, one, str(tmp_path))
    assert {r["doc_id"] for r in two.collect()} == set(kept) - {100, 101}
    three = pipeline.benchmark(spark, two, str(tmp_path))
    assert {r["doc_id"] for r in three.collect()} == set(kept) - {100, 101, 102}
    four = {r["doc_id"]: r for r in pipeline.secret_spans(spark, three, str(tmp_path)).collect()}
    assert "token=" not in four[103]["text"] and four[103]["text"].endswith("[SECRET] x") and four[103]["n_chars"] == len(four[103]["text"])
    assert all(four[i]["text"] == kept[i]["text"] for i in four if i != 103)
    t = Tokenizer.from_file(bpe.default_path())
    out = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(four)
    for i, r in out.items():
        assert np.frombuffer(r["ids"], "<u4").tolist() == t.encode(four[i]["text"], add_special_tokens=False).ids


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
