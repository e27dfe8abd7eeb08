"""The registered queries of the text operators over the small tables, against SQL or brute force."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import bpe, decontaminate, entries, langid, secrets, sharding
from tests.llm.test_small import fingerprint, plain_repeats

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entries.queries()[name](spark, SF)
    want = duck.execute(entries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_shards(spark, rows):
    placed = sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    walk = sharding.Feistel(len(rows), 20).permute(np.arange(len(rows)))
    want = sorted((*r, "rows", int(p) % 24, int(p) // 24, None) for r, p in zip(placed, walk.tolist(), strict=True))
    got = entries.queries()["op1_sharding"](spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(map(tuple, got.collect())) == want


def test_secrets(spark, rows):
    """Base spans by open patterns whose short matches are dropped, as they are defined."""
    kinds = (("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 8, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 16, 0), ("hex", re.compile("[0-9a-f]+"), 32, 0))
    got = {r["doc_id"]: r for r in entries.queries()["op3_secrets"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        found = [[(m.start(), k, m.end()) for m in pattern.finditer(t or "") if len(m[group]) >= least] for k, (_, pattern, least, group) in enumerate(kinds)]
        assert [got[i][f"n_{name}"] for name, *_ in kinds] == [len(x) for x in found]
        listed = [f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(y for x in found for y in x)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("format")] == listed


def test_tiling(spark, rows):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = set()
    for j, item in bench:
        p = decontaminate.tokens(item)
        for i, t, _ in rows:
            d, free, used, n = decontaminate.tokens(t), [True] * len(p), set(), 0
            runs = sorted({tuple(p[k : k + 5]) for k in range(len(p) - 4)} & {tuple(d[k : k + 5]) for k in range(len(d) - 4)})
            if not runs:
                continue
            while True:
                best = (0, 0, 0)
                for a in range(len(p)):
                    for b in range(len(d)):
                        m = 0
                        while a + m < len(p) and b + m < len(d) and free[a + m] and b + m not in used and p[a + m] == d[b + m]:
                            m += 1
                        best = max(best, (m, -a, -b))
                m, a, b = best[0], -best[1], -best[2]
                if m < 5:
                    break
                n += m
                free[a : a + m] = [False] * m
                used.update(range(b, b + m))
            if n >= 0.5 * len(p):
                want.add((i, j, round(n / len(p), 9)))
    got = {(r["doc_id"], r["item_id"], round(r["coverage"], 9)) for r in entries.queries()["op5_decontaminate"](spark, SF).collect()}
    assert got == want and want


def test_languages(spark, rows):
    got = {r["doc_id"]: r for r in entries.queries()["op6_langid"](spark, SF).collect()}
    assert len(got) == len(rows)
    learned = {x for i, _, x in rows if x is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    right = held = 0
    for i, t, x in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned | {"und"} and (r["lang_pred"] == "und") == (not langid.words(t))
        if r["held_out"] and x is not None:
            held += 1
            right += r["lang_pred"] == x
    assert held > 30 and right >= 0.97 * held


def test_repeats(spark, rows):
    got = {(r["doc_id"], r["n_bytes"], r["kept_sha256"]): (r["n_removed"], r["n_spans"]) for r in entries.queries()["op8_suffixes"](spark, SF).collect()}
    assert got == plain_repeats([(i, t) for i, t, _ in rows])


def test_tokens(spark, rows):
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    got = {r["doc_id"]: r for r in entries.queries()["op9_bpe"](spark, SF).collect()}
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_fingerprints(spark, rows):
    f = {i: fingerprint(t) for i, t, _ in rows}
    group = {i: i for i in f}
    for i in sorted(f):
        for j in sorted(f):
            if j < i and (f[i] ^ f[j]).bit_count() <= 2 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in entries.queries()["op10_simhash"](spark, SF).collect()}
    assert got == {i: (f"{f[i]:016x}", group[i]) for i in f}


def test_formats_are_found_without_keywords(spark):
    """Precision and recall of the added spans: credentials of two learned formats stand alone among words, numbers and addresses."""
    rng = random.Random(12)
    base, upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 14))) for _ in range(3000)]
    secret = lambda: rng.choice([lambda: "".join(rng.choices(base, k=40)), lambda: "sk_" + "".join(rng.choices(upper, k=12))])()
    plain = lambda: rng.choice([lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"www.{rng.choice(words)}.org/{rng.choice(words)}", lambda: str(rng.randint(10**8, 10**12)), lambda: f"{rng.choice(words)}_{rng.choice(words)}"])()
    some = lambda n: " ".join(plain() if rng.random() < 0.1 else rng.choice(words) for _ in range(n))
    rows, planted = [], {}
    for i in range(600):
        text = some(60)
        if i % 3 == 0:
            text += f" token={secret()} " + some(20)
        elif i % 3 == 1:
            s = secret()
            planted[i] = (len(text) + 1, len(text) + 1 + len(s))
            text += f" {s} " + some(20)
        rows.append((i, text))
    out = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["id"], x["start"], x["end"]) for r in out for x in r["spans"] if x["kind"] == "format"}
    true = {(i, *p) for i, p in planted.items()}
    assert len(found & true) >= 0.95 * len(true)
    assert len(found & true) >= 0.95 * len(found)
