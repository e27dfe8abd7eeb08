"""Concordance of many rows: pairs are counted by ranks, not met one by one."""

import numpy as np

from sparkloom.operators import survival as V


def brute(t, e, r):
    good = total = 0.0
    for i in range(len(t)):
        for j in range(i + 1, len(t)):
            a, b = (i, j) if t[i] <= t[j] else (j, i)
            if t[a] == t[b]:
                total += e[a] or e[b]
                good += 0.5 * (e[a] or e[b])
            elif e[a]:
                total += 1
                gap = r[a] - r[b]
                good += 1.0 if gap > 1e-10 else 0.5 if abs(gap) <= 1e-10 else 0.0
    return good, total


def test_pairs_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    for k in (1, 2, 5, 40, 200):
        t, r, e = rng.integers(0, k, 150).astype(float), rng.integers(0, 9, 150) / 7 + rng.choice([0.0, 4e-11], 150), rng.integers(0, 2, 150).astype(float)
        r[:5] = np.nan
        assert V._counted(t, np.ones(150), e, r) == brute(t, e, r)


def test_ranges_and_copies(spark):
    rng = np.random.default_rng(2)
    t, r, e = np.round(rng.exponential(5, 400), 1), np.round(rng.normal(size=400), 1), (rng.random(400) < 0.6).astype(int)
    rows = [(float(a), int(b), float(c)) for a, b, c in zip(t, e, r, strict=True)] * 3
    got = V.concordance(spark.createDataFrame(rows, "t double, e int, r double"), "t", "e", "r", size=20).first()
    assert (got["concordant"], got["comparable"]) == brute(np.tile(t, 3), np.tile(e, 3), np.tile(r, 3))


def test_work_is_not_that_of_all_pairs():
    """200,000 rows in one range: all pairs would be 20,000,000,000 and take minutes."""
    import time

    rng = np.random.default_rng(3)
    began = time.process_time()
    good, total = V._counted(rng.random(200_000), np.ones(200_000), np.ones(200_000), rng.random(200_000))
    assert total == 200_000 * 199_999 / 2 and abs(good / total - 0.5) < 0.01 and time.process_time() - began < 20
