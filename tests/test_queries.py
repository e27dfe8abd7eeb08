"""Every registered query with SQL returns what DuckDB returns over the same tables."""

import os

import duckdb
import pytest

from sparkloom.plans import catalogue

SF = "/root/testdata/sf0.001"
#: These need more rows.
LARGER = dict.fromkeys(("cv_timeseries",), "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    found = {}
    for d in {SF, *LARGER.values()}:
        found[d] = duckdb.connect()
        for t in TABLES:
            found[d].execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return found


def comparable(rows):
    return sorted(tuple("null" if v is None else f"{v + 0.0:.4f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    d = LARGER.get(name, SF)
    df = catalogue.queries()[name](spark, d)
    cols = sorted(df.columns)
    got = duck[d].execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in got.fetchall()]
    assert comparable([tuple(r[c] for c in cols) for r in df.collect()]) == comparable(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() == 5
