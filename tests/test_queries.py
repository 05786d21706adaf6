"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from coaffil.plans import registry

DATA = "/root/testdata/sf0.001"
FAST = [n for n in registry.oracle_sql() if n != "nb_glm_binary"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(rows):
    fix = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    done = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in done.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in done.fetchall()]
    assert plain(df.select(*cols).collect()) == plain(want)
