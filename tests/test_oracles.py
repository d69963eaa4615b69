"""Every query with a DuckDB twin gives the twin's rows, on the smallest tables."""

import math

import duckdb
import pytest

from corpuslab.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "None" if math.isnan(f) else repr(round(f, 5) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    found = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
