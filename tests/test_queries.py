"""Every registered query with SQL gives DuckDB's rows; those without give rows without NaN (their operators are held against plain answers in the other tests)."""

import math

import duckdb
import pytest

from sondeflow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found):
    norm = lambda x: "0.0" if x == 0 and isinstance(x, float) else repr(x) if isinstance(x, float) else str(x)
    return sorted(tuple(map(norm, r)) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_as_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    sql = duck.sql(registry.oracle_sql()[name])
    assert sorted(sql.columns) == cols
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rows(df.select(*cols).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    """Rows under distinct names of known types, and no NaN."""
    df = registry.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and all(kind != "void" for _, kind in df.dtypes)
    got = df.collect()
    assert got and not any(math.isnan(v) for r in got for v in r if isinstance(v, float))
