import duckdb
import pytest

from sondeflow.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_as_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(want, key=str)


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 14))
