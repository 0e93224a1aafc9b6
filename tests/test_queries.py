import duckdb
import pytest

from codecframe.plans import suite

SF = "/root/testdata/sf0.001"
TABLES = "nation part orders lineitem documents pages conversations".split()


@pytest.mark.parametrize("name", sorted(suite.ORACLES))
def test_query_matches_oracle(spark, name):
    got = suite.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(suite.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
