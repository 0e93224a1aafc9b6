import duckdb
import pandas as pd
import pytest

from codecframe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got)
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    rows = lambda d: sorted(str([plain(v) for v in r]) for r in d[cols].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
