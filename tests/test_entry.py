"""The driver contract: entry() on sf0.001 and the query/oracle registries."""

import duckdb

from wordtally.sources.tables import TABLES


def test_entry_and_registries(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["word", "idx", "pos_idf", "neg_idf", "pos_df", "neg_df"]
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
    # every twin parses in DuckDB (names of the driver's views, without data)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in o.items():
        con.execute(f"EXPLAIN {sql}")
