import os

import duckdb
import pytest

from umbra.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,table", [("read_join_using_whole", "orders"), ("read_join_theta_whole", None), ("read_correlated_whole", "customer"), ("upsert_excluded_whole_state", "customer")])
def test_whole_tables(spark, name, table):
    db = duckdb.connect()
    for t in catalog.QUERIES[name].tables.split():
        db.execute(f"CREATE VIEW {t} AS FROM '{os.path.join(SF, t)}.parquet'")
    got = sorted(map(tuple, catalog.queries()[name](spark, SF).collect()), key=repr)
    assert got == sorted(db.execute(catalog.oracle_sql()[name]).fetchall(), key=repr)
    if table:
        assert len(got) == db.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    else:
        assert sum(n for _, n in got) > db.execute("SELECT count(*) FROM part").fetchone()[0] ** 2 // 3
