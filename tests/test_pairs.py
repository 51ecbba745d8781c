"""Aggregates over unequal pairs: as SQLite, by work that doesn't grow with the pairs."""

import sqlite3
from collections import Counter

import pytest

from umbra import ShadowSession
from umbra.plans import catalog

TABLES = {
    "t": ("id INTEGER PRIMARY KEY, x INTEGER, r REAL, s TEXT", [(k, None if k % 7 == 0 else k * k % 11 - 3, None if k % 5 == 0 else k % 4 / 2 - 0.5, None if k % 9 == 0 else "aBc"[k % 3] * (k % 2 + 1)) for k in range(60)]),
    "u": ("id INTEGER PRIMARY KEY, x INTEGER, y REAL, s TEXT", [(k, None if k % 6 == 0 else k % 8 - 2, k % 3 - 0.5, "abC"[k % 3]) for k in range(40)]),
    "none": ("id INTEGER PRIMARY KEY, x INTEGER", []),
}
ORDERED = [
    *(f"SELECT a.x, count(*) AS n FROM t a JOIN t b ON a.x {op} b.x GROUP BY a.x" for op in ("<", "<=", ">", ">=")),
    *(f"SELECT b.x AS k, count(*) FROM t a JOIN u AS b ON (a.x {op} b.x) GROUP BY b.x" for op in ("<", "<=", ">", ">=")),
    "SELECT a.r, count(*), min(a.id), count(DISTINCT a.s) FROM t a, u b WHERE (a.r < b.y) AND a.x > 0 GROUP BY a.r",
    "SELECT a.s, count(*) FROM t a INNER JOIN u b ON b.s <= a.s GROUP BY a.s HAVING count(*) > 3 ORDER BY count(*) DESC LIMIT 50",
    "SELECT count(*), count(a.s), count(*) * 2 FROM t a JOIN u b ON a.x < b.x",
    "SELECT count(*) / 7, count(*) % 7 FROM t AS a JOIN u AS b ON a.x < b.x",
    "SELECT y, count(*) FROM t JOIN u ON r < y GROUP BY y",
    "SELECT \"a\".\"x\" / 2 AS h, count(*) FROM \"t\" AS \"a\" JOIN u ON \"a\".x < u.x GROUP BY \"a\".\"x\" / 2",
    "SELECT count(*) FROM t a JOIN none b ON a.x < b.x",
    "SELECT a.x, count(*) FROM none a JOIN t b ON a.x < b.x GROUP BY a.x",
    "SELECT DISTINCT a.s FROM t a JOIN u b ON a.x < b.x GROUP BY a.s, a.x",
    "SELECT count(*) FROM t a JOIN u b ON a.x < b.x AND a.x",
]
COUNTED = [
    "SELECT a.x, count(*), min(b.x), max(b.s) FROM t a JOIN u b ON a.x < b.x GROUP BY a.x",
    "SELECT b.s, count(*), count(a.x), count(DISTINCT a.s) FROM t a JOIN u b ON a.x + 1 < b.x AND b.y > a.r GROUP BY b.s",
    "SELECT count(*) FROM t a JOIN u b ON a.x <> b.x",
    "SELECT count(*) FROM t a JOIN u b ON a.x < b.x OR a.s = b.s",
    "SELECT count(*) FROM t a JOIN u b ON a.x BETWEEN b.y AND b.x",
    "SELECT count(*) FROM t a JOIN u b ON NOT a.x < b.x",
    "SELECT count(*) FROM t a JOIN u b ON a.x < b.y",
    "SELECT a.s, count(*) FROM t a JOIN u b ON a.x < b.x WHERE a.x < b.y OR a.id < 9 GROUP BY a.s",
    "SELECT a.s, count(*) FROM t a JOIN u b ON a.x < b.x AND b.s > 'a' GROUP BY a.s",
    "SELECT count(*) FROM t, u",
    "SELECT count(*), max(a.x) FROM t a CROSS JOIN none b",
    "SELECT a.s, count(*) FROM t a, none b GROUP BY a.s",
]
PLAIN = [
    "SELECT max(a.x, b.x) FROM t a JOIN u b ON a.x < b.x",
    "SELECT a.x, b.x FROM t a JOIN u b ON a.x < b.x",
    "SELECT a.x, sum(b.x), avg(b.y), count(*) FROM t a JOIN u b ON a.x < b.x GROUP BY a.x",
    "SELECT count(*) FROM t a LEFT JOIN u b ON a.x < b.x",
    "SELECT a.s, count(*) FROM t a JOIN u b ON a.s = b.s AND a.x < b.x GROUP BY a.s",
    "SELECT count(*) FROM t a JOIN u b ON a.x < b.x JOIN none c ON c.x < a.x",
    "SELECT count(*) FROM t a JOIN u b ON a.x < b.x WHERE EXISTS (SELECT 1 FROM none c WHERE c.x = a.x)",
    "SELECT count(a.s) / 2 FROM t a JOIN u b ON a.x < b.x",
    "SELECT a.x, a.s, max(a.id), count(*) FROM t a JOIN u b ON a.x < b.x AND a.x > 6 GROUP BY a.x",
]


@pytest.fixture(scope="module")
def session(spark):
    s = ShadowSession(spark)
    for name, (body, rows) in TABLES.items():
        s.add(name, [dict(zip((c.split()[0] for c in body.split(", ")), r)) for r in rows], f"CREATE TABLE {name} ({body})")
    return s


@pytest.fixture(scope="module")
def lite():
    con = sqlite3.connect(":memory:")
    for name, (body, rows) in TABLES.items():
        con.execute(f'CREATE TABLE "{name}" ({body})')
        con.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * body.count(",") + "?")})', rows)
    return con


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("sql", ORDERED + COUNTED + PLAIN)
def test_as_sqlite(session, lite, sql):
    got = session.execute(sql)
    want = lite.execute(sql)
    assert got.columns == [d[0] for d in want.description]
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
    plan = _plan(got)
    assert ("__umbra_n" in plan) == (sql not in PLAIN)
    assert ("Window" in plan) == (sql in ORDERED)


def test_schema_is_that_of_a_count(session):
    assert session.execute("SELECT a.x, count(*) AS n FROM t a JOIN t b ON a.x < b.x GROUP BY a.x").schema["n"].simpleString() == "n:bigint"
    assert not session.execute("SELECT count(*) AS n FROM t a JOIN t b ON a.x < b.x").schema["n"].nullable


def test_doubles_that_are_no_numbers(spark):
    values = [0.0, -0.0, 1.5, float("inf"), float("-inf"), float("nan"), float("nan"), None]
    s = ShadowSession.create(spark, {"d": spark.createDataFrame([(v,) for v in values], "v double")})
    for op in ("<", "<=", ">", ">="):
        got = s.execute(f"SELECT a.v, count(*) AS n FROM d a JOIN d b ON a.v {op} b.v GROUP BY a.v")
        plain = s.child.sql(f"SELECT a.v, count(*) AS n FROM d a JOIN d b ON a.v {op} b.v GROUP BY a.v")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_read_join_theta_whole_on_many_rows(spark, tmp_path):
    """400 times the parts of sf0.01: 320 billion pairs, with sizes that are NULL too."""
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    sizes = Counter(r[0] for r in part.select("p_size").collect())
    many = part.crossJoin(spark.range(400).withColumnRenamed("id", "copy"))
    many = many.selectExpr("p_partkey + copy * 2000 AS p_partkey", "p_name", "p_brand", "p_type", "if(copy = 0, NULL, p_size) AS p_size", "p_retailprice")
    many.write.parquet(str(tmp_path / "part.parquet"))
    found = catalog.queries()["read_join_theta_whole"](spark, str(tmp_path))
    assert "NestedLoop" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    got = dict(map(tuple, found.collect()))
    assert got == {a: n * sum(m for b, m in sizes.items() if a < b) * 399**2 for a, n in sizes.items() if a < max(sizes)}
