"""States after writes, held against the same statements in an in-memory SQLite database."""

import sqlite3

import pytest

from umbra import ShadowSession, UnknownSchema, UnsupportedSql
from umbra.errors import is_unknown_schema

SHOP = {
    "users": ("id INTEGER PRIMARY KEY, name TEXT NOT NULL, email TEXT, status TEXT", [("1", "Alice", "alice@example.com", "active"), ("2", "Bob", "bob@example.com", "pending"), ("3", "Charlie", None, "active")]),
    "orders": ("id INTEGER PRIMARY KEY, user_id INTEGER NOT NULL, amount REAL, created_at TEXT", [("1", "1", "100.00", "2024-01-01 00:00:00"), ("2", "2", "250.50", "2024-01-02 12:30:00")]),
    "order_items": ("order_id INTEGER NOT NULL, product_id INTEGER NOT NULL, quantity INTEGER NOT NULL DEFAULT 1, PRIMARY KEY (order_id, product_id)", [("1", "1", "2"), ("1", "2", "1"), ("2", "1", "3")]),
    "products": ("id INTEGER PRIMARY KEY, name TEXT NOT NULL, price REAL, category TEXT", [("1", "Widget", "19.99", "tools"), ("2", "Gadget", "49.99", "electronics")]),
}


def _columns(body):
    return [p.split()[0] for p in body.split(", PRIMARY KEY (")[0].split(", ")]


@pytest.fixture
def shop(spark):
    s = ShadowSession(spark)
    for name, (body, rows) in SHOP.items():
        s.add(name, [dict(zip(_columns(body), r)) for r in rows], f"CREATE TABLE {name} ({body})")
    return s


@pytest.fixture
def lite():
    con = sqlite3.connect(":memory:")
    for name, (body, rows) in SHOP.items():
        con.execute(f"CREATE TABLE {name} ({body})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return con


def _rows(found):
    return sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in found), key=repr)


WRITES = [
    "INSERT INTO users (id, name) VALUES (4, 'D''e'), (5, 'E')",
    "INSERT INTO users SELECT id + 10, upper(name), email, status FROM users WHERE status = 'active'",
    "INSERT OR IGNORE INTO users VALUES (1, 'x', NULL, NULL), (9, 'first', NULL, NULL), (9, 'second', NULL, NULL)",
    "REPLACE INTO users VALUES (2, 'one', NULL, NULL), (2, 'two', NULL, NULL)",
    "INSERT OR REPLACE INTO order_items VALUES (1, 1, 50), (3, 3, 3)",
    "INSERT INTO order_items (order_id, product_id) VALUES (7, 7)",
    "INSERT INTO users VALUES (1, 'N', 'n', 'n'), (6, 'six', NULL, 's') ON CONFLICT (id) DO UPDATE SET name = name || excluded.name, status = excluded.status WHERE users.status = 'active'",
    "INSERT INTO users VALUES (1, 'N', 'n', 'n'), (6, 'six', NULL, 's') ON CONFLICT DO NOTHING",
    "UPDATE users SET name = status, status = name WHERE email LIKE 'A%'",
    "UPDATE users SET email = NULL WHERE NOT (email = 'bob@example.com')",
    "UPDATE users SET id = id + 100",
    "UPDATE orders SET amount = amount / 2, user_id = user_id / 2",
    "UPDATE users SET status = (SELECT max(amount) FROM orders o WHERE o.user_id = users.id) WHERE id IN (SELECT user_id FROM orders)",
    "UPDATE users AS u SET name = u.name || '!' WHERE u.id > 1",
    "UPDATE order_items SET quantity = quantity + 1 WHERE order_id = 1 ORDER BY quantity DESC LIMIT 1",
    "DELETE FROM users WHERE email <> 'alice@example.com'",
    "DELETE FROM users WHERE email IS NULL",
    "DELETE FROM orders",
    "DELETE FROM order_items ORDER BY quantity DESC, product_id LIMIT 1 OFFSET 1",
    "DELETE FROM users WHERE EXISTS (SELECT 1 FROM orders WHERE orders.user_id = users.id AND amount > 200)",
    "WITH big AS (SELECT user_id FROM orders WHERE amount > 200) DELETE FROM users WHERE id IN (SELECT user_id FROM big)",
    "WITH big AS (SELECT user_id FROM orders WHERE amount > 200) INSERT INTO products (id, name) SELECT user_id + 20, 'p' FROM big",
]


@pytest.mark.parametrize("sql", WRITES)
def test_write_as_sqlite(shop, lite, sql):
    lite.execute(sql)
    before = {t: _rows(shop.table(t).collect()) for t in SHOP}
    plan = shop.plan(sql)
    assert {t: _rows(shop.table(t).collect()) for t in SHOP} == before, "planning changed a table"
    affected = shop.apply(plan)
    kept = _rows(affected.collect())
    for t in SHOP:
        got = _rows(shop.table(t).collect())
        assert got == _rows(lite.execute(f"SELECT * FROM {t}").fetchall())
        if t != plan.table:
            assert got == before[t], "another table changed"
    shop.execute(f"DELETE FROM {plan.table}")
    assert _rows(affected.collect()) == kept, "a later write changed the returned rows"


READS = [
    "SELECT 5/2, 5/0, -7/2, 7 % 4, 7 % 0, 5.0/2",
    "SELECT id / 2, id * 1.0 / 2 FROM users",
    "SELECT name FROM users WHERE name LIKE 'a%' OR name GLOB '[BC]*'",
    "SELECT id FROM users WHERE email IS NOT 'bob@example.com'",
    "SELECT id, email IS NULL FROM users WHERE id ORDER BY id LIMIT 1, 2",
    "SELECT iif(id > 1, 'many', 'one'), ifnull(email, 'none'), typeof(id), typeof(name), typeof(email) FROM users",
    "SELECT status, count(*), total(id), group_concat(name, '/') FROM users GROUP BY status HAVING count(*) = 1",
    "SELECT min(1, 2), max(3, 1, 2), max(1, NULL)",
    "SELECT CAST('12abc' AS INTEGER), CAST('' AS INTEGER), CAST('3.5e1x' AS REAL), CAST(12 AS TEXT), CAST('-7' AS INTEGER)",
    "SELECT strftime('%Y/%m/%d', created_at), date(created_at), time(created_at), date(created_at, '+1 month', 'start of month'), julianday(created_at) FROM orders",
    "SELECT substr('hello', 2, 3), instr('hello', 'l'), replace('aaa', 'a', 'b'), trim('  x '), unicode('A'), hex('AB'), char(72, 105), length('abc')",
    "SELECT u.name, o.amount FROM users u LEFT JOIN orders o ON o.user_id = u.id",
    "SELECT name FROM (SELECT name, id FROM users) t WHERE id IN (SELECT user_id FROM orders)",
    "WITH users AS (SELECT 1 AS one) SELECT one FROM users",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT sum(n) FROM r",
    "SELECT name, row_number() OVER (PARTITION BY status ORDER BY id DESC) FROM users",
    "SELECT CASE id WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END FROM users WHERE id BETWEEN 1 AND 2 AND 1",
    "VALUES (1, 'a'), (2, 'b')",
    "SELECT json_extract('{\"a\": {\"b\": \"x\"}}', '$.a.b'), nullif(1, 1), coalesce(NULL, 2), abs(-3), round(2.567, 2)",
    "SELECT count(*) FROM main.users, orders WHERE users.id = orders.user_id",
    "SELECT \"name\", `email`, [status] FROM \"users\" WHERE [id] == 1",
    "SELECT 'a\\b', 'it''s -- no comment', '#1'",
    # integer division by the types of what the query reads
    "SELECT c / 2, c % 2 FROM (SELECT count(*) AS c FROM users)",
    "SELECT id / 2 FROM (SELECT id * 1.5 AS id FROM users)",
    "SELECT x.id / 2, o.id / 2 FROM (SELECT id * 1.0 AS id FROM users) x JOIN orders o ON o.id = x.id",
    "WITH c AS (SELECT id, amount AS a FROM orders), d(n, m) AS (SELECT id, a FROM c) SELECT n / 2, m / 2 FROM d",
    "WITH RECURSIVE r(n) AS (SELECT 7 UNION ALL SELECT n - 3 FROM r WHERE n > 3) SELECT n / 2 FROM r",
    "SELECT (SELECT max(quantity) FROM order_items i WHERE i.order_id = users.id) / 2, id / 2 FROM users",
    "SELECT n / 2 FROM (SELECT id AS n FROM users UNION ALL SELECT quantity FROM order_items)",
    "SELECT 7.5 % 2, -7 % 3, 7 % 2.9, 9 % id FROM users",
    "SELECT round(2.567, 1), round(2.5), round(7), typeof(round(7)), 1e2, .5, 2.",
    "SELECT name FROM users WHERE name || '\\%' LIKE 'b%\\%'",
    "SELECT name FROM users WHERE name LIKE 'b\\%'",
    "SELECT name FROM users WHERE name LIKE 'b!%' ESCAPE '!' OR name LIKE 'b' || '%'",
    "SELECT substr('hello', 0, 3), substr('hello', 0), substr('hello', -3, 2), substr(name, id - 1, 2) FROM users",
    "SELECT ltrim('xxhi', 'x'), rtrim('hixx', 'x'), trim('xyhiyx', 'xy'), ltrim('  a '), trim('xxhixx', 'x')",
    "SELECT printf('%.2f|%d|%5d|%-5s|%s|%x|%%', id, id, id, name, NULL, 255), printf('%d', 7.9) FROM users",
    "SELECT date('2024-01-31', '+1 month'), date('2024-02-29', '+1 year'), date('2024-05-31', '-3 months'), date('2024-03-15', '+1 month'), datetime('2024-01-31 10:00:00', '+1 month', '+1 day')",
    # recursion that drops repeated rows
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT n + 1 FROM r WHERE n < 5) SELECT n FROM r",
    "WITH RECURSIVE r(n) AS (SELECT 0 UNION SELECT (n + 2) % 5 FROM r) SELECT count(*), sum(n) FROM r",
    "WITH RECURSIVE e(a, b) AS (VALUES (1, 2), (2, 3), (3, 1), (7, 8)), r(x) AS (SELECT 1 UNION SELECT b FROM e JOIN r ON e.a = r.x), z AS (SELECT x * 10 AS t FROM r) SELECT t FROM z",
    "WITH RECURSIVE users(id, name) AS (SELECT 1, 'a' UNION SELECT id + 1, NULL FROM users WHERE id < 3) SELECT id, name FROM users",
    # a bare column comes from the row of the only minimum or maximum
    "SELECT status, name, max(id) FROM users GROUP BY status",
    "SELECT name, min(id) AS m FROM users",
    "SELECT order_id, product_id, max(quantity), count(*) FROM order_items GROUP BY order_id",
]


@pytest.mark.parametrize("sql", READS)
def test_read_as_sqlite(shop, lite, sql):
    want = lite.execute(sql)
    got = shop.execute(sql)
    assert _rows([float(v) if type(v).__name__ == "Decimal" else v for v in r] for r in got.collect()) == _rows([int(v) if isinstance(v, bool) else v for v in r] for r in want.fetchall()) or _booleans(got, want)
    assert len(got.columns) == len(want.description)


def _booleans(got, want):
    return any(t == "boolean" for _, t in got.dtypes)


def test_result_names(shop):
    assert shop.execute("SELECT id + 1, count(*) n, name AS x, u.email FROM users u GROUP BY id, name, u.email").columns == ["id + 1", "n", "x", "email"]
    assert shop.execute("UPDATE users SET status = 'a' WHERE id = 1").columns == ["status", "id", "name", "email"]


def test_ddl_script(shop, lite):
    script = (
        "CREATE TABLE t (a INTEGER DEFAULT 7, b TEXT); INSERT INTO t DEFAULT VALUES; INSERT INTO t (b) VALUES ('x'); ALTER TABLE t ADD COLUMN c INT DEFAULT 3;"
        "ALTER TABLE t RENAME COLUMN a TO z; ALTER TABLE t RENAME TO u; UPDATE u SET z = z + c; ALTER TABLE u DROP COLUMN c"
    )
    lite.executescript(script)
    shop.execute_script(script)
    assert _rows(shop.execute("SELECT * FROM u").collect()) == _rows(lite.execute("SELECT * FROM u").fetchall())
    with pytest.raises(UnknownSchema):
        shop.plan("SELECT * FROM t")
    shop.execute("DROP TABLE u")
    shop.execute("DROP TABLE IF EXISTS u")
    shop.execute("CREATE TABLE IF NOT EXISTS users (x)")
    assert shop.table("users").count() == 3


@pytest.mark.parametrize(
    "sql, error",
    [
        ("SELECT * FROM nope", UnknownSchema), ("SELECT nope FROM users", UnknownSchema), ("SELECT * FROM (SELECT * FROM nope) t", UnknownSchema), ("UPDATE nope SET a = 1", UnknownSchema),
        ("DELETE FROM nope", UnknownSchema), ("DROP TABLE nope", UnknownSchema), ("ALTER TABLE nope ADD a", UnknownSchema), ("INSERT INTO nope VALUES (1)", UnknownSchema),
        ("INSERT INTO users (nope) VALUES (1)", UnknownSchema), ("PRAGMA x", UnsupportedSql), ("", UnsupportedSql), ("SELECT 1; SELECT 2", UnsupportedSql), ("SELEC 1", UnsupportedSql),
        ("INSERT INTO users VALUES (1)", UnsupportedSql), ("CREATE TABLE users (a)", UnsupportedSql), ("ALTER TABLE users FROB", UnsupportedSql), ("SELECT ((1)", UnsupportedSql),
        ("INSERT INTO users (name) VALUES ('a') ON CONFLICT (name) DO UPDATE SET email = 'q'", UnsupportedSql),
        ("SELECT sum(id) OVER (ORDER BY id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM users", UnsupportedSql),
        ("WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT n + 1 FROM r WHERE n < 5 UNION SELECT 9) SELECT n FROM r", UnsupportedSql), ("UPDATE users SET nope = 1", (UnsupportedSql, UnknownSchema)),
    ],
)
def test_errors(shop, sql, error):
    with pytest.raises(error):
        shop.execute(sql)


def test_error_classifier(shop):
    try:
        shop.spark.sql("SELECT * FROM surely_not_here")
    except Exception as e:
        assert is_unknown_schema(e)
    assert not is_unknown_schema(ValueError("no such table: x"))


def test_plan_many_does_not_apply(shop):
    plans = shop.plan_many("DELETE FROM users; SELECT count(*) AS n FROM users")
    assert [p.kind.value for p in plans] == ["WRITE_SIMULATED", "READ"] and plans[0].mutation and not plans[1].mutation
    assert plans[1].result.first()[0] == 3
    assert shop.execute_script("DELETE FROM users; SELECT count(*) AS n FROM users")[1].first()[0] == 0


def test_counters(shop):
    shop.execute("INSERT INTO users (id, name) VALUES (41, 'a'), (42, 'b')")
    shop.execute("DELETE FROM users WHERE id = 41")
    assert tuple(shop.execute("SELECT changes(), total_changes(), last_insert_rowid()").first())[:2] == (1, 3)


def test_inferred_rows_and_unknown_insert(spark):
    s = ShadowSession.create(spark, {"t": [{"a": 1, "b": "x"}, {"c": 2.5, "a": None}]})
    assert s.table("t").columns == ["a", "b", "c"] and s.table("t").count() == 2
    s.execute("INSERT INTO fresh (k, v) VALUES (1, 'one')")
    assert [tuple(r) for r in s.table("fresh").collect()] == [(1, "one")]
    with pytest.raises(TypeError):
        s.add("bad", [{"a": [1]}])


def test_lenient_fixtures(spark):
    s = ShadowSession(spark)
    s.add("t", [{"a": "12abc", "b": True}, {"a": "", "b": False}, {"a": None}], "CREATE TABLE t (a INTEGER, b BOOLEAN, c TEXT)")
    assert sorted(map(tuple, s.table("t").collect()), key=repr) == [(0, 0, None), (12, 1, None), (None, None, None)]


def test_pass_through_without_tables(spark):
    assert ShadowSession(spark).execute("SELECT 1 AS one").first()[0] == 1


def test_strict(spark):
    s = ShadowSession(spark, strict=True)
    s.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT NOT NULL)")
    s.execute("INSERT INTO t VALUES (1, 'x')")
    for sql in ("INSERT INTO t VALUES (1, 'y')", "INSERT INTO t (a) VALUES (2)"):
        with pytest.raises(UnsupportedSql):
            s.execute(sql)


def test_reflected_tables_read_empty(spark):
    spark.range(5).createOrReplaceTempView("umbra_reflected")
    try:
        s = ShadowSession.reflected(spark)
        assert s.execute("SELECT count(*) AS n FROM umbra_reflected").first()[0] == 0
    finally:
        spark.catalog.dropTempView("umbra_reflected")


def test_dataframe_fixture_and_long_scripts(spark):
    s = ShadowSession.create(spark, {"t": spark.range(10).withColumnRenamed("id", "k")}, keys={"t": ("k",)})
    s.execute_script(";".join(["UPDATE t SET k = k + 1"] * 20))
    assert s.execute("SELECT min(k) AS lo, count(*) AS n FROM t").first() == (20, 10)
    assert s.snapshot.get("t").version == 20
    assert spark.range(3).count() == 3 and not spark.catalog.tableExists("t")


def test_random_values_stay(spark):
    s = ShadowSession.create(spark, {"t": [{"a": 1}, {"a": 2}]})
    s.execute("UPDATE t SET a = random()")
    assert sorted(s.table("t").collect()) == sorted(s.table("t").collect())


UNIQUE = [
    "INSERT OR IGNORE INTO t VALUES (5, 'a', 1), (5, 'b', 2)",
    "INSERT OR IGNORE INTO t VALUES (5, 'p', 1), (6, 'p', 2), (6, 'q', 3), (5, 'q', 4), (8, 'r', 5), (NULL, 'r', 6), (9, NULL, 7), (10, NULL, 8)",
    "INSERT INTO t VALUES (1, 'z', 0), (20, 'x', 1), (20, 'y', 2) ON CONFLICT DO NOTHING",
    "REPLACE INTO t VALUES (1, 'x'  , 5), (1, 'y', 6)",
    "REPLACE INTO t VALUES (30, 'a', 1), (31, 'a', 2), (31, 'c', 3)",
    "INSERT OR REPLACE INTO t VALUES (40, NULL, 1), (41, NULL, 2), (7, 'b', 3)",
    "INSERT INTO t VALUES (1, 'k', 1), (1, 'l', 2), (50, 'm', 3), (50, 'n', 4), (50, 'o', 5) ON CONFLICT (id) DO UPDATE SET n = t.n * 10 + excluded.n",
    "INSERT INTO t VALUES (1, 'k', 1), (1, 'l', 9), (60, 'm', 1), (60, 'n', 8) ON CONFLICT (id) DO UPDATE SET n = excluded.n WHERE excluded.n > 5",
    "INSERT INTO t VALUES (70, 's', 1), (70, 's', 1), (70, 's', 1), (70, 's', 1), (70, 's', 1), (70, 's', 1) ON CONFLICT (id) DO UPDATE SET n = n + excluded.n",
    "INSERT INTO t (u, n) SELECT u, n + 1 FROM t WHERE u IS NOT NULL ON CONFLICT (u) DO UPDATE SET n = excluded.n",
]


@pytest.mark.parametrize("sql", UNIQUE)
def test_writes_under_several_keys_as_sqlite(spark, sql):
    rows = [(1, "a", 1), (2, "b", 2), (7, "x", 3), (9, None, 4)]
    body = "id INT PRIMARY KEY, u TEXT UNIQUE, n INTEGER"
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE TABLE t ({body})")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    s = ShadowSession(spark)
    s.add("t", [dict(zip(("id", "u", "n"), map(str, r))) | ({"u": None} if r[1] is None else {}) for r in rows], f"CREATE TABLE t ({body})")
    con.execute(sql)
    s.execute(sql)
    assert _rows(s.table("t").collect()) == _rows(con.execute("SELECT * FROM t").fetchall())


def test_volatile_writes_give_the_rows_that_they_store(shop):
    made = {r.id: r.name for r in shop.execute("UPDATE users SET name = random()").collect()}
    assert made == {r.id: r.name for r in shop.table("users").collect()}
    shop.add("many", [{"id": str(k)} for k in range(300)], "CREATE TABLE many (id INTEGER PRIMARY KEY)")
    gone = {r.id for r in shop.execute("DELETE FROM many WHERE random() > 0").collect()}
    left = {r.id for r in shop.table("many").collect()}
    assert gone | left == set(range(300)) and not gone & left and gone and left
