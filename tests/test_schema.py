import pytest
from pyspark.sql import types as T

from umbra.errors import UnknownSchema, UnsupportedSql
from umbra.functions.types import ColumnType, Family, column_type, render_cast, render_null_cast, spark_type
from umbra.plans.ddl import altered, parse_alter, parse_create, parse_definition, parse_drop


@pytest.mark.parametrize(
    "native, family, target, spark",
    [
        ("INT", Family.INTEGER, "INTEGER", T.LongType()), ("int8", Family.INTEGER, "INTEGER", T.LongType()), ("DOUBLE  PRECISION", Family.FLOAT, "REAL", T.DoubleType()),
        ("DECIMAL(10, 2)", Family.DECIMAL, "NUMERIC", T.DecimalType(10, 2)), ("NUMERIC", Family.DECIMAL, "NUMERIC", T.DoubleType()), ("BOOL", Family.BOOLEAN, "INTEGER", T.LongType()),
        ("VARCHAR(255)", Family.STRING, "TEXT", T.StringType()), ("BLOB", Family.BINARY, "BLOB", T.BinaryType()), ("DATETIME", Family.DATETIME, "TEXT", T.StringType()),
        ("JSON", Family.JSON, "TEXT", T.StringType()), ("GEOMETRY", Family.UNKNOWN, "TEXT", T.StringType()),
    ],
)
def test_types(native, family, target, spark):
    kind = column_type(native)
    assert kind.family is family and spark_type(kind) == spark
    assert render_cast("x", kind) == f"CAST(x AS {target})" and render_null_cast(kind) == f"CAST(NULL AS {target})"


def test_unknown_family_goes_by_native_name():
    assert render_cast("x", ColumnType(Family.UNKNOWN, "INTEGER")) == "CAST(x AS INTEGER)"


def test_definition():
    d = parse_definition(
        "CREATE TABLE IF NOT EXISTS \"my t\" (\"my id\" INTEGER PRIMARY KEY AUTOINCREMENT, name VARCHAR(10) NOT NULL DEFAULT 'a,b', email TEXT UNIQUE, n INT CHECK (n > 0 AND 'NOT NULL' <> ''),"
        " ref INT REFERENCES o(id), unique_code TEXT, UNIQUE (name, n), CONSTRAINT u2 UNIQUE (ref), FOREIGN KEY (ref) REFERENCES o(id), CHECK (n < 9)) WITHOUT ROWID"
    )
    assert d.columns == ("my id", "name", "email", "n", "ref", "unique_code")
    assert d.primary_key == ("my id",) and d.not_null == ("my id", "name")
    assert d.unique == {"email_UNIQUE": ("email",), "unique_0": ("name", "n"), "u2": ("ref",)} or set(d.unique) >= {"email_UNIQUE", "u2"}
    assert d.defaults == {"name": "'a,b'"} and d.types["name"] == "VARCHAR(10)"


def test_composite_key_and_untyped():
    d = parse_definition("CREATE TABLE t (a, b INT, PRIMARY KEY (b DESC, A))")
    assert d.primary_key == ("b", "a") and "a" not in d.typed


@pytest.mark.parametrize("sql", ["SELECT 1", "CREATE TABLE t (a INT, UNIQUE (nope))", "CREATE TABLE t ()", "CREATE TABLE t (a, a)", "CREATE TABLE t", "DROP TABLE t"])
def test_no_definition(sql):
    assert parse_definition(sql) is None


def test_alter():
    d = parse_definition("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT NOT NULL UNIQUE, b INT, UNIQUE (a, b))")
    more = altered(d, parse_alter("ALTER TABLE t ADD COLUMN c int DEFAULT (1 + 2)"))
    assert more.columns[-1] == "c" and more.typed["c"].family is Family.UNKNOWN and more.defaults["c"] == "(1 + 2)"
    less = altered(d, parse_alter("ALTER TABLE t DROP a"))
    assert less.columns == ("id", "b") and less.not_null == ("id",) and all("a" not in c for c in less.unique.values()) and len(less.unique) == 1
    new = altered(d, parse_alter('ALTER TABLE t RENAME COLUMN A TO "add"'))
    assert new.columns == ("id", "add", "b") and "add" in new.not_null
    assert parse_alter("ALTER TABLE t RENAME TO add_x").new_name == "add_x"
    assert parse_alter("ALTER TABLE t RENAME COLUMN add TO x").action == "RENAME_COLUMN"
    with pytest.raises(UnknownSchema):
        altered(d, parse_alter("ALTER TABLE t DROP COLUMN nope"))
    for sql in ("ALTER TABLE t ALTER COLUMN a TYPE INT", "ALTER TABLE t RENAME"):
        with pytest.raises(UnsupportedSql):
            parse_alter(sql)


def test_create_and_drop():
    assert parse_create("CREATE TEMPORARY TABLE t AS SELECT 1 AS x").query == "SELECT 1 AS x"
    assert parse_drop('DROP TABLE IF EXISTS main."x y";').table == "x y"
