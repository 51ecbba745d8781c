"""Column types: declared name -> family -> Spark type, and the lenient casts of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class Family(Enum):
    INTEGER = "INTEGER"
    FLOAT = "FLOAT"
    DOUBLE = "DOUBLE"
    DECIMAL = "DECIMAL"
    BOOLEAN = "BOOLEAN"
    TEXT = "TEXT"
    STRING = "STRING"
    BINARY = "BINARY"
    DATE = "DATE"
    TIME = "TIME"
    DATETIME = "DATETIME"
    TIMESTAMP = "TIMESTAMP"
    JSON = "JSON"
    UNKNOWN = "UNKNOWN"


#: Declared type names of each family.
_NAMES = {
    Family.INTEGER: ("INT", "INTEGER", "TINYINT", "SMALLINT", "MEDIUMINT", "BIGINT", "INT2", "INT8"),
    Family.FLOAT: ("REAL", "DOUBLE", "DOUBLE PRECISION", "FLOAT"),
    Family.DECIMAL: ("DECIMAL", "NUMERIC"),
    Family.BOOLEAN: ("BOOLEAN", "BOOL"),
    Family.TEXT: ("TEXT", "CLOB"),
    Family.STRING: ("CHAR", "CHARACTER", "VARCHAR", "VARYING CHARACTER", "NCHAR", "NATIVE CHARACTER", "NVARCHAR"),
    Family.BINARY: ("BLOB",),
    Family.DATE: ("DATE",),
    Family.TIME: ("TIME",),
    Family.DATETIME: ("DATETIME",),
    Family.TIMESTAMP: ("TIMESTAMP",),
    Family.JSON: ("JSON",),
}
_FAMILY = {name: family for family, names in _NAMES.items() for name in names}

#: The cast target of each family in the source dialect.
_CAST = {
    Family.INTEGER: "INTEGER", Family.BOOLEAN: "INTEGER", Family.FLOAT: "REAL", Family.DOUBLE: "REAL",
    Family.DECIMAL: "NUMERIC", Family.BINARY: "BLOB",
}


@dataclass(frozen=True)
class ColumnType:
    family: Family
    native: str


def _bare(native: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\(.*?\)", "", native)).strip().upper()


def column_type(native: str) -> ColumnType:
    """Family of a declared type; a size in parentheses doesn't count."""
    return ColumnType(_FAMILY.get(_bare(native), Family.UNKNOWN), native)


def cast_target(kind: ColumnType) -> str:
    """The type name that the source dialect casts to; UNKNOWN goes by the native name, else TEXT."""
    if kind.family is Family.UNKNOWN:
        known = _FAMILY.get(_bare(kind.native))
        return _CAST.get(known, "TEXT") if known else "TEXT"
    return _CAST.get(kind.family, "TEXT")


def render_cast(expression: str, kind: ColumnType) -> str:
    return f"CAST({expression} AS {cast_target(kind)})"


def render_null_cast(kind: ColumnType) -> str:
    return render_cast("NULL", kind)


def spark_type(kind: ColumnType) -> T.DataType:
    """Integers and booleans are 64-bit, dates and JSON are text, sized decimals are exact."""
    target = cast_target(kind)
    if kind.family is Family.DECIMAL:
        size = re.search(r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", kind.native)
        if size and 1 <= int(size[1]) <= 38 and int(size[2] or 0) <= int(size[1]):
            return T.DecimalType(int(size[1]), int(size[2] or 0))
        return T.DoubleType()
    return {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "NUMERIC": T.DoubleType(), "BLOB": T.BinaryType()}.get(target, T.StringType())


def family_of(kind: T.DataType) -> ColumnType:
    """The nearest declared type of a Spark type, for fixtures that are read from files."""
    if isinstance(kind, T.BooleanType):
        return ColumnType(Family.BOOLEAN, "BOOLEAN")
    if isinstance(kind, T.IntegralType):
        return ColumnType(Family.INTEGER, "INTEGER")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return ColumnType(Family.FLOAT, "REAL")
    if isinstance(kind, T.DecimalType):
        return ColumnType(Family.DECIMAL, f"DECIMAL({kind.precision},{kind.scale})")
    if isinstance(kind, T.BinaryType):
        return ColumnType(Family.BINARY, "BLOB")
    if isinstance(kind, T.StringType):
        return ColumnType(Family.TEXT, "TEXT")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return ColumnType(Family.TIMESTAMP, "TIMESTAMP")
    if isinstance(kind, T.DateType):
        return ColumnType(Family.DATE, "DATE")
    return ColumnType(Family.UNKNOWN, kind.simpleString())


def lenient_sql(expression: str, to: T.DataType) -> str:
    """SQL that converts any value to a type without ever failing.

    Text gives its leading number or 0, as the source dialect's CAST does; other
    values that don't fit give NULL."""
    name = to.simpleString()
    if isinstance(to, T.StringType):
        return f"CAST({expression} AS STRING)"
    if isinstance(to, T.IntegralType):
        lead = rf"try_cast(regexp_extract(CAST({expression} AS STRING), '^\\s*([-+]?[0-9]+)', 1) AS {name})"
        return f"CASE WHEN {expression} IS NULL THEN NULL ELSE coalesce(try_cast({expression} AS {name}), {lead}, 0) END"
    if isinstance(to, (T.DoubleType, T.FloatType, T.DecimalType)):
        lead = rf"try_cast(regexp_extract(CAST({expression} AS STRING), '^\\s*([-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?)', 1) AS {name})"
        return f"CASE WHEN {expression} IS NULL THEN NULL ELSE coalesce(try_cast({expression} AS {name}), {lead}, CAST(0 AS {name})) END"
    if isinstance(to, T.BinaryType):
        return f"CAST(CAST({expression} AS STRING) AS BINARY)"
    return f"try_cast({expression} AS {name})"
