"""Fixture sources: rows, files and existing tables as shadow tables."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Mapping
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.functions.types import ColumnType, Family, lenient_sql
from umbra.plans.ddl import TableDef
from umbra.plans.tokens import tick


def columns_of(rows: Iterable[Mapping[str, Any]]) -> list[str]:
    """All keys of ragged rows in the order they first appear."""
    return list(dict.fromkeys(k for row in rows for k in row))


def _inferred(values: list[Any]) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds and kinds <= {int, bool}:
        return T.LongType()
    if kinds and kinds <= {int, bool, float, Decimal}:
        return T.DoubleType()
    if kinds and kinds <= {bytes, bytearray}:
        return T.BinaryType()
    return T.StringType()


def _plain(value: Any, kind: T.DataType) -> Any:
    """A Python value for a column of that type; True and False are 1 and 0."""
    if value is None:
        return None
    if isinstance(value, (dict, list, tuple, set)):
        raise TypeError(f"Cannot store a {type(value).__name__} as a column value")
    if isinstance(value, bool):
        value = int(value)
    if isinstance(kind, T.LongType):
        return int(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.BinaryType):
        return bytes(value)
    return value.isoformat(" ") if isinstance(value, datetime.datetime) else str(value)


def from_rows(spark: SparkSession, rows: list[Mapping[str, Any]], definition: TableDef | None = None) -> tuple[DataFrame, TableDef]:
    """Rows as a DataFrame: declared columns and types win, else both are inferred from all rows.

    Values of declared columns are converted leniently: '12abc' is 12 in an INTEGER column."""
    names = list(definition.columns) if definition else columns_of(rows)
    found = [{k.lower(): v for k, v in row.items()} for row in rows]
    given = {c: [row.get(c.lower()) for row in found] for c in names}
    raw = T.StructType([T.StructField(c, _inferred(given[c])) for c in names])
    data = [tuple(_plain(given[c][i], raw[c].dataType) for c in names) for i in range(len(rows))]
    df = spark.createDataFrame(data, raw)
    if definition is None:
        return df, TableDef.of(raw)
    return conform(df, definition.spark_schema()), definition


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``df`` under the names and types of ``schema``, by name; missing ones are NULL."""
    have = {f.name.lower(): f for f in df.schema}
    out = []
    for f in schema:
        old = have.get(f.name.lower())
        if old is None:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif old.dataType == f.dataType:
            out.append(F.col(tick(old.name)).alias(f.name))
        else:
            out.append(F.expr(lenient_sql(tick(old.name), f.dataType)).alias(f.name))
    return df.select(*out)


def empty(spark: SparkSession, definition: TableDef) -> DataFrame:
    return spark.createDataFrame([], definition.spark_schema())


def from_frame(df: DataFrame, primary_key: tuple[str, ...] = ()) -> tuple[DataFrame, TableDef]:
    """A DataFrame as it is; its types stay, and no row is read."""
    return df, TableDef.of(df.schema, primary_key)


def from_parquet(spark: SparkSession, path: str, primary_key: tuple[str, ...] = ()) -> tuple[DataFrame, TableDef]:
    return from_frame(spark.read.parquet(path), primary_key)


def reflect_all(spark: SparkSession, database: str | None = None) -> dict[str, TableDef]:
    """Definitions of the session's catalog tables and views by name, in order of name; no rows are read."""
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.name.lower().startswith("sqlite_"))
    return {n: reflect_one(spark, n) for n in names}


def reflect_one(spark: SparkSession, table: str) -> TableDef | None:
    """The definition of one catalog table, or None if there is none."""
    if not spark.catalog.tableExists(table):
        return None
    return TableDef.of(spark.table(table).schema)


__all__ = ["ColumnType", "Family", "columns_of", "conform", "empty", "from_frame", "from_parquet", "from_rows", "reflect_all", "reflect_one"]
