"""Immutable snapshots of the shadow tables, and their views in a child session."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from umbra.errors import UnknownSchema
from umbra.plans.ddl import TableDef
from umbra.plans.tokens import tick
from umbra.sources.scratch import written

#: Writes to a table after which its rows go to the shared folder, to cut the plan.
WRITES_PER_TABLE_FILE = 8


@dataclass(frozen=True)
class Table:
    name: str
    df: DataFrame
    definition: TableDef
    version: int = 0
    pending: int = 0  # writes since the rows were last in a file

    def changed(self, df: DataFrame, definition: TableDef | None = None, volatile: bool = False) -> Table:
        """The next version; a long chain of writes, or values that differ when computed again, are written out."""
        pending = self.pending + 1
        if volatile or pending >= WRITES_PER_TABLE_FILE:
            df, pending = written(df, "shadow"), 0
        return replace(self, df=df, definition=definition or self.definition, version=self.version + 1, pending=pending)


@dataclass(frozen=True)
class Snapshot:
    tables: dict[str, Table] = field(default_factory=dict)

    def find(self, name: str) -> Table | None:
        return self.tables.get(name.lower())

    def get(self, name: str) -> Table:
        found = self.find(name)
        if found is None:
            raise UnknownSchema(f"No such table: {name}")
        return found

    def with_(self, table: Table) -> Snapshot:
        return Snapshot({**self.tables, table.name.lower(): table})

    def without(self, name: str) -> Snapshot:
        return Snapshot({k: v for k, v in self.tables.items() if k != name.lower()})

    def column_type(self, name: str) -> T.DataType | None:
        """The type of a column if every table that has one of that name agrees on it."""
        kinds = {f.dataType.simpleString(): f.dataType for t in self.tables.values() for f in t.df.schema if f.name.lower() == name.lower()}
        whole = [k for k in kinds.values() if isinstance(k, T.IntegralType)]
        if len(whole) == len(kinds) and whole:
            return whole[0]
        return next(iter(kinds.values())) if len(kinds) == 1 else None


def publish(child: SparkSession, old: Snapshot, new: Snapshot) -> None:
    """Makes the child's temp views those of the new snapshot; unchanged tables are left alone."""
    for key, table in old.tables.items():
        if key not in new.tables:
            child.catalog.dropTempView(table.name)
    for key, table in new.tables.items():
        before = old.tables.get(key)
        if before is None or before.df is not table.df:
            table.df.createOrReplaceTempView(tick(table.name) if not table.name.isidentifier() else table.name)
