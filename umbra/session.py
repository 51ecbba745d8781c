"""The shadow session: plans and runs statements against fixture tables only."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.errors import ShadowError, UnknownSchema, UnsupportedSql, is_unknown_schema
from umbra.functions.dialect import to_spark, with_names
from umbra.functions.types import lenient_sql
from umbra.operators import mutations
from umbra.plans import ddl, pairs, statements
from umbra.plans.statements import QueryKind, classify, query_kind
from umbra.plans.tokens import close_of, split_commas, split_statements, text_of, tick, tokenize
from umbra.sources import fixtures
from umbra.sources.scratch import written
from umbra.sources.store import Snapshot, Table, publish

_INHERITED = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
_VOLATILE = re.compile(r"(?i)\b(random|randomblob|uuid|current_timestamp|current_date|current_time)\b|'now'")


@dataclass(frozen=True)
class Mutation:
    """A deferred change of one table."""

    kind: str
    table: str
    apply: Callable[[Snapshot], Snapshot]


@dataclass(frozen=True)
class Plan:
    """What a statement will do: its result rows, and the change it makes if it writes."""

    sql: str
    kind: QueryKind
    result: DataFrame
    mutation: Mutation | None = None
    table: str | None = None


class ShadowSession:
    """SQL over shadow tables.  Tables are versioned DataFrames published as temp views of a child session;
    nothing outside it is read or changed, save a SELECT that runs while no table is known at all."""

    def __init__(self, spark: SparkSession, strict: bool = False):
        self.spark, self.strict = spark, strict
        self.child = spark.newSession()
        for key in _INHERITED:
            value = spark.conf.get(key, None)
            if value is not None:
                self.child.conf.set(key, value)
        self.snapshot = Snapshot()
        self._changes: list[DataFrame | int] = []  # results of writes, or their numbers of rows once counted
        self._last_insert: tuple[DataFrame, str] | None = None

    # -- fixtures ---------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, fixtures_by_name: Mapping[str, Any] | None = None, keys: Mapping[str, tuple[str, ...]] | None = None, strict: bool = False) -> ShadowSession:
        """A session with a table for each DataFrame, list of row dicts, or parquet path."""
        session = cls(spark, strict)
        for name, given in (fixtures_by_name or {}).items():
            session.add(name, given, primary_key=(keys or {}).get(name, ()))
        return session

    @classmethod
    def reflected(cls, spark: SparkSession, database: str | None = None) -> ShadowSession:
        """A session that knows every catalog table, each without rows until it gets fixtures."""
        session = cls(spark)
        for name, definition in fixtures.reflect_all(spark, database).items():
            session._set(Table(name, fixtures.empty(session.child, definition), definition))
        return session

    def add(self, name: str, given: Any, definition: ddl.TableDef | str | None = None, primary_key: tuple[str, ...] = ()) -> None:
        """Sets a table's rows: a DataFrame, a parquet path, or a list of dicts under a definition or CREATE TABLE text."""
        if isinstance(definition, str):
            definition = ddl.parse_create(definition).definition
        known = self.snapshot.find(name)
        if definition is None and known is not None and isinstance(given, list):
            definition = known.definition
        if isinstance(given, list):
            df, made = fixtures.from_rows(self.child, given, definition)
        elif isinstance(given, str):
            df, made = fixtures.from_parquet(self.child, given, primary_key)
        else:
            df, made = fixtures.from_frame(self._adopt(given), primary_key)
        if primary_key:
            made = replace(made, primary_key=tuple(primary_key))
        self._set(Table(name, df, made))

    def _adopt(self, df: DataFrame) -> DataFrame:
        """The DataFrame under the child session, so that its view lives there; only its plan is taken over."""
        if df.sparkSession is self.child:
            return df
        rows = self.child._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.child._jsparkSession, df._jdf.queryExecution().analyzed())
        return DataFrame(rows, self.child)

    def _set(self, table: Table) -> None:
        self._move(self.snapshot.with_(table))

    def _move(self, new: Snapshot) -> None:
        publish(self.child, self.snapshot, new)
        self.snapshot = new

    def table(self, name: str) -> DataFrame:
        """The rows of a table as they are now."""
        return self.snapshot.get(name).df

    def definition(self, name: str) -> ddl.TableDef:
        return self.snapshot.get(name).definition

    def reset(self) -> None:
        self._move(Snapshot())
        self._changes.clear()
        self._last_insert = None

    # -- statements -------------------------------------------------------------

    @staticmethod
    def assert_allowed(sql: str) -> QueryKind:
        kind = query_kind(sql)
        if kind is None:
            raise UnsupportedSql("Unsupported statement", sql)
        return kind

    def plan(self, sql: str) -> Plan:
        """The plan of exactly one statement; the session stays as it is."""
        parts = split_statements(sql)
        if not parts:
            raise UnsupportedSql("Empty or unparseable", sql)
        if len(parts) > 1:
            raise UnsupportedSql("Multi-statement", sql)
        return self._plan(parts[0])

    def plan_many(self, sql: str) -> list[Plan]:
        """Plans of all statements against the session as it is now."""
        parts = split_statements(sql)
        if not parts:
            raise UnsupportedSql("Empty or unparseable", sql)
        return [self._plan(p) for p in parts]

    def apply(self, plan: Plan) -> DataFrame:
        """Makes a plan's change and gives its rows, which later changes don't alter."""
        if plan.mutation is not None:
            self._move(plan.mutation.apply(self.snapshot))
            if plan.kind is QueryKind.WRITE_SIMULATED:
                self._changes.append(plan.result)
                table = self.snapshot.find(plan.mutation.table)
                if plan.mutation.kind in ("INSERT", "REPLACE", "IGNORE", "UPSERT") and table is not None and len(table.definition.primary_key) == 1:
                    self._last_insert = (plan.result, table.definition.primary_key[0])
        return plan.result

    def execute(self, sql: str) -> DataFrame:
        return self.apply(self.plan(sql))

    def execute_script(self, sql: str) -> list[DataFrame]:
        """Plans and applies statements one after the other."""
        parts = split_statements(sql)
        if not parts:
            raise UnsupportedSql("Empty or unparseable", sql)
        return [self.apply(self._plan(p)) for p in parts]

    def changes(self) -> int:
        """Rows affected by the last write."""
        return self._counted(len(self._changes) - 1) if self._changes else 0

    def total_changes(self) -> int:
        return sum(self._counted(k) for k in range(len(self._changes)))

    def _counted(self, k: int) -> int:
        found = self._changes[k]
        if not isinstance(found, int):
            found = self._changes[k] = found.count()
        return found

    def last_insert_rowid(self) -> int:
        if self._last_insert is None:
            return 0
        df, key = self._last_insert
        return df.agg(F.max(tick(key))).first()[0] or 0

    # -- planning ---------------------------------------------------------------

    def _plan(self, sql: str) -> Plan:
        kind = self.assert_allowed(sql)
        try:
            return getattr(self, f"_plan_{classify(sql).lower()}")(sql, kind)
        except ShadowError:
            raise
        except (AnalysisException, ParseException) as e:
            if is_unknown_schema(e):
                raise UnknownSchema(str(e).split("\n")[0], sql) from e
            raise UnsupportedSql(str(e).split("\n")[0], sql) from e
        except IndexError as e:
            raise UnsupportedSql("Cannot parse statement", sql) from e

    def _spark(self, text: str) -> str:
        if re.search(r"(?i)\b(last_insert_rowid|changes|total_changes)\s*\(\s*\)", text):
            text = "".join(self._counters(text))
        return to_spark(text, self.snapshot.column_type, self._schema_of)

    def _schema_of(self, query: str) -> T.StructType | None:
        """The schema of a FROM item of a query, if it stands for itself."""
        try:
            return self.child.sql(self._spark(with_names(query))).schema
        except (AnalysisException, ParseException, ShadowError):
            return None

    def _counters(self, text: str) -> list[str]:
        """The text with the session's counters in place of their calls."""
        out, at, tokens = [], 0, tokenize(text)
        for i, t in enumerate(tokens):
            if t.is_("LAST_INSERT_ROWID", "CHANGES", "TOTAL_CHANGES") and [x.text for x in tokens[i + 1 : i + 3]] == ["(", ")"]:
                out += [text[at : t.start], str(getattr(self, t.text.lower())())]
                at = tokens[i + 2].end
        return [*out, text[at:]]

    def _run(self, sql: str) -> DataFrame:
        """Spark SQL over the shadow views only: a table that isn't known is an error."""
        if self.snapshot.tables:
            self._check_tables(sql)
        return self.child.sql(sql)

    def _check_tables(self, sql: str) -> None:
        for parts in sorted(_relations(self.child, sql)):
            if self.snapshot.find(parts[-1]) is None or len(parts) > 1:
                raise UnknownSchema(f"No such table: {'.'.join(parts)}", sql)

    def _fixpoint(self, sql: str) -> DataFrame | None:
        """A query whose WITH has one recursive UNION that drops repeated rows: rounds until none is new.

        Each round's new rows are written; the query then reads the rows as a table.  None if it's no such query."""
        found = statements.distinct_recursion(sql)
        if found is None:
            return None
        old = self.snapshot
        rows = self._query(found.anchor)
        rows = rows.toDF(*(found.columns or rows.columns)).distinct()
        definition = ddl.TableDef.of(rows.schema)
        seen = new = written(rows, "round")
        try:
            for k in range(1, 1 << 30):
                self._move(old.with_(Table(found.name, new, definition)))
                step = self._query(found.step)
                if len(step.columns) != len(seen.columns):
                    raise UnsupportedSql("Sides of a UNION differ in their columns", sql)
                step = step.toDF(*seen.columns).select(*(F.col(tick(f.name)).cast(f.dataType) for f in seen.schema))
                new = written(_new(step, seen), "round", n=F.count(F.lit(1)))
                if not new.observed["n"]:
                    break
                seen = seen.unionByName(new)
                seen = written(seen, "rounds") if k % 8 == 0 else seen
            self._move(old.with_(Table(found.name, seen, definition)))
            return self._query(found.rest)
        finally:
            self._move(old)

    def _query(self, sql: str) -> DataFrame:
        if self.snapshot.tables and re.search(r"(?i)\brecursive\b", sql) and (fixed := self._fixpoint(sql)) is not None:
            return fixed
        named = with_names(_without_main(sql))
        spark_sql = self._spark(named)
        if not self.snapshot.tables:
            return self.spark.sql(spark_sql)
        if (counted := pairs.counted(named, self._columns)) is not None:
            try:
                return self._run(self._spark(counted))
            except (AnalysisException, ParseException):  # the query as given says what is wrong
                pass
        try:
            return self._run(spark_sql)
        except AnalysisException as e:
            if e.getCondition() in ("MISSING_AGGREGATION", "MISSING_GROUP_BY"):
                return self._run(_any_value(spark_sql))
            raise

    def _columns(self, table: str) -> T.StructType | None:
        found = self.snapshot.find(table)
        return found.df.schema if found is not None else None

    def _plan_select(self, sql: str, kind: QueryKind) -> Plan:
        return Plan(sql, kind, self._query(sql))

    _plan_values = _plan_select

    def _keys(self, definition: ddl.TableDef) -> list[tuple[str, ...]]:
        keys = [definition.primary_key] if definition.primary_key else []
        return keys + [k for k in definition.unique.values() if k not in keys]

    def _insert_rows(self, s: statements.Insert, table: Table) -> DataFrame:
        """New rows with all columns of the table, in order, by position of the given ones."""
        definition = table.definition
        schema = table.df.schema
        given = [definition.column(c) or _missing(c, s.table) for c in s.columns] if s.columns is not None else list(definition.columns)
        if len(set(given)) != len(given):
            raise UnsupportedSql("A column is named twice")
        if s.default_values:
            rows, given = self.child.range(1).select(F.lit(None).alias("__umbra_none")), []
        elif s.rows is not None:
            if any(len(r) != len(given) for r in s.rows):
                raise UnsupportedSql("Number of values and columns differ")
            cells = [", ".join(lenient_sql(f"({self._spark(v)})", schema[c].dataType) if v.upper() != "NULL" else f"CAST(NULL AS {schema[c].dataType.simpleString()})" for c, v in zip(given, r)) for r in s.rows]
            names = ", ".join(tick(f"v{k}") for k in range(len(given)))
            try:
                rows = self._run(f"{s.with_clause} SELECT * FROM VALUES {', '.join(f'({c}, {k})' for k, c in enumerate(cells))} AS v({names}, {tick(mutations._POS)})")
            except AnalysisException as e:
                if e.getCondition() not in ("INVALID_INLINE_TABLE.CANNOT_EVALUATE_EXPRESSION_IN_INLINE_TABLE", "INVALID_INLINE_TABLE.FAILED_SQL_EXPRESSION_EVALUATION"):
                    raise
                union = " UNION ALL ".join(f"SELECT {c}, {k}" for k, c in enumerate(cells))
                rows = self._run(f"{s.with_clause} SELECT * FROM ({union}) AS v({names}, {tick(mutations._POS)})")
        else:
            rows = self._query(f"{s.with_clause} {s.query}")
            if len(rows.columns) != len(given):
                raise UnsupportedSql("Number of values and columns differ")
            rows = rows.toDF(*(f"v{k}" for k in range(len(given))))
        at = {c: f"v{k}" for k, c in enumerate(given)}
        out = []
        for f in schema:
            if f.name in at:
                same = rows.schema[at[f.name]].dataType == f.dataType
                value = F.col(at[f.name]) if same else F.expr(lenient_sql(at[f.name], f.dataType))
            elif f.name in definition.defaults:
                value = F.expr(lenient_sql(f"({self._spark(definition.defaults[f.name])})", f.dataType))
            else:
                value = F.lit(None).cast(f.dataType)
            out.append(value.alias(f.name))
        keep = [mutations._POS] if mutations._POS in rows.columns else []
        return rows.select(*out, *keep)

    def _plan_insert(self, sql: str, kind: QueryKind) -> Plan:
        s = statements.parse_insert(sql)
        table = self.snapshot.find(s.table)
        if table is None:
            table = self._inferred_table(s)
        definition, keys = table.definition, self._keys(table.definition)
        rows = self._insert_rows(s, table)
        volatile = bool(_VOLATILE.search(sql)) or s.query is not None and bool(re.search(r"(?i)\blimit\b", s.query))
        if volatile:  # the rows must be the same each time they are read
            rows = written(rows, "inserted")
        name = "INSERT"
        if s.upsert is not None:
            key = self._conflict_key(definition, s.upsert.target)
            if s.upsert.nothing:
                name = "IGNORE"
                affected, after = mutations.insert_ignore(table, rows, [key] if key and s.upsert.target else keys)
            else:
                if key is None:
                    raise UnsupportedSql("ON CONFLICT needs a primary key or a unique constraint", sql)
                name = "UPSERT"
                assignments = [(definition.column(c) or _missing(c, s.table), self._spark(_unqualified(e, s.table))) for c, e in s.upsert.assignments]
                where = self._spark(_unqualified(s.upsert.where, s.table)) if s.upsert.where else ""
                affected, after = mutations.upsert_in_order(table, rows, key, assignments, where)
        elif s.conflict == "IGNORE":
            name = "IGNORE"
            affected, after = mutations.insert_ignore(table, rows, keys)
        elif s.conflict == "REPLACE":
            name = "REPLACE"
            affected, after = mutations.insert_replace(table, rows, keys)
        else:
            affected, after = mutations.insert(table, rows)
            if self.strict:
                self._check_constraints(after, definition)
        return self._write(sql, kind, name, table, affected, after)

    def _inferred_table(self, s: statements.Insert) -> Table:
        """INSERT with named columns into a table that isn't known makes one."""
        if s.columns is None:
            raise UnknownSchema(f"No such table: {s.table}")
        if s.rows is not None:
            names = ", ".join(tick(c) for c in s.columns)
            cells = ", ".join("(" + ", ".join(self._spark(v) for v in r) + ")" for r in s.rows)
            schema = self.child.sql(f"SELECT * FROM VALUES {cells} AS v({names})").schema
        elif s.query is not None:
            schema = self._query(f"{s.with_clause} {s.query}").toDF(*s.columns).schema
        else:
            raise UnknownSchema(f"No such table: {s.table}")
        definition = ddl.TableDef.of(schema)
        return Table(s.table, fixtures.empty(self.child, definition), definition)

    def _conflict_key(self, definition: ddl.TableDef, target: list[str]) -> tuple[str, ...] | None:
        if not target:
            return definition.primary_key or next(iter(definition.unique.values()), None)
        names = {c.lower() for c in target}
        for key in self._keys(definition):
            if {c.lower() for c in key} == names:
                return key
        raise UnsupportedSql("ON CONFLICT names no primary key or unique constraint")

    @staticmethod
    def _check_constraints(after: DataFrame, definition: ddl.TableDef) -> None:
        """NOT NULL and uniqueness, in one aggregation each (strict sessions only)."""
        required = [c for c in definition.not_null]
        if required and after.agg(*(F.count_if(F.col(tick(c)).isNull()).alias(c) for c in required)).filter(" or ".join(f"{tick(c)} > 0" for c in required)).count():
            raise UnsupportedSql("NOT NULL constraint failed")
        for key in [definition.primary_key, *definition.unique.values()]:
            if key and not after.dropna(subset=list(key)).groupBy(*(F.col(tick(c)) for c in key)).count().filter("count > 1").isEmpty():
                raise UnsupportedSql("UNIQUE constraint failed")

    def _write(self, sql: str, kind: QueryKind, name: str, table: Table, affected: DataFrame, after: DataFrame) -> Plan:
        volatile = bool(_VOLATILE.search(sql))

        def apply(snapshot: Snapshot) -> Snapshot:
            return snapshot.with_(table.changed(after, volatile=volatile))

        return Plan(sql, kind, affected, Mutation(name, table.name, apply), table.name)

    def _chosen(self, s, table: Table, where: str, alias: str) -> tuple[Table, DataFrame | None, tuple[str, ...]]:
        """For ORDER BY and LIMIT: the table, the ids of the rows to change, and what identifies a row.

        A primary key does; without one, the place in a parquet file of a fixture; else rows are numbered and
        written once, so that numbers stay."""
        if not (s.limit or s.order_by):
            return table, None, ()
        row_id, plain = table.definition.primary_key, table
        if not row_id:
            try:
                place = F.struct("_metadata.file_path", "_metadata.file_block_start", "_metadata.row_index").alias("__umbra_row")
                numbered = table.df.select("*", place)
            except AnalysisException:
                numbered = written(table.df.withColumn("__umbra_row", F.monotonically_increasing_id()), "numbered")
            row_id = ("__umbra_row",)
            table = replace(table, df=numbered)
        source = f"{tick('__umbra_target')} AS {tick(alias or table.name)}"
        table.df.createOrReplaceTempView("__umbra_target")
        sql = f"{s.with_clause} SELECT {', '.join(tick(c) for c in row_id)} FROM {source}"
        sql += f" WHERE coalesce(({where}), false)" if where else ""
        sql += f" ORDER BY {self._spark(s.order_by)}" if s.order_by else ""
        sql += f" {self._spark('LIMIT ' + s.limit)}" if s.limit else ""
        chosen = self.child.sql(sql)
        self.child.catalog.dropTempView("__umbra_target")
        return (table if row_id == ("__umbra_row",) else plain), chosen, row_id

    def _source(self, table: Table, alias: str) -> str:
        return f"{tick(table.name)} AS {tick(alias)}" if alias else tick(table.name)

    def _plan_update(self, sql: str, kind: QueryKind) -> Plan:
        s = statements.parse_update(sql)
        table = self.snapshot.find(s.table)
        if table is None:
            raise UnknownSchema(f"No such table: {s.table}", sql)
        where = self._spark(s.where) if s.where else ""
        target, chosen, row_id = self._chosen(s, table, where, s.alias)
        assignments = [(c, self._spark(e)) for c, e in s.assignments]
        run = self._run_with(s.with_clause, target, table)
        affected, after = mutations.update(target, run, self._source(table, s.alias), assignments, where, chosen, row_id, bool(_VOLATILE.search(sql)))
        names = [c for c in affected.columns if c != "__umbra_row"]
        return self._write(sql, kind, "UPDATE", table, affected.select(*map(tick, names)), after.drop("__umbra_row"))

    def _run_with(self, with_clause: str, target: Table, table: Table) -> Callable[[str], DataFrame]:
        """Runs SQL with the statement's CTEs; numbered rows stand in for the table while it does."""

        def run(sql: str) -> DataFrame:
            if target is table:
                return self._run(f"{self._spark(with_clause)} {sql}")
            target.df.createOrReplaceTempView(tick(table.name))
            try:
                return self._run(f"{self._spark(with_clause)} {sql}")
            finally:
                table.df.createOrReplaceTempView(tick(table.name))

        return run

    def _plan_delete(self, sql: str, kind: QueryKind) -> Plan:
        s = statements.parse_delete(sql)
        table = self.snapshot.find(s.table)
        if table is None:
            raise UnknownSchema(f"No such table: {s.table}", sql)
        where = self._spark(s.where) if s.where else ""
        target, chosen, row_id = self._chosen(s, table, where, s.alias)
        run = self._run_with(s.with_clause, target, table)
        affected, after = mutations.delete(target, run, self._source(table, s.alias), where, chosen, row_id, bool(_VOLATILE.search(sql)))
        return self._write(sql, kind, "DELETE", table, affected.drop("__umbra_row"), after.drop("__umbra_row"))

    # -- virtual schema ---------------------------------------------------------

    def _ddl(self, sql: str, kind: QueryKind, name: str, table: str, apply: Callable[[Snapshot], Snapshot]) -> Plan:
        none = self.child.range(0).select(F.col("id").alias("1"))
        return Plan(sql, kind, none, Mutation(name, table, apply), table)

    def _plan_create_table(self, sql: str, kind: QueryKind) -> Plan:
        s = ddl.parse_create(sql)
        if self.snapshot.find(s.table) is not None:
            if not s.if_not_exists:
                raise UnsupportedSql("Table already exists", sql)
            return self._ddl(sql, kind, "CREATE_TABLE", s.table, lambda snapshot: snapshot)
        if s.query is not None:
            df = self._query(s.query)
            made = Table(s.table, df, ddl.TableDef.of(df.schema))
            if _VOLATILE.search(sql):
                made = made.changed(df, volatile=True)
        else:
            made = Table(s.table, fixtures.empty(self.child, s.definition), s.definition)
        return self._ddl(sql, kind, "CREATE_TABLE", s.table, lambda snapshot: snapshot.with_(made))

    def _plan_drop_table(self, sql: str, kind: QueryKind) -> Plan:
        s = ddl.parse_drop(sql)
        if self.snapshot.find(s.table) is None and not s.if_exists:
            raise UnknownSchema(f"No such table: {s.table}", sql)
        return self._ddl(sql, kind, "DROP_TABLE", s.table, lambda snapshot: snapshot.without(s.table))

    def _plan_alter_table(self, sql: str, kind: QueryKind) -> Plan:
        s = ddl.parse_alter(sql)
        table = self.snapshot.find(s.table)
        if table is None:
            raise UnknownSchema(f"No such table: {s.table}", sql)
        if s.action == "RENAME_TABLE":
            if self.snapshot.find(s.new_name) is not None:
                raise UnsupportedSql("Table already exists", sql)
            return self._ddl(sql, kind, "ALTER_TABLE", table.name, lambda snapshot: snapshot.without(s.table).with_(replace(snapshot.get(s.table), name=s.new_name)))
        definition = ddl.altered(table.definition, s, sql)
        old = table.definition.column(s.column)
        if s.action == "ADD":
            kind_of = definition.spark_schema()[s.column].dataType
            default = definition.defaults.get(s.column)
            value = F.expr(lenient_sql(f"({self._spark(default)})", kind_of)) if default else F.lit(None).cast(kind_of)
            df = table.df.withColumn(s.column, value)
        elif s.action == "DROP":
            df = table.df.drop(old)
        else:
            df = table.df.withColumnRenamed(old, s.new_name)
        return self._ddl(sql, kind, "ALTER_TABLE", table.name, lambda snapshot: snapshot.with_(table.changed(df, definition)))


def _new(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct rows that aren't among the seen ones; NULLs are equal."""
    old = seen.toDF(*(f"__umbra_{k}" for k in range(len(seen.columns))))
    same = reduce(lambda a, b: a & b, (F.col(tick(c)).eqNullSafe(F.col(f"__umbra_{k}")) for k, c in enumerate(seen.columns)))
    return rows.distinct().join(old, same, "left_anti")


def _missing(column: str, table: str):
    raise UnknownSchema(f"Table {table} has no column named {column}")


def _without_main(sql: str) -> str:
    """``main.t`` as ``t``."""
    tokens, out, at = tokenize(sql), [], 0
    for i, t in enumerate(tokens[:-2]):
        before = tokens[i - 1] if i else None
        if t.is_name and t.name.lower() == "main" and tokens[i + 1].text == "." and before is not None and (before.is_("FROM", "JOIN", "INTO", "UPDATE", "TABLE") or before.text == ","):
            out.append(sql[at : t.start])
            at = tokens[i + 2].start
    return "".join([*out, sql[at:]])


def _unqualified(expression: str, table: str) -> str:
    """``t.c`` as ``c`` for the table itself: a bare name is the existing row's."""
    tokens, out, at = tokenize(expression), [], 0
    for i, t in enumerate(tokens[:-2]):
        if t.is_name and t.name.lower() == table.lower() and tokens[i + 1].text == ".":
            out.append(expression[at : t.start])
            at = tokens[i + 2].start
    return "".join([*out, expression[at:]])


def _relations(spark: SparkSession, sql: str) -> set[tuple[str, ...]]:
    """Tables a query reads, by Spark's own parser, without the names of its CTEs."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found: set[tuple[str, ...]] = set()

    def each(seq):
        for i in range(seq.length()):
            yield seq.apply(i)

    def walk(node, known: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = tuple(each(node.multipartIdentifier()))
            if len(parts) > 1 or parts[0].lower() not in known:
                found.add(parts)
        if kind == "UnresolvedWith":
            for pair in each(node.cteRelations()):
                name = pair._1().lower()
                # a recursive CTE reads itself
                walk(pair._2(), known | {name} if node.allowRecursion() else known)
                known = known | {name}
        for child in each(node.children()):
            walk(child, known)
        for sub in each(node.subqueries()):
            walk(sub, known)

    walk(plan, frozenset())
    return found


_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "LISTAGG", "ANY_VALUE", "FIRST", "LAST"}


def _calls(sql: str, body: list) -> list[tuple[str, list]]:
    """Aggregate calls of a select item: name and tokens of the arguments."""
    found = []
    for k, t in enumerate(body):
        if t.upper in _AGGREGATES and k + 1 < len(body) and body[k + 1].text == "(":
            found.append((t.upper, body[k + 2 : close_of(body, k + 1)]))
    return found


def _any_value(sql: str) -> str:
    """Select items of an aggregate query that are neither aggregates nor grouped: of the row that has the minimum or
    maximum if there is just one such aggregate, else as any value of their group."""
    tokens = tokenize(sql)
    start = next((i for i, t in enumerate(tokens) if t.is_("SELECT") and t.depth == 0), None)
    end = next((i for i, t in enumerate(tokens) if start is not None and i > start and t.is_("FROM") and t.depth == 0), None)
    if start is None or end is None:
        return sql
    group = next((i for i, t in enumerate(tokens) if t.is_("GROUP") and t.depth == 0), None)
    grouped = set()
    if group is not None:
        stop = next((i for i, t in enumerate(tokens) if i > group and t.depth == 0 and t.is_("HAVING", "ORDER", "LIMIT", "WINDOW", "UNION")), len(tokens))
        grouped = {text_of(sql, p).lower() for p in split_commas(tokens[group + 2 : stop])}
    parts, bodies = split_commas(tokens[start + 1 : end]), []
    for part in parts:
        alias = next((k for k, t in enumerate(part) if t.is_("AS") and t.depth == 0), len(part))
        bodies.append((part[:alias], alias))
    ends = [(name, inside) for body, _ in bodies for name, inside in _calls(sql, body) if name in ("MIN", "MAX")]
    pick = f"{ends[0][0].lower()}_by" if len(ends) == 1 and ends[0][1] else ""
    items = []
    for part, (body, alias) in zip(parts, bodies):
        text = text_of(sql, body)
        if _calls(sql, body) or text.lower() in grouped or all(t.kind in ("number", "string") for t in body):
            items.append(text_of(sql, part))
        else:
            name = part[alias + 1].name if alias < len(part) else body[-1].name if body[-1].is_name else text
            value = f"{pick}({text}, {text_of(sql, ends[0][1])})" if pick else f"any_value({text})"
            items.append(f"{value} AS {tick(name)}")
    return f"{sql[: tokens[start].end]} {', '.join(items)} {sql[tokens[end].start :]}"


__all__ = ["Mutation", "Plan", "QueryKind", "ShadowSession"]
