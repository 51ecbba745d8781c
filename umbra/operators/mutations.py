"""Writes as pure functions: a snapshot's table and new rows to affected rows and the next version.

Every function returns ``(affected, after)``.  Nothing runs until an action does, but for what depends on the
order of rows in one statement (upserts, and ignored conflicts under several keys) and on volatile values: those
new rows are written first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.errors import UnsupportedSql
from umbra.functions.types import lenient_sql
from umbra.plans.tokens import tick, tokenize
from umbra.sources.scratch import written
from umbra.sources.store import Table

_HIT, _POS, _NEW = "__umbra_hit", "__umbra_pos", "__umbra_new"

Run = Callable[[str], DataFrame]


def _same_key(key: Sequence[str], left: str, right: str) -> Column:
    """Keys are equal; NULL keys never conflict."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{tick(c)}") == F.col(f"{right}.{tick(c)}") for c in key))


def _some_null(key: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(tick(c)).isNull() for c in key))


def _one_per_key(rows: DataFrame, key: Sequence[str], last: bool) -> DataFrame:
    """The first or last row of each key; rows with a NULL in the key all stay."""
    if _POS not in rows.columns:
        rows = rows.withColumn(_POS, F.monotonically_increasing_id())
    order = F.col(_POS).desc() if last else F.col(_POS)
    rank = F.row_number().over(Window.partitionBy(*(F.col(tick(c)) for c in key)).orderBy(order))
    return rows.withColumn("__umbra_rank", rank).filter((F.col("__umbra_rank") == 1) | _some_null(key)).drop("__umbra_rank")


def insert(table: Table, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = rows.drop(_POS)
    return rows, table.df.unionByName(rows)


def _taken(table: Table, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of new rows that old rows have.  The new rows are the side that can be broadcast: a large table isn't
    shuffled for a small batch."""
    columns = [F.col(tick(c)) for c in key]
    return table.df.select(*columns).alias("o").join(rows.select(*columns).alias("n"), _same_key(key, "o", "n"), "left_semi").distinct()


def _typed_sql(df: DataFrame, expression: str, kind: T.DataType) -> str:
    """An expression over ``df`` as a value of that type."""
    if df.select(F.expr(expression)).schema[0].dataType == kind:
        return f"({expression})"
    return lenient_sql(f"({expression})", kind)


def _typed(df: DataFrame, expression: str, kind: T.DataType) -> Column:
    return F.expr(_typed_sql(df, expression, kind))


def _rank(rows: DataFrame, key: Sequence[str], last: bool) -> Column:
    """Whether a row is the first or last with its key; rows with a NULL in the key all are."""
    order = F.col(_POS).desc() if last else F.col(_POS)
    rank = F.row_number().over(Window.partitionBy(*(F.col(tick(c)) for c in key)).orderBy(order))
    return (rank == 1) | _some_null(key)


def _placed(rows: DataFrame) -> DataFrame:
    return rows if _POS in rows.columns else rows.withColumn(_POS, F.monotonically_increasing_id())


def insert_ignore(table: Table, rows: DataFrame, keys: Sequence[Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """New rows whose keys are all free, of old rows and of new ones before them.  Without a key: a plain insert.

    With several keys a row may be refused under one and so leave another free: rows are settled in rounds, each
    of which takes those that come first under all their keys and drops those that clash with them."""
    for key in keys:
        rows = rows.alias("n").join(_taken(table, rows, key).alias("o"), _same_key(key, "n", "o"), "left_anti")
    if len(keys) < 2:
        return insert(table, _one_per_key(rows, keys[0], last=False) if keys else rows)
    rest, taken, count = written(_placed(rows), "new"), None, {"n": F.count(F.lit(1))}
    while True:
        first = rest.withColumns({f"__umbra_first_{k}": _rank(rest, key, last=False) for k, key in enumerate(keys)})
        first = written(first.filter(" and ".join(f"__umbra_first_{k}" for k in range(len(keys)))).select(*map(tick, rest.columns)), "first", **count)
        taken = first if taken is None else taken.unionByName(first)
        rest = rest.alias("n").join(first.alias("o"), F.col(f"n.{_POS}") == F.col(f"o.{_POS}"), "left_anti")
        for key in keys:
            rest = rest.alias("n").join(first.select(*map(tick, key)).alias("o"), _same_key(key, "n", "o"), "left_anti")
        rest = written(rest, "rest", **count)
        if not rest.observed["n"]:
            return insert(table, taken)


def insert_replace(table: Table, rows: DataFrame, keys: Sequence[Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """New rows take the place of old ones with any of their keys, and of new ones before them."""
    old, rows = table.df, _placed(rows)
    for key in keys:  # a row that a later one replaces has removed old ones before
        old = old.alias("o").join(rows.select(*(F.col(tick(c)) for c in key)).alias("n"), _same_key(key, "o", "n"), "left_anti")
    columns = rows.columns
    last = rows.withColumns({f"__umbra_last_{k}": _rank(rows, key, last=True) for k, key in enumerate(keys)})
    rows = last.filter(" and ".join(f"__umbra_last_{k}" for k in range(len(keys)))).select(*map(tick, columns)) if keys else rows
    rows = rows.drop(_POS)
    return rows, old.unionByName(rows)


def upsert_in_order(table: Table, rows: DataFrame, key: Sequence[str], assignments: Sequence[tuple[str, str]], where: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`upsert`, for rows that may share a key: a later one meets what the ones before it made.

    The rows of a key are folded, in order, in one expression.  With a subquery among the expressions the nth rows
    of all keys are one step instead, in which only old rows with a key among the new ones take part."""
    if not any(t.is_("SELECT") for e in (*(e for _, e in assignments), where) for t in tokenize(e)):
        return _upsert_fold(table, rows, key, assignments, where)
    rank = F.row_number().over(Window.partitionBy(*(F.col(tick(c)) for c in key)).orderBy(_POS))
    ranked = _placed(rows).withColumn("__umbra_nth", F.when(_some_null(key), 1).otherwise(rank))
    ranked = written(ranked, "ranked", steps=F.max("__umbra_nth"))
    steps = ranked.observed["steps"] or 1
    if steps == 1:
        return upsert(table, ranked.drop("__umbra_nth"), key, assignments, where)
    keys = ranked.select(*(F.col(tick(c)) for c in key)).distinct()
    old = table.df.alias("o")
    untouched = old.join(keys.alias("n"), _same_key(key, "o", "n"), "left_anti")
    now, affected = old.join(keys.alias("n"), _same_key(key, "o", "n"), "left_semi"), None
    for step in range(1, steps + 1):
        made, now = upsert(replace(table, df=now), ranked.filter(F.col("__umbra_nth") == step).drop("__umbra_nth"), key, assignments, where)
        if step % 4 == 0:
            made, now = written(made, "made"), written(now, "now")
        affected = made if affected is None else affected.unionByName(made)
    return affected, untouched.unionByName(now)


def _of_state(expression: str, columns: Sequence[str]) -> str:
    """An expression over a row as one over a struct ``__umbra_state`` of it; what belongs to ``excluded`` stays."""
    names, out, at, tokens = {c.lower() for c in columns}, [], 0, tokenize(expression)
    for i, t in enumerate(tokens):
        after = tokens[i + 1].text if i + 1 < len(tokens) else ""
        if t.is_name and t.name.lower() in names and after not in (".", "(") and not (i and tokens[i - 1].text == "."):
            out += [expression[at : t.start], f"__umbra_state.{tick(t.name)}"]
            at = t.end
    return "".join([*out, expression[at:]])


def _upsert_fold(table: Table, rows: DataFrame, key: Sequence[str], assignments: Sequence[tuple[str, str]], where: str) -> tuple[DataFrame, DataFrame]:
    fields, columns = list(table.df.schema), table.df.columns
    said = {c: "'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in columns}
    row = f"named_struct({', '.join(f'{said[c]}, {tick(c)}' for c in columns)})"
    free = rows.filter(_some_null(key)).drop(_POS)
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    excluded = F.struct(*(F.col(tick(c)).cast(kind[c].dataType).alias(c) for c in columns)).cast(kind).alias("excluded")
    news = _placed(rows).filter(~_some_null(key)).select(*(F.col(tick(c)).alias(f"__umbra_key_{k}") for k, c in enumerate(key)), F.struct(F.col(_POS).alias("at"), excluded).alias("x"))
    keys = [f"__umbra_key_{k}" for k in range(len(key))]
    news = news.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["excluded"]).alias(_NEW))

    one = table.df.join(rows.select(excluded), how="cross")  # for the types of expressions only
    change = {c.lower(): _of_state(_typed_sql(one, e, kind[table.definition.column(c) or c].dataType), columns) for c, e in assignments}
    parts = ", ".join(f"{said[c]}, {change[c.lower()] if c.lower() in change else f'__umbra_state.{tick(c)}'}" for c in columns)
    holds = _of_state(f"coalesce(({where}), false)", columns) if where else "true"
    shape = f"struct<{', '.join(f'{tick(f.name)}: {f.dataType.simpleString()}' for f in fields)}>"
    # the state is the row, null while there is none, and the number of changes; it is taken apart for the expressions
    step = f"aggregate(array(s.row), CAST(NULL AS {shape}), (none, __umbra_state) -> CAST(CASE WHEN __umbra_state IS NULL THEN excluded WHEN {holds} THEN named_struct({parts}) ELSE __umbra_state END AS {shape}))"
    grown = f"named_struct('row', {step}, 'n', s.n + CASE WHEN s.row IS NULL THEN 1 ELSE aggregate(array(s.row), 0, (zero, __umbra_state) -> CASE WHEN {holds} THEN 1 ELSE 0 END) END)"

    def folded(first: str) -> Column:
        return F.expr(f"aggregate({_NEW}, named_struct('row', CAST({first} AS {shape}), 'n', 0), (s, excluded) -> {grown})")

    same = reduce(lambda a, b: a & b, (F.col(tick(c)) == F.col(k) for c, k in zip(key, keys)))
    old = table.df.join(news, same, "left").select(F.when(F.col(_NEW).isNotNull(), folded(row)).otherwise(F.expr(f"named_struct('row', CAST({row} AS {shape}), 'n', 0)")).alias("s"))
    taken = table.df.select(*(F.col(tick(c)).alias(c) for c in key)).join(news.select(*keys), same, "left_semi").distinct()
    fresh = news.join(taken, same, "left_anti").select(folded("NULL").alias("s"))
    states = old.unionByName(fresh)
    out = [F.col("s.row").getField(c).alias(c) for c in columns]
    affected = states.filter("s.n > 0").withColumn("__umbra_times", F.explode(F.sequence(F.lit(1), "s.n"))).select(*out)
    return affected.unionByName(free), states.select(*out).unionByName(free)


def upsert(table: Table, rows: DataFrame, key: Sequence[str], assignments: Sequence[tuple[str, str]], where: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a free key are inserted; for the others the old row takes the assignments.  No two rows share a key.

    Expressions are over the columns of the old row, under its own names, and of the new row as a struct ``excluded``."""
    rows = rows.drop(_POS)
    columns = table.df.columns
    new = rows.select(F.struct(*(F.col(tick(c)) for c in columns)).alias("excluded"), F.lit(True).alias(_NEW))
    same = reduce(lambda a, b: a & b, (F.col(tick(c)) == F.col(f"excluded.{tick(c)}") for c in key))
    both = table.df.join(new, same, "left")
    hit = F.coalesce(F.col(_NEW) & (F.expr(where) if where else F.lit(True)), F.lit(False))
    change = {c.lower(): e for c, e in assignments}
    set_to = {f.name: _typed(both, change[f.name.lower()], f.dataType) if f.name.lower() in change else F.col(tick(f.name)) for f in table.df.schema}
    # one projection: every right side sees the old row
    out = both.select(hit.alias(_HIT), *(F.when(hit, set_to[c]).otherwise(F.col(tick(c))).alias(c) if c.lower() in change else F.col(tick(c)) for c in columns))
    fresh = rows.alias("n").join(_taken(table, rows, key).alias("o"), _same_key(key, "n", "o"), "left_anti")
    names = [tick(c) for c in columns]
    return out.filter(_HIT).select(*names).unionByName(fresh), out.select(*names).unionByName(fresh)


def update(table: Table, run: Run, source: str, assignments: Sequence[tuple[str, str]], where: str, chosen: DataFrame | None, row_id: Sequence[str], volatile: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy ``where`` (or are ``chosen``) with new values; all right sides see the old row.

    ``run`` executes SQL over the snapshot; ``source`` is the FROM item.  The affected rows have the assigned
    columns first, then the others in their order."""
    columns = table.df.columns
    lower = {c.lower(): c for c in columns}
    schema = {f.name: f.dataType for f in table.df.schema}
    change: dict[str, str] = {}
    for c, e in assignments:
        if c.lower() not in lower:
            raise UnsupportedSql(f"No such column: {c}")
        change[lower[c.lower()]] = e
    old, new = {c: f"__umbra_old_{k}" for k, c in enumerate(columns)}, {c: f"__umbra_set_{k}" for k, c in enumerate(change)}
    pred = f"coalesce(({where}), false)" if where else "true"
    picked = [f"{e} AS {tick(new[c])}" for c, e in change.items()] + [f"{tick(c)} AS {tick(old[c])}" for c in columns]
    rows = run(f"SELECT {', '.join(picked)}, {pred} AS {_HIT} FROM {source}")
    if chosen is not None:
        mark = chosen.select(*(F.col(tick(c)).alias(f"__umbra_key_{k}") for k, c in enumerate(row_id)), F.lit(True).alias("__umbra_chosen"))
        same = reduce(lambda a, b: a & b, (F.col(old[c]).eqNullSafe(F.col(f"__umbra_key_{k}")) for k, c in enumerate(row_id)))
        rows = rows.join(mark, same, "left").withColumn(_HIT, F.coalesce(F.col("__umbra_chosen"), F.lit(False)))
    if volatile:  # values that differ each time: both results come from the same ones
        rows = written(rows, "updated")
    value = {c: _typed(rows, tick(new[c]), schema[c]) if c in change else F.col(old[c]) for c in columns}
    # a plain WHERE reaches the scan; it drops NULL as well
    hit = run(f"SELECT {', '.join(picked)} FROM {source} WHERE {where or 'true'}") if chosen is None and not volatile else rows.filter(_HIT)
    affected = hit.select(*(value[c].alias(c) for c in [*change, *(c for c in columns if c not in change)]))
    after = rows.select(*(F.when(F.col(_HIT), value[c]).otherwise(F.col(old[c])).alias(c) if c in change else F.col(old[c]).alias(c) for c in columns))
    return affected, after


def delete(table: Table, run: Run, source: str, where: str, chosen: DataFrame | None, row_id: Sequence[str], volatile: bool = False) -> tuple[DataFrame, DataFrame]:
    """The deleted rows, and those that stay; a row whose predicate is NULL stays."""
    columns = [tick(c) for c in table.df.columns]
    if chosen is not None:
        same = reduce(lambda a, b: a & b, (F.col(f"o.{tick(c)}").eqNullSafe(F.col(f"d.{tick(c)}")) for c in row_id))
        old = table.df.alias("o")
        return old.join(chosen.alias("d"), same, "left_semi").select(*columns), old.join(chosen.alias("d"), same, "left_anti").select(*columns)
    if not where:
        return table.df, table.df.limit(0)
    names = ", ".join(columns)
    pred = f"coalesce(({where}), false)"
    if volatile:
        rows = written(run(f"SELECT {names}, {pred} AS {_HIT} FROM {source}"), "deleted")
        return rows.filter(_HIT).drop(_HIT), rows.filter(~F.col(_HIT)).drop(_HIT)
    return run(f"SELECT {names} FROM {source} WHERE {where}"), run(f"SELECT {names} FROM {source} WHERE NOT {pred}")
