"""The registered queries of the shadow engine, each with DuckDB SQL for the same rows.

A query is a script that runs in a fresh session over the parquet tables it
names, and one last statement whose rows are the result.  The SQL sees only the
base tables, so states after writes are spelt out as SELECTs over them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from umbra.errors import ShadowError
from umbra.plans import ddl, statements
from umbra.plans.tokens import quote, split_statements, tokenize, unquote
from umbra.session import ShadowSession
from umbra.sources import fixtures

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",),
    "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}


@dataclass(frozen=True)
class Query:
    tables: str
    sql: str
    oracle: str
    script: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        session = ShadowSession(spark)
        for name in self.tables.split():
            session.add(name, f"{sf_dir}/{name}.parquet", primary_key=KEYS.get(name, ()))
        if self.script:
            session.execute_script(self.script)
        return session.execute(self.sql)


def _same(tables: str, sql: str) -> Query:
    return Query(tables, sql, sql)


def _narrowed(q: Query, *columns: str) -> Query:
    """Spark counts ranks and lengths in 32 bits, DuckDB in 64."""
    casts = ", ".join(f"{c}::INTEGER AS {c}" for c in columns)
    return Query(q.tables, q.sql, f"SELECT * REPLACE ({casts}) FROM ({q.oracle})", q.script)


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_REGION = "SELECT r_regionkey, r_name FROM region"

_UNIQUE = "CREATE TABLE t (k INTEGER PRIMARY KEY, u TEXT UNIQUE, n INTEGER); INSERT INTO t SELECT c_custkey, c_name, c_nationkey FROM customer;"

QUERIES: dict[str, Query] = {
    "flagship": Query(
        "customer orders nation",
        "SELECT n.n_name AS nation, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderstatus <> 'X' GROUP BY n.n_name ORDER BY revenue DESC, nation",
        "SELECT n.n_name AS nation, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_totalprice >= 20000 GROUP BY n.n_name",
        "UPDATE orders SET o_orderstatus = 'X' WHERE o_totalprice < 20000",
    ),
    # reading
    "read_filter": _same("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'"),
    "read_project_expr": _same("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, upper(l_returnflag) || '-' || l_linestatus AS flags FROM lineitem WHERE l_quantity < 5"),
    "read_join_inner": _same("customer orders", "SELECT c.c_name, o.o_orderkey FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_acctbal > 5000"),
    "read_join_left": _same("customer orders", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 GROUP BY c.c_custkey"),
    "read_join_right": _same("nation region", "SELECT n.n_name, r.r_name FROM nation n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey < 5"),
    "read_join_full": _same("supplier nation", "SELECT s.s_name, n.n_name FROM supplier s FULL JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000"),
    "read_join_cross": _same("region nation", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n"),
    "read_join_comma": _same("region nation", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey"),
    "read_join_using_whole": Query("orders", "SELECT o_orderkey, x.p AS p FROM orders JOIN (SELECT o_orderkey, o_totalprice * 2 AS p FROM orders) x USING (o_orderkey)", "SELECT o_orderkey, o_totalprice * 2 AS p FROM orders"),
    "read_join_natural": Query("nation", "SELECT n_name, k FROM nation NATURAL JOIN (SELECT n_nationkey, n_nationkey + 1 AS k FROM nation) x", "SELECT n_name, n_nationkey + 1 AS k FROM nation"),
    "read_join_theta_whole": _same("part", "SELECT a.p_size AS size, count(*) AS n FROM part a JOIN part b ON a.p_size < b.p_size GROUP BY a.p_size"),
    "read_semi_exists": _same("customer orders", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"),
    "read_anti_not_exists": _same("customer orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"),
    "read_in_subquery": _same("customer nation", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "read_not_in_subquery": _same("customer nation", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "read_scalar_subquery": _same("part", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)"),
    "read_correlated_whole": _same("customer orders", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c"),
    "read_derived_table": _same("lineitem", "SELECT f, q FROM (SELECT l_returnflag AS f, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag) t WHERE q > 0"),
    "read_cte": _same("orders", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 250000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus"),
    "read_cte_multi": _same("nation region", "WITH a AS (SELECT * FROM region WHERE r_regionkey < 3), b AS (SELECT n.n_name, a.r_name FROM nation n JOIN a ON n.n_regionkey = a.r_regionkey) SELECT r_name, count(*) AS n FROM b GROUP BY r_name"),
    "read_cte_shadowing": _same("nation", "WITH nation AS (SELECT 1 AS one) SELECT one FROM nation"),
    "read_cte_recursive": Query("region", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n FROM r", "SELECT range::INTEGER AS n FROM range(1, 21)"),
    "read_cte_recursive_union": Query("nation", "WITH RECURSIVE r(k) AS (SELECT 3 UNION SELECT (k * 7) % 25 FROM r JOIN nation ON n_nationkey = k) SELECT k FROM r", "WITH RECURSIVE r(k) AS (SELECT 3::BIGINT UNION SELECT (k * 7) % 25 FROM r JOIN nation ON n_nationkey = k) SELECT k::INTEGER AS k FROM r"),
    "read_union": _same("nation region", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "read_union_all": _same("nation region", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"),
    "read_intersect": _same("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "read_except": _same("nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0"),
    "read_distinct": _same("lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "read_values": Query("", "VALUES (1, 'a'), (2, 'b')", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(column1, column2)"),
    "read_case": _same("part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'middle' ELSE 'large' END AS size FROM part"),
    # aggregates and windows
    "agg_group_having": _same("lineitem", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY l_suppkey HAVING count(*) > 5"),
    "agg_distinct": _same("orders", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus"),
    "agg_filter": _same("orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY o_orderpriority"),
    "agg_group_concat": Query("nation", "SELECT n_regionkey, group_concat(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_total": Query("customer", "SELECT c_mktsegment, total(c_nationkey) AS t FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'none', total(c_nationkey) FROM customer WHERE c_custkey < 0", "SELECT c_mktsegment, sum(c_nationkey)::DOUBLE AS t FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'none', 0.0::DOUBLE"),
    "agg_bare_column": Query("nation", "SELECT n_regionkey, n_name, max(n_nationkey) AS k, count(*) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, arg_max(n_name, n_nationkey) AS n_name, max(n_nationkey) AS k, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "agg_bare_column_min": Query("orders", "SELECT o_custkey, o_orderkey, min(o_totalprice) AS p FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS o_orderkey, min(o_totalprice) AS p FROM orders GROUP BY o_custkey"),
    "agg_tpch_q1": _same("lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "win_row_number": _narrowed(_same("orders", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders"), "rn"),
    "win_rank": _narrowed(_same("part", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part"), "r"),
    "win_dense_rank": _narrowed(_same("part", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part"), "r"),
    "win_percent_rank": _same("part", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS r, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS d FROM part"),
    "win_ntile": _narrowed(_same("customer", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer"), "q"),
    "win_lag_lead": _same("orders", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS later FROM orders"),
    "win_first_last": _same("orders", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "win_frame_rows": _same("orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders"),
    "win_frame_range": _same("part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part"),
    "win_named": _same("customer", "SELECT c_custkey, count(*) OVER w AS n, round(max(c_acctbal) OVER w, 2) AS m FROM customer WINDOW w AS (PARTITION BY c_nationkey)"),
    # order
    "order_limit": _same("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "order_limit_offset": _same("customer", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5"),
    "order_limit_comma": Query("customer", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5, 10", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5"),
    "order_nulls": Query("customer", "SELECT x FROM (SELECT nullif(c_nationkey, 3) AS x FROM customer) t ORDER BY x LIMIT 40", "SELECT x FROM (SELECT nullif(c_nationkey, 3) AS x FROM customer) t ORDER BY x NULLS FIRST LIMIT 40"),
    "topk": _same("lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100"),
    # rows that a write returns
    "insert_values_result": Query("region", "INSERT INTO region (r_regionkey, r_name) VALUES (10, 'NORTH'), (11, 'SOU''TH')", "SELECT * FROM (VALUES (10, 'NORTH'), (11, 'SOU''TH')) v(r_regionkey, r_name)"),
    "insert_select_result": Query("region nation", "INSERT INTO region SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2", "SELECT n_nationkey + 100 AS r_regionkey, n_name AS r_name FROM nation WHERE n_regionkey = 2"),
    "update_result": Query("customer", "UPDATE customer SET c_acctbal = c_acctbal + 1, c_mktsegment = lower(c_mktsegment) WHERE c_nationkey = 7", "SELECT c_acctbal + 1 AS c_acctbal, lower(c_mktsegment) AS c_mktsegment, c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 7"),
    "update_order_limit_result": Query("customer", "UPDATE customer SET c_name = 'top' ORDER BY c_acctbal DESC, c_custkey LIMIT 5", "SELECT 'top' AS c_name, c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5"),
    "delete_result": Query("orders", "DELETE FROM orders WHERE o_orderstatus = 'P'", "SELECT * FROM orders WHERE o_orderstatus = 'P'"),
    "delete_all_result": Query("nation", "DELETE FROM nation", "SELECT * FROM nation"),
    "delete_order_limit_result": Query("lineitem", "DELETE FROM lineitem WHERE l_quantity = 1 ORDER BY l_extendedprice, l_orderkey, l_partkey, l_linenumber LIMIT 10", "SELECT * FROM lineitem WHERE l_quantity = 1 ORDER BY l_extendedprice, l_orderkey, l_partkey, l_linenumber LIMIT 10"),
    "replace_result": Query("nation", "REPLACE INTO nation VALUES (1, 'NEW', 4), (30, 'MORE', 4)", "SELECT * FROM (VALUES (1, 'NEW', 4), (30, 'MORE', 4)) v(n_nationkey, n_name, n_regionkey)"),
    # states after writes
    "insert_state": Query("region", "SELECT * FROM region", _REGION + " UNION ALL VALUES (9, 'NINE')", "INSERT INTO region VALUES (9, 'NINE')"),
    "insert_partial_state": Query("nation", "SELECT * FROM nation", _NATION + " UNION ALL VALUES (77, 'ONLY', NULL)", "INSERT INTO nation (n_name, n_nationkey) VALUES ('ONLY', '77')"),
    "insert_ignore_state": Query("nation", "SELECT * FROM nation", _NATION + " UNION ALL VALUES (40, 'FIRST', 0)", "INSERT OR IGNORE INTO nation VALUES (1, 'LOST', 0), (40, 'FIRST', 0), (40, 'SECOND', 0)"),
    "insert_do_nothing_state": Query("nation", "SELECT * FROM nation", _NATION + " UNION ALL VALUES (41, 'KEPT', 0)", "INSERT INTO nation VALUES (1, 'LOST', 0), (41, 'KEPT', 0) ON CONFLICT (n_nationkey) DO NOTHING"),
    "replace_state": Query("nation", "SELECT * FROM nation", _NATION + " WHERE n_nationkey <> 1 UNION ALL VALUES (1, 'LAST', 2)", "REPLACE INTO nation VALUES (1, 'FIRST', 1), (1, 'LAST', 2)"),
    "insert_or_replace_state": Query("nation", "SELECT * FROM nation", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 3 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation", "INSERT OR REPLACE INTO nation SELECT n_nationkey, n_name, 0 FROM nation WHERE n_regionkey = 3"),
    "insert_or_abort_state": Query("region", "SELECT * FROM region", _REGION + " UNION ALL VALUES (8, 'EIGHT')", "INSERT OR ABORT INTO region VALUES (8, 'EIGHT')"),
    "upsert_state": Query("nation", "SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'UP' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL VALUES (50, 'IN', 1)", "INSERT INTO nation VALUES (2, 'X', 9), (50, 'IN', 1) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = 'UP'"),
    "upsert_excluded_whole_state": Query("customer", "SELECT * FROM customer", "SELECT c_custkey, c_name || '/' || c_name || '!' AS c_name, c_nationkey, c_acctbal + 10 AS c_acctbal, c_mktsegment FROM customer", "INSERT INTO customer SELECT c_custkey, c_name || '!', 0, 10, 'x' FROM customer WHERE true ON CONFLICT (c_custkey) DO UPDATE SET c_name = c_name || '/' || excluded.c_name, c_acctbal = customer.c_acctbal + excluded.c_acctbal"),
    "upsert_where_state": Query("nation", "SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'NEW' ELSE n_name END AS n_name, n_regionkey FROM nation", "INSERT INTO nation SELECT n_nationkey, 'NEW', n_regionkey FROM nation ON CONFLICT (n_nationkey) DO UPDATE SET n_name = excluded.n_name WHERE nation.n_nationkey < 3"),
    "update_state": Query("supplier", "SELECT * FROM supplier", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey < 10 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier", "UPDATE supplier SET s_acctbal = s_acctbal * 2 WHERE s_nationkey < 10"),
    "update_swap_state": Query("nation", "SELECT * FROM nation", "SELECT n_regionkey AS n_nationkey, n_name, n_nationkey AS n_regionkey FROM nation", "UPDATE nation SET n_nationkey = n_regionkey, n_regionkey = n_nationkey"),
    "update_alias_state": Query("nation region", "SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey", "UPDATE nation AS n SET n_name = (SELECT r_name FROM region r WHERE r.r_regionkey = n.n_regionkey) WHERE n.n_regionkey = 1"),
    "update_null_pred_state": Query("nation", "SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey <> 1 THEN 'NOT ONE' ELSE n_name END AS n_name, nullif(n_regionkey, 2) AS n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey, n_name, NULL FROM nation WHERE n_regionkey = 2", "UPDATE nation SET n_regionkey = NULL WHERE n_regionkey = 2; UPDATE nation SET n_name = 'NOT ONE' WHERE n_regionkey <> 1"),
    "update_subquery_state": Query("part lineitem", "SELECT * FROM part", "SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN -1 ELSE p_size END AS p_size, p_retailprice FROM part", "UPDATE part SET p_size = -1 WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)"),
    "update_order_limit_state": Query("lineitem", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag", "SELECT f AS l_returnflag, count(*) AS n FROM (SELECT CASE WHEN rn <= 100 THEN 'Z' ELSE l_returnflag END AS f FROM (SELECT l_returnflag, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem)) GROUP BY f", "UPDATE lineitem SET l_returnflag = 'Z' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100"),
    "update_with_cte_state": Query("supplier nation", "SELECT * FROM supplier", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 4) THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier", "WITH r AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 4) UPDATE supplier SET s_acctbal = 0 WHERE s_nationkey IN (SELECT n_nationkey FROM r)"),
    "delete_state": Query("orders", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice >= 100000 GROUP BY o_orderstatus", "DELETE FROM orders WHERE o_totalprice < 100000"),
    "delete_null_pred_state": Query("nation", "SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey = 2 OR n_name >= 'NATION_1'", "UPDATE nation SET n_name = NULL WHERE n_regionkey = 2; DELETE FROM nation WHERE n_name < 'NATION_1'"),
    "delete_all_state": Query("region", "SELECT count(*) AS n FROM region", "SELECT 0::BIGINT AS n", "DELETE FROM region"),
    "delete_order_limit_state": Query("customer", "SELECT * FROM customer", "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn FROM customer) WHERE rn > 7", "DELETE FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7"),
    "update_or_clause_state": Query("region", "SELECT * FROM region", "SELECT r_regionkey, lower(r_name) AS r_name FROM region", "UPDATE OR ABORT region SET r_name = lower(r_name); UPDATE OR ROLLBACK region SET r_name = r_name; UPDATE OR FAIL region SET r_name = r_name"),
    "insert_with_cte_state": Query("region nation", "SELECT * FROM region", _REGION + " UNION ALL SELECT n_nationkey + 500, upper(n_name) FROM nation WHERE n_regionkey = 3", "WITH few AS (SELECT * FROM nation WHERE n_regionkey = 3) INSERT INTO region SELECT n_nationkey + 500, upper(n_name) FROM few"),
    "delete_with_cte_state": Query("customer nation", "SELECT * FROM customer", "SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "WITH few AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) DELETE FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM few)"),
    "insert_or_fail_state": Query("region", "SELECT * FROM region", _REGION + " UNION ALL VALUES (60, 'A'), (61, 'B')", "INSERT OR FAIL INTO region VALUES (60, 'A'); INSERT OR ROLLBACK INTO region VALUES (61, 'B')"),
    "insert_ignore_unique_state": Query("customer", "SELECT k, u, n FROM t", "SELECT c_custkey::BIGINT AS k, c_name AS u, c_nationkey::BIGINT AS n FROM customer UNION ALL VALUES (-1, 'free', 1), (-3, 'also', 3)", _UNIQUE + "INSERT OR IGNORE INTO t SELECT c_custkey, 'other' || c_custkey, 0 FROM customer; INSERT OR IGNORE INTO t SELECT -c_custkey - 10, c_name, 0 FROM customer; INSERT OR IGNORE INTO t VALUES (-1, 'free', 1), (-2, 'free', 2), (-1, 'lost', 9), (-3, 'also', 3)"),
    "replace_unique_state": Query("customer", "SELECT k, u, n FROM t", "SELECT c_custkey::BIGINT AS k, c_name AS u, CASE WHEN c_nationkey < 5 THEN -1 ELSE c_nationkey END::BIGINT AS n FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT -c_custkey, c_name, 7 FROM customer WHERE c_nationkey = 7", _UNIQUE + "REPLACE INTO t SELECT -c_custkey, c_name, 7 FROM customer WHERE c_nationkey = 7; REPLACE INTO t SELECT c_custkey, c_name, -1 FROM customer WHERE c_nationkey < 5"),
    "replace_batch_state": Query("", "SELECT k, u, n FROM t", "SELECT * FROM (VALUES (1::BIGINT, 'y', 6::BIGINT)) v(k, u, n)", "CREATE TABLE t (k INTEGER PRIMARY KEY, u TEXT UNIQUE, n INTEGER); INSERT INTO t VALUES (7, 'x', 1); REPLACE INTO t VALUES (1, 'x', 5), (1, 'y', 6)"),
    "upsert_fold_state": Query("orders", "SELECT k, n, p FROM t", "SELECT o_custkey::BIGINT AS k, count(*) AS n, max(o_totalprice) AS p FROM orders GROUP BY o_custkey", "CREATE TABLE t (k INTEGER PRIMARY KEY, n INTEGER, p REAL); INSERT INTO t SELECT o_custkey, 1, o_totalprice FROM orders WHERE true ON CONFLICT (k) DO UPDATE SET n = n + excluded.n, p = max(p, excluded.p)"),
    "update_volatile_state": Query("supplier", "SELECT s_suppkey, s_acctbal BETWEEN -9223372036854775808 AND 9223372036854775807 AS ok FROM supplier", "SELECT s_suppkey, true AS ok FROM supplier", "UPDATE supplier SET s_acctbal = random()"),
    "script_insert_update_delete_state": Query("nation", "SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'ZERO' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey >= 5 UNION ALL VALUES (60, 'ZERO', 0)", "INSERT INTO nation VALUES (60, 'SIXTY', 0); UPDATE nation SET n_name = 'ZERO' WHERE n_regionkey = 0; DELETE FROM nation WHERE n_nationkey < 5"),
    "script_many_writes_state": Query("region", "SELECT * FROM region", "SELECT r_regionkey + 20 AS r_regionkey, r_name FROM region", ";".join(["UPDATE region SET r_regionkey = r_regionkey + 1"] * 20)),
    "table_isolation_state": Query("nation region", "SELECT * FROM region", _REGION, "UPDATE nation SET n_regionkey = 0; DELETE FROM nation WHERE n_nationkey = 1"),
    # virtual schema
    "create_table_empty": Query("", "SELECT a, b FROM t", "SELECT 1::BIGINT AS a, 'x' AS b WHERE false", "CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT NOT NULL)"),
    "create_insert_select": Query("nation", "SELECT * FROM t", "SELECT n_nationkey::BIGINT AS k, n_name AS name, 'new' AS state FROM nation WHERE n_regionkey = 1", "CREATE TABLE t (k INTEGER PRIMARY KEY, name VARCHAR(25), state TEXT DEFAULT 'new'); INSERT INTO t (k, name) SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1"),
    "create_table_as": Query("nation", "SELECT * FROM t", "SELECT n_name AS name, n_regionkey * 10 AS r FROM nation", "CREATE TEMP TABLE t AS SELECT n_name AS name, n_regionkey * 10 AS r FROM nation"),
    "insert_default_values_state": Query("", "SELECT * FROM t", "SELECT 7::BIGINT AS a, NULL::VARCHAR AS b, 1.5::DOUBLE AS c", "CREATE TABLE t (a INT DEFAULT 7, b TEXT, c REAL DEFAULT 1.5); INSERT INTO t DEFAULT VALUES"),
    "alter_add_column_state": Query("region", "SELECT * FROM region", "SELECT r_regionkey, r_name, 'none' AS note FROM region", "ALTER TABLE region ADD COLUMN note TEXT DEFAULT 'none'"),
    "alter_drop_column_state": Query("nation", "SELECT * FROM nation", "SELECT n_nationkey, n_name FROM nation", "ALTER TABLE nation DROP COLUMN n_regionkey"),
    "alter_rename_column_state": Query("nation", "SELECT key, n_name FROM nation", "SELECT n_nationkey AS key, n_name FROM nation", "ALTER TABLE nation RENAME COLUMN n_nationkey TO key"),
    "alter_rename_table_state": Query("region", "SELECT * FROM area", _REGION, "ALTER TABLE region RENAME TO area"),
    "drop_if_exists": Query("region nation", "SELECT * FROM region", _REGION, "DROP TABLE IF EXISTS nothing; DROP TABLE nation"),
    # dialect
    "fn_ifnull_iif": Query("part", "SELECT p_partkey, ifnull(nullif(p_size, 1), -1) AS s, iif(p_size > 20, 'big', 'small') AS t FROM part", "SELECT p_partkey, ifnull(nullif(p_size, 1), -1) AS s, CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END AS t FROM part"),
    "fn_integer_division": Query("part", "SELECT p_partkey, p_size / 4 AS q, p_size % 4 AS r, p_size / 0 AS z, p_retailprice / 4 AS f FROM part", "SELECT p_partkey, (p_size // 4)::BIGINT AS q, p_size % 4 AS r, NULL::BIGINT AS z, p_retailprice / 4 AS f FROM part"),
    "fn_division_derived": Query("customer", "SELECT c_nationkey, n / 2 AS half, m / 2 AS m, (SELECT max(c2.c_nationkey) FROM customer c2) / 7 AS s FROM (SELECT c_nationkey, count(*) AS n, c_nationkey * 1.5 AS m FROM customer GROUP BY c_nationkey)", "SELECT c_nationkey, n // 2 AS half, m / 2 AS m, (SELECT max(c_nationkey) FROM customer)::BIGINT // 7 AS s FROM (SELECT c_nationkey, count(*) AS n, c_nationkey * 1.5::DOUBLE AS m FROM customer GROUP BY c_nationkey)"),
    "fn_modulo_real": Query("part", "SELECT p_partkey, p_retailprice % 7 AS r, 7.5 % 2 AS c FROM part", "SELECT p_partkey, (trunc(p_retailprice)::BIGINT % 7)::DOUBLE AS r, 1::DOUBLE AS c FROM part"),
    "fn_round_real": Query("part", "SELECT p_partkey, round(p_size) AS r, round(2.567, 1) AS c, typeof(1.5) AS t FROM part", "SELECT p_partkey, p_size::DOUBLE AS r, 2.6::DOUBLE AS c, 'real' AS t FROM part"),
    "fn_like_backslash": Query("part", r"SELECT p_partkey, p_name || '\x' LIKE '%\X' AS a, p_name LIKE '%\%' AS b FROM part", "SELECT p_partkey, true AS a, false AS b FROM part"),
    "fn_substr_zero": Query("customer", "SELECT c_custkey, substr(c_name, 0, 5) AS a, substr(c_name, 0) AS b, substr(c_name, c_custkey % 2, 3) AS c FROM customer", "SELECT c_custkey, c_name[1:4] AS a, c_name AS b, CASE WHEN c_custkey % 2 = 0 THEN c_name[1:2] ELSE c_name[1:3] END AS c FROM customer"),
    "fn_trim_characters": _same("customer", "SELECT c_custkey, ltrim(c_name, 'Cust') AS l, rtrim(c_name, '0123') AS r, trim(c_name, 'C0123456789') AS b FROM customer"),
    "fn_printf_casts": Query("nation", "SELECT n_nationkey, printf('%.2f|%d|%s', n_nationkey, n_nationkey + 0.9, n_name) AS t FROM nation", "SELECT n_nationkey, printf('%.2f|%d|%s', n_nationkey::DOUBLE, n_nationkey, n_name) AS t FROM nation"),
    "fn_type_meta": Query("region", "SELECT typeof(r_regionkey) AS k, typeof(r_name) AS n, typeof(NULL) AS z, typeof(1.5) AS f, changes() AS c, total_changes() AS t, last_insert_rowid() AS i FROM region WHERE r_regionkey = 0", "SELECT 'integer' AS k, 'text' AS n, 'null' AS z, 'real' AS f, 1::INTEGER AS c, 3::INTEGER AS t, 71::INTEGER AS i", "INSERT INTO region VALUES (70, 'a'), (71, 'b'); UPDATE region SET r_name = 'c' WHERE r_regionkey = 71"),
    "fn_regexp": Query("customer", "SELECT c_custkey FROM customer WHERE c_name REGEXP '[02468]$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[02468]$')"),
    "agg_grouping_sets": _same("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "fn_like_nocase": Query("part", "SELECT p_partkey FROM part WHERE p_type LIKE '%st%' AND p_name NOT LIKE 'PART_1%'", "SELECT p_partkey FROM part WHERE p_type ILIKE '%st%' AND p_name NOT ILIKE 'PART_1%'"),
    "fn_glob": Query("customer", "SELECT c_custkey FROM customer WHERE c_name GLOB '*[13]?'", "SELECT c_custkey FROM customer WHERE c_name GLOB '*[13]?'"),
    "fn_is_nullsafe": Query("nation", "SELECT n_nationkey, nullif(n_regionkey, 1) IS NULL AS a, nullif(n_regionkey, 1) IS 2 AS b, nullif(n_regionkey, 1) IS NOT 2 AS c FROM nation", "SELECT n_nationkey, nullif(n_regionkey, 1) IS NULL AS a, nullif(n_regionkey, 1) IS NOT DISTINCT FROM 2 AS b, nullif(n_regionkey, 1) IS DISTINCT FROM 2 AS c FROM nation"),
    "fn_strftime": Query("orders", "SELECT o_orderkey, strftime('%Y-%m', o_orderdate) AS m, date(o_orderdate, '+1 month') AS d, date(o_orderdate, 'start of year') AS y FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS m, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(day(o_orderdate)::INTEGER - 1), '%Y-%m-%d') AS d, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS y FROM orders"),
    "fn_substr_instr": _narrowed(_same("customer", "SELECT c_custkey, substr(c_name, 3, 4) AS s, instr(c_name, '1') AS i, length(c_name) AS n, replace(c_name, '0', 'o') AS r FROM customer"), "i", "n"),
    "fn_printf": Query("nation", "SELECT n_nationkey, printf('%05d:%s', n_nationkey, n_name) AS t FROM nation", "SELECT n_nationkey, printf('%05d:%s', n_nationkey, n_name) AS t FROM nation"),
    "fn_json_extract": Query("events", "SELECT event_id, json_extract('{\"a\": {\"b\": [1, 2, 3]}}', '$.a.b[1]') AS b, json_array_length('[1,2,3]') AS n FROM events", "SELECT event_id, '2' AS b, 3 AS n FROM events"),
    "fn_min_max_scalar": Query("part", "SELECT p_partkey, min(p_size, 10) AS lo, max(p_size, 10, NULL) AS hi FROM part", "SELECT p_partkey, least(p_size, 10) AS lo, NULL::INTEGER AS hi FROM part"),
    "fn_cast_lenient": Query("region", "SELECT r_regionkey, cast('12abc' AS INTEGER) AS i, cast('' AS INTEGER) AS z, cast('2.5x' AS REAL) AS r, cast(r_regionkey AS TEXT) AS t FROM region", "SELECT r_regionkey, 12::BIGINT AS i, 0::BIGINT AS z, 2.5::DOUBLE AS r, r_regionkey::VARCHAR AS t FROM region"),
    "fn_truth_of_numbers": Query("part", "SELECT p_partkey FROM part WHERE p_size AND NOT p_size = 5", "SELECT p_partkey FROM part WHERE p_size <> 0 AND NOT p_size = 5"),
}

_STATEMENTS = (
    "SELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a", "WITH a AS (SELECT 1) DELETE FROM t", "VALUES (1)", "INSERT INTO t VALUES (1)", "REPLACE INTO t VALUES (1)",
    "-- note\nUPDATE t SET a = 1", "DELETE FROM t", "CREATE TEMPORARY TABLE t (a INT)", "DROP TABLE t", "ALTER TABLE t ADD c", "BEGIN", "PRAGMA x", "VACUUM",
    "ATTACH 'f' AS d", "CREATE VIEW v AS SELECT 1", "CREATE INDEX i ON t (a)", "SELECTED", "",
)
_KINDS = ("READ", "READ", "WRITE_SIMULATED", "READ", "WRITE_SIMULATED", "WRITE_SIMULATED", "WRITE_SIMULATED", "WRITE_SIMULATED", "DDL_SIMULATED", "DDL_SIMULATED", "DDL_SIMULATED", *["refused"] * 8)


def _text_rows(spark: SparkSession, columns: str, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), T.StructType([T.StructField(c, T.StringType()) for c in columns.split()]))


def _values(columns: str, rows) -> str:
    cell = lambda v: "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({columns.replace(' ', ', ')})"


def classify_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [(s, k.value if (k := statements.query_kind(s)) else "refused") for s in _STATEMENTS]
    return _text_rows(spark, "statement kind", kinds)


_SCRIPT = "SELECT ';' ; -- a; b\nINSERT INTO t VALUES ('x;y'); /* ; */ ; DELETE FROM \"a;b\";;"
_PIECES = ("SELECT ';'", "-- a; b\nINSERT INTO t VALUES ('x;y')", 'DELETE FROM "a;b"')


def split_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_rows(spark, "piece", [(p,) for p in split_statements(_SCRIPT)])


_DDL = "CREATE TABLE t (a INT, b DOUBLE PRECISION, c VARCHAR(10), d BLOB, e DECIMAL(10,2), f BOOLEAN, g DATETIME, h JSON, i, unique_j TEXT UNIQUE, PRIMARY KEY (a))"
_FAMILIES = (("a", "INTEGER"), ("b", "FLOAT"), ("c", "STRING"), ("d", "BINARY"), ("e", "DECIMAL"), ("f", "BOOLEAN"), ("g", "DATETIME"), ("h", "JSON"), ("i", "none"), ("unique_j", "TEXT"))


def parse_ddl_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ddl.parse_create(_DDL).definition
    return _text_rows(spark, "name family", [(c, made.typed[c].family.value if c in made.typed else "none") for c in made.columns])


_WRONG = (
    ("SELECT * FROM nothing", "UnknownSchema"), ("DELETE FROM nothing", "UnknownSchema"), ("UPDATE nothing SET a = 1", "UnknownSchema"), ("DROP TABLE nothing", "UnknownSchema"),
    ("SELECT no_column FROM region", "UnknownSchema"), ("SELECT 1; SELECT 2", "UnsupportedSql"), ("", "UnsupportedSql"), ("PRAGMA user_version", "UnsupportedSql"),
    ("INSERT INTO region VALUES (1)", "UnsupportedSql"), ("CREATE TABLE region (a INT)", "UnsupportedSql"), ("ALTER TABLE region FROBNICATE", "UnsupportedSql"),
)


def statement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = ShadowSession(spark)
    session.add("region", f"{sf_dir}/region.parquet", primary_key=KEYS["region"])
    found = []
    for sql, _ in _WRONG:
        try:
            session.plan(sql)
            found.append((sql, "none"))
        except ShadowError as e:
            found.append((sql, type(e).__name__))
    return _text_rows(spark, "statement error", found)


_QUOTED = (("a b", '"a b"'), ('say "x"', '"say ""x"""'), ('"done"', '"done"'), ("", '""'))
_PLAIN = (('"a""b"', 'a"b'), ("`x y`", "x y"), ("[id]", "id"), ("plain", "plain"))


def quote_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_rows(spark, "given made", [(n, quote(n)) for n, _ in _QUOTED] + [(n, unquote(n)) for n, _ in _PLAIN])


_COMMENTED = "SELECT 1 -- one\n, '--no' /* two\nlines */ AS b"


def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_rows(spark, "token", [(t.text,) for t in tokenize(_COMMENTED)])


def plan_many_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = ShadowSession(spark)
    session.add("region", f"{sf_dir}/region.parquet", primary_key=KEYS["region"])
    plans = session.plan_many("SELECT * FROM region; DELETE FROM region; INSERT INTO region VALUES (1, 'x'); DROP TABLE region; SELECT count(*) FROM region")
    return _text_rows(spark, "kind target", [(p.kind.value, p.mutation.table if p.mutation else "none") for p in plans])


_CONSTRAINED = "CREATE TABLE t (a INT, b TEXT UNIQUE, c TEXT, d INT, CONSTRAINT pair UNIQUE (c, d), UNIQUE (d, a), PRIMARY KEY (a, b)) WITHOUT ROWID"


def constraint_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ddl.parse_create(_CONSTRAINED).definition
    return _text_rows(spark, "name columns", [("primary key", ",".join(made.primary_key)), *((n, ",".join(c)) for n, c in made.unique.items())])


def _views(spark: SparkSession, sf_dir: str) -> SparkSession:
    """A session whose catalog has two views over the tables."""
    catalog = spark.newSession()
    for name in ("nation", "region"):
        catalog.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return catalog


def reflect_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fixtures.reflect_all(_views(spark, sf_dir))
    return _text_rows(spark, "name columns", [(n, ",".join(d.columns)) for n, d in found.items() if n in ("nation", "region")])


def reflect_one_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _views(spark, sf_dir)
    made, none = fixtures.reflect_one(views, "nation"), fixtures.reflect_one(views, "nothing_there")
    return _text_rows(spark, "name family", [(c, made.typed[c].family.value if c in made.typed else "none") for c in made.columns] + [("nothing_there", str(none))])


def fixture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row dicts with missing, null and undeclared columns, declared and not."""
    session = ShadowSession(spark)
    session.add("d", [{"ID": "7x", "name": None}, {"id": 8, "extra": 1}, {}], "CREATE TABLE d (id INTEGER, name TEXT, score REAL)")
    session.add("u", [{"a": 1}, {"b": "x"}, {"a": 2, "b": None}])
    return session.execute("SELECT 'd' AS t, CAST(id AS TEXT) AS x, name AS y, score IS NULL AS z FROM d UNION ALL SELECT 'u', CAST(a AS TEXT), b, 1 = 1 FROM u")


_OTHERS = (classify_matrix, split_script, parse_ddl_types, statement_errors, quote_names, strip_comments, plan_many_kinds, constraint_names, reflect_all_tables, reflect_one_table, fixture_rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: q.run for name, q in QUERIES.items()}, **{f.__name__: f for f in _OTHERS}}


def oracle_sql() -> dict[str, str]:
    return {
        **{name: q.oracle for name, q in QUERIES.items()},
        "classify_matrix": _values("statement kind", zip(_STATEMENTS, _KINDS)),
        "split_script": _values("piece", [(p,) for p in _PIECES]),
        "parse_ddl_types": _values("name family", _FAMILIES),
        "statement_errors": _values("statement error", _WRONG),
        "quote_names": _values("given made", _QUOTED + _PLAIN),
        "strip_comments": _values("token", [(t,) for t in ("SELECT", "1", ",", "'--no'", "AS", "b")]),
        "plan_many_kinds": _values("kind target", [("READ", "none"), ("WRITE_SIMULATED", "region"), ("WRITE_SIMULATED", "region"), ("DDL_SIMULATED", "region"), ("READ", "none")]),
        "constraint_names": _values("name columns", [("primary key", "a,b"), ("b_UNIQUE", "b"), ("pair", "c,d"), ("unique_2", "d,a")]),
        "reflect_all_tables": _values("name columns", [("nation", "n_nationkey,n_name,n_regionkey"), ("region", "r_regionkey,r_name")]),
        "reflect_one_table": _values("name family", [("n_nationkey", "INTEGER"), ("n_name", "TEXT"), ("n_regionkey", "INTEGER"), ("nothing_there", "None")]),
        "fixture_rows": "SELECT * FROM (VALUES ('d', '7', NULL, true), ('d', '8', NULL, true), ('d', NULL, NULL, true), ('u', '1', NULL, true), ('u', NULL, 'x', true), ('u', '2', NULL, true)) v(t, x, y, z)",
    }
