"""Queries over the driver's tables, one per operator, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.functions.time import coarsen_column
from factflow.functions.values import Typed, tagged
from factflow.operators.attributes import TIME, AttributeConfig, snapshot_bitemporal
from factflow.operators.hector import triangles
from factflow.operators.relation import dealt
from factflow.plans.ast import (
    Aggregate,
    Antijoin,
    AttributeBinding,
    ConstantBinding,
    Filter,
    GraphQl,
    Hector,
    Join,
    MatchA,
    MatchAV,
    MatchEA,
    NameExpr,
    Negate,
    NotBinding,
    Plan,
    PredicateBinding,
    Project,
    Pull,
    PullAll,
    PullLevel,
    Rule,
    Transform,
    Union,
    q,
)
from factflow.plans.compile import result_columns
from factflow.sinks.core import FileSink
from factflow.sources.files import CsvFile, JsonFile
from factflow.storage import settle, shared_dir
from factflow.streaming.domain import Domain
from factflow.streaming.engine import Engine
from factflow.streaming.incremental import epoch_diffs

CENTS = "CAST(round({} * 100) AS BIGINT)"
#: A cyclic graph of all lines: suppliers to the parts they deliver; a number is one node, whether of a supplier or of a part.
EDGE_SQL = "SELECT DISTINCT l_suppkey AS e, l_partkey AS v FROM lineitem"
#: What belongs to what: orders to customers, these to nations, these to regions; the last digit tells the kind.
ABOVE_SQL = ("SELECT o_orderkey * 4 AS e, o_custkey * 4 + 1 AS v FROM orders UNION ALL SELECT c_custkey * 4 + 1, c_nationkey * 4 + 2 FROM customer "
             "UNION ALL SELECT n_nationkey * 4 + 2, n_regionkey * 4 + 3 FROM nation")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> Domain:
    """The tables as attributes; money in cents, times in milliseconds."""
    d = Domain(spark)

    def read(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def cents(c: str):
        return F.round(F.col(c) * 100).cast("long")

    def ms(c: str):
        return F.unix_millis(F.col(c).cast("timestamp"))

    def long(c: str):
        return F.col(c).cast("long")

    d.add_table("region", read("region"), "r_regionkey", {"region_name": "r_name"})
    d.add_table("nation", read("nation"), "n_nationkey", {"nation_name": "n_name", "nation_region": long("n_regionkey")})
    d.add_table("customer", read("customer"), "c_custkey", {
        "customer_name": "c_name", "customer_segment": "c_mktsegment", "customer_nation": long("c_nationkey"), "customer_cents": cents("c_acctbal")})
    d.add_table("supplier", read("supplier"), "s_suppkey", {"supplier_nation": long("s_nationkey"), "supplier_cents": cents("s_acctbal")})
    d.add_table("part", read("part"), "p_partkey", {"part_brand": "p_brand", "part_type": "p_type", "part_size": long("p_size")})
    d.add_table("orders", read("orders"), "o_orderkey", {
        "order_customer": "o_custkey", "order_status": "o_orderstatus", "order_priority": "o_orderpriority",
        "order_cents": cents("o_totalprice"), "order_date": ms("o_orderdate")}, types={"order_date": "Instant"})
    # an order has many lines: the same fact may stand several times
    d.add_table("lineitem", read("lineitem"), "l_orderkey", {
        "line_part": "l_partkey", "line_supplier": "l_suppkey", "line_quantity": long("l_quantity"), "line_flag": "l_returnflag"}, unique=False)
    d.add_table("events", read("events"), "event_id", {
        "event_user": "user_id", "event_type": "event_type", "event_cents": cents("value"), "event_time": ms("ts")}, types={"event_time": "Instant"})
    d.add_table("documents", read("documents"), "doc_id", {"doc_lang": "lang", "doc_source": "source", "doc_chars": "n_chars"})

    def edge() -> DataFrame:
        lines = read("lineitem")()
        return dealt(lines.select(F.col("l_suppkey").alias("e"), F.col("l_partkey").alias("v")), lines.count()).distinct()

    d.add_derived("edge", edge)

    def above() -> DataFrame:
        kinds = [("orders", "o_orderkey", "o_custkey"), ("customer", "c_custkey", "c_nationkey"), ("nation", "n_nationkey", "n_regionkey")]
        parts = [read(t)().select((long(e) * 4 + k).alias("e"), (long(v) * 4 + k + 1).alias("v")).where("e IS NOT NULL AND v IS NOT NULL") for k, (t, e, v) in enumerate(kinds)]
        return parts[0].union(parts[1]).union(parts[2])

    d.add_derived("above", above)
    return d


def _query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _plan(name: str, plan: Plan | str, columns: list[str], sql: str, rules: tuple[Rule, ...] = (), set_mode: bool = False, flatten: tuple[str, ...] = ()) -> None:
    """A query that is a plan; ``flatten`` splits fractions into _num and _den."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = tables(spark, sf_dir)
        d.set_mode = set_mode
        d.register(*rules)
        df = result_columns(d.query(plan), columns)
        for c in flatten:
            df = df.withColumns({f"{c}_num": F.col(c)["num"], f"{c}_den": F.col(c)["den"]}).drop(c)
        return df

    QUERIES[name] = run
    SQL[name] = sql


def _fraction(num: str, den: str, name: str) -> str:
    g = f"greatest(gcd(CAST({num} AS BIGINT), CAST({den} AS BIGINT)), 1)"
    return f"CAST({num} AS BIGINT) // {g} AS {name}_num, CAST({den} AS BIGINT) // {g} AS {name}_den"


# -- patterns, projection, filters ---------------------------------------------
_plan("match_a", MatchA(0, "customer_segment", 1), ["e", "v"], "SELECT c_custkey AS e, c_mktsegment AS v FROM customer")
_plan("match_ea", MatchEA(7, "line_part", 0), ["v"], "SELECT l_partkey AS v FROM lineitem WHERE l_orderkey = 7")
_plan("match_av", MatchAV(0, "order_status", "P"), ["e"], "SELECT o_orderkey AS e FROM orders WHERE o_orderstatus = 'P'")
_plan("project_bag", Project((1,), MatchA(0, "line_flag", 1)), ["v"], "SELECT l_returnflag AS v FROM lineitem")
_plan("project_reorder", Project((1, 0, 1), MatchA(0, "nation_name", 1)), ["v", "e", "v2"], "SELECT n_name AS v, CAST(n_nationkey AS INT) AS e, n_name AS v2 FROM nation")
for _name, _op in (("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">="), ("eq", "="), ("neq", "<>")):
    _plan(f"filter_{_name}", Filter((1,), _name.upper(), MatchA(0, "part_size", 1), (None, 25)), ["e", "v"],
          f"SELECT p_partkey AS e, CAST(p_size AS BIGINT) AS v FROM part WHERE p_size {_op} 25")
_plan("filter_constant_first", Filter((1,), "LT", MatchA(0, "part_size", 1), (25, None)), ["e", "v"],
      "SELECT p_partkey AS e, CAST(p_size AS BIGINT) AS v FROM part WHERE 25 < p_size")
_plan("filter_var_var", Filter((1, 2), "GT", Join((0,), MatchA(0, "customer_nation", 1), MatchA(0, "customer_cents", 2)), (None, None)), ["e", "c", "p"],
      f"SELECT c_custkey AS e, CAST(c_nationkey AS BIGINT) AS c, {CENTS.format('c_acctbal')} AS p FROM customer WHERE c_nationkey > {CENTS.format('c_acctbal')}")
_plan("filter_cross_type", Filter((1,), "LT", MatchA(0, "nation_name", 1), (None, 5)), ["e", "v"], "SELECT CAST(n_nationkey AS INT) AS e, n_name AS v FROM nation")

# an entity is greater than any number, an instant than any entity
_plan("filter_eid_number", Filter((0,), "GT", MatchA(0, "nation_name", 1), (None, 10)), ["e", "v"], "SELECT CAST(n_nationkey AS INT) AS e, n_name AS v FROM nation")
_plan("filter_eid_eid", Filter((0,), "LT", MatchA(0, "nation_name", 1), (None, Typed("Eid", 10))), ["e", "v"], "SELECT CAST(n_nationkey AS INT) AS e, n_name AS v FROM nation WHERE n_nationkey < 10")
_plan("filter_instant_eid", Filter((1, 0), "GT", MatchA(0, "event_time", 1), (None, None)), ["e", "t"], "SELECT event_id AS e, epoch_us(ts) // 1000 AS t FROM events")

# -- transforms ----------------------------------------------------------------
for _name, _w in (("minute", 60_000), ("hour", 3_600_000), ("day", 86_400_000), ("week", 604_800_000)):
    _plan(f"transform_truncate_{_name}", Transform((1,), 2, MatchA(0, "event_time", 1), "TRUNCATE", (None, f":{_name}")), ["e", "t", "w"],
          f"SELECT event_id AS e, epoch_us(ts) // 1000 AS t, (epoch_us(ts) // 1000) // {_w} * {_w} AS w FROM events")
_plan("transform_add", Transform((1, 2), 3, Join((0,), MatchA(0, "order_customer", 1), MatchA(0, "order_cents", 2)), "ADD", (None, None, 10)), ["e", "c", "p", "s"],
      f"SELECT o_orderkey AS e, o_custkey AS c, {CENTS.format('o_totalprice')} AS p, o_custkey + {CENTS.format('o_totalprice')} + 10 AS s FROM orders")
_plan("transform_subtract", Transform((1,), 2, MatchA(0, "part_size", 1), "SUBTRACT", (100,)), ["e", "v", "s"],
      "SELECT p_partkey AS e, CAST(p_size AS BIGINT) AS v, CAST(100 - p_size AS BIGINT) AS s FROM part")

# -- joins and sets ------------------------------------------------------------
_plan("join_one_key", Join((1,), MatchA(0, "order_customer", 1), MatchA(1, "customer_segment", 2)), ["c", "o", "s"],
      "SELECT o_custkey AS c, o_orderkey AS o, c_mktsegment AS s FROM orders JOIN customer ON o_custkey = c_custkey")
_plan("join_bag", Project((1,), Join((0,), MatchA(0, "line_flag", 1), MatchA(0, "order_status", 2))), ["f"],
      "SELECT l_returnflag AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
_plan("join_two_keys", Join((0, 1), MatchA(0, "line_part", 1), MatchA(0, "line_part", 1)), ["o", "p"],
      "SELECT a.l_orderkey AS o, a.l_partkey AS p FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey")
_plan("join_collection_attribute", Join((1,), MatchA(1, "customer_nation", 2), Filter((3,), "EQ", Join((0,), MatchA(0, "order_customer", 1), MatchA(0, "order_status", 3)), (None, "P"))),
      ["c", "o", "s", "n"], "SELECT o_custkey AS c, o_orderkey AS o, o_orderstatus AS s, CAST(c_nationkey AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
_plan("join_star_collapsed", Join((0,), MatchA(0, "order_status", 1), Join((0,), MatchA(0, "order_priority", 2), MatchA(0, "order_cents", 3))), ["o", "s", "p", "c"],
      f"SELECT o_orderkey AS o, o_orderstatus AS s, o_orderpriority AS p, {CENTS.format('o_totalprice')} AS c FROM orders")
_plan("self_join_value", Join((1,), MatchA(0, "supplier_nation", 1), MatchA(2, "supplier_nation", 1)), ["n", "a", "b"],
      "SELECT CAST(a.s_nationkey AS BIGINT) AS n, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
_plan("semi_join_idiom", Union((0,), (Project((0,), Join((0,), MatchA(1, "order_customer", 0), MatchAV(0, "customer_segment", "BUILDING"))),)), ["c"],
      "SELECT DISTINCT c_custkey AS c FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_plan("intersect_idiom", Join((0,), MatchAV(0, "part_brand", "Brand#11"), Project((0,), Filter((1,), "LT", MatchA(0, "part_size", 1), (None, 20)))), ["p"],
      "SELECT p_partkey AS p FROM part WHERE p_brand = 'Brand#11' AND p_size < 20")
_plan("union_distinct", Union((0,), (MatchAV(0, "order_status", "F"), MatchAV(0, "order_priority", "1-URGENT"))), ["o"],
      "SELECT DISTINCT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
_plan("union_of_projections", Union((1,), (MatchA(0, "line_supplier", 1), MatchA(2, "supplier_nation", 1))), ["v"],
      "SELECT l_suppkey AS v FROM lineitem UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
_plan("difference_negate", Union((0,), (MatchAV(0, "order_status", "F"), Negate(MatchAV(0, "order_priority", "1-URGENT")))), ["o"],
      "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
_plan("antijoin", Antijoin((0,), MatchA(0, "customer_name", 1), Project((0,), Join((2,), MatchA(2, "order_customer", 0), MatchAV(2, "order_status", "F")))), ["c", "n"],
      "SELECT DISTINCT c_custkey AS c, c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")

# -- aggregates ----------------------------------------------------------------
_BY_ORDER = "FROM lineitem GROUP BY l_orderkey"
_QTY = "CAST(l_quantity AS BIGINT)"
for _fn, _sql in (("MIN", f"min({_QTY})"), ("MAX", f"max({_QTY})"), ("COUNT", "count(*)"), ("SUM", f"CAST(sum({_QTY}) AS BIGINT)"),
                  ("MEDIAN", f"list_sort(list_distinct(list({_QTY})))[len(list_distinct(list({_QTY}))) // 2 + 1]")):
    _plan(f"agg_{_fn.lower()}", Aggregate((0, 1), MatchA(0, "line_quantity", 1), (_fn,), (0,), (1,)), ["o", "a"], f"SELECT l_orderkey AS o, {_sql} AS a {_BY_ORDER}")
_plan("agg_avg", Aggregate((0, 1), MatchA(0, "line_quantity", 1), ("AVG",), (0,), (1,)), ["o", "a"],
      f"SELECT o, {_fraction('s', 'n', 'a')} FROM (SELECT l_orderkey AS o, sum({_QTY}) AS s, count(*) AS n {_BY_ORDER})", flatten=("a",))
_plan("agg_variance", Aggregate((0, 1), MatchA(0, "line_quantity", 1), ("VARIANCE",), (0,), (1,)), ["o", "a"],
      f"SELECT o, {_fraction('n * qq - s * s', 'n * n', 'a')} FROM (SELECT l_orderkey AS o, sum({_QTY}) AS s, sum({_QTY} * {_QTY}) AS qq, count(*) AS n {_BY_ORDER})", flatten=("a",))
_plan("agg_global", Aggregate((1, 1), MatchA(0, "part_size", 1), ("MEDIAN", "COUNT"), (), (1, 1)), ["m", "n"],
      "SELECT CAST(list_sort(list_distinct(list(p_size)))[len(list_distinct(list(p_size))) // 2 + 1] AS BIGINT) AS m, count(*) AS n FROM part")
_plan("agg_empty", Aggregate((1,), MatchAV(1, "order_status", "none"), ("COUNT",), (), (1,)), ["n"], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'none' HAVING count(*) > 0")
_plan("agg_multi", Aggregate((0, 1, 1, 2), Join((0,), MatchA(0, "line_quantity", 1), MatchA(0, "order_cents", 2)), ("MIN", "SUM", "MAX"), (0,), (1, 1, 2)), ["o", "a", "b", "c"],
      f"SELECT l_orderkey AS o, min({_QTY}) AS a, CAST(sum({_QTY}) AS BIGINT) AS b, max({CENTS.format('o_totalprice')}) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
_plan("agg_having", Filter((1,), "GTE", Aggregate((0, 1), MatchA(1, "order_customer", 0), ("COUNT",), (0,), (1,)), (None, 12)), ["c", "n"],
      "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
_plan("agg_set_mode", Aggregate((0, 1, 1), MatchA(0, "line_quantity", 1), ("COUNT", "SUM"), (0,), (1, 1)), ["o", "n", "s"],
      f"SELECT l_orderkey AS o, count(DISTINCT {_QTY}) AS n, CAST(sum(DISTINCT {_QTY}) AS BIGINT) AS s {_BY_ORDER}", set_mode=True)
_plan("agg_with_set_mode", Aggregate((1,), MatchA(0, "part_size", 1), ("SUM",), (), (1,), (0,)), ["s"], "SELECT CAST(sum(p_size) AS BIGINT) AS s FROM part", set_mode=True)

# -- bindings ------------------------------------------------------------------
B, C, P, N = AttributeBinding, ConstantBinding, PredicateBinding, NotBinding
_plan("hector_star", q([0, 1, 2, 3], [B(0, "order_status", 1), B(0, "order_cents", 2), B(0, "order_priority", 3)]), ["o", "s", "c", "p"],
      f"SELECT o_orderkey AS o, o_orderstatus AS s, {CENTS.format('o_totalprice')} AS c, o_orderpriority AS p FROM orders")
_plan("hector_chain", q([0, 3, 5], [B(0, "order_customer", 1), B(1, "customer_nation", 2), B(2, "nation_name", 3), B(2, "nation_region", 4), B(4, "region_name", 5)]), ["o", "n", "r"],
      "SELECT o_orderkey AS o, n_name AS n, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_plan("hector_triangle", q([0, 1, 2], [B(0, "edge", 1), B(1, "edge", 2), B(0, "edge", 2)]), ["a", "b", "c"],
      f"WITH edge AS ({EDGE_SQL}) SELECT x.e AS a, y.e AS b, y.v AS c FROM edge x JOIN edge y ON x.v = y.e JOIN edge z ON z.e = x.e AND z.v = y.v")
_plan("hector_constant", q([0, 1, 2], [B(0, "order_customer", 1), B(0, "order_status", 2), C(2, "P")]), ["o", "c", "s"],
      "SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'P'")
_plan("hector_predicate_inverted", q([1, 2], [B(0, "line_part", 1), B(0, "line_part", 2), P("LT", (1, 2))]), ["b", "c"],
      "WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT a.l_partkey AS b, c.l_partkey AS c FROM l a JOIN l c USING (l_orderkey) WHERE c.l_partkey < a.l_partkey")
_plan("hector_constant_predicate", q([0, 1, 2], [B(0, "part_size", 1), C(2, 40), P("LT", (1, 2))]), ["p", "s", "k"],
      "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s, 40 AS k FROM part WHERE p_size > 40")
_plan("hector_not", q([0, 1], [B(0, "edge", 1), N(B(1, "edge", 0))]), ["a", "b"],
      f"WITH edge AS ({EDGE_SQL}) SELECT e AS a, v AS b FROM edge x WHERE NOT EXISTS (SELECT 1 FROM edge y WHERE y.e = x.v AND y.v = x.e)")
_plan("hector_bag_projection", q([1, 3], [B(0, "customer_nation", 2), B(4, "supplier_nation", 2), B(0, "customer_segment", 1), B(2, "nation_name", 3)]), ["s", "n"],
      "SELECT c_mktsegment AS s, n_name AS n FROM customer JOIN supplier ON s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey")


@_query("triangle_intersection", f"WITH edge AS ({EDGE_SQL}) SELECT x.e AS a, y.e AS b, y.v AS c FROM edge x JOIN edge y ON x.v = y.e JOIN edge z ON z.e = x.e AND z.v = y.v")
def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles(settle(tables(spark, sf_dir).source().pairs("edge")[0]), is_set=True)


# -- recursion -----------------------------------------------------------------
REACH = Rule("reach", Union((0, 1), (MatchA(0, "edge", 1), Project((0, 1), Join((2,), NameExpr((0, 2), "reach"), MatchA(2, "edge", 1))))))
_plan("recursive_reach", "reach", ["a", "b"],
      f"WITH RECURSIVE edge AS ({EDGE_SQL}), reach(a, b) AS (SELECT e, v FROM edge UNION SELECT a, v FROM reach JOIN edge ON b = e) SELECT a, b FROM reach", (REACH,))
_plan("recursive_nonlinear", "path", ["a", "b"],
      f"WITH RECURSIVE edge AS ({EDGE_SQL}), reach(a, b) AS (SELECT e, v FROM edge UNION SELECT a, v FROM reach JOIN edge ON b = e) SELECT a, b FROM reach",
      (Rule("path", Union((0, 1), (MatchA(0, "edge", 1), Project((0, 1), Join((2,), NameExpr((0, 2), "path"), NameExpr((2, 1), "path")))))),))
_ODD = Rule("odd", Union((0, 1), (MatchA(0, "edge", 1), Project((0, 1), Join((2,), NameExpr((0, 2), "even"), MatchA(2, "edge", 1))))))
_EVEN = Rule("even", Union((0, 1), (Project((0, 1), Join((2,), NameExpr((0, 2), "odd"), MatchA(2, "edge", 1))),)))
_plan("recursive_mutual", "even", ["a", "b"],
      f"WITH RECURSIVE edge AS ({EDGE_SQL}), p(a, b, k) AS (SELECT e, v, 1 FROM edge UNION SELECT a, v, 1 - k FROM p JOIN edge ON b = e) SELECT a, b FROM p WHERE k = 0", (_ODD, _EVEN))
_plan("rule_reference", Aggregate((0, 1), NameExpr((0, 1), "reach"), ("COUNT",), (0,), (1,)), ["a", "n"],
      f"WITH RECURSIVE edge AS ({EDGE_SQL}), reach(a, b) AS (SELECT e, v FROM edge UNION SELECT a, v FROM reach JOIN edge ON b = e) SELECT a, count(*) AS n FROM reach GROUP BY a", (REACH,))


REACH_ABOVE = Rule("reach_above", Union((0, 1), (MatchA(0, "above", 1), Project((0, 1), Join((2,), NameExpr((0, 2), "reach_above"), MatchA(2, "above", 1))))))
_plan("recursive_hierarchy", "reach_above", ["a", "b"],
      f"WITH RECURSIVE above AS ({ABOVE_SQL}), reach(a, b) AS (SELECT e, v FROM above UNION SELECT a, v FROM reach JOIN above ON b = e) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM reach", (REACH_ABOVE,))


# -- pulls ---------------------------------------------------------------------
def _pulled(name: str, plan: Plan, sql: str) -> None:
    @_query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return result_columns(tables(spark, sf_dir).query(plan)).select(F.concat_ws("/", "path").alias("path"), "attr", "value")


_URGENT = MatchAV(0, "order_status", "P")
_pulled("pull_level", PullLevel((), _URGENT, 0, ("order_priority", "order_customer")),
        "SELECT CAST(o_orderkey AS VARCHAR) AS path, 'order_priority' AS attr, o_orderpriority AS value FROM orders WHERE o_orderstatus = 'P' "
        "UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'order_customer', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'")
_HOP = q([0, 1], [B(0, "order_status", 2), C(2, "P"), B(0, "order_customer", 1)])
_HOP_SQL = "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'"
_pulled("pull_nested", PullLevel((), _HOP, 1, ("customer_name",), ("order_customer",), False),
        f"SELECT o_orderkey || '/order_customer' AS path, 'customer_name' AS attr, c_name AS value {_HOP_SQL} "
        f"UNION ALL SELECT o_orderkey || '/order_customer', 'db__id', CAST(o_custkey AS VARCHAR) {_HOP_SQL}")
_pulled("pull_nested_many", PullLevel((), _HOP, 1, ("customer_name",), ("order_customer",), True),
        f"SELECT o_orderkey || '/order_customer/' || o_custkey AS path, 'customer_name' AS attr, c_name AS value {_HOP_SQL}")
_pulled("pull_paths", Pull((), (PullLevel((), _URGENT, 0, ("order_priority",)), PullLevel((), _HOP, 1, ("customer_segment",), ("order_customer",), True))),
        "SELECT CAST(o_orderkey AS VARCHAR) AS path, 'order_priority' AS attr, o_orderpriority AS value FROM orders WHERE o_orderstatus = 'P' "
        f"UNION ALL SELECT o_orderkey || '/order_customer/' || o_custkey, 'customer_segment', c_mktsegment {_HOP_SQL}")
_pulled("pull_all", PullAll((), ("nation_name", "region_name")),
        "SELECT CAST(n_nationkey AS VARCHAR) AS path, 'nation_name' AS attr, n_name AS value FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 'region_name', r_name FROM region")
_SELECTION = '{ order_priority order_customer(customer_segment: "BUILDING") { customer_name } }'
_pulled("graphql_nested_args", GraphQl(_SELECTION, Hector((0,), (B(0, "order_status", 9), C(9, "P")))),
        "SELECT CAST(o_orderkey AS VARCHAR) AS path, 'order_priority' AS attr, o_orderpriority AS value FROM orders WHERE o_orderstatus = 'P' "
        f"UNION ALL SELECT o_orderkey || '/order_customer', 'customer_name', c_name {_HOP_SQL} AND c_mktsegment = 'BUILDING' "
        f"UNION ALL SELECT o_orderkey || '/order_customer', 'db__id', CAST(o_custkey AS VARCHAR) {_HOP_SQL} AND c_mktsegment = 'BUILDING'")


@_query("derive_attribute", "SELECT DISTINCT c_custkey AS e, c_name AS v FROM orders JOIN customer ON o_custkey = c_custkey")
def _derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.domain = tables(spark, sf_dir)
    engine.derive("buyer", "{ order_customer { customer_name } }")
    return result_columns(engine.domain.query(MatchA(0, "buyer/customer_name", 1)), ["e", "v"])


# -- inputs over time ----------------------------------------------------------
def _log(spark: SparkSession, sf_dir: str, semantics: str, value: str, time: str, weight: str = "1L", name: str = "fact") -> Domain:
    """Events as changes of one attribute of their users."""
    d = Domain(spark)
    d.create_attribute(name, AttributeConfig.uncompacted(semantics, value_type="Number"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    d.transact_frame(name, events.select(F.col("user_id").alias("e"), F.expr(value).alias("v"), F.expr(time).alias(TIME), F.expr(weight).alias("_w")))
    return d


_EV = CENTS.format("value")
_MAX = (1 << 62)


@_query("lww_snapshot", f"SELECT user_id AS e, arg_max({_EV}, event_id) AS v FROM events GROUP BY user_id")
def _lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_columns(_log(spark, sf_dir, "LastWriteWins", _EV, "event_id").query(MatchA(0, "fact", 1), _MAX), ["e", "v"])


@_query("lww_tie", f"SELECT user_id AS e, arg_max({_EV}, struct_pack(a := event_id // 100, b := {_EV})) AS v FROM events GROUP BY user_id")
def _lww_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_columns(_log(spark, sf_dir, "LastWriteWins", _EV, "event_id div 100").query(MatchA(0, "fact", 1), _MAX), ["e", "v"])


@_query("lww_diffs", f"""
WITH w AS (SELECT user_id AS e, {_EV} AS v, event_id AS t FROM events),
x AS (SELECT *, lag(v) OVER (PARTITION BY e ORDER BY t, v) AS old FROM w),
y AS (SELECT e, v, t, 1 AS d FROM x UNION ALL SELECT e, old, t, -1 FROM x WHERE old IS NOT NULL)
SELECT e, v, t, CAST(sum(d) AS BIGINT) AS d FROM y GROUP BY e, v, t HAVING sum(d) <> 0""")
def _lww_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, "LastWriteWins", _EV, "event_id").logs["fact"].diffs().toDF("e", "v", "t", "d")


_SIGN = "CASE WHEN event_type = 'error' THEN -1L ELSE 1L END"
_SIGN_SQL = "CASE WHEN event_type = 'error' THEN -1 ELSE 1 END"


@_query("raw_input", f"SELECT user_id AS e, {_EV} % 5 AS v, CAST(sum({_SIGN_SQL}) AS BIGINT) AS n FROM events GROUP BY 1, 2 HAVING sum({_SIGN_SQL}) <> 0")
def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _log(spark, sf_dir, "Raw", f"{_EV} % 5", "0L", _SIGN).query(MatchA(0, "fact", 1), 0)
    return r.df.toDF("e", "v", "n")


@_query("distinct_input", f"SELECT user_id AS e, {_EV} % 5 AS v FROM events GROUP BY 1, 2 HAVING sum({_SIGN_SQL}) > 0")
def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_columns(_log(spark, sf_dir, "Distinct", f"{_EV} % 5", "0L", _SIGN).query(MatchA(0, "fact", 1), 0), ["e", "v"])


@_query("future_dated", f"SELECT user_id AS e, {_EV} % 5 AS v FROM events WHERE event_id % 4 <= 2 GROUP BY 1, 2")
def _future(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_columns(_log(spark, sf_dir, "Distinct", f"{_EV} % 5", "event_id % 4").query(MatchA(0, "fact", 1), 2), ["e", "v"])


@_query("coarsen_granularity", f"SELECT (event_id // 500 + 1) * 500 AS w, CAST(sum({_SIGN_SQL}) AS BIGINT) AS n FROM events GROUP BY 1")
def _coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = _log(spark, sf_dir, "Raw", f"{_EV} % 5", "event_id", _SIGN).logs["fact"].diffs()
    return diffs.groupBy(coarsen_column(F.col(TIME), 500).alias("w")).agg(F.sum("_w").alias("n"))


_COUNTED = Aggregate((0, 1), MatchA(0, "fact", 1), ("COUNT",), (0,), (1,))
_COUNTS_SQL = """
WITH n AS (SELECT user_id AS e, count(*) AS v FROM events WHERE event_id % 3 <= 2 GROUP BY 1),
o AS (SELECT user_id AS e, count(*) AS v FROM events WHERE event_id % 3 <= 1 GROUP BY 1)
SELECT e, v, CAST(sum(d) AS BIGINT) AS d FROM (SELECT e, v, 1 AS d FROM n UNION ALL SELECT e, v, -1 FROM o) GROUP BY e, v HAVING sum(d) <> 0"""


@_query("epoch_diff", _COUNTS_SQL)
def _epoch_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _log(spark, sf_dir, "Raw", _EV, "event_id % 3")
    return d.diffs(_COUNTED, 2).drop(TIME).toDF("e", "v", "d")


@_query("epoch_diff_incremental", _COUNTS_SQL)
def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _log(spark, sf_dir, "Raw", _EV, "event_id % 3")
    return epoch_diffs(d, _COUNTED, 2).drop(TIME).toDF("e", "v", "d")


# as of half of the system time that there is, so that the log it sees grows with the input
@_query("bitemporal_snapshot", f"SELECT user_id AS e, arg_max({_EV}, struct_pack(a := event_id % 10, b := event_id)) AS v FROM events WHERE event_id % 10 <= 6 AND event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY user_id")
def _bitemporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    changes = events.select(F.col("user_id").alias("e"), F.expr(_EV).alias("v"), (F.col("event_id") % 10).alias("_event"), F.col("event_id").alias("_system"), F.lit(1).alias("_w"))
    half = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    return snapshot_bitemporal(changes, 6, half).select("e", "v")


# of each user, what was last written is taken back where the last event was an error
@_query("lww_retraction", f"SELECT user_id AS e, arg_max({_EV}, event_id) AS v FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def _lww_retraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _log(spark, sf_dir, "LastWriteWins", _EV, "event_id")
    last = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max_by(F.struct("event_type", F.expr(_EV).alias("v"), "event_id"), "event_id").alias("x"))
    gone = last.where("x.event_type = 'error'")
    d.transact_frame("fact", gone.select(F.col("user_id").alias("e"), "x.v", (F.col("x.event_id") + 1).alias(TIME), F.lit(-1).alias("_w")))
    return result_columns(d.query(MatchA(0, "fact", 1), _MAX), ["e", "v"])


@_query("lww_compacted", f"SELECT user_id AS e, arg_max({_EV}, event_id) AS v FROM events GROUP BY user_id")
def _lww_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History up to the middle of the events is folded first."""
    d = _log(spark, sf_dir, "LastWriteWins", _EV, "event_id")
    log = d.logs["fact"]
    log.compact((log.changes().agg(F.max(TIME)).first()[0] or 0) // 2)
    return result_columns(d.query(MatchA(0, "fact", 1), _MAX), ["e", "v"])


@_query("distinct_compacted", f"SELECT user_id AS e, {_EV} % 5 AS v FROM events GROUP BY 1, 2 HAVING sum({_SIGN_SQL}) > 0")
def _distinct_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _log(spark, sf_dir, "Distinct", f"{_EV} % 5", "event_id", _SIGN)
    log = d.logs["fact"]
    log.compact((log.changes().agg(F.max(TIME)).first()[0] or 0) // 2)
    return result_columns(d.query(MatchA(0, "fact", 1), _MAX), ["e", "v"])


# -- sources and sinks -----------------------------------------------------------
def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_query("csv_source", "SELECT c_custkey AS e, c_name AS n, c_mktsegment AS s FROM customer")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    e = Engine(spark)
    e.register_source(CsvFile(path, {"csv/name": (1, "String"), "csv/segment": (2, "String")}, has_headers=True))
    return result_columns(e.domain.query(Join((0,), MatchA(0, "csv/name", 1), MatchA(0, "csv/segment", 2))), ["e", "n", "s"])


@_query("json_source", "SELECT o_orderstatus AS s, count(*) AS n, 0 AS first FROM orders GROUP BY 1")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities are line numbers from 0 on, without gaps: told by ``first``."""
    path = _folder(spark, "json")
    spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).write.json(path)
    e = Engine(spark)
    e.register_source(JsonFile(path, {"status": "String", "customer": "Number"}))
    df = result_columns(e.domain.query(MatchA(0, "status", 1)), ["e", "s"])
    gaps = df.agg((F.max("e") + 1 - F.count_distinct("e") + F.min("e")).cast("int").alias("first"))
    return df.groupBy("s").agg(F.count("*").alias("n")).crossJoin(F.broadcast(gaps)).select("s", "n", "first")


def _sunk(spark: SparkSession, sf_dir: str, register: Callable[[Engine, FileSink], None]) -> DataFrame:
    """Events in three epochs by their types, through the engine into files."""
    e = Engine(spark)
    e.create_attribute("kind", AttributeConfig.uncompacted("Distinct", value_type="Number"))
    path = _folder(spark, "sink")
    register(e, FileSink(path, "parquet"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(3):
        own = events.where(F.pmod(F.length("event_type"), F.lit(3)) == k)
        e.message([lambda own=own: e.domain.transact_frame("kind", own.select(F.col("user_id").alias("e"), F.length("event_type").cast("long").alias("v")))])
    e.message([])
    return spark.read.parquet(path)


_SUNK = "SELECT DISTINCT user_id AS e, CAST(length(event_type) AS BIGINT) AS v, CAST(length(event_type) % 3 AS BIGINT) AS t FROM events"


@_query("subscribe_file_sink", f"SELECT e, v, t, CAST(1 AS BIGINT) AS d FROM ({_SUNK})")
def _subscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sunk(spark, sf_dir, lambda e, sink: e.subscribe("kind", sink=sink)).toDF("e", "v", "t", "d")


@_query("interest_granularity", f"SELECT e, v, (t // 2 + 1) * 2 AS t, CAST(1 AS BIGINT) AS d FROM ({_SUNK})")
def _granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def register(e: Engine, sink: FileSink) -> None:
        e.register(Rule("all", MatchA(0, "kind", 1)))
        e.interest("all", sink=sink, granularity=2)

    return _sunk(spark, sf_dir, register).toDF("e", "v", "t", "d")


@_query("tagged_lane", "SELECT v FROM (SELECT r_name AS v, 1 AS t, r_name AS s, 0 AS n FROM region UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 5, NULL, n_nationkey FROM nation) WHERE t > 1 OR s >= 'ASIA'")
def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables(spark, sf_dir)
    names = d.source().pairs("region_name")[0].select(F.col("v").alias("x"), tagged("String", F.col("v")).alias("t"))
    keys = d.source().pairs("nation_name")[0].select(F.col("e").cast("string").alias("x"), tagged("Eid", F.col("e")).alias("t"))
    floor = tagged("String", F.lit("ASIA"))
    return names.union(keys).where(F.col("t") >= floor).select(F.col("x").alias("v"))


# -- the flagship --------------------------------------------------------------
FLAGSHIP = Aggregate((2, 0, 3), Join((1,), Join((0,), MatchA(0, "order_customer", 1), MatchA(0, "order_cents", 3)), MatchA(1, "customer_segment", 2)),
                     ("COUNT", "SUM"), (2,), (0, 3))
_plan("segment_revenue", FLAGSHIP, ["segment", "orders", "cents"],
      f"SELECT c_mktsegment AS segment, count(*) AS orders, CAST(sum({CENTS.format('o_totalprice')}) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["segment_revenue"](spark, sf_dir)


__all__ = ["QUERIES", "SQL", "flagship", "tables"]
