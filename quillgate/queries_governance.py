"""Registered queries of the policy: for each group of checks, statements with the code of their refusal.

Every group also has statements that must pass; those are run, and their number of rows is compared with
what SQL finds in the same tables. So a row differs if a check lets through what it should refuse, refuses
what it should let through, or lets a query read other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgate.demo_catalog import CATALOG
from quillgate.plans.builder import Query
from quillgate.plans.catalog import Ref
from quillgate.plans.ir import Compare, Literal, Plan
from quillgate.plans.issues import Rejected
from quillgate.queries_relational import governed
from quillgate.session import GovernedSession, Options, Principal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_ROW = "statement string, code string, n_rows bigint"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _outcome(spark: SparkSession, found: list[tuple[str, str | None, Callable[[], DataFrame]]]) -> DataFrame:
    """A check names all it finds; the row has the code the group is about if that is among them, all of them if not."""
    rows = []
    for label, code, make in found:
        try:
            rows.append((label, "passed", make().count()))
        except Rejected as e:
            rows.append((label, code if code in e.codes else " ".join(sorted(set(e.codes))), None))
    return spark.createDataFrame(rows, _ROW)


def _count(sql: str | None) -> str:
    """Rows of a query, at most as many as the catalog lets one have."""
    return f"(select least(count(*), {CATALOG.max_limit})::bigint from (\n{sql}\n) x)"


def _expected(cases: list[tuple[str, str | None, str | None]]) -> str:
    return "\nunion all ".join(
        f"select {_quote(label)} as statement, {_quote(code or 'passed')} as code, {_count(sql) if code is None else 'null::bigint'} as n_rows" for label, code, sql in cases
    )


def _statements(name: str, *cases: tuple[str, str | None], principal: Principal | None = None, oracle: dict[str, str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = governed(spark, sf_dir, principal)
        return _outcome(spark, [(text, code, lambda t=text: session.sql(t)) for text, code in cases])

    QUERIES[name] = run
    SQL[name] = _expected([(text, code, (oracle or {}).get(text, text)) for text, code in cases])


def _plans(name: str, *cases: tuple[str, Callable[[], Query], str | None, str | None]) -> None:
    """``cases``: label, plan, code of the refusal or none, SQL whose rows the plan must have."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = governed(spark, sf_dir)
        return _outcome(spark, [(label, code, lambda b=build: session.plan(b().plan()).df) for label, build, code, _ in cases])

    QUERIES[name] = run
    SQL[name] = _expected([(label, code, sql) for label, _, code, sql in cases])


# --- statements of the SQL dialect -------------------------------------------------------------------

_statements(
    "refuse_writes",
    ("drop table nation", "sql.read_only"), ("insert into nation select * from nation", "sql.read_only"), ("create view v as select 1", "sql.read_only"), ("delete from nation", "sql.read_only"),
    ("update nation set n_name = 'x'", "sql.read_only"), ("truncate table nation", "sql.read_only"), ("set spark.sql.ansi.enabled=false", "sql.read_only"), ("show tables", "sql.read_only"),
    ("describe nation", "sql.read_only"), ("select n_name from nation", None),
)
_statements("refuse_several_statements", ("select n_name from nation; drop table nation", "sql.statements"), ("select n_name from nation; select 1", "sql.statements"), ("select r_name from region", None))
_statements("refuse_broken_text", ("selec n_name from nation", "sql.parse"), ("select n_name n2 n3 from nation", "sql.parse"), ("select n_name from nation for update", "sql.parse"), ("select n_nationkey from nation", None))
_statements(
    "refuse_recursion",
    ("with recursive r as (select 1 as n union all select n + 1 from r where n < 5) select n from r", "sql.recursive"),
    ("with r as (select n_regionkey from nation) select n_regionkey from r", None),
)
_statements("refuse_table_functions", ("select * from range(10)", "sql.table_function"), ("select * from explode(array(1, 2))", "sql.table_function"), ("select * from values (1), (2) as t(a)", "sql.forbidden"), ("select r_regionkey from region", None))
_statements(
    "refuse_qualified_names",
    ("select * from parquet.`/etc`", "sql.unknown_table"), ("select * from text.`/etc/hostname`", "sql.unknown_table"), ("select * from other.nation", "sql.unknown_table"), ("select * from nowhere", "sql.unknown_table"),
    ("select n_name from nation version as of 3", "sql.forbidden"), ("select n_name from nation tablesample (10 percent)", "sql.forbidden"), ("select nation.n_name from nation", None),
)
_statements("refuse_whole_rows", ("select n from nation n", "sql.whole_row"), ("select count(n) from nation n", "sql.whole_row"), ("select n.n_name from nation n", None))
_statements("refuse_star_arguments", ("select struct(*) from nation", "sql.star"), ("select hash(*) from nation", "sql.star"), ("select count(n.*) from nation n", "sql.star"), ("select count(*) as n from nation", None))
_statements("refuse_unknown_columns", ("select nothing from nation", "sql.unknown_column"), ("select n_name from region", "sql.unknown_column"), ("select n_name as nothing from nation", None))
_statements(
    "refuse_high_pii",
    ("select c_name from customer", "sql.pii"), ("select count(c_name) from customer", "sql.pii"), ("select c_custkey from customer where c_name like 'C%'", "sql.pii"), ("select c_custkey from customer order by c_name", "sql.pii"),
    ("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_name = 'x')", "sql.pii"), ("select n_name from nation union select c_name from customer", "sql.pii"),
    ("with x as (select c_name as f from customer) select f from x", "sql.pii"), ("select c_custkey, row_number() over (order by c_name) as k from customer", "sql.pii"),
    ("select case when c_name = 'x' then 1 else 0 end as hit from customer", "sql.pii"), ("select c_custkey, c_acctbal from customer", None),
)
_statements(
    "refuse_unknown_functions",
    ("select reflect('java.lang.System', 'getenv', 'HOME') from nation", "sql.function"), ("select java_method('java.lang.System', 'exit', 1) from nation", "sql.function"), ("select secret_thing(n_nationkey) from nation", "sql.function"),
    ("select input_file_name() from nation", "sql.function"), ("select transform(array(1), x -> x + 1) from nation", "sql.function"), ("select upper(n_name) as u from nation", None),
)
_statements(
    "refuse_unbounded_memory",
    ("select repeat('x', 1000000000) from nation", "sql.function"), ("select lpad(n_name, 1000000, 'x') from nation", "sql.function"), ("select explode(sequence(1, 1000000)) from nation", "sql.function"), ("select trim(n_name) as t from nation", None),
)
_statements("refuse_session_identity", ("select current_user() from nation", "sql.function"), ("select session_user() from nation", "sql.function"), ("select version() from nation", "sql.function"), ("select length(n_name) as l from nation", None))
_statements("refuse_computed_limits", ("select n_name from nation limit 1 + 1", "sql.limit"), ("select n_name from nation order by n_name limit 4", None))
_statements("quoted_identifiers", ('select "n_name" from "nation"', None), ('select "n"."n_name" from nation as "n" where "n_regionkey" = 1', None), ('select "c_name" from customer', "sql.pii"))
_statements("comments_dropped", ("select n_name /* , c_name */ from nation -- where 1 = 0", None), ("select /* x */ c_name from customer", "sql.pii"))

# --- joins -------------------------------------------------------------------------------------------

_statements(
    "refuse_cross_joins",
    ("select n_name, r_name from nation cross join region", "sql.cross_join"), ("select n_name, r_name from nation, region", "sql.cross_join"), ("select n_name, r_name from nation join region on true", "sql.join"),
    ("select o_orderkey from orders cross join (select avg(o_totalprice) as m from orders) x where o_totalprice > x.m", None),
)
_statements("refuse_using", ("select n_name from nation join region using (r_regionkey)", "sql.join"), ("select n_name from nation natural join region", "sql.join"), ("select n_name, r_name from nation join region on n_regionkey = r_regionkey", None))
_statements(
    "refuse_unapproved_joins",
    ("select n_name, r_name from nation join region on n_nationkey = r_regionkey", "sql.join_not_allowed"), ("select n_name, r_name from nation join region on n_regionkey > r_regionkey", "sql.join"),
    ("select n_name, r_name from nation join region on n_regionkey = r_regionkey or n_nationkey = 1", "sql.join"), ("select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey", None),
)
_statements(
    "refuse_self_joins",
    ("select a.o_orderkey, b.o_orderkey from orders a join orders b on a.o_orderkey = b.o_orderkey", "sql.join_not_allowed"),
    ("select a.o_orderkey, b.n from orders a join (select o_custkey, count(*) as n from orders group by o_custkey) b on a.o_custkey = b.o_custkey", None),
)
_statements(
    "refuse_fan_out",
    ("select sum(o.o_totalprice) from orders o join lineitem l on l.l_orderkey = o.o_orderkey", "sql.fan_out"), ("select c_mktsegment, count(c_custkey) from customer join orders on o_custkey = c_custkey group by c_mktsegment", "sql.fan_out"),
    ("select sum(o.o_totalprice) over (partition by o.o_orderkey) as x, l.l_tax from orders o join lineitem l on l.l_orderkey = o.o_orderkey", "sql.fan_out"),
    ("select o_orderpriority, sum(l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey group by o_orderpriority", None),
    ("select c_mktsegment, count(distinct c_custkey) as n, max(c_acctbal) as m from customer join orders on o_custkey = c_custkey group by c_mktsegment", None),
)
_statements(
    "refuse_hidden_fan_out",
    ("select sum(x.o_totalprice) from (select o.o_totalprice, l.l_tax from orders o join lineitem l on l.l_orderkey = o.o_orderkey) x", "sql.fan_out"),
    ("with j as (select o.o_totalprice, l.l_tax from orders o join lineitem l on l.l_orderkey = o.o_orderkey) select avg(o_totalprice) from j", "sql.fan_out"),
    ("select x.k, c.c_mktsegment from (select o.o_custkey as k, l.l_tax from orders o join lineitem l on l.l_orderkey = o.o_orderkey) x join customer c on x.k = c.c_custkey", "sql.join_unknown_grain"),
    ("select max(n) as m from (select o_custkey, count(*) as n from orders group by o_custkey) x", None),
)
_statements("refuse_unused_joins", ("select o_orderkey from orders join customer on o_custkey = c_custkey", "sql.unused_join"), ("select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey", None))
_statements(
    "windowed_aggregate_is_not_one_row",
    ("select n_name from nation cross join (select max(n_nationkey) over () as m from nation) x where n_nationkey = x.m", "sql.cross_join"),
    ("select n_name from nation cross join (select max(n_nationkey) as m from nation) x where n_nationkey = x.m", None),
)
_statements(
    "sets_keep_their_rows",
    ("select n_name from nation where n_nationkey in (select c_nationkey from customer join orders on o_custkey = c_custkey)", None),
    ("select n_regionkey as k from nation union all select r_regionkey from region limit 7", None), ("select c_nationkey as k from customer except select s_nationkey from supplier", None),
)

# --- plans -------------------------------------------------------------------------------------------

_q = Query.over

_plans(
    "plan_unknown_names",
    ("unknown table", lambda: _q("nowhere").limit(5), "catalog.unknown_table", None), ("unknown column", lambda: _q("nation").where("nation.colour", "eq", 1).limit(5), "catalog.unknown_column", None),
    ("unknown order", lambda: _q("nation").agg("count", None, "n").order("m").limit(5), "plan.unknown_order_alias", None), ("unknown having", lambda: _q("nation").agg("count", None, "n").having("m", "gt", 3).limit(5), "plan.unknown_having_alias", None),
    ("known", lambda: _q("nation").where("nation.n_regionkey", "eq", 1).limit(50), None, "select * from nation where n_regionkey = 1"),
)
_plans(
    "plan_literal_types",
    ("like on a number", lambda: _q("orders").where("orders.o_totalprice", "like", "1%").limit(5), "typecheck.like_on_non_string", None), ("text for a number", lambda: _q("orders").where("orders.o_totalprice", "eq", "1").limit(5), "typecheck.literal_mismatch", None),
    ("number for a time", lambda: _q("orders").where("orders.o_orderdate", "eq", 4).limit(5), "typecheck.literal_mismatch", None), ("number", lambda: _q("nation").where("nation.n_nationkey", "ge", 20).limit(50), None, "select * from nation where n_nationkey >= 20"),
)
_plans(
    "plan_aggregate_types",
    ("sum of text", lambda: _q("nation").agg("sum", "nation.n_name", "s").limit(5), "typecheck.agg_non_numeric", None), ("sum of nothing", lambda: _q("nation").agg("sum", None, "s").limit(5), "typecheck.agg_requires_column", None),
    ("greatest label of all", lambda: _q("nation").agg("max", "nation.n_name", "x").limit(5), "policy.ungrouped_label_aggregate", None),
    ("greatest label by group", lambda: _q("nation").by("region.r_name").agg("max", "nation.n_name", "x").limit(50), None, "select n_regionkey, max(n_name) from nation group by 1"),
)
_plans(
    "plan_limits",
    ("no limit", lambda: _q("nation").agg("count", None, "n"), "policy.limit_required", None), ("one of unordered groups", lambda: _q("nation").by("nation.n_regionkey").agg("count", None, "n").limit(1), "plan.arbitrary_group", None),
    ("one of ordered groups", lambda: _q("nation").by("region.r_name").agg("count", None, "n").order("n", descending=True).limit(1), None, "select 1"), ("limit", lambda: _q("nation").limit(7), None, "select * from nation limit 7"),
)
_plans(
    "plan_order_keys",
    ("key not grouped", lambda: _q("orders").by("orders.o_orderstatus").agg("count", None, "n").order("orders.o_orderpriority").limit(5), "plan.order_key_not_grouped", None),
    ("dead key", lambda: _q("orders").by("orders.o_orderstatus").agg("count", None, "n").order("orders.o_orderstatus").order("n").limit(5), "plan.dead_order_keys", None),
    ("list by its many side", lambda: _q("customer").order("orders.o_totalprice").limit(5), "plan.list_order_many_side", None),
    ("group key", lambda: _q("orders").by("orders.o_orderstatus").agg("count", None, "n").order("orders.o_orderstatus").limit(50), None, "select distinct o_orderstatus from orders"),
)
_plans(
    "plan_high_pii",
    ("filter", lambda: _q("customer").where("customer.c_name", "eq", "x").agg("count", None, "n").limit(5), "policy.pii_filter_blocked", None), ("group", lambda: _q("customer").by("customer.c_name").agg("count", None, "n").limit(5), "policy.pii_exposed", None),
    ("order", lambda: _q("customer").order("customer.c_name").limit(5), "policy.pii_exposed", None), ("show", lambda: _q("customer").show("customer.c_name").limit(5), "policy.pii_exposed", None),
    ("greatest", lambda: _q("customer").by("customer.c_mktsegment").agg("max", "customer.c_name", "x").limit(5), "policy.pii_exposed", None),
    ("by segment", lambda: _q("customer").by("customer.c_mktsegment").agg("count", None, "n").limit(50), None, "select distinct c_mktsegment from customer"),
)
_plans(
    "plan_fan_out",
    ("orders by their lines", lambda: _q("orders").agg("sum", "orders.o_totalprice", "s").where("lineitem.l_tax", "gt", 0.01).limit(5), "plan.fan_out", None),
    ("no way of keys", lambda: _q("events").where("nation.n_nationkey", "eq", 1).limit(5), "plan.no_join_path", None),
    ("lines by order", lambda: _q("lineitem").by("orders.o_orderpriority").agg("sum", "lineitem.l_quantity", "q").limit(50), None, "select o_orderpriority from lineitem join orders on l_orderkey = o_orderkey group by 1"),
    ("different orders", lambda: _q("lineitem").by("lineitem.l_returnflag").agg("count_distinct", "orders.o_orderkey", "n").limit(50), None, "select distinct l_returnflag from lineitem"),
)
_plans(
    "plan_having_dropped",
    ("having more than none", lambda: _q("orders").by("orders.o_orderstatus").agg("count", None, "n").having("n", "gt", 0).limit(50), None, "select distinct o_orderstatus from orders"),
    ("having more than some", lambda: _q("nation").by("region.r_name").agg("count", None, "n").having("n", "gt", 4).limit(50), None, "select n_regionkey from nation group by 1 having count(*) > 4"),
)


_plans(
    "plan_bucketed_keys",
    ("a key and its month", lambda: _q("orders").by("orders.o_orderdate").bucket("orders.o_orderdate", "month").agg("count", None, "n").limit(1000), None, "select distinct date_trunc('month', o_orderdate) from orders"),
    ("a key", lambda: _q("orders").by("orders.o_orderpriority").agg("count", None, "n").limit(1000), None, "select distinct o_orderpriority from orders"),
)
_plans(
    "plan_all_faults",
    ("three faults at once", lambda: _q("customer").by("customer.c_name").agg("sum", "customer.c_mktsegment", "s").having("m", "gt", 3), "plan.unknown_having_alias policy.limit_required policy.pii_exposed typecheck.agg_non_numeric", None),
    ("none", lambda: _q("customer").by("customer.c_mktsegment").agg("sum", "customer.c_acctbal", "s").having("s", "gt", 3.0).limit(50), None, "select c_mktsegment from customer group by 1 having sum(c_acctbal) > 3"),
)
def metrics_authorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric over tables a principal may not read is unknown to it."""
    names = ("order_count", "revenue_by_nation", "monthly_orders")
    rows = []
    for who, tables in (("all", None), ("guest", frozenset({"orders"}))):
        session = governed(spark, sf_dir, Principal(who, allowed_tables=tables))
        rows += [(f"{who} {m}", "catalog.unknown_metric", lambda s=session, m=m: s.metric(m).df) for m in names]
    return _outcome(spark, rows)


QUERIES["metrics_authorised"] = metrics_authorised
_MONTHS, _NATIONS = "select distinct date_trunc('month', o_orderdate) from orders", "select distinct c_nationkey from orders join customer on o_custkey = c_custkey"
SQL["metrics_authorised"] = _expected(
    [("all order_count", None, "select 1"), ("all revenue_by_nation", None, _NATIONS), ("all monthly_orders", None, _MONTHS),
     ("guest order_count", None, "select 1"), ("guest revenue_by_nation", "catalog.unknown_metric", None), ("guest monthly_orders", None, _MONTHS)]
)

# --- whom a session serves, and how it runs --------------------------------------------------------------

_FEW = Principal("guest", allowed_tables=frozenset({"nation", "region"}))
_statements("tables_allowed", ("select c_custkey from customer", "sql.unknown_table"), ("select n_name, r_name from nation join region on n_regionkey = r_regionkey", None), principal=_FEW)
_ASIA = Principal("asia", row_filters=(Compare(Ref("region", "r_name"), "eq", Literal("string", "ASIA")),))
_statements(
    "row_filters_reach_all_tables",
    ("select r_name from region", None), ("select n_name from nation", None), ("select c_custkey from customer", None), ("select o_orderkey from orders", None),
    principal=_ASIA,
    oracle={
        "select r_name from region": "select 1 from region where r_name = 'ASIA'",
        "select n_name from nation": "select 1 from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'",
        "select c_custkey from customer": "select 1 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'",
        "select o_orderkey from orders": "select 1 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'",
    },
)


def execution_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit says of a run cut at the row limit and of one that is not."""
    from quillgate.demo_catalog import sources

    log: list = []
    session = GovernedSession(spark, CATALOG, sources(sf_dir), Principal("ann"), audit=log.append)
    for text in ("select o_orderkey from orders", "select n_name from nation"):
        query = session.query(text)
        session.run(query.df, query.query_hash, Options(max_rows=100))
    return spark.createDataFrame([(a.principal_id, a.status, a.row_count, a.truncated) for a in log], "principal string, status string, row_count bigint, truncated boolean")


QUERIES["execution_audit"] = execution_audit
SQL["execution_audit"] = "\nunion all ".join(f"select 'ann' as principal, 'ok' as status, least(count(*), 100)::bigint as row_count, count(*) > 100 as truncated from {t}" for t in ("orders", "nation"))


def plan_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan read back from its own JSON has the same digest and the same rows."""
    session = governed(spark, sf_dir)
    plan = _q("orders").where("orders.o_totalprice", "gt", 1000.0).by("orders.o_orderpriority").agg("count", None, "n").limit(50).plan()
    again = Plan.from_json(plan.canonical())
    if again.digest() != plan.digest() or session.plan(again) is not session.plan(plan):
        raise AssertionError("the plan read back is another")
    return session.plan(again).df


QUERIES["plan_round_trip"] = plan_round_trip
SQL["plan_round_trip"] = "select o_orderpriority, count(*) as n from orders where o_totalprice > 1000 group by 1"
