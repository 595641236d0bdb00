"""Registered queries of the governed engine: plans, guarded SQL, metrics, row filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgate.demo_catalog import CATALOG, sources
from quillgate.plans.builder import Query
from quillgate.plans.catalog import Ref
from quillgate.plans.ir import Compare, Literal, Plan
from quillgate.session import GovernedSession, Principal
from quillgate.sqlguard.rewrite import case_insensitive_like

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AFRICA = Principal("analyst", row_filters=(Compare(Ref("region", "r_name"), "eq", Literal("string", "AFRICA")),))
URGENT = Principal("desk", row_filters=(Compare(Ref("orders", "o_orderpriority"), "eq", Literal("string", "1-URGENT")),))


def governed(spark: SparkSession, sf_dir: str, principal: Principal | None = None) -> GovernedSession:
    return GovernedSession(spark, CATALOG, sources(sf_dir), principal)


def _sql(name: str, text: str, oracle: str | None = None, principal: Principal | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: governed(spark, sf_dir, principal).sql(text)
    SQL[name] = oracle or text


def _plan(name: str, build: Callable[[], Plan], oracle: str, principal: Principal | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: governed(spark, sf_dir, principal).plan(build()).df
    SQL[name] = oracle


def _metric(name: str, metric_id: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: governed(spark, sf_dir).metric(metric_id).df
    SQL[name] = oracle


# --- plans: the minimum slice ------------------------------------------------------------------------

_plan(
    "revenue_by_nation_top10",
    lambda: Query.over("lineitem").via("customer").by("nation.n_name").agg("count", None, "n_lines").agg("sum", "lineitem.l_quantity", "quantity").top(10, "quantity").via("orders").plan(),
    """select n_name, count(*) as n_lines, sum(l_quantity) as quantity from lineitem join orders on l_orderkey = o_orderkey
       join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name order by quantity desc limit 10""",
)


def _count(column: str, op: str, value: object = None, high: object = None) -> Callable[[], Plan]:
    source = column.split(".")[0]
    key = {"lineitem": "lineitem.l_returnflag", "orders": "orders.o_orderstatus", "track": "track.mediatypeid", "part": "part.p_brand", "events": "events.event_type"}[source]
    return lambda: Query.over(source).where(column, op, value, high).by(key).agg("count", None, "n").limit(10_000).plan()


for _name, _args, _where in (
    ("filter_eq", ("orders.o_orderpriority", "eq", "2-HIGH"), "orders where o_orderpriority = '2-HIGH'"),
    ("filter_ne", ("orders.o_orderpriority", "ne", "2-HIGH"), "orders where o_orderpriority <> '2-HIGH'"),
    ("filter_lt", ("lineitem.l_quantity", "lt", 10), "lineitem where l_quantity < 10"),
    ("filter_le", ("lineitem.l_discount", "le", 0.05), "lineitem where l_discount <= 0.05"),
    ("filter_gt", ("lineitem.l_extendedprice", "gt", 50000.0), "lineitem where l_extendedprice > 50000"),
    ("filter_ge", ("lineitem.l_linenumber", "ge", 4), "lineitem where l_linenumber >= 4"),
    ("filter_in", ("lineitem.l_linenumber", "in", [1, 3, 5]), "lineitem where l_linenumber in (1, 3, 5)"),
    ("filter_not_in", ("lineitem.l_linenumber", "not_in", [1, 3, 5]), "lineitem where l_linenumber not in (1, 3, 5)"),
    ("filter_between", ("lineitem.l_quantity", "between", 5, 15), "lineitem where l_quantity between 5 and 15"),
    ("filter_is_null", ("track.genreid", "is_null"), "track where genreid is null"),
    ("filter_not_null", ("track.genreid", "not_null"), "track where genreid is not null"),
    ("filter_like", ("part.p_type", "like", "%AR%"), "part where p_type like '%AR%'"),
    ("filter_ilike", ("part.p_name", "ilike", "%a%"), "part where p_name ilike '%a%'"),
    ("filter_col_vs_col", ("lineitem.l_discount", "gt", Ref("lineitem", "l_tax")), "lineitem where l_discount > l_tax"),
):
    _key = {"lineitem": "l_returnflag", "orders": "o_orderstatus", "track": "mediatypeid", "part": "p_brand"}[_where.split()[0]]
    _plan(_name, _count(*_args), f"select {_key}, count(*) as n from {_where} group by {_key}")

_plan(
    "filter_datetime_literal",
    lambda: Query.over("orders").where("orders.o_orderdate", "ge", Literal("datetime", "1997-01-01T00:00:00")).by("orders.o_orderstatus").agg("count", None, "n").limit(100).plan(),
    "select o_orderstatus, count(*) as n from orders where o_orderdate >= timestamp '1997-01-01 00:00:00' group by 1",
)
_plan(
    "scan_project",
    lambda: Query.over("nation").show("nation.n_name", "nation.n_nationkey").order("nation.n_name").limit(100).plan(),
    "select n_name, n_nationkey from nation order by n_name limit 100",
)
_plan(
    "list_safe_projection",
    lambda: Query.over("customer").where("customer.c_mktsegment", "eq", "BUILDING").order("customer.c_custkey").limit(50).plan(),
    "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer where c_mktsegment = 'BUILDING' order by c_custkey limit 50",
)
_plan(
    "list_auto_join",
    lambda: Query.over("supplier").show("supplier.s_suppkey", "nation.n_name", "region.r_name").order("supplier.s_suppkey").limit(100).plan(),
    "select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey order by s_suppkey limit 100",
)
_plan(
    "semi_join_list",
    lambda: Query.over("customer").where("orders.o_totalprice", "gt", 450000.0).where("orders.o_orderpriority", "eq", "1-URGENT").order("customer.c_custkey").limit(200).plan(),
    """select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer c where exists
       (select 1 from orders where o_custkey = c.c_custkey and o_totalprice > 450000 and o_orderpriority = '1-URGENT') order by c_custkey limit 200""",
)
_plan(
    "semi_join_two_hops",
    lambda: Query.over("customer").where("lineitem.l_quantity", "ge", 50).where("customer.c_acctbal", "gt", 9000.0).order("customer.c_custkey").limit(200).plan(),
    """select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer c where c_acctbal > 9000 and exists
       (select 1 from orders join lineitem on l_orderkey = o_orderkey where o_custkey = c.c_custkey and l_quantity >= 50) order by c_custkey limit 200""",
)
_plan(
    "left_join_plan",
    lambda: Query.over("track").join("genre", "track.genreid", "genre.genreid", "left").by("genre.name").agg("count", None, "n_tracks").limit(1000).plan(),
    "select g.name, count(*) as n_tracks from track t left join genre g on t.genreid = g.genreid group by 1",
)
_plan(
    "multi_hop_auto_join",
    lambda: Query.over("lineitem").via("supplier").by("region.r_name").agg("sum", "lineitem.l_quantity", "quantity").agg("count_distinct", "lineitem.l_suppkey", "suppliers").limit(100).plan(),
    """select r_name, sum(l_quantity) as quantity, count(distinct l_suppkey) as suppliers from lineitem join supplier on l_suppkey = s_suppkey
       join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""",
)
_plan(
    "label_for_key",
    lambda: Query.over("supplier").by("supplier.s_nationkey").agg("count", None, "suppliers").limit(100).plan(),
    "select n_name, count(*) as suppliers from supplier join nation on s_nationkey = n_nationkey group by 1",
)
_plan(
    "agg_all",
    lambda: Query.over("lineitem")
    .agg("count", None, "n").agg("count", "lineitem.l_partkey", "n_parts").agg("count_distinct", "lineitem.l_suppkey", "d_suppliers").agg("sum", "lineitem.l_linenumber", "s")
    .agg("avg", "lineitem.l_linenumber", "a").agg("min", "lineitem.l_shipdate", "first_day").agg("max", "lineitem.l_quantity", "most").limit(1).plan(),
    """select count(*) as n, count(l_partkey) as n_parts, count(distinct l_suppkey) as d_suppliers, cast(sum(l_linenumber) as bigint) as s, avg(l_linenumber) as a,
       min(l_shipdate) as first_day, max(l_quantity) as most from lineitem""",
)
_plan(
    "group_by_two",
    lambda: Query.over("lineitem").by("lineitem.l_returnflag", "lineitem.l_linestatus").agg("sum", "lineitem.l_quantity", "quantity").agg("avg", "lineitem.l_quantity", "mean").order("lineitem.l_returnflag").order("lineitem.l_linestatus").limit(100).plan(),
    "select l_returnflag, l_linestatus, sum(l_quantity) as quantity, avg(l_quantity) as mean from lineitem group by 1, 2",
)
_plan(
    "group_by_having",
    lambda: Query.over("orders").by("orders.o_custkey").agg("count", None, "n_orders").having("n_orders", "ge", 18).order("n_orders", descending=True).order("orders.o_custkey").limit(10_000).plan(),
    "select o_custkey, count(*) as n_orders from orders group by 1 having count(*) >= 18",
)
for _grain in ("hour", "day", "week", "month", "quarter", "year"):
    _plan(
        f"bucket_{_grain}",
        lambda g=_grain: Query.over("events").bucket("events.ts", g).agg("count", None, "n").agg("count_distinct", "events.user_id", "users").order("events.ts").limit(10_000).plan(),
        f"select date_trunc('{_grain}', ts)::timestamp as ts_{_grain}, count(*) as n, count(distinct user_id) as users from events group by 1 order by 1 limit 10000",
    )
_plan(
    "topk_plan",
    lambda: Query.over("orders").by("orders.o_custkey").agg("max", "orders.o_totalprice", "biggest").top(15, "biggest").plan(),
    "select o_custkey, max(o_totalprice) as biggest from orders group by 1 order by biggest desc limit 15",
)
_plan("row_filter_plan", lambda: Query.over("orders").agg("count", None, "n").limit(1).plan(), """select count(*) as n from orders where exists (select 1 from customer join nation on c_nationkey = n_nationkey
   join region on n_regionkey = r_regionkey where c_custkey = o_custkey and r_name = 'AFRICA')""", AFRICA)  # fmt: skip

# --- metrics -----------------------------------------------------------------------------------------

_metric("metric_plan", "order_count", "select count(*) as order_count from orders")
_metric(
    "metric_grouped",
    "revenue_by_nation",
    "select n_name, sum(o_totalprice) as revenue from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
)
_metric("metric_bucketed", "monthly_orders", "select date_trunc('month', o_orderdate)::timestamp as o_orderdate_month, count(*) as order_count from orders group by 1")
_metric("ratio_metric", "revenue_per_buyer", "select o_orderpriority, sum(o_totalprice) / nullif(count(distinct o_custkey), 0) as revenue_per_buyer from orders group by 1")
_metric("builtin_product_metric", "net_revenue", "select l_returnflag, sum(l_extendedprice * (1 - l_discount)) as net_revenue from lineitem group by 1")

# --- guarded SQL -------------------------------------------------------------------------------------

for _name, _text in {
    "sql_scan_star": "select * from nation",
    "sql_or_not": "select l_returnflag, count(*) as n from lineitem where (l_quantity < 5 or l_discount > 0.08) and not l_linestatus = 'F' group by l_returnflag",
    "sql_in_subquery": "select o_orderstatus, count(*) as n from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY') group by o_orderstatus",
    "sql_not_in_subquery": "select count(*) as n from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)",
    "sql_exists": "select c_mktsegment, count(*) as n from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000) group by c_mktsegment",
    "sql_not_exists": "select c_mktsegment, count(*) as n from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 300000) group by c_mktsegment",
    "sql_correlated_scalar": "select count(*) as n from orders o where o.o_totalprice = (select max(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
    "sql_inner_join": "select n_name, count(*) as n, round(sum(c_acctbal), 2) as balance from customer c join nation n on c.c_nationkey = n.n_nationkey group by n_name",
    "sql_left_join": "select g.name, count(t.trackid) as n from genre g left join track t on t.genreid = g.genreid group by g.name",
    "sql_right_join": "select g.name, count(t.trackid) as n from track t right join genre g on t.genreid = g.genreid group by g.name",
    "sql_full_join": "select count(distinct t.trackid) as tracks, count(distinct g.genreid) as genres from track t full outer join genre g on t.genreid = g.genreid",
    "sql_extra_join_condition": "select count(*) as n from lineitem l join orders o on l.l_orderkey = o.o_orderkey and o.o_orderstatus = 'O'",
    "sql_sibling_join_distinct": "select n_name, count(distinct c.c_custkey) as customers, count(distinct s.s_suppkey) as suppliers from customer c join supplier s on c.c_nationkey = s.s_nationkey join nation n on n.n_nationkey = s.s_nationkey group by n_name",
    "sql_single_row_cross_join": "select count(*) as n from orders cross join (select avg(o_totalprice) as mean from orders) m where o_totalprice > m.mean",
    "sql_join_pre_aggregated": "select c_mktsegment, sum(o.n) as orders from customer c join (select o_custkey, count(*) as n from orders group by o_custkey) o on o.o_custkey = c.c_custkey group by c_mktsegment",
    "sql_group_having": "select o_orderpriority, count(*) as n from orders group by o_orderpriority having count(*) > 10",
    "sql_conditional_agg": "select l_returnflag, sum(case when l_linestatus = 'O' then 1 else 0 end) as still_open, count(*) as n from lineitem group by l_returnflag",
    "sql_nested_agg": "select max(n) as most, min(n) as least, count(*) as buyers from (select o_custkey, count(*) as n from orders group by o_custkey) x",
    "sql_agg_vs_avg_subquery": "select o_orderstatus, count(*) as n from orders where o_totalprice > (select avg(o_totalprice) from orders) group by o_orderstatus",
    "sql_expression_over_aggs": "select l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 8) as rate from lineitem group by l_returnflag",
    "sql_cube": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)",
    "sql_rollup": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)",
    "sql_grouping_sets": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())",
    "sql_stddev_median": "select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, median(l_quantity) as mid from lineitem group by l_returnflag",
    "sql_filter_clause": "select count(*) filter (where l_quantity > 25) as big, count(*) as n from lineitem",
    "sql_window_row_number": "select count(*) as n, sum(k) as s from (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) x",
    "sql_window_rank": "select r, count(*) as n from (select l_returnflag, rank() over (partition by l_returnflag order by l_linenumber) as r from lineitem) x group by r",
    "sql_window_dense_rank": "select r, count(*) as n from (select dense_rank() over (partition by l_returnflag order by l_quantity) as r from lineitem) x group by r",
    "sql_window_lag": "select count(*) as n, count(before) as with_before from (select lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders) x",
    "sql_window_running_sum": "select max(run) as top from (select sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row) as run from orders) x",
    "sql_topk_per_group": "select r_name, n_name from (select r.r_name, n.n_name, row_number() over (partition by r.r_name order by n.n_name) as k from nation n join region r on n.n_regionkey = r.r_regionkey) x where k <= 3",
    "sql_order_multi": "select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority asc nulls last, o_totalprice desc nulls last, o_orderkey asc limit 40",
    "sql_topk_tiebreak": "select l_orderkey, l_linenumber, l_quantity from lineitem order by l_quantity desc nulls last limit 25",
    "sql_offset": "select n_nationkey, n_name from nation order by n_nationkey limit 5 offset 7",
    "sql_distinct": "select distinct l_returnflag, l_linestatus from lineitem",
    "sql_union": "select n_nationkey as k from nation union select r_regionkey as k from region",
    "sql_union_all": "select n_nationkey as k from nation union all select r_regionkey as k from region",
    "sql_intersect": "select c_nationkey as k from customer intersect select s_nationkey as k from supplier",
    "sql_except": "select n_nationkey as k from nation except select s_nationkey as k from supplier where s_acctbal > 5000",
    "sql_cte": "with big as (select o_custkey, o_totalprice from orders where o_totalprice > 300000), who as (select o_custkey, count(*) as n from big group by o_custkey) select n, count(*) as buyers from who group by n",
    "sql_derived_table": "select p_size, n from (select p_size, count(*) as n from part group by p_size) x where n > 5",
    "sql_case_when": "select case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as class, count(*) as n from part group by case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end",
    "sql_string_functions": "select upper(substring(p_type, 1, 3)) as head, count(*) as n, max(length(trim(p_name))) as longest, min(lower(p_brand)) as first_brand from part group by upper(substring(p_type, 1, 3))",
    "sql_null_functions": "select coalesce(composer, 'unknown') as who, count(*) as n from track group by coalesce(composer, 'unknown') having count(*) > 1",
    "sql_math_functions": "select l_linenumber, round(avg(abs(l_discount - l_tax)), 8) as gap, max(floor(l_quantity / 7)) as weeks, round(max(sqrt(l_quantity)), 8) as root from lineitem group by l_linenumber",
    "sql_date_functions": "select year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n from orders group by year(o_orderdate), month(o_orderdate)",
    "sql_date_parts": "select extract(quarter from o_orderdate) as q, date_part('day', o_orderdate) as d, count(*) as n from orders group by extract(quarter from o_orderdate), date_part('day', o_orderdate)",
    "sql_nullif_ratio": "select o_orderstatus, round(sum(o_totalprice) / nullif(count(*), 0), 4) as mean from orders group by o_orderstatus",
}.items():
    _sql(_name, _text)

_sql(
    "sql_date_arithmetic",
    "select date_format(o_orderdate, 'yyyy-MM') as m, max(datediff(date '2030-01-01', o_orderdate)) as days, min(to_date('2020-03-01')) as d, max(add_months(o_orderdate, 1)) as later from orders group by date_format(o_orderdate, 'yyyy-MM')",
    "select strftime(o_orderdate, '%Y-%m') as m, cast(max(date_diff('day', cast(o_orderdate as date), date '2030-01-01')) as integer) as days, min(date '2020-03-01') as d, max(cast(o_orderdate + interval 1 month as date)) as later from orders group by 1",
)
_sql("sql_set_limit", "select n_nationkey as k from nation union select r_regionkey + 100 as k from region order by k desc limit 8")
SQL["sql_set_limit"] = "select cast(k as integer) as k from (" + SQL["sql_set_limit"] + ")"
SQL["sql_date_parts"] = SQL["sql_date_parts"].replace("select extract(quarter from o_orderdate) as q, date_part('day', o_orderdate) as d", "select cast(extract(quarter from o_orderdate) as integer) as q, cast(date_part('day', o_orderdate) as integer) as d")
SQL["sql_join_pre_aggregated"] = SQL["sql_join_pre_aggregated"].replace("sum(o.n)", "cast(sum(o.n) as bigint)")
SQL["sql_conditional_agg"] = SQL["sql_conditional_agg"].replace("sum(case when l_linestatus = 'O' then 1 else 0 end)", "cast(sum(case when l_linestatus = 'O' then 1 else 0 end) as bigint)")
SQL["sql_window_row_number"] = SQL["sql_window_row_number"].replace("sum(k)", "cast(sum(k) as bigint)")
SQL["sql_window_running_sum"] = SQL["sql_window_running_sum"].replace("max(run)", "cast(max(run) as bigint)")
for _name in ("sql_window_rank", "sql_window_dense_rank"):
    SQL[_name] = SQL[_name].replace("select r,", "select cast(r as integer) as r,")
SQL["sql_string_functions"] = SQL["sql_string_functions"].replace("max(length(trim(p_name)))", "cast(max(length(trim(p_name))) as integer)")
SQL["sql_date_functions"] = SQL["sql_date_functions"].replace("year(o_orderdate) as y, month(o_orderdate) as m", "cast(year(o_orderdate) as integer) as y, cast(month(o_orderdate) as integer) as m")
SQL["sql_topk_tiebreak"] = "select l_orderkey, l_linenumber, l_quantity from lineitem order by l_quantity desc nulls last, l_orderkey, l_linenumber limit 25"
SQL["sql_math_functions"] = SQL["sql_math_functions"].replace("max(floor(l_quantity / 7))", "cast(max(floor(l_quantity / 7)) as bigint)")
_sql(
    "sql_date_trunc",
    "select cast(date_trunc('quarter', o_orderdate) as timestamp_ntz) as q, count(*) as n from orders group by cast(date_trunc('quarter', o_orderdate) as timestamp_ntz)",
    "select date_trunc('quarter', o_orderdate)::timestamp as q, count(*) as n from orders group by 1",
)
_sql("limit_capped", "select l_orderkey, l_linenumber from lineitem order by l_orderkey, l_linenumber limit 99999999", "select l_orderkey, l_linenumber from lineitem order by l_orderkey, l_linenumber limit 10000")

_LINKED = "exists (select 1 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_custkey = o_custkey and r_name = 'AFRICA')"
_sql("row_filter_direct", "select r_name from region", "select r_name from region where r_name = 'AFRICA'", AFRICA)
_sql("row_filter_via_path", "select o_orderstatus, count(*) as n from orders group by o_orderstatus", f"select o_orderstatus, count(*) as n from orders where {_LINKED} group by 1", AFRICA)
_sql(
    "row_filter_child_table",
    "select l_returnflag, count(*) as n from lineitem group by l_returnflag",
    "select l_returnflag, count(*) as n from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderpriority = '1-URGENT') group by 1",
    URGENT,
)

_RANKED = "select o_orderpriority from orders group by o_orderpriority having count(*) > 5 order by sum(o_totalprice) desc limit 4"
QUERIES["ranking_measure_shown"] = lambda spark, sf_dir: governed(spark, sf_dir).query(_RANKED, show_measures=True).df
SQL["ranking_measure_shown"] = (
    "select o_orderpriority, sum(o_totalprice) as sum_o_totalprice, count(*) as count from orders group by o_orderpriority having count(*) > 5 order by 2 desc limit 4"
)
QUERIES["ilike_rewrite"] = lambda spark, sf_dir: governed(spark, sf_dir).sql(
    case_insensitive_like("select p_brand, count(*) as n from part where p_type like 'st%' and p_name not like '%RED%' group by p_brand")
)
SQL["ilike_rewrite"] = "select p_brand, count(*) as n from part where p_type ilike 'st%' and p_name not ilike '%RED%' group by p_brand"
