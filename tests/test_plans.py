import datetime as dt
from dataclasses import replace

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgate.plans import graph
from quillgate.plans.builder import Query
from quillgate.plans.catalog import Catalog, Column, JoinKey, Metric, Ref, Table
from quillgate.plans.checks import issues_of, normalize, semi_joins
from quillgate.plans.compile import compile_metric, compile_plan, measure
from quillgate.plans.explain import explain
from quillgate.plans.ir import Between, Literal, Member, Plan
from quillgate.plans.issues import Rejected

CATALOG = Catalog(
    "shop",
    (
        Table("country", (Column("id", "int"), Column("title"))),
        Table("buyer", (Column("id", "int"), Column("full", pii="high"), Column("mail", pii="high"), Column("country_id", "int", label_for="country.title"), Column("rank", "int"))),
        Table("sale", (Column("id", "int"), Column("buyer_id", "int"), Column("made", "datetime"), Column("total", "float", unit="USD"), Column("note"), Column("paid", "bool"))),
        Table("item", (Column("id", "int"), Column("sale_id", "int"), Column("amount", "int"))),
        Table("visit", (Column("id", "int"), Column("buyer_id", "int"), Column("page"))),
        Table("secret", (Column("code", pii="high"),)),
        Table("island", (Column("id", "int"),)),
        Table("route", (Column("from_id", "int"), Column("to_id", "int"), Column("miles", "int"))),
    ),
    tuple(JoinKey(*k.split(">")) for k in ("buyer.country_id>country.id", "sale.buyer_id>buyer.id", "item.sale_id>sale.id", "visit.buyer_id>buyer.id", "route.from_id>country.id", "route.to_id>country.id")),
    metrics=(
        Metric("sales", source="sale", aggregations=("sum:sale.total:revenue",), group_by=("country.title",)),
        Metric("per_buyer", kind="ratio", source="sale", numerator="sum:sale.total:revenue", denominator="count_distinct:sale.buyer_id:buyers"),
    ),
)

T0 = dt.datetime(2024, 1, 1)
ROWS = {
    "country": [(1, "A"), (2, "B"), (3, None)],
    "buyer": [(i, f"n{i}", f"m{i}@x.y", 1 + i % 2 if i < 8 else None, i % 3) for i in range(10)],
    "sale": [(i, i % 9 if i % 7 else None, T0 + dt.timedelta(hours=31 * i), float(i % 5), "x%_\\" if i % 2 else None, bool(i % 2)) for i in range(60)],
    "item": [(i, i % 50, i % 4) for i in range(150)],
    "visit": [(i, i % 5, f"p{i % 3}") for i in range(30)],
    "secret": [("s",)],
    "island": [(1,)],
    "route": [(1, 2, 5)],
}
SCHEMAS = {
    "country": "id int, title string", "buyer": "id int, full string, mail string, country_id int, rank int",
    "sale": "id int, buyer_id int, made timestamp_ntz, total double, note string, paid boolean", "item": "id int, sale_id int, amount int",
    "visit": "id int, buyer_id int, page string", "secret": "code string", "island": "id int", "route": "from_id int, to_id int, miles int",
}


@pytest.fixture(scope="module")
def tables(spark):
    frames = {t: spark.createDataFrame(rows, SCHEMAS[t]).cache() for t, rows in ROWS.items()}
    return frames.__getitem__


@pytest.fixture(scope="module")
def duck():
    con, kinds = duckdb.connect(), {"timestamp_ntz": "timestamp", "string": "varchar"}
    for t, rows in ROWS.items():
        columns = [c.split() for c in SCHEMAS[t].split(", ")]
        con.execute(f"create table {t} ({', '.join(f'\"{n}\" {kinds.get(k, k)}' for n, k in columns)})")
        con.executemany(f"insert into {t} values ({', '.join('?' * len(rows[0]))})", rows)
    return con


def codes(plan):
    try:
        plan = normalize(plan, CATALOG)
    except Rejected as e:
        return set(e.codes)
    return {i.code for i in (*issues_of(plan, CATALOG), *semi_joins(plan, CATALOG)[2])}


def q(source="sale"):
    return Query.over(source)


@pytest.mark.parametrize(
    "build, code",
    [
        (lambda: q("nowhere").limit(5), "catalog.unknown_table"),
        (lambda: q().where("sale.colour", "eq", 1).limit(5), "catalog.unknown_column"),
        (lambda: q().agg("count", None, "n"), "policy.limit_required"),
        (lambda: q().by("sale.buyer_id").agg("count", None, "n").limit(1), "plan.arbitrary_group"),
        (lambda: q().agg("sum", "sale.note", "s").limit(5), "typecheck.agg_non_numeric"),
        (lambda: q().agg("sum", None, "s").limit(5), "typecheck.agg_requires_column"),
        (lambda: q().where("sale.total", "like", "1%").limit(5), "typecheck.like_on_non_string"),
        (lambda: q().where("sale.total", "eq", "1").limit(5), "typecheck.literal_mismatch"),
        (lambda: q().where("sale.made", "eq", 4).limit(5), "typecheck.literal_mismatch"),
        (lambda: q().agg("count", None, "n").having("m", "gt", 3).limit(5), "plan.unknown_having_alias"),
        (lambda: q().agg("count", None, "n").order("m").limit(5), "plan.unknown_order_alias"),
        (lambda: q().by("sale.buyer_id").agg("count", None, "n").order("sale.note").limit(5), "plan.order_key_not_grouped"),
        (lambda: q().by("sale.note").agg("count", None, "n").order("sale.note").order("n").limit(5), "plan.dead_order_keys"),
        (lambda: q("buyer").where("buyer.mail", "eq", "a@b.c").agg("count", None, "n").limit(5), "policy.pii_filter_blocked"),
        (lambda: q("buyer").by("buyer.mail").agg("count", None, "n").limit(5), "policy.pii_exposed"),
        (lambda: q("buyer").order("buyer.mail").limit(5), "policy.pii_exposed"),
        (lambda: q("buyer").show("buyer.full").limit(5), "policy.pii_exposed"),
        (lambda: q("buyer").by("buyer.rank").agg("max", "buyer.full", "x").limit(5), "policy.pii_exposed"),
        (lambda: q("buyer").agg("count", None, "mail_count").limit(5), "policy.misleading_alias"),
        (lambda: q().agg("max", "sale.note", "x").limit(5), "policy.ungrouped_label_aggregate"),
        (lambda: q("secret").limit(5), "policy.no_selectable_columns"),
        (lambda: q().agg("sum", "sale.total", "s").where("item.amount", "gt", 1).limit(5), "plan.fan_out"),
        (lambda: q().agg("count", None, "n").where("item.amount", "gt", 1).where("visit.page", "eq", "p1").limit(5), "plan.fan_out"),
        (lambda: q().where("island.id", "eq", 1).limit(5), "plan.no_join_path"),
        (lambda: q("route").where("country.title", "eq", "A").limit(5), "plan.ambiguous_join_path"),
        (lambda: q("buyer").order("sale.total").limit(5), "plan.list_order_many_side"),
        (lambda: q("buyer").where("sale.id", "eq", Ref("visit", "id")).limit(5), "plan.list_filter_spans_children"),
    ],
)
def test_refused(build, code):
    assert code in codes(build().plan())


def test_limit_above_catalog_and_unapproved_joins():
    small = replace(CATALOG, max_limit=10)
    assert {i.code for i in issues_of(q().limit(11).plan(), small)} == {"policy.limit_too_large"}
    bad = q().join("visit", "sale.id", "visit.id").limit(5).plan()
    assert "policy.join_not_allowed" in {i.code for i in issues_of(bad, CATALOG)}
    assert "policy.cross_join_not_allowed" in {i.code for i in issues_of(q().join("visit", "sale.id", "visit.id", "cross").limit(5).plan(), CATALOG)}
    unjoined = Plan(source="sale", filters=q().where("buyer.rank", "eq", 1).plan().filters, limit=5)
    assert "plan.table_not_in_scope" in {i.code for i in issues_of(unjoined, CATALOG)}


def test_allowed():
    assert codes(q().agg("sum", "item.amount", "s").by("country.title").limit(5).plan()) == set()
    assert codes(q("item").agg("sum", "item.amount", "s").by("country.title").limit(5).plan()) == set()
    assert codes(q("item").agg("count_distinct", "sale.id", "s").agg("max", "sale.total", "m").by("country.title").limit(5).plan()) == set()
    assert codes(q("buyer").agg("count", "buyer.mail", "n").limit(5).plan()) == set()
    assert codes(q("route").join("country", "route.to_id", "country.id").limit(5).plan()) == {"plan.ambiguous_join_path"}


def test_normalize_is_idempotent_and_rewrites():
    plan = q().by("buyer.country_id", "sale.made").bucket("sale.made", "month").agg("count", None, "n").having("n", "gt", 0).having("n", "gt", 3).order("buyer.country_id").limit(9).plan()
    done = normalize(plan, CATALOG)
    assert normalize(done, CATALOG) == done
    assert [str(c) for c in done.group_by] == ["country.title"] and len(done.having) == 1
    assert [j.table for j in done.joins] == ["buyer", "country"] and str(done.order_by[0].column) == "country.title"


def test_json_round_trip_and_hash():
    plan = q().where("sale.made", "between", dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)).where("sale.id", "in", [1, 2]).where("sale.note", "not_null").where("sale.total", "gt", 1.5).where("sale.id", "ne", Ref("sale", "buyer_id")).by("sale.paid").agg("avg", "sale.total", "a").top(3, "a").plan()
    again = Plan.from_json(plan.canonical())
    assert again == plan and again.digest() == plan.digest() and plan.but(limit=4).digest() != plan.digest()
    with pytest.raises(ValueError):
        Plan.from_dict({"source": "sale", "sql": "select 1"})
    for bad in (lambda: Between(Ref("a", "b"), Literal.of(3), Literal.of(1)), lambda: Member(Ref("a", "b"), ()), lambda: Literal("integer", "x"), lambda: Literal("date", 5), lambda: Plan("a", limit=0), lambda: Literal("boolean", 1)):
        with pytest.raises(ValueError):
            bad()
    assert Literal("integer", " 7 ").value == 7 and Literal("date", "2024-02-29").value == dt.date(2024, 2, 29)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _same(spark_rows, duck_rows):
    clean = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert clean(spark_rows) == clean(duck_rows)


@pytest.mark.parametrize(
    "build, sql",
    [
        (lambda: q("buyer").where("sale.total", "ge", 3).where("sale.paid", "eq", True).limit(50), "select id, country_id, rank from buyer b where exists (select 1 from sale where buyer_id = b.id and total >= 3 and paid)"),
        (lambda: q("buyer").where("item.amount", "eq", 3).where("visit.page", "eq", "p1").limit(50), "select id, country_id, rank from buyer b where exists (select 1 from sale s join item i on i.sale_id = s.id where s.buyer_id = b.id and amount = 3) and exists (select 1 from visit v where v.buyer_id = b.id and page = 'p1')"),
        (lambda: q("buyer").where("sale.id", "gt", Ref("buyer", "id")).limit(50), "select id, country_id, rank from buyer b where exists (select 1 from sale where buyer_id = b.id and sale.id > b.id)"),
        (lambda: q().join("buyer", "sale.buyer_id", "buyer.id", "left").by("buyer.rank").agg("count", None, "n").limit(50), "select rank, count(*) from sale left join buyer b on sale.buyer_id = b.id group by 1"),
        (lambda: q().where("sale.note", "like", "x%").by("sale.paid").agg("count", None, "n").limit(50), "select paid, count(*) from sale where note like 'x%' group by 1"),
        (lambda: q().where("sale.note", "like", "%\\").agg("count", None, "n").limit(50), "select count(*) from sale where note like '%\\'"),
        (lambda: q().bucket("sale.made", "week").agg("sum", "sale.total", "s").agg("count", "sale.buyer_id", "n").limit(100), "select date_trunc('week', made)::timestamp, sum(total), count(buyer_id) from sale group by 1"),
        (lambda: q().by("country.title").agg("avg", "sale.total", "a").having("a", "ge", 1).limit(10), "select title, avg(total) from sale join buyer b on buyer_id = b.id join country c on country_id = c.id group by 1 having avg(total) >= 1"),
        (lambda: q().by("sale.paid").limit(10), "select distinct paid from sale"),
    ],
)
def test_same_rows_as_sql(tables, duck, build, sql):
    _same(_rows(compile_plan(build().plan(), CATALOG, tables).df), duck.sql(sql).fetchall())


FILTERS = st.one_of(
    st.tuples(st.just("sale.total"), st.sampled_from(["eq", "ne", "lt", "le", "gt", "ge"]), st.integers(0, 4)),
    st.tuples(st.just("sale.buyer_id"), st.sampled_from(["in", "not_in"]), st.lists(st.integers(0, 9), min_size=1, max_size=3)),
    st.tuples(st.sampled_from(["sale.note", "sale.buyer_id"]), st.sampled_from(["is_null", "not_null"]), st.none()),
    st.tuples(st.just("sale.paid"), st.just("eq"), st.booleans()),
)
_OPS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "in": "in", "not_in": "not in"}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(FILTERS, max_size=3), st.sampled_from(["paid", "buyer_id", "note"]), st.sampled_from(["sum", "avg", "min", "max", "count", "count_distinct"]))
def test_plans_agree_with_sql(tables, duck, filters, key, fn):
    query = q().by(f"sale.{key}").agg(fn, "sale.total", "x").limit(1000)
    where = []
    for column, op, value in filters:
        query.where(column, op, value)
        c = column.split(".")[1]
        if op in ("is_null", "not_null"):
            where.append(f"{c} is {'not ' if op == 'not_null' else ''}null")
        else:
            where.append(f"{c} {_OPS[op]} {tuple(value) if isinstance(value, list) and len(value) > 1 else f'({value[0]})' if isinstance(value, list) else value}")
    call = f"count(distinct total)" if fn == "count_distinct" else f"{fn}(total)"
    _same(_rows(compile_plan(query.plan(), CATALOG, tables).df), duck.sql(f"select {key}, {call} from sale {'where ' + ' and '.join(where) if where else ''} group by 1").fetchall())


def test_order_puts_nulls_last_and_units_survive(tables):
    done = compile_plan(q().by("sale.buyer_id").agg("sum", "sale.total", "s").order("sale.buyer_id").limit(20).plan(), CATALOG, tables)
    keys = [r.buyer_id for r in done.df.collect()]
    assert keys[-1] is None and keys[:-1] == sorted(keys[:-1])
    assert done.units == {"s": "USD"} and done.plan_hash == done.plan.digest()


def test_metrics(tables, duck):
    _same(_rows(compile_metric("sales", CATALOG, tables).df), duck.sql("select title, sum(total) from sale join buyer b on buyer_id = b.id join country c on country_id = c.id group by 1").fetchall())
    _same(_rows(compile_metric("per_buyer", CATALOG, tables).df), duck.sql("select sum(total) / nullif(count(distinct buyer_id), 0) from sale").fetchall())
    assert str(measure("count:*").column) == "None" and measure("sum:sale.total:x").alias == "x"
    with pytest.raises(Rejected):
        compile_metric("nothing", CATALOG, tables)


def test_catalog_invariants(tmp_path):
    again = Catalog.from_dict(CATALOG.to_dict())
    assert again == CATALOG and again.digest() == CATALOG.digest()
    with pytest.raises(ValueError):
        Column("x", pii="high", values=("a",))
    with pytest.raises(ValueError):
        Catalog("c", (Table("a", (Column("x"),)), Table("a", ())))
    with pytest.raises(ValueError):
        Catalog("c", (Table("a", (Column("x"),)),), (JoinKey("a.x", "b.y"),))
    with pytest.raises(TypeError):
        Catalog.from_dict({**CATALOG.to_dict(), "password": 1})
    with pytest.raises(PermissionError):
        CATALOG.require_approved()
    part = CATALOG.slice(["sale", "buyer"])
    assert {t.name for t in part.tables} == {"sale", "buyer"} and len(part.join_keys) == 1 and [m.id for m in part.metrics] == ["per_buyer"]
    assert "mail" in CATALOG.summary() and "m1@x.y" not in CATALOG.summary()


def test_ways_through_the_graph():
    ways = graph.shortest_ways(CATALOG, {"item"})
    assert ways["country"][0] == 3 and len(ways["country"][1]) == 1 and "island" not in ways
    assert graph.only_way(CATALOG, "route", "country") is None
    assert [h.right.table for h in graph.only_way(CATALOG, "item", "buyer")] == ["sale", "buyer"]


def test_explained_in_words():
    plan = q().where("sale.total", "gt", 2.5).by("buyer.rank").bucket("sale.made", "month").agg("sum", "sale.total", "revenue").having("revenue", "ge", 10).top(3, "revenue").plan()
    text = explain(plan)
    for piece in ("sale.total is above 2.5", "the total of sale.total (revenue)", "sale.made by month", "revenue is at least 10", "revenue from the top", "at most 3 rows"):
        assert piece in text
    assert F is not None


def test_metrics_of_a_slice_are_those_over_its_tables():
    from quillgate.plans.catalog import Metric, metric_tables

    assert metric_tables(Metric("m", source="sale", aggregations=("count:*:n", "sum:item.amount:s"), group_by=("buyer.rank", "sale.made@month"))) == {"sale", "item", "buyer"}
    assert metric_tables(Metric("m", source="item", aggregations=("count:*",), joins=("item:sale:item.sale_id=sale.id",))) == {"item", "sale"}
    counted = replace(CATALOG, metrics=(Metric("m", source="sale", aggregations=("count:*:n",)),))
    assert [m.id for m in counted.slice(["sale"]).metrics] == ["m"] and not counted.slice(["buyer"]).metrics
