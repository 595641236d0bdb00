"""A catalog over the test tables."""

from __future__ import annotations

from quillgate.plans.catalog import Approval, Catalog, Column, JoinKey, Metric, Synonym, Table
from quillgate.plans.compile import register_builtin


def _table(name: str, columns: str, **options: object) -> Table:
    """``columns``: ``name:type`` with ``!`` (high PII), ``~`` (low), ``[unit]`` or ``->label`` after it."""
    out = []
    for spec in columns.split():
        spec, _, label = spec.partition("->")
        spec, _, unit = spec.rstrip("]").partition("[")
        pii = {"!": "high", "~": "low"}.get(spec[-1], "none")
        column, dtype = spec.rstrip("!~").split(":")
        out.append(Column(column, dtype, pii, unit=unit or None, label_for=label or None))
    return Table(name, tuple(out), **options)


CATALOG = Catalog(
    name="demo",
    tables=(
        _table("region", "r_regionkey:int r_name:str", display_column="region.r_name"),
        _table("nation", "n_nationkey:int n_name:str n_regionkey:int->region.r_name", display_column="nation.n_name"),
        _table("customer", "c_custkey:int c_name:str! c_nationkey:int->nation.n_name c_acctbal:float~[USD] c_mktsegment:str"),
        _table("supplier", "s_suppkey:int s_name:str! s_nationkey:int->nation.n_name s_acctbal:float[USD]"),
        _table("part", "p_partkey:int p_name:str p_brand:str p_type:str p_size:int p_retailprice:float[USD]"),
        _table("orders", "o_orderkey:int o_custkey:int o_orderstatus:str o_totalprice:float[USD] o_orderdate:datetime o_orderpriority:str"),
        _table(
            "lineitem",
            "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_quantity:float l_extendedprice:float[USD] l_discount:float l_tax:float "
            "l_returnflag:str l_linestatus:str l_shipdate:datetime",
        ),
        _table("events", "event_id:int ts:datetime user_id:int event_type:str value:float props:json"),
        _table("genre", "genreid:int name:str"),
        _table("track", "trackid:int name:str albumid:int mediatypeid:int genreid:int->genre.name composer:str milliseconds:int bytes:int unitprice:float[USD]"),
        _table("invoice", "invoiceid:int customerid:int invoicedate:datetime billingaddress:str! billingcity:str billingstate:str billingcountry:str billingpostalcode:str! total:float[USD]"),
        _table("invoiceline", "invoicelineid:int invoiceid:int trackid:int unitprice:float[USD] quantity:int"),
        _table("chinook_customer", "customerid:int firstname:str lastname:str company:str address:str! city:str state:str country:str postalcode:str! phone:str! fax:str! email:str! supportrepid:int"),
    ),
    join_keys=tuple(
        JoinKey(*k.split(">"))
        for k in (
            "nation.n_regionkey>region.r_regionkey",
            "customer.c_nationkey>nation.n_nationkey",
            "supplier.s_nationkey>nation.n_nationkey",
            "orders.o_custkey>customer.c_custkey",
            "lineitem.l_orderkey>orders.o_orderkey",
            "lineitem.l_partkey>part.p_partkey",
            "lineitem.l_suppkey>supplier.s_suppkey",
            "track.genreid>genre.genreid",
            "invoiceline.invoiceid>invoice.invoiceid",
            "invoiceline.trackid>track.trackid",
            "invoice.customerid>chinook_customer.customerid",
        )
    ),
    synonyms=(Synonym("sales", "orders.o_totalprice"), Synonym("buyer", "customer.c_custkey")),
    metrics=(
        Metric("order_count", source="orders", aggregations=("count:*:order_count",), description="number of orders"),
        Metric("revenue_by_nation", source="orders", aggregations=("sum:orders.o_totalprice:revenue",), group_by=("nation.n_name",), description="order value by nation"),
        Metric("monthly_orders", source="orders", aggregations=("count:*:order_count",), group_by=("orders.o_orderdate@month",), description="orders a month"),
        Metric(
            "revenue_per_buyer", kind="ratio", source="orders", numerator="sum:orders.o_totalprice:revenue", denominator="count_distinct:orders.o_custkey:buyers",
            group_by=("orders.o_orderpriority",), description="order value per buying customer",
        ),
        Metric("net_revenue", kind="builtin", tables=("lineitem",), description="price less discount"),
    ),
    approval=Approval("1", "data owner", "2024-01-01"),
)


def sources(sf_dir: str) -> dict[str, str]:
    return {t.name: f"{sf_dir}/{t.name}.parquet" for t in CATALOG.tables}


@lambda build: register_builtin("net_revenue", build)
def _net_revenue(tables):
    from pyspark.sql import functions as F

    return tables("lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_revenue"))
