"""Registered queries of the engine's data operators: profiling, grounding, comparison, evidence, sources."""

from __future__ import annotations

import json
import sqlite3
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.ask.retrieve import relevant_tables
from quillgate.demo_catalog import CATALOG, sources
from quillgate.evidence import ledger
from quillgate.operators import compare, ground, profile
from quillgate.plans.catalog import Catalog, Column, Ref, Table
from quillgate.queries_relational import governed
from quillgate.sources.readers import typed_copy
from quillgate.sources.sqlite import import_file
from quillgate.sqlguard.tree import parse
from quillgate.workspace import fresh_dir, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query("select p_name as value, count(*) as n from part where lower(p_name) like '%red%wid%' group by 1 order by length(p_name), p_name limit 50")
def value_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.lookup(governed(spark, sf_dir).filtered, Ref("part", "p_name"), "Red wid")


@_query("select distinct n_name as value from nation where regexp_replace(lower(n_name), '[^0-9a-z]', '', 'g') = (select regexp_replace(lower(max(n_name)), '[^0-9a-z]', '', 'g') from nation)")
def ground_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = governed(spark, sf_dir)
    spelled = session.filtered("nation").agg(F.max("n_name")).first()[0].lower().replace(" ", "-")
    return ground.stored_like(session.filtered, Ref("nation", "n_name"), spelled)


@_query("select 'region.r_name' as column_name, r_name as value from region where r_name = 'AFRICA'")
def stored_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.stored_elsewhere(governed(spark, sf_dir).filtered, CATALOG, Ref("nation", "n_name"), "africa")


@_query(
    """with v as (select 'l_returnflag' as column_name, l_returnflag as value from lineitem union all select 'l_linestatus', l_linestatus from lineitem),
    c as (select column_name, value, count(*) as n from v where value is not null group by 1, 2)
    select column_name, list(value order by value) as stored from c group by 1
    having count(*) <= 25 and sum(n) >= 2 * count(*) and min(length(value)) >= 1 and max(length(value)) <= 40"""
)
def value_list_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_lists(read_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@_query(
    "\nunion all ".join(
        f"select '{c}' as column_name, count(*) as n_rows, count({c}) as n_values, count(distinct {c}) as n_distinct from track"
        for c in ("trackid", "name", "albumid", "mediatypeid", "genreid", "composer", "milliseconds", "bytes", "unitprice")
    )
)
def profile_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_statistics(read_table(spark, sf_dir, "track"))


@_query(
    "\nunion all ".join(
        f"select '{a}.{c}' as many_side, '{b}.{c}' as one_side where (select count(*) from {a} x where {c} is not null and not exists (select 1 from {b} y where y.{c} = x.{c})) = 0 and (select count(*) = count(distinct {c}) from {b})"
        for a, c, b in (("invoice", "customerid", "chinook_customer"), ("invoiceline", "invoiceid", "invoice"), ("invoiceline", "trackid", "track"), ("track", "genreid", "genre"))
    )
)
def discover_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys found in the data of the invoice tables when none is declared."""
    from dataclasses import replace

    names = ["invoice", "invoiceline", "track", "genre", "chinook_customer"]
    bare = replace(CATALOG.slice(names), join_keys=())
    found = profile.discover_joins({n: read_table(spark, sf_dir, n) for n in names}, bare)
    return spark.createDataFrame([(k.many, k.one) for k in found], "many_side string, one_side string")


_DTYPE = """case when data_type like '%[]' then 'str' when data_type in ('VARCHAR', 'STRING') then 'str' when data_type like '%INT%' then 'int' when data_type like 'TIMESTAMP%' or data_type = 'DATE' then 'datetime' when data_type = 'BOOLEAN' then 'bool' else 'float' end"""
_KNOWN = ", ".join(f"('{t.name}', '{c.name}', '{c.dtype}')" for t in CATALOG.tables for c in t.columns)


@_query(
    f"""with known(table_name, column_name, dtype) as (values {_KNOWN}, ('gone', 'x', 'str'), ('genre', 'color', 'str'), ('region', 'r_name', 'int')),
    stored as (select table_name, column_name, {_DTYPE} as dtype from information_schema.columns where table_name in (select table_name from known) or table_name = 'part'),
    kept as (select * from known where table_name <> 'part' and not (table_name = 'region' and column_name = 'r_name' and dtype = 'str') and not (table_name = 'nation' and column_name = 'n_name'))
    select 'breaking' as severity, table_name, null as column_name, 'table is missing' as detail from kept where table_name not in (select table_name from stored) group by table_name
    union all select 'new', table_name, null, 'table is not in the catalog' from stored where table_name = 'part' group by table_name
    union all select 'breaking', k.table_name, k.column_name, 'column is missing' from kept k where k.table_name in (select table_name from stored) and not exists (select 1 from stored s where s.table_name = k.table_name and s.column_name = k.column_name)
    union all select 'breaking', k.table_name, k.column_name, 'type changed from ' || k.dtype || ' to ' || s.dtype from kept k join stored s using (table_name, column_name) where k.dtype <> s.dtype and not (k.dtype = 'json' and s.dtype = 'str')
    union all select 'new', s.table_name, s.column_name, 'column is not in the catalog' from stored s where s.table_name <> 'part' and not exists (select 1 from kept k where s.table_name = k.table_name and s.column_name = k.column_name)"""
)
def catalog_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored tables against a catalog that has lost a table and a column, has two of its own, and is wrong about a type."""

    def changed(t: Table) -> Table:
        columns = tuple(Column(c.name, "int") if (t.name, c.name) == ("region", "r_name") else c for c in t.columns if (t.name, c.name) != ("nation", "n_name"))
        return Table(t.name, (*columns, Column("color")) if t.name == "genre" else columns)

    old = Catalog("old", (*(changed(t) for t in CATALOG.tables if t.name != "part"), Table("gone", (Column("x"),))))
    return profile.catalog_drift(spark, old, {t.name: read_table(spark, sf_dir, t.name).schema for t in CATALOG.tables})


@_query(f"select table_name, column_name, {_DTYPE} as dtype from information_schema.columns where table_name in ('genre', 'region', 'orders', 'track', 'audit_record', 'principal_profile')")
def schema_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("genre", "region", "orders", "track", "audit_record", "principal_profile")
    drafted = profile.draft_catalog("draft", {t: read_table(spark, sf_dir, t).schema for t in names})
    return spark.createDataFrame([(t.name, c.name, c.dtype) for t in drafted.tables for c in t.columns], "table_name string, column_name string, dtype string")


@_query("select count(*) as n_rows, true as order_free, true as sees_one_cell, true as sees_one_row from lineitem")
def answer_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That the fingerprint of a large result doesn't depend on the order of rows or columns, but on every cell and row."""
    rows, small = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "customer")
    other = rows.select(*[f"`{c}`" for c in reversed(rows.columns)]).repartition(7, "l_partkey")
    one = F.col("c_custkey") == small.agg(F.min("c_custkey")).first()[0]
    cell = small.withColumn("c_acctbal", F.when(one, F.col("c_acctbal") + 0.5).otherwise(F.col("c_acctbal")))
    a, b, c, d, e = (compare.fingerprint_frame(x).first() for x in (rows, other, small, cell, small.unionAll(small.filter(one))))
    same = [x.fingerprint == y.fingerprint for x, y in ((a, b), (c, d), (c, e))]
    return spark.createDataFrame([(a.n_rows, same[0], not same[1], not same[2])], "n_rows bigint, order_free boolean, sees_one_cell boolean, sees_one_row boolean")


@_query("select 'left' as side, l_orderkey, l_linenumber from lineitem where l_quantity > 49 and l_returnflag = 'R'")
def result_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select("l_orderkey", "l_linenumber", "l_returnflag")
    return compare.frames_differ(rows, rows.filter("l_returnflag <> 'R'")).select("side", "l_orderkey", "l_linenumber")


@_query("select row_number() over (order by n_nationkey) - 1 as seq, n_nationkey <> 6 as holds from nation")
def ledger_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of the nations, one of whose lines was changed afterwards."""
    names = [r.n_name for r in read_table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    with tempfile.TemporaryDirectory() as folder:  # read by this process only
        for name in names:
            ledger.append(f"{folder}/ledger.jsonl", {"nation": name, "status": "ok"})
        lines = [json.loads(x) for x in Path(folder, "ledger.jsonl").read_text().splitlines()]
    lines[6]["body"] = lines[6]["body"].replace(names[6], "ATLANTIS")
    path = fresh_dir(spark, "ledger")
    spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "i int, value string").coalesce(1).orderBy("i").select("value").write.text(path)
    return ledger.verify_frame(spark, path)


@_query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def typed_text_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns get their types back from their values."""
    rows = read_table(spark, sf_dir, "nation")
    return typed_copy(rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns]))


@_query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def sqlite_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table kept in a SQLite file and taken from there; the file lies in the shared folder."""
    folder = fresh_dir(spark, "sqlite").removeprefix("file://").removeprefix("file:")
    Path(folder).mkdir(parents=True)
    with sqlite3.connect(f"{folder}/nation.db") as db:
        db.execute("create table NATION (N_NATIONKEY integer primary key, N_NAME text, N_REGIONKEY integer)")
        db.executemany("insert into NATION values (?, ?, ?)", [tuple(r) for r in read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()])
    import_file(spark, f"{folder}/nation.db", folder)
    return spark.read.parquet(f"{folder}/nation.parquet")


@_query(f"select table_name, table_name as found from information_schema.tables where table_name in ({', '.join(repr(t.name) for t in CATALOG.tables)})")
def tables_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a question about each table, the table it is found to be about."""
    rows = [(t.name, relevant_tables(f"list all {t.name.replace('_', ' ')}", CATALOG)[0]) for t in CATALOG.tables]
    return spark.createDataFrame(rows, "table_name string, found string")


_ASKED = ("FRANCE", "france", "united states", "Atlantis", "saudi-arabia")


@_query(
    "\nunion all ".join(
        f"""select '{v}' as asked, case when exists (select 1 from nation where n_name = '{v}') then 'stored' when exists (select 1 from nation where regexp_replace(lower(n_name), '[^0-9a-z]', '', 'g') = regexp_replace(lower('{v}'), '[^0-9a-z]', '', 'g')) then 'respelled' else 'nowhere' end as verdict,
        (select n_name from nation where n_name <> '{v}' and regexp_replace(lower(n_name), '[^0-9a-z]', '', 'g') = regexp_replace(lower('{v}'), '[^0-9a-z]', '', 'g')) as spelling"""
        for v in _ASKED
    )
)
def literals_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants of queries that are stored as they are, in another spelling, or nowhere."""
    session, rows = governed(spark, sf_dir), []
    for v in _ASKED:
        found = ground.ground(parse(spark, f"select n_regionkey from nation where n_name = '{v}'").root, CATALOG, session.filtered, {"nation"})
        rows.append((v, "respelled" if v in found.replacements else "nowhere" if v in found.unmatched else "stored", found.replacements.get(v)))
    return spark.createDataFrame(rows, "asked string, verdict string, spelling string")


@_query("select p_name as value from (select p_name from part where lower(p_name) like '%red%' group by 1 order by length(p_name), p_name limit 3)")
def similar_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ground.similar(governed(spark, sf_dir).filtered, Ref("part", "p_name"), "red")
    return spark.createDataFrame([(v,) for v in found], "value string")


__all__ = ["QUERIES", "SQL", "sources"]
