import datetime as dt
import json
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgate.evidence import bundle, ledger
from quillgate.operators import compare, ground, profile
from quillgate.plans.catalog import Catalog, Column, Ref, Table
from quillgate.sources.readers import register_reader, source, typed_copy
from quillgate.sources.sinks import JsonLines, append_rows
from quillgate.sqlguard.tree import parse


# --- profiling ---------------------------------------------------------------------------------------


def test_value_lists(spark):
    rows = [("granite", f"quarry {i}", "y" * 60, f"s{i}@pit.example") for i in range(4)] + [("slate", "quarry 4", "y" * 60, None), ("slate", "quarry 5", "y" * 60, None)]
    df = spark.createDataFrame(rows, "stone string, pit string, report string, contact string")
    assert {r.column_name: r.stored for r in profile.value_lists(df, ["stone", "pit", "report"]).collect()} == {"stone": ["granite", "slate"]}
    assert profile.value_lists(df, []).count() == 0
    many = spark.range(2000).select((F.col("id") % 26).cast("string").alias("a"), (F.col("id") % 25).cast("string").alias("b"))
    assert [r.column_name for r in profile.value_lists(many, ["a", "b"]).collect()] == ["b"]


def test_column_statistics(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    got = {r.column_name: (r.n_rows, r.n_values, r.n_distinct) for r in profile.column_statistics(df).collect()}
    assert got == {"k": (3, 3, 2), "v": (3, 2, 2)}
    assert {r.column_name: (r.n_rows, r.n_values, r.n_distinct) for r in profile.column_statistics(df.limit(0)).collect()} == {"k": (0, 0, 0), "v": (0, 0, 0)}


@pytest.mark.parametrize(
    "column, table, key, agrees",
    [
        ("vessel_id", "vessels", "id", True), ("vess_id", "vessels", "id", True), ("vesselid", "vessels", "vesselid", True), ("harbour", "harbours", "code", True), ("hrbr_code", "harbours", "code", True),
        ("v_harbourkey", "harbour", "h_harbourkey", True), ("ferry_no", "ferries", "no", True), ("pilot_licence", "harbour_pilots", "licence", True),
        ("id", "vessels", "id", False), ("name", "piers", "name", False), ("pier_id", "vessels", "id", False), ("vid", "v_logs", "id", False), ("ve_id", "vessels", "id", False),
    ],
)
def test_names_agree(column, table, key, agrees):
    assert profile.names_agree(column, table, key) is agrees


def test_discover_joins(spark):
    catalog = Catalog(
        "port",
        (
            Table("vessels", (Column("id", "int"), Column("radio", pii="high"))),
            Table("calls", (Column("call_no", "int"), Column("vessel_id", "int"), Column("berth_id", "int"), Column("radio", pii="high"))),
            Table("tows", (Column("tow_no", "int"), Column("call_no", "int"))),
        ),
    )
    frames = {
        "vessels": spark.createDataFrame([(i, f"r{i}") for i in range(25)], "id int, radio string"),
        "calls": spark.createDataFrame([(i, i % 6, 70 + i, f"r{i}") for i in range(30)], "call_no int, vessel_id int, berth_id int, radio string"),
        # some tows are of calls that aren't there
        "tows": spark.createDataFrame([(i, 27 + i) for i in range(8)], "tow_no int, call_no int"),
    }
    assert profile.discover_joins(frames, catalog) == [profile.FoundKey("calls.vessel_id", "vessels.id")]


def test_draft_and_drift(spark):
    schema = T.StructType.fromDDL("id bigint, email string, price decimal(9,2), at date, extra array<int>")
    drafted = profile.draft_catalog("d", {"t": schema}, values={"t.extra": ["a"], "t.email": ["x"]}, tags={"t.price": ["PII"]})
    got = {c.name: (c.dtype, c.pii, c.values) for c in drafted.tables[0].columns}
    assert got == {"id": ("int", "none", ()), "email": ("str", "high", ()), "price": ("float", "high", ()), "at": ("datetime", "none", ()), "extra": ("str", "none", ("a",))}
    assert profile.catalog_drift(spark, drafted, {"t": schema}).count() == 0
    changed = T.StructType.fromDDL("id string, email string, price double, new int")
    rows = {(r.severity, r.column_name) for r in profile.catalog_drift(spark, drafted, {"t": changed}).collect()}
    assert rows == {("breaking", "id"), ("breaking", "at"), ("breaking", "extra"), ("new", "new")}


# --- grounding ---------------------------------------------------------------------------------------

PLACES = Catalog("p", (Table("place", (Column("city"), Column("land"), Column("mail", pii="high"))),))


def _tables(spark):
    df = spark.createDataFrame([("New York", "USA", "a"), ("new-york", "USA", "b"), ("Saint Lo", "France", "c"), ("York", "U.K.", "d"), ("New York State", None, "e")], "city string, land string, mail string")
    return lambda _: df


def test_lookups(spark):
    t, ref = _tables(spark), Ref("place", "city")
    assert [(r.value, r.n) for r in ground.lookup(t, ref, "new york").collect()] == [("New York", 1), ("new-york", 1), ("New York State", 1)]
    assert [r.value for r in ground.stored_like(t, ref, "saint-lo").collect()] == ["Saint Lo"]
    assert ground.similar(t, ref, "York") == ["York", "New York", "new-york"]
    assert [(r.column_name, r.value) for r in ground.stored_elsewhere(t, PLACES, ref, "uk").collect()] == [("place.land", "U.K.")]


def test_constants_and_grounding(spark):
    text = "select city from place where lower(city) = 'saint lo' and land in ('usa', 'Mars') and not land = 'nowhere' and city = 'newyork' and city = 'SAINT-LO'"
    root = parse(spark, text).root
    got = {(c.column, c.value, c.negated, c.folded) for c in ground.constants(root)}
    assert got == {("city", "saint lo", False, True), ("land", "usa", False, False), ("land", "Mars", False, False), ("land", "nowhere", True, False), ("city", "newyork", False, False), ("city", "SAINT-LO", False, False)}
    found = ground.ground(root, PLACES, _tables(spark), {"place"})
    assert found.replacements.get("usa") == "USA" and "newyork" not in found.replacements and found.unmatched == ["Mars"]


# --- comparing -----------------------------------------------------------------------------------------


def test_same_rows():
    a = [(1, "x", 2.00001), (2, "y", None)]
    assert compare.same_rows(a, [(None, 2, "y"), (2.0, 1, "x")]) and not compare.same_rows(a, a[:1])
    assert compare.same_rows([(dt.date(2022, 1, 1), 3)], [("2022", 3)]) and not compare.same_rows([(dt.date(2022, 2, 1), 3)], [("2022", 3)])
    assert not compare.same_rows([(1,), (2,)], [(2,), (1,)], ordered=True) and compare.same_rows([], [])
    assert not compare.same_rows([(1,), (1,), (2,)], [(1,), (2,), (2,)])
    assert compare.contains_columns([(1, "a", 9), (2, "b", 9)], [("b", 2), ("a", 1)]) and not compare.contains_columns([(1, "a")], [("b",)])


def test_ties_leaks_and_fingerprints():
    whole = [("oak", 9), ("elm", 4), ("ash", 4), ("yew", 4)]
    assert compare.valid_tie([("oak", 9), ("yew", 4)], whole[:2], whole) and compare.valid_tie([(4, "ash"), (9, "oak")], whole[:2], whole)
    assert not compare.valid_tie([("oak", 9), ("fir", 4)], whole[:2], whole) and not compare.valid_tie([("elm", 4), ("yew", 4)], whole[:2], whole)
    assert not compare.valid_tie([("yew", 4), ("yew", 4)], whole[:2], whole) and not compare.valid_tie([("oak", 9)], whole[:1], whole[:2]) and not compare.valid_tie(whole, whole, whole)
    assert compare.leaks(["Email", "x", "y"], [("q", "me@home.org", 1)], frozenset({"email"})) == ["Email", "x"]
    a = compare.fingerprint([(1, "x"), (2, "y")])
    assert a == compare.fingerprint([("y", 2.00001), ("x", 1)]) != compare.fingerprint([(1, "y"), (2, "x")]) and len(a) == 16
    assert compare.fingerprint([(1,)], ["a"]) != compare.fingerprint([(1,)], ["b"])


def test_fingerprint_and_difference_of_frames(spark):
    df = spark.createDataFrame([(1, "x", 1.00001), (2, None, None), (2, None, None)], "a int, b string, c double")
    print_of = lambda d: compare.fingerprint_frame(d).first()
    assert print_of(df) == print_of(df.select("c", "b", "a").orderBy(F.desc("a")))
    assert print_of(df) != print_of(df.distinct()) and print_of(df.limit(0)).n_rows == 0
    assert compare.frames_differ(df, df.withColumn("c", F.col("c") + 1e-9)).count() == 0
    assert [(r.side, r.a) for r in compare.frames_differ(df, df.distinct()).collect()] == [("left", 2)]
    assert sorted((r.side, r.a) for r in compare.frames_differ(df.limit(1), df.unionAll(df)).collect()) == [("right", 1), ("right", 2), ("right", 2), ("right", 2), ("right", 2)]


# --- evidence ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("key", [None, b"secret"])
def test_ledger_chain(tmp_path, key):
    path = tmp_path / "l.jsonl"
    threads = [threading.Thread(target=lambda i=i: [ledger.append(path, {"n": i, "text": "é" * 3000}, key) for _ in range(5)]) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert ledger.verify(path, key) == (True, 20) and ledger.verify(tmp_path / "none", key) == (True, 0)
    assert not ledger.verify(path, b"other")[0]
    lines = path.read_text().splitlines()
    for bad in (lines[:7] + lines[8:], lines[:7] + [lines[7].replace("text", "tent")] + lines[8:], [*lines[:3], "broken"]):
        path.write_text("\n".join(bad) + "\n")
        ok, at = ledger.verify(path, key)
        assert not ok and at in (3, 7)


def test_ledger_frame_finds_the_same_line(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    for i in range(9):
        ledger.append(path, {"n": i})
    rows = [json.loads(x) for x in path.read_text().splitlines()]
    rows[4]["body"] = '{"n":400}'
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")
    assert [r.seq for r in ledger.verify_frame(spark, str(path)).filter("not holds").collect()] == [4]


def test_reviews_and_evidence():
    signed = bundle.signed_review("ann", {"query": "q"}, b"k", now=1000)
    assert bundle.open_review(signed, "ann", b"k", now=1500) == {"query": "q"}
    for change, who, now in (({"review": {"query": "other"}}, "ann", 1500), ({}, "bob", 1500), ({}, "ann", 2000), ({"expires": 9e9}, "ann", 1500)):
        with pytest.raises(PermissionError):
            bundle.open_review({**signed, **change}, who, b"k", now=now)
    e = bundle.Evidence("q?", "ann", "c", "h", "ok", ("parsed",)).signed(b"k")
    assert bundle.verify(e, b"k") and not bundle.verify({**e, "status": "refused"}, b"k") and not bundle.verify(e, b"x")


# --- sources -------------------------------------------------------------------------------------------


def test_typed_copy(spark):
    df = spark.createDataFrame([("1", "1.5", "007", "x", " ", "nan"), ("-2", "3", "123", None, "", "1")], "a string, b string, c string, d string, e string, f string")
    got = typed_copy(df)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "double", "string", "string", "string", "string"]
    assert got.first().a == 1 and typed_copy(got.limit(0)).count() == 0


def test_readers_and_sinks(spark, tmp_path):
    df = spark.range(3).select("id", F.concat(F.lit("n"), "id").alias("name"))
    for kind in ("parquet", "orc", "json"):
        append_rows(df, str(tmp_path / kind), kind)
        assert source({"format": kind, "path": str(tmp_path / kind)})(spark).count() == 3
    df.coalesce(1).write.csv(str(tmp_path / "csv"), header=True)
    assert typed_copy(source({"format": "csv", "path": str(tmp_path / "csv")})(spark)).schema["id"].dataType == T.LongType()
    register_reader("mine", lambda s, n: s.range(n))
    assert source({"format": "mine", "n": 5})(spark).count() == 5
    with pytest.raises(ValueError):
        source({"format": "nothing"})
    sink = JsonLines(tmp_path / "log.jsonl")
    sink({"a": 1})
    sink({"b": dt.date(2024, 1, 1)})
    assert len((tmp_path / "log.jsonl").read_text().splitlines()) == 2
    append_rows(df.withColumn("part", F.col("id") % 2), str(tmp_path / "by"), by=("part",))
    assert spark.read.parquet(str(tmp_path / "by")).filter("part = 0").count() == 2
    assert replace(PLACES, name="x").name == "x"
