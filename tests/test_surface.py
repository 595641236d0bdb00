"""The parts a user meets from outside: command line, imports, evaluation, principals."""

import base64
import hashlib
import hmac
import json
import sqlite3

import pytest

from quillgate.__main__ import main
from quillgate.ask.http import Service
from quillgate.ask.pipeline import Asker, Prompted, Scripted
from quillgate.evals.run import adjudicated, cases_of, evaluate, report, without_limit
from quillgate.operators.ground import respelled
from quillgate.plans.compile import join_spec, metric_plan
from quillgate.plans.catalog import Metric
from quillgate.principals import Counters, Registry, development_principal, forwarded_principal, signed_principal
from quillgate.sources.sqlite import base_tables, import_file
from quillgate.sqlguard.tree import parse
from tests.test_guard import _session, refused
from tests.test_plans import CATALOG

REGISTRY = Registry.from_json(json.dumps({"tenant": "t", "tokens": {"secret": "ann"}, "principals": {"ann": {"allowed_tables": ["sale"]}}}))


def _client(catalog):
    return Scripted({"How many nations are there?": [{"sql": "select count(*) as n from nation"}]})


def _sqlite(path):
    with sqlite3.connect(path) as db:
        db.execute("create table Nation (N_nationkey integer primary key, n_name text, area real, code text)")
        db.executemany("insert into Nation values (?, ?, ?, ?)", [(i, f"n'{i}", i / 2, f"{i:03d}") for i in range(1, 40)])
        db.execute('create table "Odd ""one" (a text)')
        db.execute("create view v as select 1 as one")
    return str(path)


def test_sqlite_import(spark, tmp_path):
    path = _sqlite(tmp_path / "x.db")
    assert base_tables(path) == {"Nation": ["N_nationkey", "n_name", "area", "code"], 'Odd "one': ["a"]}
    with sqlite3.connect(path) as db:
        db.execute('drop table "Odd ""one"')
    assert import_file(spark, path, str(tmp_path / "out")) == {"nation": 39}
    got = spark.read.parquet(str(tmp_path / "out" / "nation.parquet"))
    assert dict(got.dtypes) == {"n_nationkey": "bigint", "n_name": "string", "area": "double", "code": "string"}
    assert got.agg({"n_nationkey": "sum"}).first()[0] == 780 and got.filter("code = '007' and n_name = \"n'7\"").count() == 1
    with pytest.raises(ValueError):
        import_file(spark, path, str(tmp_path / "out"), sha256="0" * 64)


def test_command_line_asks_imports_and_evaluates(spark, tmp_path, capsys):
    assert main(["import", _sqlite(tmp_path / "x.db"), "--data", str(tmp_path / "t")]) == 0 and "nation 39" in capsys.readouterr().out
    assert main(["draft", "--data", str(tmp_path / "t"), "--joins"]) == 0
    drafted = json.loads(capsys.readouterr().out)
    (tmp_path / "c.json").write_text(json.dumps(drafted))
    base = ["--data", str(tmp_path / "t"), "--catalog", str(tmp_path / "c.json"), "--client", "tests.test_surface:_client"]
    assert main(["ask", "How many nations are there?", *base]) == 0 and "39" in capsys.readouterr().out
    assert main(["ask", "How many nations are there?", "--confirm", *base]) == 0 and "select count" in capsys.readouterr().out
    assert main(["ask", "Something nobody knows", *base]) == 2
    cases = [("1", "How many nations are there?", "answer", "select count(*) as n from nation", False, ["scalar"]), ("2", "Who?", "abstain", None, None, None), ("3", " ", "answer", None, None, None)]
    spark.createDataFrame(cases, "id string, question string, expect string, reference_sql string, ordered boolean, tags array<string>").write.parquet(str(tmp_path / "cases"))
    capsys.readouterr()
    assert main(["eval", str(tmp_path / "cases"), "--report", str(tmp_path / "r.json"), *base]) == 0
    told = json.loads((tmp_path / "r.json").read_text())
    assert told["summary"]["counts"]["correct"] == 2 and [c["verdict"] for c in told["cases"]] == ["correct", "correct"]
    capsys.readouterr()
    assert main(["scorecard", str(tmp_path / "r.json")]) == 0 and json.loads(capsys.readouterr().out)[0]["right"] == 2


def test_evaluation_takes_other_cuts_at_a_tie(spark, tmp_path):
    session = _session(spark)
    text = "select buyer_id, count(*) as n from sale group by buyer_id order by n desc limit 1"
    whole = without_limit(session, text)
    assert len(whole) > 1 and without_limit(session, "select id from sale") is None
    other = next(r for r in whole if r[1] == whole[0][1] and r != tuple(session.sql(text).first())) if sum(r[1] == whole[0][1] for r in whole) > 1 else None
    cases = cases_of(spark.createDataFrame([("a", "best buyer?", "answer", text)], "id string, question string, expect string, reference_sql string"))
    if other:
        asker = Asker(session, Scripted({"best buyer?": [{"sql": f"select buyer_id, count(*) as n from sale where buyer_id = {other[0]} group by buyer_id"}]}), b"k", readings=1)
        judged = evaluate(cases, asker, session)
        assert [j.verdict for j in judged] == ["correct"]
        assert report(judged, tmp_path / "r.json")["summary"]["n"] == 1 and (tmp_path / "r.json").exists()


def test_adjudication():
    told = {"cases": [{"id": i, "verdict": v} for i, v in (("a", "wrong"), ("b", "wrong"), ("c", "correct"), ("d", "wrong"))]}
    out = adjudicated(told, [{"a": "right", "b": "right"}, {"a": "right", "b": "wrong"}])
    assert (out["judged_wrong"], out["really_wrong"], out["raters_differ"], out["cases"]) == (3, 2, 1, ["b", "d"])


def _token(claims, key=b"k", alg="HS256"):
    part = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    text = f"{part(json.dumps({'alg': alg}).encode())}.{part(json.dumps(claims).encode())}"
    return f"{text}.{part(hmac.new(key, text.encode(), hashlib.sha256).digest())}"


def test_principals_by_token_proxy_and_machine():
    good = {"sub": "ann", "exp": 1000, "aud": ["q"], "iss": "i"}
    assert signed_principal(_token(good), b"k", REGISTRY, audience="q", issuer="i", now=900).id == "ann"
    for claims, key, alg, now in ((good, b"x", "HS256", 900), (good, b"k", "none", 900), (good, b"k", "HS256", 2000), ({**good, "nbf": 990}, b"k", "HS256", 900), ({**good, "aud": "z"}, b"k", "HS256", 900), ({**good, "iss": "j"}, b"k", "HS256", 900), ({**good, "sub": "bob"}, b"k", "HS256", 900), ({"sub": "ann", "aud": "q", "iss": "i"}, b"k", "HS256", 900)):
        with pytest.raises(PermissionError):
            signed_principal(_token(claims, key, alg), b"k", REGISTRY, audience="q", issuer="i", now=now)
    for broken in ("", "a.b", "a.b.c", "é.é.é"):
        with pytest.raises(PermissionError):
            signed_principal(broken, b"k", REGISTRY)
    assert forwarded_principal({"x-principal": "ann", "X-Proxy-Secret": "s"}, REGISTRY, secret="s").id == "ann"
    for headers, secret in (({"X-Principal": "ann"}, "s"), ({"X-Principal": "ann", "X-Proxy-Secret": ""}, ""), ({"X-Principal": "bob", "X-Proxy-Secret": "s"}, "s")):
        with pytest.raises(PermissionError):
            forwarded_principal(headers, REGISTRY, secret=secret)
    assert development_principal(REGISTRY, "ann", host="localhost").id == "ann"
    with pytest.raises(PermissionError):
        development_principal(REGISTRY, "ann", host="0.0.0.0")


def test_http_bodies_and_counters(spark):
    service = Service(REGISTRY, lambda p: None)
    for body in (b'["question"]', b'"question"', b"1", b"null", b"{}", b"nothing"):
        assert service.handle("POST", "/ask", "secret", body)[0] == 400
    assert service.handle("GET", "/", "", b"")[0] == 200
    counters = Counters()
    for s in (0.05, 0.1, 0.3, 100.0):
        counters.add("ok", "", s)
    text = counters.text()
    assert 'le="0.1"} 2' in text and 'le="0.5"} 3' in text and 'le="30"} 3' in text and "ask_seconds_count{status=\"ok\"} 4" in text and "100.45" in text


def test_constants_are_respelled_where_they_are_compared(spark):
    text = "select 'p-1' as shown /* 'p-1' */ from visit where page = 'p-1' and lower(page) = 'p-1'"
    assert respelled(text, {"p-1": "it's"}, lambda t: parse(spark, t).root) == "select 'p-1' as shown /* 'p-1' */ from visit where page = 'it\\'s' and lower(page) = 'p-1'"


def test_pipeline_gates_and_prompted_client(spark):
    session = _session(spark)
    told = []

    def complete(text, schema):
        told.append((text, schema))
        return json.dumps({"sql": "select count(*) as n from sale"})

    out = Asker(session, Prompted(complete, CATALOG), b"k", readings=1).ask("How many sales are there?")
    assert out.status == "ok" and "How many sales" in told[0][0] and "oneOf" in told[0][1]
    out = Asker(session, Scripted({"q?": [{"sql": "select count(*) as n from visit where page = 'nowhere at all'"}]}), b"k", readings=1).ask("q?")
    assert (out.status, out.code) == ("refused", "no_stored_value")
    out = Asker(session, Scripted({"visits by page": [{"sql": "select count(*) as n from sale"}]}), b"k", readings=1, least_confidence=0.5).ask("visits by page")
    assert (out.status, out.code) == ("refused", "low_link_confidence")


def test_gathering_needs_a_group_and_metric_joins(spark):
    session = _session(spark)
    for text in ("select collect_list(id) as x from sale", "select array_agg(id) as x from sale", "select id, collect_set(id) over (partition by paid) as x from sale"):
        assert "sql.function" in refused(session, text)
    assert refused(session, "select paid, collect_set(buyer_id) as x from sale group by paid") == set()
    m = Metric("m", source="item", aggregations=("count:*:n",), group_by=("buyer.rank",), joins=("item:sale:item.sale_id=sale.id",))
    assert [j.table for j in metric_plan(m, 5).joins] == ["sale"]
    with pytest.raises(ValueError):
        join_spec("item:sale:item.sale_id=visit.id")
