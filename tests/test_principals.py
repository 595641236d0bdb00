import json

import pytest

from quillgate.__main__ import main
from quillgate.demo_catalog import CATALOG as DEMO
from quillgate.evals.golden import check, keep, scorecard
from quillgate.evidence import ledger
from quillgate.plans.builder import Query
from quillgate.principals import Counters, RateLimit, Registry
from quillgate.sqlguard.rewrite import case_insensitive_like
from tests.test_guard import _session

FILTER = {"is": "Compare", "column": "country.title", "op": "eq", "value": {"type": "string", "value": "A"}}
REGISTRY = {
    "tenant": "t1",
    "tokens": {"tok-1": "ann"},
    "groups": {"readers": {"allowed_tables": ["sale"], "row_filters": [FILTER]}},
    "principals": {"ann": {"groups": ["readers"], "allowed_tables": ["buyer"], "row_filters": [FILTER]}, "bob": {"allowed_tables": ["item"]}},
}


def test_registry():
    r = Registry.from_json(json.dumps(REGISTRY))
    ann = r.by_token("tok-1")
    assert (ann.id, ann.tenant, ann.allowed_tables, len(ann.row_filters)) == ("ann", "t1", frozenset({"sale", "buyer"}), 1)
    for bad in (lambda: r.by_token("tok-2"), lambda: r.principal("eve")):
        with pytest.raises(PermissionError):
            bad()
    for change in ({"colour": 1}, {"tokens": {"x": "eve"}}, {"principals": {"ann": {"groups": ["none"]}}, "tokens": {}}):
        with pytest.raises(ValueError):
            Registry.from_json(json.dumps({**REGISTRY, **change}))
    with pytest.raises(PermissionError):
        Registry.from_json(json.dumps({"principals": {"ann": {}}}))
    assert Registry.from_json(json.dumps({"principals": {"ann": {}}, "open_by_default": True})).principal("ann").allowed_tables is None


def test_rate_limit_and_counters():
    limit = RateLimit(per_minute=60, burst=2)
    assert [limit.allow("a", now) for now in (0, 0, 0, 0.5, 1.5)] == [True, True, False, False, True] and limit.allow("b", 0)
    c = Counters()
    c.add("ok", "", 0.3)
    c.add("ok", "", 7)
    assert 'asks_total{status="ok",code=""} 2' in c.text() and 'le="0.5"} 1' in c.text()


@pytest.mark.parametrize(
    "text, n, columns",
    [
        ("select buyer_id from sale group by buyer_id order by sum(total) desc limit 3", 3, ["buyer_id", "sum_total"]),
        ("select buyer_id, sum(total) as t from sale group by buyer_id order by sum(total) desc limit 3", 3, ["buyer_id", "t"]),
        ("select paid from sale group by paid having count(*) > 3 order by avg(total), paid", 2, ["paid", "avg_total", "count"]),
        ("select paid, count(*) as n from sale group by paid order by n", 2, ["paid", "n"]),
        ("select id from sale order by total limit 2", 2, ["id"]),
        ("select distinct paid from sale group by paid order by paid", 2, ["paid"]),
        ("select b.rank from sale s join buyer b on s.buyer_id = b.id group by b.rank order by max(s.total), b.rank", 3, ["rank", "max_total"]),
    ],
)
def test_ranking_measures_are_shown(spark, text, n, columns):
    df = _session(spark).query(text, show_measures=True).df
    assert df.columns == columns and df.count() == n


def test_case_insensitive_like():
    text = "select 'a like ''x''' from t where a like 'B%' and b LIKE c -- like 'x'\n and c not like  'z'"
    assert case_insensitive_like(text) == "select 'a like ''x''' from t where a ILIKE 'B%' and b LIKE c -- like 'x'\n and c not ILIKE  'z'"


def test_plans_are_compiled_once(spark):
    s = _session(spark)
    plan = Query.over("sale").agg("count", None, "n").limit(1).plan()
    assert s.plan(plan) is s.plan(plan)


def test_golden_and_scorecard(spark, tmp_path):
    s = _session(spark)
    keep(tmp_path, "sales", Query.over("sale").by("sale.paid").agg("count", None, "n").order("sale.paid").limit(5).plan(), s)
    assert [(g.name, g.passed) for g in check(tmp_path, s)] == [("sales", True)]
    kept = json.loads((tmp_path / "sales.json").read_text())
    kept["rows"][0][1] += 1
    (tmp_path / "sales.json").write_text(json.dumps(kept))
    assert [(g.plan_hash_kept, g.rows_kept) for g in check(tmp_path, s)] == [(True, False)]
    a, b = scorecard({"a": {"1": "correct", "2": "wrong", "3": "abstained"}, "b": {"1": "wrong", "2": "correct", "4": "correct"}})
    assert (a["cases"], a["right"], a["wrong"], a["only_right"], b["only_wrong"]) == (2, 1, 1, 1, 1) and scorecard({}) == []


def test_command_line(spark, tmp_path, capsys):
    for t in ("nation", "region"):
        spark.range(3).selectExpr(f"cast(id as int) as {t[0]}_{t}key", f"concat('{t}', id) as {t[0]}_name", *(["cast(id % 2 as int) as n_regionkey"] if t == "nation" else [])).write.parquet(str(tmp_path / f"{t}.parquet"))
    catalog = tmp_path / "catalog.json"
    catalog.write_text(json.dumps(DEMO.slice(["nation", "region"]).to_dict()))
    base = ["--data", str(tmp_path), "--catalog", str(catalog)]
    assert main(["query", "select count(*) as n from nation", *base]) == 0 and capsys.readouterr().out.split() == ["n", "3"]
    assert main(["query", "drop table nation", *base]) == 2 and "sql.read_only" in capsys.readouterr().err
    plan = Query.over("nation").by("region.r_name").agg("count", None, "n").order("region.r_name").limit(5).plan().canonical()
    assert main(["plan", plan, *base]) == 0 and "region0\t2" in capsys.readouterr().out
    assert main(["drift", *base]) == 0
    assert main(["draft", "--data", str(tmp_path), "--values"]) == 0 and json.loads(capsys.readouterr().out)["tables"][0]["name"] == "nation"
    ledger.append(tmp_path / "l.jsonl", {"a": 1})
    assert main(["verify", str(tmp_path / "l.jsonl")]) == 0
