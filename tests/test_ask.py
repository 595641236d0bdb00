import pytest

from quillgate.ask.guards import before_planning, dropped_constants, dropped_measures
from quillgate.ask.pipeline import Asker, Scripted, describe
from quillgate.ask.retrieve import link_confidence, relevant_tables, suggestions, with_knowledge
from quillgate.evals.verdicts import Attempt, Case, Judged, agreement, judge, run_cases, summarize, wilson
from quillgate.evidence.bundle import verify
from tests.test_guard import _session
from tests.test_plans import CATALOG

KEY = b"key"


@pytest.fixture(scope="module")
def session(spark):
    return _session(spark)


def _asker(session, answers, **options):
    return Asker(session, Scripted(answers), KEY, **options)


def test_an_answer_that_both_readings_agree_on(session):
    log = []
    asker = _asker(session, {"How many sales are there?": [{"sql": "select count(*) as n from sale"}, {"sql": "select count(id) as n from sale"}]}, record=log.append)
    out = asker.ask("How many sales are there?")
    assert out.status == "ok" and out.rows == ((60,),) and verify(out.evidence, KEY) and log == [out.evidence]
    assert "n" in describe(out)


def test_readings_that_disagree_are_refused(session):
    out = _asker(session, {"Which sales?": [{"sql": "select count(*) as n from sale"}, {"sql": "select count(*) as n from visit"}]}).ask("Which sales?")
    assert (out.status, out.code) == ("refused", "unstable_answer")


def test_errors_are_told_to_the_client_once(session):
    client = Scripted({"What did each buyer pay?": [{"sql": "select mail from buyer"}, {"sql": "select buyer_id, sum(total) as t from sale group by buyer_id"}]})
    out = Asker(session, client, KEY, readings=1).ask("What did each buyer pay?")
    assert out.status == "ok" and "sql.pii" in client.asked[1][1][0]
    bad = _asker(session, {"x?": [{"sql": "select mail from buyer"}]}, readings=1).ask("x?")
    assert (bad.status, bad.code) == ("refused", "validation_failed")
    assert _asker(session, {}, readings=1).ask("something").code == "no_plan"


def test_metrics_and_grounding(session):
    out = _asker(session, {"Show the sales metric": [{"metric": "sales"}]}).ask("Show the sales metric")
    assert out.status == "ok" and len(out.rows) == 2
    out = _asker(session, {"How many visits to page P-1?": [{"sql": "select count(*) as n from visit where page = 'P-1'"}]}).ask("How many visits to page P-1?")
    assert out.rows == ((10,),) and "'p1'" in out.query


def test_confirmed_queries_run_as_confirmed(session):
    asker = _asker(session, {"How many buyers?": [{"sql": "select count(*) as n from buyer"}]})
    review = asker.ask("How many buyers?", confirm_only=True).review
    assert asker.execute_reviewed(review).rows == ((10,),)
    with pytest.raises(PermissionError):
        asker.execute_reviewed({**review, "review": {**review["review"], "query": "select count(*) as n from sale"}})


def test_questions_turned_back():
    ask = lambda q, c=CATALOG: (before_planning(q, c) or type("x", (), {"code": None})).code
    assert ask("  ") == "empty_question" and ask("x" * 3000) == "question_too_long" and ask("select id from sale") == "sql_in_question"
    assert ask("list the mail of buyers") == "restricted_request" and ask("anything", CATALOG.slice([])) == "no_access" and ask("How many sales?") is None
    assert dropped_constants("sales over 4711 to 'Saint Lo'", "select 1 where total > 4711") == ["Saint Lo"]
    assert dropped_measures("the average total", "select sum(total) from sale") == ["dropped_average"] and dropped_measures("how many sales", "select count(*) from sale") == []


def test_retrieval_and_knowledge():
    assert relevant_tables("visits by page", CATALOG)[0] == "visit" and "buyer" in relevant_tables("visits by page", CATALOG)
    assert len(relevant_tables("zzz", CATALOG)) == len(CATALOG.tables) and link_confidence("visit page", CATALOG, ["visit"]) == 1.0 and link_confidence("visit page", CATALOG, ["route"]) == 0.0
    assert len(suggestions(CATALOG)) == 3
    more = with_knowledge(CATALOG, '{"synonyms": [{"term": "client", "target": "buyer.id"}], "instructions": ["totals are in USD"]}')
    assert more.synonyms[-1].term == "client" and relevant_tables("each client", more)[0] == "buyer"
    for bad in ('{"sql": "x"}', '{"instructions": ["select a from b"]}', '{"synonyms": [{"term": "x", "target": "nowhere.id"}]}'):
        with pytest.raises(ValueError):
            with_knowledge(CATALOG, bad)


def test_verdicts():
    case = Case("1", "q", reference="r", tags=("t",))
    assert judge(case, Attempt(("a",), ((1,),)), [(1,)]) == "correct" and judge(case, Attempt(("a",), ((2,),)), [(1,)]) == "wrong"
    assert judge(case, Attempt(refusal="x"), [(1,)]) == "abstained" and judge(case, Attempt(error="x"), [(1,)]) == "error"
    assert judge(case, Attempt(("mail",), (("m",),)), [(1,)], high_pii=frozenset({"mail"})) == "unsafe"
    no = Case("2", "q", expect="abstain")
    assert judge(no, Attempt(refusal="x"), None) == "correct" and judge(no, Attempt(("a",), ((1,),)), None) == "wrong"
    assert judge(Case("3", "q", extra_columns_ok=True), Attempt(("a", "b"), ((1, 2),)), [(1,)]) == "correct"
    judged = run_cases([case, no], lambda c: Attempt(("a",), ((1,),)), lambda sql: [(1,)], repeats=2)
    out = summarize([*judged, Judged(case, ["correct", "wrong"], ["code"], ["s", "t"])])
    assert out["counts"] == {"unsafe": 0, "wrong": 2, "error": 0, "abstained": 0, "correct": 1} and out["by_refusal"] == {"code": 1} and 0 < out["flip_rate"] < 1
    low, high = wilson(0, 12)
    assert low == 0 and round(high, 3) == 0.243 and wilson(0, 0) == (0.0, 1.0)
    assert agreement([["a", "a", "b"], ["a", "b", None]], 2) == {"n": 2, "answered": 1, "refused": 1}


def test_plans_are_proposed_and_guarded(session):
    plan = {"source": "sale", "aggregations": [{"fn": "avg", "column": "sale.total", "alias": "a"}], "limit": 1}
    out = _asker(session, {"What is the average total of sales?": [{"plan": plan}]}).ask("What is the average total of sales?")
    assert out.status == "ok" and round(out.rows[0][0], 3) == 2.0
    wrong = {"source": "sale", "aggregations": [{"fn": "sum", "column": "sale.total", "alias": "a"}], "limit": 1}
    out = _asker(session, {"What is the average total of sales?": [{"plan": wrong}]}, readings=1).ask("What is the average total of sales?")
    assert out.status == "refused" and "dropped_average" in out.message
    out = _asker(session, {"sales?": [{"plan": {"source": "sale", "colour": 1}}]}, readings=1).ask("sales?")
    assert "plan.malformed" in out.message
    out = _asker(session, {"How many visits?": [{"metric": "per_buyer"}]}, readings=1).ask("How many visits?")
    assert "unrelated_metric" in out.message


@pytest.mark.parametrize(
    "question, build, code",
    [
        ("What share of sales is paid?", lambda q: q("sale").agg("count", None, "n"), "inexpressible_request"),
        ("How many sales are there?", lambda q: q("sale"), "dropped_count"),
        ("What is the average total per buyer?", lambda q: q("sale").agg("avg", "sale.total", "a"), "averaged_per_other_entity"),
        ("How many buyers are there?", lambda q: q("sale").agg("count", None, "n"), "counted_other_entity"),
        ("How many buyers bought something?", lambda q: q("sale").agg("count_distinct", "sale.buyer_id", "n"), None),
        ("Which country has the most sales?", lambda q: q("sale").by("country.title").agg("count", None, "n").order("n", descending=True), "ranked_list_for_singular_question"),
        ("Sales with the note 'late'", lambda q: q("sale"), "dropped_literals"),
        ("Sales that are late", lambda q: q("sale").where("sale.note", "eq", "urgent"), "unmatched_values"),
        ("Sales for each buyer", lambda q: q("sale").by("sale.buyer_id").agg("count", None, "n"), "opaque_grouping_keys"),
        ("Sales and visits", lambda q: q("sale").agg("count", None, "n"), "missing_concepts"),
        ("What is the total of sales?", lambda q: q("sale").agg("sum", "sale.total", "s"), None),
    ],
)
def test_plan_guards(question, build, code):
    from quillgate.ask.guards import after_planning
    from quillgate.plans.builder import Query

    found = after_planning(question, build(Query.over).limit(5).plan(), CATALOG)
    assert (found.code if found else None) == code


def test_scope_and_schema():
    from quillgate.ask.guards import out_of_scope, unknown_terms
    from quillgate.ask.prompt import prompt, proposal_schema

    assert unknown_terms("How many visits to the moon were launched in Berlin?", CATALOG) == ["moon", "launched"]
    assert out_of_scope("what is the weather on the moon", CATALOG).code == "out_of_scope" and out_of_scope("total of sales by country", CATALOG) is None
    schema = str(proposal_schema(CATALOG))
    assert "sale.total" in schema and "buyer.mail" not in schema and "per_buyer" in schema
    assert "refused" in prompt("q", "c", ["sql.pii: no"])
