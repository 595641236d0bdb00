"""Running evaluation cases through the question pipeline, with a report as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from quillgate.ask.pipeline import Asker
from quillgate.evals.verdicts import Attempt, Case, Judged, run_cases, summarize, wilson
from quillgate.operators.compare import fingerprint
from quillgate.session import GovernedSession
from quillgate.sqlguard.tree import as_dataframe, parse


def cases_of(table: DataFrame) -> list[Case]:
    """Cases from a table of them; rows without a question are left out. For sets a person has written: it is collected."""
    wanted = ("id", "question", "expect", "reference_sql", "ordered", "tags", "extra_columns_ok", "subset_columns_ok")
    rows = table.select(*[c for c in wanted if c in table.columns]).filter("trim(question) <> ''").orderBy("id").collect()
    return [
        Case(r["id"], r["question"], r["expect"] or "answer", *(lambda d: (d.get("reference_sql"), bool(d.get("ordered")), tuple(d.get("tags") or ()), bool(d.get("extra_columns_ok")), bool(d.get("subset_columns_ok"))))(r.asDict()))
        for r in rows
    ]


def without_limit(session: GovernedSession, text: str, *, most: int = 10_000) -> list[tuple] | None:
    """The rows of a checked query without its outermost limit; none if it has none."""
    session.query(text)
    plan = parse(session.spark, text).jvm_plan
    limited = False
    while plan.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit"):
        plan, limited = plan.child(), True
    return [tuple(r) for r in as_dataframe(session.spark, plan).limit(most).collect()] if limited else None


def attempt_with(asker: Asker):
    def attempt(case: Case) -> Attempt:
        try:
            out = asker.ask(case.question)
        except Exception as e:  # noqa: BLE001
            return Attempt(error=f"{type(e).__name__}: {e}")
        if out.status != "ok":
            return Attempt(refusal=out.code or out.status)
        return Attempt(out.columns, out.rows, shape=fingerprint(list(out.rows)))

    return attempt


def evaluate(cases: Iterable[Case], asker: Asker, references: GovernedSession, *, repeats: int = 1) -> list[Judged]:
    return run_cases(
        cases,
        attempt_with(asker),
        lambda text: [tuple(r) for r in references.sql(text).collect()],
        repeats=repeats,
        high_pii=frozenset(asker.catalog.high_pii_names),
        run_unlimited=lambda text: without_limit(references, text),
    )


def report(judged: list[Judged], path: str | Path | None = None) -> dict[str, Any]:
    """The summary and every case; written to ``path`` whole or not at all."""
    cases = [{"id": j.case.id, "question": j.case.question, "verdict": j.verdict, "verdicts": j.verdicts, "refusals": j.refusals, "tags": list(j.case.tags)} for j in judged]
    out = {"summary": summarize(judged), "cases": cases}
    if path is not None:
        part = Path(f"{path}.part")
        part.write_text(json.dumps(out, indent=1, ensure_ascii=False) + "\n", encoding="utf-8")
        part.replace(path)
    return out


def adjudicated(reported: dict[str, Any], ratings: Iterable[dict[str, str]]) -> dict[str, Any]:
    """How many of the answers judged wrong are so in the eyes of raters: ``{rater: {case: "wrong" or "right"}}`` each.

    A case counts as wrong unless all who rated it call it right; one nobody rated stays wrong.
    """
    ratings = list(ratings)
    wrong = [c["id"] for c in reported["cases"] if c["verdict"] in ("wrong", "unsafe")]
    real = [c for c in wrong if not (votes := [r[c] for r in ratings if c in r]) or "wrong" in votes]
    split = [c for c in wrong if len({r[c] for r in ratings if c in r}) > 1]
    n = len(reported["cases"])
    return {"n": n, "judged_wrong": len(wrong), "really_wrong": len(real), "raters_differ": len(split), "interval": wilson(len(real), n), "cases": real}
