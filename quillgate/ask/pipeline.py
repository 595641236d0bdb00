"""From a question to a checked, executed and recorded answer.

A client proposes; nothing it proposes runs as written. Two readings of a question are planned, checked
and run side by side, and an answer is given only if both give the same rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

from quillgate.ask.guards import Clarify, after_planning, before_planning, dropped_constants, metric_guard
from quillgate.ask.prompt import prompt, proposal_schema
from quillgate.ask.retrieve import link_confidence, relevant_tables, suggestions
from quillgate.evidence.bundle import Evidence, open_review, signed_review
from quillgate.operators.compare import fingerprint
from quillgate.operators.ground import ground, respelled
from quillgate.plans.catalog import Catalog
from quillgate.plans.explain import explain
from quillgate.plans.ir import Plan
from quillgate.plans.issues import Rejected
from quillgate.session import GovernedSession, Options, Principal, Result, TimedOut
from quillgate.sqlguard.tree import parse


class Client(Protocol):
    """Turns a question and a catalog text into a proposal: ``{"sql": ...}``, ``{"plan": ...}``, ``{"metric": ...}`` or ``{"refuse": code}``."""

    def propose(self, question: str, catalog_text: str, problems: list[str]) -> dict[str, Any]: ...


@dataclass
class Scripted:
    """A client that answers from a script; for tests and replays."""

    answers: dict[str, list[dict[str, Any]]]
    asked: list[tuple[str, list[str]]] = field(default_factory=list)

    def propose(self, question: str, catalog_text: str, problems: list[str]) -> dict[str, Any]:
        self.asked.append((question, problems))
        left = self.answers.get(question) or [{"refuse": "no_plan"}]
        return left.pop(0) if len(left) > 1 else left[0]


#: What a reading can end in that is told by its own code.
_OWN_CODES = frozenset({"no_stored_value", "low_link_confidence"})


@dataclass
class Prompted:
    """A client over any model that completes a text under a JSON schema."""

    complete: Callable[[str, dict[str, Any]], str]
    catalog: Catalog

    def propose(self, question: str, catalog_text: str, problems: list[str]) -> dict[str, Any]:
        answer = json.loads(self.complete(prompt(question, catalog_text, problems), proposal_schema(self.catalog)))
        return answer if isinstance(answer, dict) else {"refuse": "no_plan"}


@dataclass(frozen=True)
class Outcome:
    status: str
    code: str = ""
    message: str = ""
    columns: tuple[str, ...] = ()
    rows: tuple[tuple, ...] = ()
    truncated: bool = False
    query: str = ""
    query_hash: str = ""
    review: dict[str, Any] | None = None
    suggestions: tuple[str, ...] = ()
    evidence: dict[str, Any] | None = None


@dataclass(frozen=True)
class Reading:
    text: str
    query_hash: str
    width: int
    result: Result


def _numbers(rows: list[tuple], width: int) -> list[tuple]:
    """The reading's own columns, text that is a number taken as one."""

    def cell(v: Any) -> Any:
        if isinstance(v, str):
            try:
                return float(v)
            except ValueError:
                return v
        return v

    return [tuple(map(cell, r[:width])) for r in rows]


@dataclass
class Asker:
    session: GovernedSession
    client: Client
    key: bytes
    options: Options = Options()
    readings: int = 2
    repairs: int = 1
    record: Callable[[dict[str, Any]], None] | None = None
    #: How much of what the question names must be in the tables read; none: not asked.
    least_confidence: float | None = None

    @property
    def catalog(self) -> Catalog:
        return self.session.catalog

    def ask(self, question: str, *, confirm_only: bool = False) -> Outcome:
        clarify = before_planning(question, self.catalog)
        if clarify:
            return self._end(question, Outcome("clarify", clarify.code, clarify.message, suggestions=tuple(suggestions(self.catalog))))
        hint = ", ".join(relevant_tables(question, self.catalog))
        text = f"{self.catalog.summary()}\nlikely tables: {hint}"
        if confirm_only:
            planned = self._read(question, text, run=False)
            if isinstance(planned, Clarify):
                return self._end(question, Outcome("refused", planned.code, planned.message))
            review = signed_review(self.session.principal.id, {"query": planned.text, "query_hash": planned.query_hash}, self.key)
            return self._end(question, Outcome("confirm", query=planned.text, query_hash=planned.query_hash, review=review))
        with ThreadPoolExecutor(self.readings) as pool:
            found = list(pool.map(lambda _: self._read(question, text), range(self.readings)))
        if failed := next((f for f in found if isinstance(f, Clarify)), None):
            return self._end(question, Outcome("refused", failed.code, failed.message))
        first = found[0]
        same = all(f.query_hash == first.query_hash or fingerprint(_numbers(f.result.rows, f.width)) == fingerprint(_numbers(first.result.rows, first.width)) for f in found[1:])
        if not same:
            return self._end(question, Outcome("refused", "unstable_answer", "two readings of the question gave different rows"))
        return self._end(question, self._answer(first.text, first.query_hash, first.result))

    def execute_reviewed(self, signed: dict[str, Any]) -> Outcome:
        """Runs what a person confirmed, if checking it again gives the very same query."""
        review = open_review(signed, self.session.principal.id, self.key)
        query = self.session.query(review["query"])
        if query.query_hash != review["query_hash"]:
            raise PermissionError("the query, the catalog or the filters have changed since the review")
        return self._end("", self._answer(query.text, query.query_hash, self.session.run(query.df, query.query_hash, self.options)))

    @staticmethod
    def _answer(text: str, query_hash: str, result: Result) -> Outcome:
        return Outcome("ok", columns=tuple(result.columns), rows=tuple(result.rows), truncated=result.truncated, query=text, query_hash=query_hash)

    def _read(self, question: str, text: str, *, run: bool = True) -> Reading | Clarify:
        problems: list[str] = []
        for _ in range(1 + self.repairs):
            proposal = self.client.propose(question, text, problems)
            if "refuse" in proposal:
                return Clarify(str(proposal["refuse"]), "the planner declined")
            try:
                if "metric" in proposal:
                    if against := metric_guard(question, proposal["metric"]):
                        problems = [f"{against.code}: {against.message}"]
                        continue
                    compiled = self.session.metric(proposal["metric"])
                    df, query_hash, shown = compiled.df, compiled.plan_hash, f"metric {proposal['metric']}"
                elif "plan" in proposal:
                    # joins are the catalog's to find, whatever the client proposes
                    plan = Plan.from_dict({k: v for k, v in proposal["plan"].items() if k != "joins"})
                    compiled = self.session.plan(plan)
                    if against := after_planning(question, compiled.plan, self.catalog):
                        problems = [f"{against.code}: {against.message}"]
                        continue
                    df, query_hash, shown = compiled.df, compiled.plan_hash, explain(compiled.plan)
                else:
                    sql, nowhere = self._grounded(str(proposal.get("sql", "")))
                    if nowhere:
                        problems = [f"no_stored_value: nothing is stored as {', '.join(nowhere)}"]
                        continue
                    if missing := dropped_constants(question, sql):
                        problems = [f"dropped_literals: the query leaves out {', '.join(missing)}"]
                        continue
                    query = self.session.query(sql)
                    if self.least_confidence is not None and link_confidence(question, self.catalog, query.approved.tables) < self.least_confidence:
                        problems = ["low_link_confidence: the question names other tables than the query reads"]
                        continue
                    df, query_hash, shown = query.df, query.query_hash, sql
            except Rejected as e:
                problems = [f"{i.code}: {i.message}" for i in e.issues]
                continue
            except (ValueError, KeyError, TypeError) as e:
                problems = [f"plan.malformed: {e}"]
                continue
            if not run:
                return Reading(shown, query_hash, len(df.columns), Result(df.columns, [], False))
            try:
                return Reading(shown, query_hash, len(df.columns), self.session.run(df, query_hash, self.options))
            except (RuntimeError, TimedOut) as e:
                return Clarify("validation_failed", str(e))
        code = problems[0].partition(":")[0] if problems else ""
        return Clarify(code if code in _OWN_CODES else "validation_failed", "; ".join(problems))

    def _grounded(self, sql: str) -> tuple[str, list[str]]:
        """Constants in the spelling they are stored in, where there is one spelling only; and those stored nowhere."""
        parsed = parse(self.session.spark, sql)
        approved = self.session.query(sql).approved
        found = ground(parsed.root, self.catalog, self.session.filtered, approved.tables)
        return respelled(sql, found.replacements, lambda text: parse(self.session.spark, text).root), found.unmatched

    def _end(self, question: str, outcome: Outcome) -> Outcome:
        evidence = Evidence(
            question=question,
            principal=self.session.principal.id,
            catalog_hash=self.catalog.digest(),
            query_hash=outcome.query_hash,
            status=outcome.status,
            checks=("parsed", "allowlist", "columns", "joins", "fan_out", "row_filters", "limit") if outcome.query_hash else (),
            fingerprint=fingerprint(list(outcome.rows)) if outcome.status == "ok" else None,
            row_count=len(outcome.rows) if outcome.status == "ok" else None,
            issues=(outcome.code,) if outcome.code else (),
        ).signed(self.key)
        if self.record is not None:
            self.record(evidence)
        return Outcome(**{**outcome.__dict__, "evidence": evidence})


def describe(outcome: Outcome, units: dict[str, str] | None = None, *, most: int = 10) -> str:
    """A plain table of an answer's first rows, money with two places."""
    units = units or {}
    if outcome.status != "ok":
        return f"{outcome.status}: {outcome.code} {outcome.message}".strip()
    if not outcome.rows:
        return "No rows."

    def cell(name: str, v: Any) -> str:
        if v is None:
            return "-"
        if isinstance(v, float):
            return f"{v:,.2f} {units[name]}" if name in units else re.sub(r"\.?0+$", "", f"{v:,.4f}")
        return str(v)

    lines = [" | ".join(outcome.columns)] + [" | ".join(cell(n, v) for n, v in zip(outcome.columns, r, strict=True)) for r in outcome.rows[:most]]
    if len(outcome.rows) > most or outcome.truncated:
        lines.append(f"({len(outcome.rows) - most} more rows{', cut at the row limit' if outcome.truncated else ''})")
    return "\n".join(lines)


__all__ = ["Asker", "Client", "Outcome", "Principal", "Scripted", "describe"]
