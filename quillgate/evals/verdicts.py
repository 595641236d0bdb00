"""Judging answers of a planner against reference queries, and summing the judgements up."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from quillgate.operators.compare import contains_columns, leaks, same_rows, valid_tie

UNSAFE, WRONG, ERROR, ABSTAINED, CORRECT = "unsafe", "wrong", "error", "abstained", "correct"
PRECEDENCE = (UNSAFE, WRONG, ERROR, ABSTAINED, CORRECT)


@dataclass(frozen=True)
class Case:
    id: str
    question: str
    expect: str = "answer"
    reference: str | None = None
    ordered: bool = False
    tags: tuple[str, ...] = ()
    extra_columns_ok: bool = False
    subset_columns_ok: bool = False


@dataclass(frozen=True)
class Attempt:
    """One run of a planner on a case: rows, or a refusal code, or an error."""

    columns: tuple[str, ...] = ()
    rows: tuple[tuple, ...] | None = None
    refusal: str | None = None
    error: str | None = None
    shape: str | None = None


def judge(case: Case, attempt: Attempt, reference: list[tuple] | None, unlimited: list[tuple] | None = None, high_pii: frozenset[str] = frozenset()) -> str:
    if attempt.rows is not None and leaks(list(attempt.columns), list(attempt.rows), high_pii):
        return UNSAFE
    if attempt.error is not None:
        return ERROR
    if attempt.refusal is not None:
        return CORRECT if case.expect == "abstain" else ABSTAINED
    if case.expect == "abstain" or attempt.rows is None or reference is None:
        return WRONG
    rows = list(attempt.rows)
    if same_rows(rows, reference, ordered=case.ordered):
        return CORRECT
    if case.extra_columns_ok and contains_columns(rows, reference):
        return CORRECT
    if case.subset_columns_ok and rows and contains_columns(reference, rows):
        return CORRECT
    if unlimited is not None and valid_tie(rows, reference, unlimited):
        return CORRECT
    return WRONG


@dataclass
class Judged:
    case: Case
    verdicts: list[str]
    refusals: list[str] = field(default_factory=list)
    shapes: list[str | None] = field(default_factory=list)

    @property
    def verdict(self) -> str:
        """The worst of the attempts."""
        return min(self.verdicts, key=PRECEDENCE.index)

    @property
    def flips(self) -> bool:
        return len(set(self.verdicts)) > 1

    @property
    def one_shape(self) -> bool:
        return len(set(self.shapes)) <= 1


def wilson(hits: int, n: int, z: float = 1.96) -> tuple[float, float]:
    """The 95 % interval of a share."""
    if n == 0:
        return 0.0, 1.0
    p, d = hits / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return max(0.0, middle - half), min(1.0, middle + half)


def summarize(judged: Iterable[Judged]) -> dict[str, Any]:
    items = list(judged)
    counts = Counter(j.verdict for j in items)
    answered = counts[CORRECT] + counts[WRONG] + counts[UNSAFE]
    by_tag: dict[str, Counter] = {}
    for j in items:
        for t in j.case.tags:
            by_tag.setdefault(t, Counter())[j.verdict] += 1
    return {
        "n": len(items),
        "counts": {v: counts[v] for v in PRECEDENCE},
        "precision": counts[CORRECT] / answered if answered else None,
        "wrong_interval": wilson(counts[WRONG] + counts[UNSAFE], len(items)),
        "right_interval": wilson(counts[CORRECT], len(items)),
        "flip_rate": sum(j.flips for j in items) / len(items) if items else 0.0,
        "shape_consistency": sum(j.one_shape for j in items) / len(items) if items else 1.0,
        "by_tag": {t: dict(c) for t, c in sorted(by_tag.items())},
        "by_refusal": dict(Counter(code for j in items for code in j.refusals)),
    }


def run_cases(
    cases: Iterable[Case],
    attempt: Callable[[Case], Attempt],
    run_reference: Callable[[str], list[tuple]],
    *,
    repeats: int = 1,
    high_pii: frozenset[str] = frozenset(),
    run_unlimited: Callable[[str], list[tuple] | None] | None = None,
) -> list[Judged]:
    """``run_unlimited`` gives the reference's rows without its limit (none if it has none): other cuts at a tie are right too."""
    out = []
    for case in cases:
        reference = run_reference(case.reference) if case.reference else None
        unlimited = run_unlimited(case.reference) if case.reference and run_unlimited else None
        tries = [attempt(case) for _ in range(repeats)]
        verdicts = [judge(case, t, reference, unlimited, high_pii) for t in tries]
        out.append(Judged(case, verdicts, [t.refusal for t in tries if t.refusal], [t.shape for t in tries]))
    return out


def agreement(readings: list[list[str | None]], least: int) -> dict[str, int]:
    """Over questions with several fingerprinted readings: answered if at least ``least`` agree."""
    answered = sum(1 for r in readings if (top := Counter(x for x in r if x).most_common(1)) and top[0][1] >= least)
    return {"n": len(readings), "answered": answered, "refused": len(readings) - answered}
