"""Plans kept with the rows they gave: a change of either is seen."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from quillgate.operators.compare import same_rows
from quillgate.plans.ir import Plan
from quillgate.session import GovernedSession


@dataclass(frozen=True)
class Golden:
    name: str
    plan_hash_kept: bool
    rows_kept: bool

    @property
    def passed(self) -> bool:
        return self.plan_hash_kept and self.rows_kept


def check(folder: str | Path, session: GovernedSession) -> Iterator[Golden]:
    """Each ``NAME.json`` holds ``{"plan": ..., "hash": ..., "rows": first rows, in order}``."""
    for path in sorted(Path(folder).glob("*.json")):
        kept = json.loads(path.read_text(encoding="utf-8"))
        compiled = session.plan(Plan.from_dict(kept["plan"]))
        rows = [tuple(r) for r in compiled.df.take(len(kept["rows"]))]
        yield Golden(path.stem, compiled.plan_hash == kept["hash"], same_rows(rows, [tuple(r) for r in kept["rows"]], ordered=True))


def keep(folder: str | Path, name: str, plan: Plan, session: GovernedSession, *, rows: int = 5) -> None:
    compiled = session.plan(plan)
    first = [list(r) for r in compiled.df.take(rows)]
    text = json.dumps({"plan": plan.to_dict(), "hash": compiled.plan_hash, "rows": first}, indent=1, default=str, ensure_ascii=False)
    Path(folder, f"{name}.json").write_text(text + "\n", encoding="utf-8")


def scorecard(systems: dict[str, dict[str, str]]) -> list[dict[str, object]]:
    """Verdicts by case of several systems, side by side over the cases all of them ran.

    Beside the counts: the cases only this one got right, and only this one got wrong.
    """
    shared = set.intersection(*(set(v) for v in systems.values())) if systems else set()
    out = []
    for name, verdicts in systems.items():
        others = [v for n, v in systems.items() if n != name]
        right = {c for c in shared if verdicts[c] == "correct"}
        wrong = {c for c in shared if verdicts[c] in ("wrong", "unsafe")}
        out.append(
            {
                "system": name,
                "cases": len(shared),
                "right": len(right),
                "wrong": len(wrong),
                "refused": sum(verdicts[c] == "abstained" for c in shared),
                "only_right": len([c for c in right if all(o[c] != "correct" for o in others)]),
                "only_wrong": len([c for c in wrong if all(o[c] not in ("wrong", "unsafe") for o in others)]),
            }
        )
    return out
