"""What is wrong with a plan, a query or a catalog, as records."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Issue:
    code: str
    path: str
    message: str
    stage: str = "policy"
    severity: str = "error"


class Rejected(Exception):
    """Carries every issue found, not only the first."""

    def __init__(self, issues: Iterable[Issue]) -> None:
        self.issues = list(issues)
        super().__init__("; ".join(f"{i.code} at {i.path}: {i.message}" for i in self.issues))

    @property
    def codes(self) -> list[str]:
        return [i.code for i in self.issues]


def reject(code: str, path: str, message: str, stage: str = "policy") -> None:
    raise Rejected([Issue(code, path, message, stage)])
