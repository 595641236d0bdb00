"""Which tables a question is about, and what could be asked instead."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import replace

from quillgate.plans.catalog import Catalog, Synonym
from quillgate.plans.graph import neighbours


def _terms(text: str) -> set[str]:
    words = re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text).lower().replace("_", " "))
    return {w for word in words for w in (word, word.removesuffix("s")) if len(w) > 2}


def table_scores(question: str, catalog: Catalog) -> dict[str, float]:
    """Words shared with a table's name count most, the more of the name they are; then synonyms, columns and stored values."""
    asked = _terms(question)
    scores = {}
    for t in catalog.tables:
        named = asked & _terms(t.name)
        score = 3.0 * len(named) + len(named) / max(len(_terms(t.name)), 1) + len(asked & _terms(t.description))
        score += sum(2.0 for s in catalog.synonyms if s.target.split(".")[0] == t.name and _terms(s.term) & asked)
        for c in t.columns:
            score += len(asked & _terms(c.name)) + 1.5 * any(v.lower() in question.lower() for v in c.values)
        scores[t.name] = score
    return scores


def relevant_tables(question: str, catalog: Catalog, *, most: int = 6) -> list[str]:
    """The best tables and those one key away; all of them if none stands out."""
    scores = table_scores(question, catalog)
    best = [t for t in sorted(scores, key=lambda t: (-scores[t], t)) if scores[t] > 0][:most]
    if not best:
        return [t.name for t in catalog.tables]
    near = [h.right.table for t in best for h in neighbours(catalog).get(t, ())]
    return list(dict.fromkeys([*best, *near]))


def link_confidence(question: str, catalog: Catalog, tables: Iterable[str]) -> float:
    """How much of what the question names is found in the tables used, between 0 and 1."""
    scores = table_scores(question, catalog)
    used = set(tables)
    best = sum(sorted(scores.values(), reverse=True)[: max(1, len(used))])
    return min(1.0, sum(scores.get(t, 0.0) for t in used) / best) if best else 0.0


def suggestions(catalog: Catalog, *, most: int = 3) -> list[str]:
    """Questions that this catalog can answer."""
    out = [f"What is the {m.id.replace('_', ' ')}?" for m in catalog.metrics]
    out += [f"How many rows of {t.name} are there?" for t in catalog.tables]
    return out[:most]


def with_knowledge(catalog: Catalog, text: str) -> Catalog:
    """The catalog with more synonyms and instructions (JSON); anything else, and SQL above all, is refused."""
    data = json.loads(text)
    if unknown := set(data) - {"synonyms", "instructions"}:
        raise ValueError(f"knowledge may not hold {sorted(unknown)}")
    notes = tuple(data.get("instructions", ()))
    if any(re.search(r"\bselect\b.+\bfrom\b", n, re.I | re.S) for n in notes):
        raise ValueError("knowledge may not hold queries")
    more = tuple(Synonym(s["term"], s["target"]) for s in data.get("synonyms", ()))
    for s in more:
        table, _, column = s.target.partition(".")
        if table not in catalog.by_name or (column and column not in catalog.by_name[table].by_name):
            raise ValueError(f"synonym for an unknown column: {s.target}")
    return replace(catalog, synonyms=catalog.synonyms + more, instructions=catalog.instructions + notes)
