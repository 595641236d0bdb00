"""What a model client is told, and the form its proposal must have."""

from __future__ import annotations

from typing import Any

from quillgate.plans import ir
from quillgate.plans.catalog import Catalog

RULES = (
    "Propose one thing: a metric of the catalog, a plan, or one read-only query; refuse if the catalog cannot answer.",
    "Name tables and columns as the catalog does, without a schema. Join on the catalog's keys only.",
    "Columns of high PII cannot be read in any way.",
    "Aggregate before joining where a join would repeat rows.",
)


def proposal_schema(catalog: Catalog) -> dict[str, Any]:
    """JSON schema of a proposal; names are limited to those of the catalog."""
    tables = [t.name for t in catalog.tables]
    columns = [f"{t.name}.{c.name}" for t in catalog.tables for c in t.columns if c.pii != "high"]
    column = {"type": "string", "enum": columns}
    plan = {
        "type": "object",
        "additionalProperties": False,
        "required": ["source", "limit"],
        "properties": {
            "source": {"type": "string", "enum": tables},
            "filters": {"type": "array", "items": {"type": "object", "required": ["is", "column"]}},
            "group_by": {"type": "array", "items": column},
            "buckets": {"type": "array", "items": {"type": "object", "properties": {"column": column, "grain": {"enum": list(ir.GRAINS)}}}},
            "aggregations": {"type": "array", "items": {"type": "object", "properties": {"fn": {"enum": list(ir.AGGREGATES)}, "column": {"anyOf": [column, {"type": "null"}]}, "alias": {"type": "string"}}}},
            "having": {"type": "array"},
            "order_by": {"type": "array"},
            "projection": {"type": "array", "items": column},
            "limit": {"type": "integer", "minimum": 1, "maximum": catalog.max_limit},
        },
    }
    choices: dict[str, Any] = {"sql": {"type": "string"}, "plan": plan, "refuse": {"type": "string"}}
    if catalog.metrics:
        choices["metric"] = {"type": "string", "enum": [m.id for m in catalog.metrics]}
    return {"oneOf": [{"type": "object", "additionalProperties": False, "required": [k], "properties": {k: v}} for k, v in choices.items()]}


def prompt(question: str, catalog_text: str, problems: list[str]) -> str:
    parts = ["\n".join(RULES), catalog_text, f"Question: {question}"]
    if problems:
        parts.append("The last proposal was refused:\n" + "\n".join(problems))
    return "\n\n".join(parts)
