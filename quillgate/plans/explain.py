"""A plan told in English, from the plan alone."""

from __future__ import annotations

from quillgate.plans.catalog import Ref
from quillgate.plans.ir import Aggregation, Between, Compare, IsNull, Like, Member, Plan, Predicate

_OPS = {"eq": "is", "ne": "is not", "lt": "is below", "le": "is at most", "gt": "is above", "ge": "is at least"}
_FNS = {"count": "the number of", "count_distinct": "the number of different", "sum": "the total of", "avg": "the average of", "min": "the smallest", "max": "the largest"}


def _value(v: object) -> str:
    return str(v) if isinstance(v, Ref) else repr(v.value) if isinstance(v.value, str) else str(v.plain())


def filter_text(f: Predicate) -> str:
    c = str(f.column)
    if isinstance(f, Compare):
        return f"{c} {_OPS[f.op]} {_value(f.value)}"
    if isinstance(f, Member):
        return f"{c} is {'none' if f.negated else 'one'} of {', '.join(map(_value, f.values))}"
    if isinstance(f, Between):
        return f"{c} lies between {_value(f.low)} and {_value(f.high)}"
    if isinstance(f, IsNull):
        return f"{c} is {'known' if f.negated else 'missing'}"
    if isinstance(f, Like):
        return f"{c} looks like {f.pattern!r}" + (" in any case" if f.ignore_case else "")
    raise TypeError(type(f).__name__)


def measure_text(a: Aggregation) -> str:
    return f"{_FNS[a.fn]} {a.column or 'rows'} ({a.alias})"


def explain(plan: Plan) -> str:
    what = "; ".join(map(measure_text, plan.aggregations)) if plan.aggregations else ("the different groups" if plan.group_by or plan.buckets else "the rows")
    out = [f"From {plan.source}" + (f" with {', '.join(t for t in plan.tables[1:])}" if plan.joins else "") + f", show {what}"]
    keys = [*map(str, plan.group_by), *(f"{b.column} by {b.grain}" for b in plan.buckets)]
    if keys:
        out.append(f"for each {' and '.join(keys)}")
    if plan.filters:
        out.append("where " + " and ".join(map(filter_text, plan.filters)))
    if plan.having:
        out.append("keeping groups where " + " and ".join(f"{h.alias} {_OPS[h.op]} {h.value.plain()}" for h in plan.having))
    if plan.order_by:
        out.append("ordered by " + ", ".join(f"{o.alias or o.column}{' from the top' if o.descending else ''}" for o in plan.order_by))
    if plan.limit is not None:
        out.append(f"at most {plan.limit} rows")
    return ", ".join(out) + "."
