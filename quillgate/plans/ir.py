"""The typed logical plan: one select block over a tree of tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgate.plans.catalog import Ref

SCHEMA = "plan/1"
MAX_LIMIT = 10_000
COMPARISONS = ("eq", "ne", "lt", "le", "gt", "ge")
AGGREGATES = ("count", "count_distinct", "sum", "avg", "min", "max")
GRAINS = ("hour", "day", "week", "month", "quarter", "year")
LITERALS = ("string", "integer", "float", "boolean", "date", "datetime")
JOIN_KINDS = ("inner", "left", "right", "cross")


def _one_of(what: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{what} {value!r} is none of {', '.join(allowed)}")


@dataclass(frozen=True)
class Literal:
    """A typed constant. Text is read as the type it is declared with; a value of another type is an error."""

    type: str
    value: Any

    def __post_init__(self) -> None:
        _one_of("literal type", self.type, LITERALS)
        v = self.value
        if isinstance(v, str) and self.type != "string":
            try:
                v = {"integer": int, "float": float, "boolean": _truth, "date": dt.date.fromisoformat, "datetime": dt.datetime.fromisoformat}[self.type](v.strip())
            except ValueError as e:
                raise ValueError(f"{self.value!r} cannot be read as {self.type}") from e
        elif self.type == "float" and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        fits = {
            "string": isinstance(v, str),
            "integer": isinstance(v, int) and not isinstance(v, bool),
            "float": isinstance(v, float),
            "boolean": isinstance(v, bool),
            "date": isinstance(v, dt.date) and not isinstance(v, dt.datetime),
            "datetime": isinstance(v, dt.datetime),
        }[self.type]
        if not fits:
            raise ValueError(f"{self.value!r} is no {self.type}")
        object.__setattr__(self, "value", v)

    @classmethod
    def of(cls, value: Any) -> Literal:
        if isinstance(value, Literal):
            return value
        kinds = ((bool, "boolean"), (int, "integer"), (float, "float"), (dt.datetime, "datetime"), (dt.date, "date"), (str, "string"))
        for python, name in kinds:
            if isinstance(value, python):
                return cls(name, value)
        raise ValueError(f"no literal for {value!r}")

    def column(self) -> Column:
        if self.type == "datetime":
            return F.lit(self.value.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(self.value)

    def plain(self) -> Any:
        return self.value.isoformat() if isinstance(self.value, dt.date) else self.value


def _truth(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise ValueError(text)
    return text.lower() == "true"


@dataclass(frozen=True)
class Compare:
    column: Ref
    op: str
    value: Ref | Literal

    def __post_init__(self) -> None:
        _one_of("comparison", self.op, COMPARISONS)


@dataclass(frozen=True)
class Member:
    column: Ref
    values: tuple[Literal, ...]
    negated: bool = False

    def __post_init__(self) -> None:
        if not self.values:
            raise ValueError("a list of values must not be empty")


@dataclass(frozen=True)
class Between:
    column: Ref
    low: Literal
    high: Literal

    def __post_init__(self) -> None:
        if self.low.type == self.high.type and self.low.value > self.high.value:
            raise ValueError("the lower bound lies above the upper one")


@dataclass(frozen=True)
class IsNull:
    column: Ref
    negated: bool = False


@dataclass(frozen=True)
class Like:
    column: Ref
    pattern: str
    ignore_case: bool = False


Predicate = Compare | Member | Between | IsNull | Like


@dataclass(frozen=True)
class Aggregation:
    fn: str
    column: Ref | None
    alias: str

    def __post_init__(self) -> None:
        _one_of("aggregate", self.fn, AGGREGATES)
        if not self.alias:
            raise ValueError("an aggregate needs an alias")


@dataclass(frozen=True)
class Bucket:
    column: Ref
    grain: str

    def __post_init__(self) -> None:
        _one_of("grain", self.grain, GRAINS)

    @property
    def alias(self) -> str:
        return f"{self.column.column}_{self.grain}"


@dataclass(frozen=True)
class Having:
    alias: str
    op: str
    value: Literal

    def __post_init__(self) -> None:
        _one_of("comparison", self.op, COMPARISONS)


@dataclass(frozen=True)
class Order:
    column: Ref | None = None
    alias: str | None = None
    descending: bool = False

    def __post_init__(self) -> None:
        if (self.column is None) == (self.alias is None):
            raise ValueError("an order key is a column or an alias")


@dataclass(frozen=True)
class Join:
    table: str
    on: tuple[tuple[Ref, Ref], ...]
    kind: str = "inner"

    def __post_init__(self) -> None:
        _one_of("join", self.kind, JOIN_KINDS)


@dataclass(frozen=True)
class Plan:
    source: str
    joins: tuple[Join, ...] = ()
    filters: tuple[Predicate, ...] = ()
    group_by: tuple[Ref, ...] = ()
    buckets: tuple[Bucket, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()
    having: tuple[Having, ...] = ()
    order_by: tuple[Order, ...] = ()
    projection: tuple[Ref, ...] = ()
    limit: int | None = None
    plan_id: str = ""
    schema: str = SCHEMA

    def __post_init__(self) -> None:
        if self.schema != SCHEMA:
            raise ValueError(f"plans of schema {self.schema!r} are not read")
        if self.limit is not None and not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"a limit lies between 1 and {MAX_LIMIT}")
        names = [a.alias for a in self.aggregations]
        if len(set(names)) < len(names):
            raise ValueError("two aggregates share an alias")

    @property
    def is_list(self) -> bool:
        """Whether rows are listed rather than aggregated."""
        return not (self.aggregations or self.group_by or self.buckets)

    @property
    def tables(self) -> list[str]:
        return list(dict.fromkeys([self.source, *(j.table for j in self.joins)]))

    def reads(self) -> Iterator[tuple[str, str, Ref]]:
        """Every column read outside join conditions: (role, path, column)."""
        for i, f in enumerate(self.filters):
            yield "filter", f"$.filters[{i}]", f.column
            if isinstance(f, Compare) and isinstance(f.value, Ref):
                yield "filter", f"$.filters[{i}].value", f.value
        for i, c in enumerate(self.group_by):
            yield "key", f"$.group_by[{i}]", c
        for i, b in enumerate(self.buckets):
            yield "key", f"$.buckets[{i}]", b.column
        for i, a in enumerate(self.aggregations):
            if a.column is not None:
                yield "measure", f"$.aggregations[{i}]", a.column
        for i, o in enumerate(self.order_by):
            if o.column is not None:
                yield "order", f"$.order_by[{i}]", o.column
        for i, c in enumerate(self.projection):
            yield "output", f"$.projection[{i}]", c

    def to_dict(self) -> dict[str, Any]:
        return {f.name: _plain(getattr(self, f.name)) for f in fields(self)}

    def canonical(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def digest(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Plan:
        known = {f.name for f in fields(cls)}
        if unknown := set(data) - known:
            raise ValueError(f"unknown keys in plan: {sorted(unknown)}")
        build = {
            "joins": lambda j: Join(j["table"], tuple((Ref.of(a), Ref.of(b)) for a, b in j["on"]), j.get("kind", "inner")),
            "filters": _predicate,
            "group_by": Ref.of,
            "buckets": lambda b: Bucket(Ref.of(b["column"]), b["grain"]),
            "aggregations": lambda a: Aggregation(a["fn"], Ref.of(a["column"]) if a.get("column") else None, a["alias"]),
            "having": lambda h: Having(h["alias"], h["op"], _literal(h["value"])),
            "order_by": lambda o: Order(Ref.of(o["column"]) if o.get("column") else None, o.get("alias"), o.get("descending", False)),
            "projection": Ref.of,
        }
        return cls(**{k: tuple(build[k](x) for x in v) if k in build else v for k, v in data.items()})

    @classmethod
    def from_json(cls, text: str) -> Plan:
        return cls.from_dict(json.loads(text))

    def but(self, **changes: Any) -> Plan:
        return replace(self, **changes)


def _plain(x: Any) -> Any:
    if isinstance(x, Ref):
        return str(x)
    if isinstance(x, Literal):
        return {"type": x.type, "value": x.plain()}
    if isinstance(x, tuple):
        return [_plain(v) for v in x]
    if is_dataclass(x):
        out = {f.name: _plain(getattr(x, f.name)) for f in fields(x)}
        return {"is": type(x).__name__, **out} if isinstance(x, Predicate) else out
    return x


def _literal(x: Any) -> Literal:
    return Literal(x["type"], x["value"]) if isinstance(x, dict) else Literal.of(x)


def _predicate(x: dict[str, Any]) -> Predicate:
    x = dict(x)
    kind = {k.__name__: k for k in (Compare, Member, Between, IsNull, Like)}.get(x.pop("is", None))
    if kind is None:
        raise ValueError("a filter must say which kind it is")
    x["column"] = Ref.of(x["column"])
    if kind is Compare:
        x["value"] = Ref.of(x["value"]) if isinstance(x["value"], str) else _literal(x["value"])
    elif kind is Member:
        x["values"] = tuple(map(_literal, x["values"]))
    elif kind is Between:
        x["low"], x["high"] = _literal(x["low"]), _literal(x["high"])
    return kind(**x)
