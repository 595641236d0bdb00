"""The approved catalog: what may be read, how tables join, and what is measured."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import types as T

DTYPES = ("int", "float", "str", "datetime", "bool", "json")
PII_LEVELS = ("none", "low", "high")

_SPARK_DTYPE = {
    T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int",
    T.FloatType: "float", T.DoubleType: "float", T.DecimalType: "float",
    T.BooleanType: "bool", T.DateType: "datetime", T.TimestampType: "datetime", T.TimestampNTZType: "datetime",
}


def dtype_of(data_type: T.DataType) -> str:
    """The catalog type of a Spark type; anything unknown is text."""
    return _SPARK_DTYPE.get(type(data_type), "str")


@dataclass(frozen=True, order=True)
class Ref:
    """A column of a table."""

    table: str
    column: str

    @classmethod
    def of(cls, text: str | Ref) -> Ref:
        if isinstance(text, Ref):
            return text
        table, dot, column = text.rpartition(".")
        if not dot or not table or not column:
            raise ValueError(f"{text!r} is not of the form Table.Column")
        return cls(table, column)

    def __str__(self) -> str:
        return f"{self.table}.{self.column}"


@dataclass(frozen=True)
class Column:
    name: str
    dtype: str = "str"
    pii: str = "none"
    is_numeric: bool | None = None
    label_for: str | None = None
    unit: str | None = None
    values: tuple[str, ...] = ()
    description: str = ""

    def __post_init__(self) -> None:
        if self.dtype not in DTYPES or self.pii not in PII_LEVELS:
            raise ValueError(f"column {self.name}: unknown type {self.dtype!r} or level {self.pii!r}")
        if self.values and self.pii != "none":
            raise ValueError(f"column {self.name}: stored values of personal data may not be listed")

    @property
    def numeric(self) -> bool:
        return self.dtype in ("int", "float") if self.is_numeric is None else self.is_numeric


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    description: str = ""
    display_column: str | None = None

    @cached_property
    def by_name(self) -> dict[str, Column]:
        return {c.name: c for c in self.columns}


@dataclass(frozen=True)
class JoinKey:
    """A foreign key: the left side has many rows for one on the right."""

    many: str
    one: str

    @property
    def many_ref(self) -> Ref:
        return Ref.of(self.many)

    @property
    def one_ref(self) -> Ref:
        return Ref.of(self.one)


@dataclass(frozen=True)
class Synonym:
    term: str
    target: str


@dataclass(frozen=True)
class Approval:
    version: str
    approved_by: str
    approved_at: str


@dataclass(frozen=True)
class Metric:
    """A named measure: ``plan`` (aggregates over one table tree), ``ratio`` (two aggregates) or
    ``builtin`` (a registered function over the session's views)."""

    id: str
    kind: str = "plan"
    source: str = ""
    aggregations: tuple[str, ...] = ()
    numerator: str | None = None
    denominator: str | None = None
    group_by: tuple[str, ...] = ()
    joins: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    description: str = ""

    def __post_init__(self) -> None:
        wanted = {"plan": bool(self.source and self.aggregations), "ratio": bool(self.source and self.numerator and self.denominator), "builtin": bool(self.tables)}
        if self.kind not in wanted:
            raise ValueError(f"metric {self.id}: unknown kind {self.kind!r}")
        if not wanted[self.kind]:
            raise ValueError(f"metric {self.id}: a {self.kind} metric lacks what defines it")


@dataclass(frozen=True)
class Catalog:
    name: str
    tables: tuple[Table, ...]
    join_keys: tuple[JoinKey, ...] = ()
    synonyms: tuple[Synonym, ...] = ()
    metrics: tuple[Metric, ...] = ()
    instructions: tuple[str, ...] = ()
    max_limit: int = 10_000
    require_limit: bool = True
    allow_any_join: bool = False
    approval: Approval | None = None

    def __post_init__(self) -> None:
        names = [t.name for t in self.tables]
        metric_ids = [m.id for m in self.metrics]
        for what, items in (("table", names), ("metric", metric_ids)):
            twice = {x for x in items if items.count(x) > 1}
            if twice:
                raise ValueError(f"{what} named twice: {sorted(twice)}")
        for key in self.join_keys:
            for ref in (key.many_ref, key.one_ref):
                if self.column(ref) is None:
                    raise ValueError(f"join key names an unknown column: {ref}")

    @cached_property
    def by_name(self) -> dict[str, Table]:
        return {t.name: t for t in self.tables}

    @cached_property
    def spelling(self) -> dict[str, str]:
        """Table names by their lower case."""
        return {t.name.lower(): t.name for t in self.tables}

    def column(self, ref: Ref | str) -> Column | None:
        ref = Ref.of(ref)
        table = self.by_name.get(ref.table)
        return table.by_name.get(ref.column) if table else None

    def is_high_pii(self, ref: Ref) -> bool:
        found = self.column(ref)
        return found is not None and found.pii == "high"

    @cached_property
    def high_pii_names(self) -> frozenset[str]:
        return frozenset(c.name.lower() for t in self.tables for c in t.columns if c.pii == "high")

    def join_allowed(self, a: Ref, b: Ref) -> bool:
        return self.allow_any_join or any({a, b} == {k.many_ref, k.one_ref} for k in self.join_keys)

    def metric(self, metric_id: str) -> Metric | None:
        return next((m for m in self.metrics if m.id == metric_id), None)

    def slice(self, allowed: Iterable[str] | None) -> Catalog:
        """What remains when only some tables may be seen: their keys, synonyms and metrics with them."""
        if allowed is None:
            return self
        keep = set(allowed)
        return replace(
            self,
            tables=tuple(t for t in self.tables if t.name in keep),
            join_keys=tuple(k for k in self.join_keys if {k.many_ref.table, k.one_ref.table} <= keep),
            synonyms=tuple(s for s in self.synonyms if s.target.split(".")[0] in keep),
            metrics=tuple(m for m in self.metrics if metric_tables(m) <= keep),
        )

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Catalog:
        """Strict: an unknown key anywhere is an error."""
        parts = dict(data)
        parts["tables"] = tuple(
            Table(**{**t, "columns": tuple(Column(**{**c, "values": tuple(c.get("values", ()))}) for c in t["columns"])}) for t in data["tables"]
        )
        for name, kind in (("join_keys", JoinKey), ("synonyms", Synonym)):
            parts[name] = tuple(kind(**x) for x in data.get(name, ()))
        parts["metrics"] = tuple(Metric(**{k: tuple(v) if isinstance(v, list) else v for k, v in m.items()}) for m in data.get("metrics", ()))
        parts["instructions"] = tuple(data.get("instructions", ()))
        parts["approval"] = Approval(**data["approval"]) if data.get("approval") else None
        return cls(**parts)

    @classmethod
    def from_json_file(cls, path: str) -> Catalog:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def require_approved(self) -> None:
        if self.approval is None or not (self.approval.approved_by and self.approval.version):
            raise PermissionError(f"catalog {self.name} has no approval; production refuses it")

    def summary(self) -> str:
        """A text for planners: names, types, tags and keys, never rows."""
        lines = []
        for t in self.tables:
            lines.append(f"{t.name}: {t.description}".rstrip(": "))
            for c in t.columns:
                tags = [c.dtype, *([f"pii={c.pii}"] if c.pii != "none" else []), *([c.unit] if c.unit else []), *([f"one of {', '.join(c.values)}"] if c.values else [])]
                lines.append(f"  {c.name} ({'; '.join(tags)})")
        lines += [f"{k.many} -> {k.one}" for k in self.join_keys]
        lines += [f"'{s.term}' means {s.target}" for s in self.synonyms]
        lines += [f"metric {m.id}: {m.description}".rstrip(": ") for m in self.metrics]
        return "\n".join([*lines, *self.instructions])


def metric_tables(metric: Metric) -> set[str]:
    """Every table a metric reads."""
    names = {metric.source, *metric.tables} - {""}
    for spec in (*metric.aggregations, metric.numerator, metric.denominator):
        if spec and spec.count(":") >= 1 and (target := spec.split(":")[1]) != "*":
            names.add(target.split(".")[0])
    names |= {g.split("@")[0].split(".")[0] for g in metric.group_by}
    for j in metric.joins:
        names |= {Ref.of(side.strip()).table for condition in j.split(":")[-1].split(",") for side in condition.split("=")}
    return names
