"""Plans written fluently: ``Query.over("orders").where(...).by(...).sum(...).top(5, "revenue").plan()``."""

from __future__ import annotations

from typing import Any

from quillgate.plans.catalog import Ref
from quillgate.plans.ir import Aggregation, Between, Bucket, Compare, Having, IsNull, Join, Like, Literal, Member, Order, Plan


class Query:
    def __init__(self, source: str) -> None:
        self._parts: dict[str, Any] = {"source": source}

    @classmethod
    def over(cls, source: str) -> Query:
        return cls(source)

    def _add(self, part: str, *items: Any) -> Query:
        self._parts[part] = (*self._parts.get(part, ()), *items)
        return self

    def where(self, column: str, op: str, value: Any = None, high: Any = None) -> Query:
        ref = Ref.of(column)
        if op in ("in", "not_in"):
            return self._add("filters", Member(ref, tuple(map(Literal.of, value)), op == "not_in"))
        if op == "between":
            return self._add("filters", Between(ref, Literal.of(value), Literal.of(high)))
        if op in ("is_null", "not_null"):
            return self._add("filters", IsNull(ref, op == "not_null"))
        if op in ("like", "ilike"):
            return self._add("filters", Like(ref, value, op == "ilike"))
        return self._add("filters", Compare(ref, op, value if isinstance(value, Ref) else Literal.of(value)))

    def via(self, *tables: str) -> Query:
        return self._add("joins", *[Join(t, ()) for t in tables])

    def join(self, table: str, left: str, right: str, kind: str = "inner") -> Query:
        return self._add("joins", Join(table, ((Ref.of(left), Ref.of(right)),), kind))

    def by(self, *columns: str) -> Query:
        return self._add("group_by", *map(Ref.of, columns))

    def bucket(self, column: str, grain: str) -> Query:
        return self._add("buckets", Bucket(Ref.of(column), grain))

    def agg(self, fn: str, column: str | None, alias: str) -> Query:
        return self._add("aggregations", Aggregation(fn, Ref.of(column) if column else None, alias))

    def having(self, alias: str, op: str, value: float) -> Query:
        return self._add("having", Having(alias, op, Literal.of(value)))

    def order(self, key: str, *, descending: bool = False) -> Query:
        is_column = "." in key
        return self._add("order_by", Order(Ref.of(key) if is_column else None, None if is_column else key, descending))

    def show(self, *columns: str) -> Query:
        return self._add("projection", *map(Ref.of, columns))

    def limit(self, n: int) -> Query:
        self._parts["limit"] = n
        return self

    def top(self, n: int, key: str) -> Query:
        return self.order(key, descending=True).limit(n)

    def plan(self) -> Plan:
        return Plan(**self._parts)
