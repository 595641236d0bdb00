"""Catalyst's own parse of a query as a plain Python tree.

This is the only place that touches Spark's internal interface: the session's parser, the JSON of a
plan, and turning a parsed plan into a DataFrame. It needs a classic (not a Connect) session.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from quillgate.plans.issues import reject


@dataclass
class Node:
    kind: str
    children: list[Node] = field(default_factory=list)
    parts: dict[str, Any] = field(default_factory=dict)

    def nested(self) -> Iterator[Node]:
        """Nodes held in fields: expressions of a plan node, plans of a subquery expression."""

        def inside(v: Any) -> Iterator[Node]:
            if isinstance(v, Node):
                yield v
            elif isinstance(v, list):
                for x in v:
                    yield from inside(x)
            elif isinstance(v, dict):
                for x in v.values():
                    yield from inside(x)

        for v in self.parts.values():
            yield from inside(v)

    def walk(self) -> Iterator[Node]:
        yield self
        for n in (*self.nested(), *self.children):
            yield from n.walk()

    def names(self, part: str) -> list[str]:
        """A list of identifiers, which the JSON has as text."""
        text = self.parts.get(part) or "[]"
        return [x.strip() for x in text[1:-1].split(",")] if isinstance(text, str) else list(text)


_IDLE = {"class", "num-children", "origin", "exprId", "jvmId", "nonInheritableMetadataKeys"}


def _value(v: Any) -> Any:
    if isinstance(v, list):
        if v and all(isinstance(x, dict) and "class" in x for x in v):
            return _tree(iter(v))
        return [_value(x) for x in v]
    if isinstance(v, dict):
        return {k: _value(x) for k, x in v.items() if k not in _IDLE}
    return v


def _tree(items: Iterator[dict]) -> Node:
    head = next(items)
    node = Node(head["class"].rpartition(".")[2].rstrip("$"), [], {k: _value(v) for k, v in head.items() if k not in _IDLE})
    node.children = [_tree(items) for _ in range(head["num-children"])]
    return node


@dataclass
class Parsed:
    root: Node
    jvm_plan: Any
    digest: str

    @classmethod
    def of(cls, jvm_plan: Any) -> Parsed:
        raw = json.loads(jvm_plan.toJSON())
        digest = hashlib.sha256(json.dumps(_stable(raw), sort_keys=True).encode()).hexdigest()
        return cls(_tree(iter(raw)), jvm_plan, digest)

    def but(self, jvm_plan: Any) -> Parsed:
        return Parsed.of(jvm_plan)


def _stable(v: Any) -> Any:
    """The JSON of a plan without positions in the text and numbers given out anew each time."""
    if isinstance(v, dict):
        return {k: _stable(x) for k, x in v.items() if k not in ("origin", "exprId", "jvmId")}
    return [_stable(x) for x in v] if isinstance(v, list) else v


def parse(spark: SparkSession, text: str) -> Parsed:
    """Parses without running anything; what isn't one statement is refused by the parser.

    The parser reads its settings (how quoted names are read, above all) from the thread's active session, so
    that is this one while it parses.
    """
    sessions = spark.sparkContext._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    try:
        sessions.setActiveSession(spark._jsparkSession)
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (PySparkException, Py4JJavaError) as e:
        message = str(e).splitlines()[0]
        after = text.rstrip().rstrip(";")
        reject("sql.statements" if ";" in after and "end of input" not in message else "sql.parse", "$", message, "parse")
    finally:
        if before.isDefined():
            sessions.setActiveSession(before.get())
        else:
            sessions.clearActiveSession()
    return Parsed.of(plan)


def as_dataframe(spark: SparkSession, jvm_plan: Any) -> DataFrame:
    jvm = spark.sparkContext._jvm
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, jvm_plan), spark)


def with_tie_break(spark: SparkSession, sort: Any, width: int) -> Any:
    """The sort with every output column appended to its keys, so that a limit after it has one answer."""
    ordinals = ", ".join(str(i + 1) for i in range(width))
    extra = spark._jsparkSession.sessionState().sqlParser().parsePlan(f"SELECT 1 ORDER BY {ordinals}").order()
    order = getattr(sort, "order")().appendedAll(extra)
    return sort.copy(order, True, sort.child(), sort.hint())
