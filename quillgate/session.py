"""A principal's view of the data.

Each approved table becomes a temporary view of an isolated session: filtered by the principal's row
filters, and by those of tables it is linked to, then projected to the columns that may be read.
Policy holds by construction, whatever the query; Catalyst pushes the filters down and turns the links
into semi-joins.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from quillgate.plans.catalog import Catalog, Ref
from quillgate.plans.compile import Compiled, column, compile_metric, compile_plan, predicate
from quillgate.plans.graph import only_way, shortest_ways
from quillgate.plans.ir import Compare, Plan, Predicate
from quillgate.plans.issues import Rejected, reject
from quillgate.sqlguard.guard import Approved, Guard
from quillgate.sqlguard.rewrite import show_ranking_measure
from quillgate.sqlguard.tree import as_dataframe, parse, with_tie_break

Source = str | Callable[[SparkSession], DataFrame]


MOST_COMPILED = 256


@dataclass(frozen=True)
class Principal:
    """Who asks: identity, tenant, tables they may see (None: all) and row filters on them."""

    id: str
    tenant: str = ""
    allowed_tables: frozenset[str] | None = None
    row_filters: tuple[Predicate, ...] = ()

    def filters_key(self) -> str:
        return Plan(source="_", filters=self.row_filters).canonical()


@dataclass(frozen=True)
class Query:
    """An approved query, ready to run."""

    df: DataFrame
    text: str
    query_hash: str
    approved: Approved
    limit: int


@dataclass(frozen=True)
class Options:
    timeout_s: float = 30.0
    max_rows: int = 1000


@dataclass(frozen=True)
class Result:
    columns: list[str]
    rows: list[tuple]
    truncated: bool
    seconds: float = 0.0


@dataclass(frozen=True)
class Audit:
    audit_id: str
    at: float
    principal_id: str
    tenant_id: str
    query_hash: str
    status: str
    row_count: int | None = None
    truncated: bool | None = None
    duration_ms: float | None = None
    error: str | None = None


class TimedOut(Exception):
    pass


class GovernedSession:
    """Views, guard and execution for one principal. Make one a principal and catalog, and keep it."""

    def __init__(
        self,
        spark: SparkSession,
        catalog: Catalog,
        sources: Mapping[str, Source],
        principal: Principal | None = None,
        *,
        production: bool = False,
        audit: Callable[[Audit], None] | None = None,
    ) -> None:
        if production:
            catalog.require_approved()
        self.principal = principal or Principal("local")
        self.full = catalog
        self.catalog = catalog.slice(self.principal.allowed_tables)
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        self.audit = audit
        self._sources = sources
        self._filtered: dict[str, DataFrame] = {}
        self._views: set[str] = set()
        self._compiled: dict[str, Compiled] = {}
        self._lock = threading.Lock()

    # --- tables ------------------------------------------------------------------------------------

    def raw(self, table: str) -> DataFrame:
        source = self._sources[table]
        df = self.spark.read.parquet(source) if isinstance(source, str) else source(self.spark)
        return df.select(*[f"`{c.name}`" for c in self.full.by_name[table].columns])

    def view(self, table: str) -> None:
        """Makes a table's view, the first time it is read; a table is not opened before."""
        if table not in self._views:
            readable = [f"`{c.name}`" for c in self.catalog.by_name[table].columns if c.pii != "high"]
            self.filtered(table).select(*readable).createOrReplaceTempView(table)
            self._views.add(table)

    def filtered(self, table: str) -> DataFrame:
        """All approved columns (high PII too) of the rows the principal may see; for checked plans."""
        if table not in self._filtered:
            df = self.raw(table).alias(table)
            others: dict[str, list[Predicate]] = {}
            for f in self.principal.row_filters:
                tables = {f.column.table} | ({f.value.table} if isinstance(f, Compare) and isinstance(f.value, Ref) else set())
                if tables == {table}:
                    df = df.filter(predicate(f))
                elif len(tables) > 1:
                    reject("sql.row_filter_unreachable", f"$.{table}", "a row filter speaks of one table")
                else:
                    others.setdefault(tables.pop(), []).append(f)
            for target, filters in others.items():
                df = self._linked(df, table, target, filters)
            self._filtered[table] = df
        return self._filtered[table]

    def _linked(self, df: DataFrame, table: str, target: str, filters: list[Predicate]) -> DataFrame:
        """Rows linked to a row of ``target`` that meets the filters, by the only shortest way of keys."""
        way = only_way(self.full, table, target)
        if way is None:
            known = target in shortest_ways(self.full, {table})
            reject("sql.row_filter_ambiguous" if known else "sql.row_filter_unreachable", f"$.{table}", f"no single way of keys from {table} to {target}")
        # from the far end back, so every step is a semi-join against rows already reduced
        inner = self.raw(target).alias(target)
        for f in filters:
            inner = inner.filter(predicate(f))
        for hop in reversed(way[1:]):
            outer = self.raw(hop.left.table).alias(hop.left.table)
            inner = outer.join(inner.alias(hop.right.table), column(hop.left) == column(hop.right), "left_semi")
        return df.join(inner.alias(way[0].right.table), column(way[0].left) == column(way[0].right), "left_semi").alias(table)

    # --- queries -----------------------------------------------------------------------------------

    def plan(self, plan: Plan) -> Compiled:
        """Checks and lowers a plan; the latest plans are kept, as they are asked for again and again."""
        key = plan.digest()
        with self._lock:
            found = self._compiled.pop(key, None)
        found = found or compile_plan(plan, self.catalog, self.filtered)
        with self._lock:
            self._compiled[key] = found
            while len(self._compiled) > MOST_COMPILED:
                self._compiled.pop(next(iter(self._compiled)))
        return found

    def metric(self, metric_id: str, limit: int | None = None) -> Compiled:
        return compile_metric(metric_id, self.catalog, self.filtered, limit=limit)

    def query(self, text: str, *, show_measures: bool = False) -> Query:
        """Checks a query of the SQL dialect; gives its DataFrame with limit and tie-break in place.

        With ``show_measures`` a hidden aggregate that ranks or filters the groups becomes a column.
        """
        parsed = parse(self.spark, text)
        if show_measures:
            parsed = show_ranking_measure(self.spark, parsed) or parsed
        approved = Guard(self.catalog).check(parsed.root)
        for t in sorted(approved.tables):
            self.view(t)
        limit = min(approved.limit or self.catalog.max_limit, self.catalog.max_limit)
        try:
            df = as_dataframe(self.spark, parsed.jvm_plan)
            if approved.limit is not None and approved.ordered and approved.plain_select:
                df = self._tie_broken(parsed.jvm_plan, len(df.columns)) or df
        except (AnalysisException, Py4JJavaError) as e:
            reject("sql.unknown_column", "$", str(e).splitlines()[0], "analyze")
        key = json.dumps([parsed.digest, self.catalog.digest(), self.principal.filters_key()])
        return Query(df.limit(limit), text, f"sql:{hashlib.sha256(key.encode()).hexdigest()}", approved, limit)

    def _tie_broken(self, plan: Any, width: int) -> DataFrame | None:
        """The same query with its outermost sort settled by all output columns."""
        name = lambda p: p.getClass().getSimpleName()
        limits = []
        while name(plan) in ("GlobalLimit", "LocalLimit", "Offset"):
            if name(plan) != "LocalLimit":
                limits.append((name(plan), int(str((plan.limitExpr if name(plan) == "GlobalLimit" else plan.offsetExpr)()))))
            plan = plan.child()
        if name(plan) != "Sort":
            return None
        df = as_dataframe(self.spark, with_tie_break(self.spark, plan, width))
        for kind, n in reversed(limits):
            df = df.limit(n) if kind == "GlobalLimit" else df.offset(n)
        return df

    def sql(self, text: str) -> DataFrame:
        return self.query(text).df

    # --- execution ---------------------------------------------------------------------------------

    def run(self, df: DataFrame, query_hash: str = "", options: Options = Options()) -> Result:
        """At most ``max_rows`` rows to the driver, within the time; every outcome is audited."""
        began = time.monotonic()
        group = f"quillgate-{uuid.uuid4().hex}"
        box: dict[str, Any] = {}
        context = self.spark.sparkContext

        def work() -> None:
            context.setJobGroup(group, query_hash or "query", interruptOnCancel=True)
            try:
                box["rows"] = df.take(options.max_rows + 1)
            except Exception as e:  # noqa: BLE001
                box["error"] = e

        worker = threading.Thread(target=work, daemon=True)
        worker.start()
        worker.join(options.timeout_s)
        if worker.is_alive():
            # a cancel before the job is submitted reaches nothing, so it is repeated
            until = time.monotonic() + 30
            while worker.is_alive() and time.monotonic() < until:
                context.cancelJobGroup(group)
                worker.join(0.3)
            self._record(query_hash, "timeout", began, error=f"more than {options.timeout_s:g} s")
            raise TimedOut(f"the query took more than {options.timeout_s:g} s")
        if "error" in box:
            self._record(query_hash, "error", began, error=str(box["error"]).splitlines()[0])
            if isinstance(box["error"], (PySparkException, Py4JJavaError)):
                raise RuntimeError(f"execution failed: {str(box['error']).splitlines()[0]}") from box["error"]
            raise box["error"]
        rows = [tuple(r) for r in box["rows"]]
        truncated = len(rows) > options.max_rows
        rows = rows[: options.max_rows]
        self._record(query_hash, "ok", began, rows=len(rows), truncated=truncated)
        return Result(df.columns, rows, truncated, time.monotonic() - began)

    def _record(self, query_hash: str, status: str, began: float, *, rows: int | None = None, truncated: bool | None = None, error: str | None = None) -> None:
        if self.audit is not None:
            took = (time.monotonic() - began) * 1000
            self.audit(Audit(uuid.uuid4().hex, time.time(), self.principal.id, self.principal.tenant, query_hash, status, rows, truncated, took, error))


@dataclass
class SessionCache:
    """Sessions by principal, filters and catalog: building views anew for every question costs more than the check."""

    spark: SparkSession
    sources: Mapping[str, Source]
    most: int = 256
    _kept: dict[tuple, GovernedSession] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def get(self, catalog: Catalog, principal: Principal) -> GovernedSession:
        key = (principal.id, principal.tenant, principal.allowed_tables, principal.filters_key(), catalog.digest())
        with self._lock:
            found = self._kept.pop(key, None) or GovernedSession(self.spark, catalog, self.sources, principal)
            self._kept[key] = found
            while len(self._kept) > self.most:
                self._kept.pop(next(iter(self._kept)))
            return found
