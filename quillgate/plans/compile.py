"""From a plan to a DataFrame. Catalyst does the rest."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgate.plans.catalog import Catalog, Metric, Ref
from quillgate.plans.checks import issues_of, normalize, safe_columns, semi_joins
from quillgate.plans.ir import Aggregation, Between, Bucket, Compare, IsNull, Join, Like, Member, Order, Plan, Predicate
from quillgate.plans.issues import Issue, Rejected

Tables = Callable[[str], DataFrame]

_OPS = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


@dataclass(frozen=True)
class Compiled:
    df: DataFrame
    plan: Plan
    plan_hash: str

    @property
    def units(self) -> dict[str, str]:
        return {f.name: f.metadata["unit"] for f in self.df.schema if "unit" in f.metadata}


def column(ref: Ref) -> SparkColumn:
    return F.col(f"`{ref.table}`.`{ref.column}`")


def predicate(f: Predicate) -> SparkColumn:
    c = column(f.column)
    if isinstance(f, Compare):
        return _OPS[f.op](c, column(f.value) if isinstance(f.value, Ref) else f.value.column())
    if isinstance(f, Member):
        hit = c.isin(*[v.column() for v in f.values])
        return ~hit if f.negated else hit
    if isinstance(f, Between):
        return c.between(f.low.column(), f.high.column())
    if isinstance(f, IsNull):
        return c.isNotNull() if f.negated else c.isNull()
    # the backslash means itself here, as it does where LIKE has no escape by default
    pattern = f.pattern.replace("\\", "\\\\")
    return c.ilike(pattern) if f.ignore_case else c.like(pattern)


def aggregate(a: Aggregation) -> SparkColumn:
    if a.column is None:
        return F.count(F.lit(1))
    c = column(a.column)
    return {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.fn](c)


def truncated(value: SparkColumn, grain: str, source: T.DataType | None) -> SparkColumn:
    """Start of the hour, day, week (Monday), month, quarter or year; without a zone where the source has none."""
    start = F.date_trunc(grain, value)
    return start if isinstance(source, T.TimestampType) else start.cast("timestamp_ntz")


def _named(keys: list[Ref]) -> dict[Ref, str]:
    names = [k.column for k in keys]
    return {k: k.column if names.count(k.column) == 1 else f"{k.table}_{k.column}" for k in keys}


def _with_unit(c: SparkColumn, name: str, unit: str | None) -> SparkColumn:
    return c.alias(name, metadata={"unit": unit}) if unit else c.alias(name)


def _existence(df: DataFrame, plan: Plan, hops: tuple, numbers: tuple[int, ...], tables: Tables) -> DataFrame:
    """Keeps the rows for which some row along the way meets the filters."""
    first, rest = hops[0], hops[1:]
    inner = tables(first.right.table).alias(first.right.table)
    for h in rest:
        inner = inner.join(tables(h.right.table).alias(h.right.table), column(h.left) == column(h.right))
    # filters that look back at the outer row belong to the join's own condition
    condition = column(first.left) == column(first.right)
    inside = {h.right.table for h in hops}
    for i in numbers:
        f = plan.filters[i]
        reads = {f.column.table} | ({f.value.table} if isinstance(f, Compare) and isinstance(f.value, Ref) else set())
        if reads <= inside:
            inner = inner.filter(predicate(f))
        else:
            condition = condition & predicate(f)
    return df.join(inner, condition, "left_semi")


def lower(plan: Plan, catalog: Catalog, tables: Tables) -> DataFrame:
    """The DataFrame of a plan that passed its checks."""
    tests, replaced, _ = semi_joins(plan, catalog)
    tested = {i for _, numbers in tests for i in numbers}
    source = tables(plan.source)
    types = {Ref(plan.source, f.name): f.dataType for f in source.schema}
    df = source.alias(plan.source)
    for j in plan.joins:
        if j.table in replaced:
            continue
        right = tables(j.table)
        types |= {Ref(j.table, f.name): f.dataType for f in right.schema}
        condition = None
        for a, b in j.on:
            each = column(a) == column(b)
            condition = each if condition is None else condition & each
        df = df.join(right.alias(j.table), condition, j.kind)
    for i, f in enumerate(plan.filters):
        if i not in tested:
            df = df.filter(predicate(f))
    for hops, numbers in tests:
        df = _existence(df, plan, hops, numbers, tables)

    unit = {r: c.unit for t in plan.tables if t in catalog.by_name for c in catalog.by_name[t].columns for r in [Ref(t, c.name)]}
    if plan.is_list:
        shown = list(plan.projection or safe_columns(plan, catalog, replaced))
        names = _named(shown)
        # ordering reads the joined rows: it may use columns that aren't shown
        if plan.order_by:
            df = df.orderBy(*[_direction(column(o.column), o) for o in plan.order_by])
        df = df.limit(plan.limit) if plan.limit is not None else df
        return df.select(*[_with_unit(column(r), names[r], unit.get(r)) for r in shown])

    names = _named(list(plan.group_by))
    keys = [column(k).alias(names[k]) for k in plan.group_by]
    keys += [truncated(column(b.column), b.grain, types.get(b.column)).alias(b.alias) for b in plan.buckets]
    measures = [_with_unit(aggregate(a), a.alias, unit.get(a.column) if a.fn not in ("count", "count_distinct") else None) for a in plan.aggregations]
    if measures:
        df = df.groupBy(*keys).agg(*measures)
    else:
        df = df.select(*keys).distinct()
    for h in plan.having:
        df = df.filter(_OPS[h.op](F.col(f"`{h.alias}`"), h.value.column()))
    if plan.order_by:
        at_bucket = {b.column: b.alias for b in plan.buckets}
        order = [F.col(f"`{o.alias or at_bucket.get(o.column) or names[o.column]}`") for o in plan.order_by]
        df = df.orderBy(*[_direction(c, o) for c, o in zip(order, plan.order_by, strict=True)])
    return df.limit(plan.limit) if plan.limit is not None else df


def _direction(c: SparkColumn, o: Order) -> SparkColumn:
    return c.desc_nulls_last() if o.descending else c.asc_nulls_last()


def compile_plan(plan: Plan, catalog: Catalog, tables: Tables) -> Compiled:
    """Normalise, check, lower. Raises ``Rejected`` with everything that is wrong."""
    if plan.source not in catalog.by_name:
        raise Rejected([Issue("catalog.unknown_table", "$.source", f"unknown table {plan.source!r}", "typecheck")])
    plan = normalize(plan, catalog)
    _, _, against = semi_joins(plan, catalog)
    if found := [*issues_of(plan, catalog), *against]:
        raise Rejected(found)
    return Compiled(lower(plan, catalog, tables), plan, plan.digest())


# --- metrics ---------------------------------------------------------------------------------------


def measure(spec: str) -> Aggregation:
    """``fn:Table.Column:alias``, ``count:*`` or ``count:*:alias``."""
    fn, _, rest = spec.partition(":")
    target, _, alias = rest.partition(":")
    return Aggregation(fn, None if target == "*" else Ref.of(target), alias or f"{fn}_{target.replace('.', '_')}".removesuffix("_*"))


def group_key(spec: str) -> Ref | Bucket:
    """``Table.Column`` or ``Table.Column@grain``."""
    name, _, grain = spec.partition("@")
    return Bucket(Ref.of(name), grain) if grain else Ref.of(name)


def join_spec(spec: str) -> Join:
    """``Left:Right:Left.a=Right.b``, more conditions after commas: the join that brings ``Right`` to what holds ``Left``."""
    left, right, conditions = (p.strip() for p in spec.split(":", 2))
    pairs = []
    for condition in conditions.split(","):
        ends = [Ref.of(e.strip()) for e in condition.split("=")]
        if {e.table for e in ends} != {left, right} or len(ends) != 2:
            raise ValueError(f"the join {spec!r} states a condition of other tables")
        pairs.append(tuple(sorted(ends, key=lambda e: e.table != left)))
    return Join(right, tuple(pairs))


def metric_plan(metric: Metric, limit: int | None) -> Plan:
    """The plan a metric stands for; grouped metrics are ranked by their first measure."""
    specs = metric.aggregations if metric.kind == "plan" else (metric.numerator, metric.denominator)
    measures = tuple(measure(s) for s in specs)
    keys = [group_key(g) for g in metric.group_by]
    ranked = (Order(alias=measures[0].alias, descending=True),) if keys and metric.kind == "plan" else ()
    return Plan(
        source=metric.source,
        joins=tuple(join_spec(j) for j in metric.joins),
        group_by=tuple(k for k in keys if isinstance(k, Ref)),
        buckets=tuple(k for k in keys if isinstance(k, Bucket)),
        aggregations=measures,
        order_by=ranked,
        limit=limit,
        plan_id=f"metric:{metric.id}",
    )


Builtin = Callable[[Tables], DataFrame]
_BUILTINS: dict[str, Builtin] = {}


def register_builtin(metric_id: str, build: Builtin) -> None:
    """A trusted function over the session's views, for measures that a plan can't express."""
    _BUILTINS[metric_id] = build


def compile_metric(metric_id: str, catalog: Catalog, tables: Tables, *, limit: int | None = None) -> Compiled:
    metric = catalog.metric(metric_id)
    if metric is None:
        raise Rejected([Issue("catalog.unknown_metric", "$.metric", f"unknown metric {metric_id!r}")])
    limit = min(limit or catalog.max_limit, catalog.max_limit)
    if metric.kind == "builtin":
        if metric_id not in _BUILTINS:
            raise Rejected([Issue("catalog.unknown_metric", "$.metric", f"no function is registered for {metric_id!r}")])
        df = _BUILTINS[metric_id](tables).limit(limit)
        return Compiled(df, Plan(source=metric.tables[0], limit=limit, plan_id=f"metric:{metric_id}"), f"metric:{metric_id}")
    plan = metric_plan(metric, limit)
    if metric.kind == "plan":
        done = compile_plan(plan, catalog, tables)
        return replace(done, plan_hash=f"metric:{metric_id}:{done.plan_hash}")
    parts = compile_plan(plan.but(limit=catalog.max_limit), replace(catalog, require_limit=False), tables)
    whole = lower(parts.plan.but(limit=None), catalog, tables)
    top, bottom = (a.alias for a in plan.aggregations)
    ratio = (F.col(f"`{top}`").cast("double") / F.nullif(F.col(f"`{bottom}`"), F.lit(0))).alias(metric_id)
    df = whole.select(*[F.col(f"`{c}`") for c in whole.columns if c not in (top, bottom)], ratio)
    if metric.group_by:
        df = df.orderBy(F.col(f"`{metric_id}`").desc_nulls_last())
    return Compiled(df.limit(limit), parts.plan, f"metric:{metric_id}:{parts.plan_hash}")
