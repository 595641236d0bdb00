"""python -m quillgate ask|query|plan|metric|import|draft|drift|eval|scorecard|adjudicate|verify ...: the engine from a shell."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession

from quillgate.ask.pipeline import Asker, describe
from quillgate.evals.golden import scorecard
from quillgate.evals.run import adjudicated, cases_of, evaluate, report
from quillgate.evidence import ledger
from quillgate.operators import profile
from quillgate.plans.catalog import Catalog, JoinKey
from quillgate.plans.ir import Plan
from quillgate.plans.issues import Rejected
from quillgate.principals import Registry
from quillgate.session import GovernedSession, Options, Principal
from quillgate.sources.sqlite import import_file


def _tables(folder: str) -> dict[str, str]:
    return {p.stem: str(p) for p in sorted(Path(folder).glob("*.parquet"))}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillgate")
    parser.add_argument("action", choices=["ask", "query", "plan", "metric", "import", "draft", "drift", "eval", "scorecard", "adjudicate", "verify"])
    parser.add_argument("text", nargs="?", default="", help="the question, query, plan (JSON), metric id, SQLite file, table of cases, reports or ledger path")
    parser.add_argument("--data", help="a folder of parquet tables")
    parser.add_argument("--catalog", help="an approved catalog (JSON)")
    parser.add_argument("--principals", help="a registry of principals (JSON)")
    parser.add_argument("--principal")
    parser.add_argument("--rows", type=int, default=20)
    parser.add_argument("--client", help="ask, eval: module:name of a function that makes the client of a catalog")
    parser.add_argument("--key", default="local", help="ask, eval: what evidence is signed with")
    parser.add_argument("--confirm", action="store_true", help="ask: only show the query that would run")
    parser.add_argument("--repeats", type=int, default=1)
    parser.add_argument("--report", help="eval: where the report goes")
    parser.add_argument("--sha256", help="import: the digest the file must have")
    parser.add_argument("--joins", action="store_true", help="draft: propose keys found in the data")
    parser.add_argument("--values", action="store_true", help="draft: list stored values of short text columns")
    o = parser.parse_args(args)
    if o.action == "verify":
        holds, line = ledger.verify(o.text)
        print(f"{'holds' if holds else 'broken'} at line {line}")
        return int(not holds)
    if o.action == "scorecard":
        reports = [json.loads(Path(p).read_text(encoding="utf-8")) for p in o.text.split(",")]
        systems = {Path(p).stem: {c["id"]: c["verdict"] for c in r["cases"]} for p, r in zip(o.text.split(","), reports, strict=True)}
        print(json.dumps(scorecard(systems), indent=1))
        return 0
    if o.action == "adjudicate":
        first, *ratings = (json.loads(Path(p).read_text(encoding="utf-8")) for p in o.text.split(","))
        print(json.dumps(adjudicated(first, ratings), indent=1))
        return 0
    spark = SparkSession.builder.appName("quillgate").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.action == "import":
        for table, rows in import_file(spark, o.text, o.data, sha256=o.sha256).items():
            print(table, rows)
        return 0
    paths = _tables(o.data)
    if o.action == "draft":
        frames = {n: spark.read.parquet(p) for n, p in paths.items()}
        drafted = profile.draft_catalog(Path(o.data).name, {n: f.schema for n, f in frames.items()})
        if o.values:
            stored = {}
            for t in drafted.tables:
                names = [c.name for c in t.columns if c.dtype == "str" and c.pii == "none"]
                stored |= {f"{t.name}.{r.column_name}": r.stored for r in profile.value_lists(frames[t.name], names).collect()}
            drafted = profile.draft_catalog(drafted.name, {n: f.schema for n, f in frames.items()}, values=stored)
        if o.joins:
            drafted = replace(drafted, join_keys=tuple(JoinKey(k.many, k.one) for k in profile.discover_joins(frames, drafted)))
        print(json.dumps(drafted.to_dict(), indent=1, ensure_ascii=False))
        return 0
    catalog = Catalog.from_json_file(o.catalog)
    if o.action == "drift":
        rows = profile.catalog_drift(spark, catalog, {n: spark.read.parquet(p).schema for n, p in paths.items()}).collect()
        for r in rows:
            print(r.severity, r.table_name, r.column_name or "", r.detail)
        return int(any(r.severity == "breaking" for r in rows))
    principal = Registry.from_json(Path(o.principals).read_text(encoding="utf-8")).principal(o.principal) if o.principals else Principal(o.principal or "local")
    session = GovernedSession(spark, catalog, paths, principal)
    if o.action in ("ask", "eval"):
        module, _, name = (o.client or "").partition(":")
        if not name:
            parser.error(f"{o.action} needs a --client")
        asker = Asker(session, getattr(importlib.import_module(module), name)(session.catalog), o.key.encode())
        if o.action == "eval":
            print(json.dumps(report(evaluate(cases_of(spark.read.parquet(o.text)), asker, session, repeats=o.repeats), o.report)["summary"], indent=1))
            return 0
        out = asker.ask(o.text, confirm_only=o.confirm)
        print(out.query if o.confirm and out.query else describe(out, most=o.rows))
        return 0 if out.status in ("ok", "confirm") else 2
    try:
        df = session.sql(o.text) if o.action == "query" else session.metric(o.text).df if o.action == "metric" else session.plan(Plan.from_json(o.text)).df
    except Rejected as e:
        for i in e.issues:
            print(f"{i.code} {i.path}: {i.message}", file=sys.stderr)
        return 2
    result = session.run(df, options=Options(max_rows=o.rows))
    print("\t".join(result.columns))
    for r in result.rows:
        print("\t".join("" if v is None else str(v) for v in r))
    if result.truncated:
        print(f"(cut at {o.rows} rows)", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
