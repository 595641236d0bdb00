"""Matching the constants of a question to values that are stored."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.plans.catalog import Catalog, Ref
from quillgate.sqlguard.tree import Node

MOST_CANDIDATES, MOST_SIMILAR = 50, 3

Tables = Callable[[str], DataFrame]


def bare(text: str) -> str:
    """Letters and digits only, in lower case."""
    return re.sub(r"[^0-9a-z]", "", text.lower())


def bare_column(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-z]", "")


def lookup(tables: Tables, ref: Ref, text: str, *, most: int = MOST_CANDIDATES) -> DataFrame:
    """``value, n``: stored values that hold the text's words in order, the shortest first."""
    words = re.findall(r"[^\W_]+", text.lower())
    pattern = "%" + "%".join(words) + "%"
    c = F.col(f"`{ref.column}`")
    return (
        tables(ref.table)
        .filter(F.lower(c).like(pattern))
        .groupBy(c.alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.length("value"), "value")
        .limit(most)
    )


def stored_like(tables: Tables, ref: Ref, text: str) -> DataFrame:
    """``value``: stored values equal to the text but for case and signs."""
    c = F.col(f"`{ref.column}`")
    return tables(ref.table).filter(bare_column(c) == bare(text)).select(c.alias("value")).distinct().orderBy("value").limit(MOST_CANDIDATES)


def stored_elsewhere(tables: Tables, catalog: Catalog, ref: Ref, text: str, *, most: int | None = None) -> DataFrame:
    """``column_name, value``: other text columns that store the text; all of them, or the first ``most`` of the catalog.

    A table is read once, whatever the number of its columns.
    """
    others = [Ref(t.name, c.name) for t in catalog.tables for c in t.columns if c.dtype == "str" and c.pii != "high" and Ref(t.name, c.name) != ref][:most]
    parts = []
    for table in dict.fromkeys(o.table for o in others):
        cells = F.explode(F.array(*[F.struct(F.lit(str(o)).alias("column_name"), F.col(f"`{o.column}`").alias("value")) for o in others if o.table == table]))
        parts.append(tables(table).select(cells.alias("c")).select("c.*").filter(bare_column(F.col("value")) == bare(text)).distinct())
    return reduce(DataFrame.unionByName, parts).orderBy("column_name", "value")


def similar(tables: Tables, ref: Ref, text: str) -> list[str]:
    """Up to three stored values that hold the text's words, the shortest first."""
    return [r.value for r in lookup(tables, ref, text, most=MOST_SIMILAR).collect()]


@dataclass(frozen=True)
class Constant:
    """A text a query compares a column with."""

    column: str
    value: str
    negated: bool
    folded: bool


def constants(root: Node) -> list[Constant]:
    """Texts compared by = or IN, also through LOWER, UPPER and TRIM, with NOT in mind."""
    out: list[Constant] = []

    def target(e: Node) -> tuple[str | None, bool]:
        folded = False
        while e.kind in ("UnresolvedFunction", "StringTrim") and e.children and (e.kind == "StringTrim" or ".".join(e.names("nameParts")).lower() in ("lower", "upper", "trim", "lcase", "ucase")):
            folded, e = True, e.children[0]
        return (e.names("nameParts")[-1], folded) if e.kind == "UnresolvedAttribute" else (None, folded)

    def text(e: Node) -> str | None:
        return e.parts["value"] if e.kind == "Literal" and str(e.parts.get("dataType")).startswith("string") else None

    def visit(e: Node, negated: bool) -> None:
        flipped = negated != (e.kind == "Not")
        if e.kind in ("EqualTo", "EqualNullSafe"):
            for a, b in (e.children, e.children[::-1]):
                column, folded = target(a)
                if column and (value := text(b)) is not None:
                    out.append(Constant(column, value, negated, folded))
        elif e.kind == "In":
            column, folded = target(e.children[0])
            out.extend(Constant(column, v, negated, folded) for c in e.children[1:] if column and (v := text(c)) is not None)
        for c in (*e.nested(), *e.children):
            visit(c, flipped)

    visit(root, False)
    return list(dict.fromkeys(out))


_LEXEMES = re.compile(r"--[^\n]*|/\*.*?\*/|\"[^\"]*\"|`[^`]*`|(?P<text>'(?:[^'\\]|\\.|'')*')", re.S)


def respelled(text: str, spelling: dict[str, str], parsed: Callable[[str], Node]) -> str:
    """The query with its compared constants in another spelling; the same text elsewhere stays as it is.

    Whether a text in quotes is a constant that is compared, the parse tells: it is if a mark put in its place is one.
    """
    for m in reversed([m for m in _LEXEMES.finditer(text) if m["text"]]):
        old = m["text"][1:-1].replace("''", "'").replace("\\'", "'").replace("\\\\", "\\")
        if old in spelling:
            mark = f"mark {m.start()}"
            marked = text[: m.start()] + f"'{mark}'" + text[m.end() :]
            if any(c.value == mark and not c.folded for c in constants(parsed(marked))):
                new = spelling[old].replace("\\", "\\\\").replace("'", "\\'")
                text = text[: m.start()] + f"'{new}'" + text[m.end() :]
    return text


@dataclass(frozen=True)
class Grounding:
    replacements: dict[str, str]
    unmatched: list[str]


def ground(root: Node, catalog: Catalog, tables: Tables, reads: set[str], *, most: int | None = None) -> Grounding:
    """For a query's constants (all, or the first ``most``): the stored spelling where there is exactly one, and those stored nowhere.

    A constant compared under NOT may well be stored nowhere; one compared after folding case matches any
    case; one that would be replaced in two ways is left alone.
    """
    targets: dict[str, set[str]] = {}
    unmatched: list[str] = []
    for c in constants(root)[:most]:
        refs = [Ref(t, x.name) for t in sorted(reads) for x in catalog.by_name[t].columns if x.name.lower() == c.column.lower() and x.dtype == "str" and x.pii != "high"]
        if not refs:
            continue
        stored = [r.value for ref in refs for r in stored_like(tables, ref, c.value).collect()]
        hit = [s for s in stored if s == c.value or (c.folded and s.strip().lower() == c.value.strip().lower())]
        if hit:
            continue
        if len(set(stored)) == 1 and not c.folded:
            targets.setdefault(c.value, set()).add(stored[0])
        elif not stored and not c.negated:
            unmatched.append(c.value)
    return Grounding({k: next(iter(v)) for k, v in targets.items() if len(v) == 1}, unmatched)
