"""What is asked back, or refused, before and after planning; none of it depends on a model.

A question is read once into what it asks for (``Asked``): kinds of computation, constants and the
things of the catalog it names. A plan or query is read into what it does (``Done``). The rules compare the
two; each has a code and yields a message or nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from quillgate.plans.catalog import Catalog, Ref
from quillgate.plans.ir import Between, Compare, Like, Literal, Member, Plan

MOST_CHARACTERS = 2000


@dataclass(frozen=True)
class Clarify:
    code: str
    message: str


# English words that name nothing in a table, by their kind
_GRAMMAR = {
    "articles and pronouns": "a an the i me my we us our you your he she it its they them their this that these those there one",
    "prepositions": "about above across after against among around as at before below between by during for from in into of off on onto over per since through to toward under until up upon with within without",
    "joining words": "and but if nor not no or so than then while whether also",
    "verbs that help": "am are be been being can could did do does had has have is may might must shall should was were will would",
    "question words": "how what when where which who whom whose why",
    "amounts and order": "all any both each every few fewer fewest first last least less many more most much none only other own same second several some such top different total totals number amount",
    "requests": "compare compute count display find get give list name order please rank return show sort tell",
    "measures": "average mean maximum minimum sum highest lowest largest smallest best worst biggest",
    "time": "date day month quarter week year time",
    "talk of tables": "code data row rows value values type type name names",
}
FUNCTION_WORDS = frozenset(w for words in _GRAMMAR.values() for w in words.split())

# cues: what a computation is called in a question, as runs of words
_CUES = {
    "mean": ("average", "averages", "avg", "mean"),
    "count": ("how many", "number of", "count", "count of"),
    "between aggregates": ("ratio", "percent", "percentage", "per cent", "proportion", "share of", "growth", "divided by", "difference between", "correlation", "median"),
    "extreme": ("most", "fewest", "least", "best", "worst", "highest", "lowest", "largest", "smallest", "biggest"),
}


def words(text: str) -> set[str]:
    """Words of a text and their singulars."""
    found = set(_word_list(text))
    return found | {_singular(w) for w in found}


def _word_list(text: str) -> list[str]:
    spaced = "".join(f" {c}" if c.isupper() and i and text[i - 1].islower() else c for i, c in enumerate(text))
    return "".join(c if c.isascii() and c.isalnum() else " " for c in spaced.lower()).split()


def _singular(word: str) -> str:
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _bare(text: object) -> str:
    return "".join(c for c in str(text).lower() if c.isascii() and c.isalnum())


def _called(name: str) -> set[str]:
    """How a table or column may be called: its words of three letters and more."""
    return {w for w in words(name) if len(w) > 2}


@dataclass(frozen=True)
class Asked:
    question: str
    catalog: Catalog

    @cached_property
    def said(self) -> list[str]:
        return _word_list(self.question)

    @cached_property
    def words(self) -> set[str]:
        return words(self.question)

    def after(self, kind: str) -> list[str] | None:
        """The words after the first cue of a kind; none if there is no such cue."""
        for i in range(len(self.said)):
            for cue in sorted(_CUES[kind], key=len, reverse=True):
                run = cue.split()
                if self.said[i : i + len(run)] == run:
                    return self.said[i + len(run) :]
        if kind == "between aggregates" and "%" in self.question:
            return []
        return None

    def wants(self, kind: str) -> bool:
        return self.after(kind) is not None

    @cached_property
    def quoted(self) -> list[str]:
        parts = re.split(r"(['\"])(.+?)\1", self.question)
        return parts[2::3]

    @cached_property
    def numbers(self) -> list[str]:
        return [w.strip(".,;:?!()") for w in self.question.split() if (n := w.strip(".,;:?!()")).isdigit() and len(n) > 1]

    def tables_called(self, word: str) -> set[str]:
        """Tables that a word of the question names, by their own name or a synonym."""
        forms = {word, _singular(word)}
        named = {t.name for t in self.catalog.tables if forms & words(t.name)}
        return named | {s.target.split(".")[0] for s in self.catalog.synonyms if forms & words(s.term)}

    def first_table(self, said: Iterable[str], most: int) -> tuple[str, set[str]] | None:
        """The first of so many words that names a table."""
        for w in list(said)[:most]:
            if named := self.tables_called(w):
                return w, named
        return None


@dataclass(frozen=True)
class Done:
    """What a plan does."""

    plan: Plan
    catalog: Catalog
    functions: set[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "functions", {a.fn for a in self.plan.aggregations})

    def tables_of(self, *fns: str) -> set[str]:
        return {a.column.table if a.column else self.plan.source for a in self.plan.aggregations if a.fn in fns}

    @cached_property
    def constants(self) -> list[Literal]:
        out: list[Literal] = []
        for f in self.plan.filters:
            match f:
                case Compare(value=Literal() as v):
                    out.append(v)
                case Member():
                    out.extend(f.values)
                case Between():
                    out.extend((f.low, f.high))
                case Like():
                    out.append(Literal("string", f.pattern.strip("%")))
        return out

    def one_for(self, tables: set[str]) -> set[str]:
        """Tables whose key column stands for one of ``tables`` where different values are counted."""
        counted = {a.column for a in self.plan.aggregations if a.fn == "count_distinct"}
        return {k.many_ref.table for k in self.catalog.join_keys if k.many_ref in counted and k.one_ref.table in tables}


# --- before planning ---------------------------------------------------------------------------------


def _is_query(text: str) -> bool:
    """Whether a text is written as a statement: a verb of SQL first, or a SELECT with its FROM anywhere."""
    said = _word_list(text)
    if not said:
        return False
    if {"select", "from"} <= set(said) and said.index("select") + 1 < len(said) - said[::-1].index("from") - 1:
        return True
    return said[0] in ("alter", "create", "delete", "drop", "insert", "merge", "truncate", "update") and bool({"table", "from", "into", "set", "view", "index", "database"} & set(said[1:])) or said[:2] == ["union", "all"]


def before_planning(question: str, catalog: Catalog) -> Clarify | None:
    if not question.strip():
        return Clarify("empty_question", "nothing was asked")
    if len(question) > MOST_CHARACTERS:
        return Clarify("question_too_long", f"a question has at most {MOST_CHARACTERS} characters")
    if _is_query(question):
        return Clarify("sql_in_question", "ask in words; query text isn't read")
    if not catalog.tables:
        return Clarify("no_access", "no table may be read")
    asked = words(question)
    if hit := sorted(n for n in catalog.high_pii_names if words(n) <= asked):
        return Clarify("restricted_request", f"{hit[0]} can't be shown")
    named = {m.id: set(_word_list(m.id)) for m in catalog.metrics if words(m.id) <= asked}
    # a metric whose words are all in another's is the less exact name of the same
    exact = [m for m, w in named.items() if not any(w < other for other in named.values())]
    if len(exact) > 1:
        return Clarify("ambiguous_metric", f"this could mean {' or '.join(sorted(exact))}")
    return None


def unknown_terms(question: str, catalog: Catalog) -> list[str]:
    """Words of the question that match nothing in the catalog; constants (numbers, quoted, capitalised) don't count."""
    texts = [t for s in catalog.synonyms for t in (s.term,)] + [t for m in catalog.metrics for t in (m.id, m.description)]
    for t in catalog.tables:
        texts += [t.name, t.description]
        for c in t.columns:
            texts += [c.name, c.description, *c.values]
    known = FUNCTION_WORDS.union(*map(words, texts)) if texts else FUNCTION_WORDS
    out = []
    for i, piece in enumerate(re.sub(r"(['\"]).*?\1", " ", question).split()):
        w = piece.strip(".,;:?!()")
        if len(w) < 3 or not w.isalpha() or (i and w[0].isupper()):
            continue
        w = w.lower()
        if not {w, _singular(w), w.removesuffix("ed"), w.removesuffix("ing")} & known and w not in out:
            out.append(w)
    return out


def out_of_scope(question: str, catalog: Catalog) -> Clarify | None:
    """Most of what the question speaks of is nothing the catalog knows."""
    lost = unknown_terms(question, catalog)
    met = {w for w in _word_list(question) if len(w) > 2} - FUNCTION_WORDS - set(lost)
    return Clarify("out_of_scope", f"nothing here is called {', '.join(lost)}") if len(lost) > len(met) else None


# --- queries -----------------------------------------------------------------------------------------


def dropped_constants(question: str, sql: str) -> list[str]:
    """Quoted texts and numbers of the question that the query leaves out."""
    asked, flat = Asked(question, Catalog("none", ())), _bare(sql)
    return [v for v in (*asked.numbers, *asked.quoted) if _bare(v) not in flat]


def dropped_measures(question: str, sql: str) -> list[str]:
    """Averages and counts that were asked for but aren't computed."""
    asked = Asked(question, Catalog("none", ()))
    calls = {c.lower() for c in re.findall(r"(\w+)\s*\(", sql)}
    enough = {"mean": ("dropped_average", {"avg", "mean", "median"}, "/" in sql), "count": ("dropped_count", {"count", "sum"}, False)}
    return [code for kind, (code, fns, other) in enough.items() if asked.wants(kind) and not fns & calls and not other]


# --- plans -------------------------------------------------------------------------------------------


def _between_aggregates(a: Asked, d: Done) -> str | None:
    return "it asks for arithmetic between aggregates; only a metric can do that" if a.wants("between aggregates") else None


def _count_missing(a: Asked, d: Done) -> str | None:
    return "a number was asked for and rows are listed" if a.wants("count") and not d.functions else None


def _mean_missing(a: Asked, d: Done) -> str | None:
    return "an average was asked for and none is computed" if a.wants("mean") and "avg" not in d.functions else None


def _mean_of_other(a: Asked, d: Done) -> str | None:
    """An average per thing is an average over rows of that thing."""
    rest, averaged = a.after("mean"), d.tables_of("avg")
    if not rest or "per" not in rest or not averaged:
        return None
    met = a.first_table(rest[rest.index("per") + 1 :], 1)
    return f"an average per {met[0]} is a ratio; rows of {', '.join(sorted(averaged))} are averaged" if met and not averaged <= met[1] else None


def _count_of_other(a: Asked, d: Done) -> str | None:
    """What is asked the number of is what is counted: its rows, or its key in another table."""
    rest, counted = a.after("count"), d.tables_of("count", "count_distinct")
    if not rest or not counted:
        return None
    met = a.first_table([w for w in rest if w not in ("distinct", "different", "unique")], 1)
    if met and not counted & (met[1] | d.one_for(met[1])):
        return f"{met[0]} were asked for, rows of {', '.join(sorted(counted))} are counted"
    return None


def _many_for_one(a: Asked, d: Done) -> str | None:
    """"which x ... most" in the singular has one answer."""
    if "which" not in a.said or not a.wants("extreme") or d.plan.limit == 1:
        return None
    thing = a.said[a.said.index("which") + 1 : a.said.index("which") + 2]
    return f"one {thing[0]} was asked for" if thing and _singular(thing[0]) == thing[0] and a.tables_called(thing[0]) else None


def _constant_missing(a: Asked, d: Done) -> str | None:
    held = {_bare(v.plain()) for v in d.constants}
    lost = next((q for q in a.quoted if _bare(q) and _bare(q) not in held), None)
    return f"nothing is filtered by {lost!r}" if lost else None


def _constant_made_up(a: Asked, d: Done) -> str | None:
    """A filter's text stands in the question (but for its ending) or is a value the catalog lists."""
    listed = {_bare(v) for t in d.catalog.tables for c in t.columns for v in c.values}
    flat = _bare(a.question)
    for v in d.constants:
        text = _bare(v.plain())
        if v.type == "string" and text and text not in listed and text[: max(4, len(text) - 2)] not in flat:
            return f"{v.value!r} isn't in the question"
    return None


def _key_without_meaning(a: Asked, d: Done) -> str | None:
    """Groups shown by a number where the question names the thing."""
    if a.words & {"id", "key", "number"}:
        return None
    keys = {k.many_ref for k in d.catalog.join_keys} | {k.one_ref for k in d.catalog.join_keys}
    for c in d.plan.group_by:
        column = d.catalog.column(c)
        if column is not None and column.dtype == "int" and c in keys:
            return f"{c} is a number without a meaning; group by a name"
    return None


def _thing_missing(a: Asked, d: Done) -> str | None:
    """Tables the question names that the plan never touches."""
    used = set(d.plan.tables)
    touched = {w for t in used for w in _called(t)} | {w for _, _, ref in d.plan.reads() for w in _called(ref.column)}
    if d.plan.is_list:
        touched |= {w for t in used & set(d.catalog.by_name) for c in d.catalog.by_name[t].columns for w in _called(c.name)}
    for s in d.catalog.synonyms:
        if words(s.term) <= a.words and s.target.split(".")[0] not in used:
            return f"{s.term} was asked about and isn't in the plan"
    for t in d.catalog.tables:
        if t.name not in used and (hit := sorted((_called(t.name) & a.words) - touched - FUNCTION_WORDS)):
            return f"{hit[0]} was asked about and isn't in the plan"
    return None


#: The codes are part of the answer's form.
RULES: tuple[tuple[str, Callable[[Asked, Done], str | None]], ...] = (
    ("inexpressible_request", _between_aggregates),
    ("dropped_count", _count_missing),
    ("dropped_average", _mean_missing),
    ("averaged_per_other_entity", _mean_of_other),
    ("counted_other_entity", _count_of_other),
    ("ranked_list_for_singular_question", _many_for_one),
    ("dropped_literals", _constant_missing),
    ("unmatched_values", _constant_made_up),
    ("opaque_grouping_keys", _key_without_meaning),
    ("missing_concepts", _thing_missing),
)


def after_planning(question: str, plan: Plan, catalog: Catalog) -> Clarify | None:
    """The first thing that speaks against a plan as an answer to the question."""
    asked, done = Asked(question, catalog), Done(plan, catalog)
    return next((Clarify(code, message) for code, rule in RULES if (message := rule(asked, done))), None)


def metric_guard(question: str, metric_id: str) -> Clarify | None:
    told = {w for w in _word_list(metric_id) if len(w) > 3}
    return None if told & words(question) else Clarify("unrelated_metric", f"the metric {metric_id} has no word of the question")


__all__ = ["Clarify", "Ref", "after_planning", "before_planning", "dropped_constants", "dropped_measures", "metric_guard", "out_of_scope", "unknown_terms"]
