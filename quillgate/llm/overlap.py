"""Evaluation records that also stand, exactly or almost, in the training split.

Texts are normalised and equal ones become one class. The passages of each evaluation class (every
window of two tokens, and every name, code, number or date by itself) go into Aho-Corasick automata, one
a shard. Every training class is scanned by the automaton of its shard. A hit leads to the evaluation
classes that hold the passage; of each the matched intervals are merged, and one of whose tokens at least
``LEAST_COVERED`` are covered, its names all among them, is a candidate. An exact check of the candidates
follows: names, codes, numbers and dates must be the same ones, and the other words the same up to small
edits. So a pair needs both: coverage by passages found in the training text, and the check.

In the fields named as strict (query text) the check is narrower: all tokens must stand in the same
order, and only where there are names may words of letters differ, by one slip of the hand each.

Shards follow from the check and lose nothing: two texts with the same names share the rarest of them,
so that token is the shard key. Texts without any use the prefix principle: if at least four fifths of
their tokens agree, the rarest fifth and one more of either share a token. A token that is the rarest of
very many texts is split into blocks of both sides. What is a name is told from the whole corpus: a
token with a digit, or a word that nearly always has a capital where sentence and layout don't ask for one
and doesn't mostly begin sentences.

Within a shard, a class is looked up through its rare passages only: its commonest ones, as many as
cover less than ``LEAST_COVERED`` of it, can't make it a candidate by themselves. Nothing is lost by that
either, and passages that stand in every text of a hot shard don't bring up all of its classes.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.workspace import materialize, shuffle_width

WINDOW, LEAST_COVERED, LEAST_ALIKE, LEAST_ALIKE_PLAIN, NAME_SHARE = 2, 0.3, 0.6, 0.8, 0.9
#: Evaluation and training classes that one automaton meets at most.
BLOCK = 20_000
#: Tokens that are a larger share of all than one in so many; no more than that number can be.
COMMON = 50_000

_INVISIBLE = regex.compile(r"\p{Cf}+")
_THOUSANDS = regex.compile(r"(?<=\d),(?=\d{3}(?!\d))")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[-./:_][\p{L}\p{M}]*\p{N}+)*")
_PARTS = regex.compile(r"([^\p{L}\p{M}\p{N}]*+)([\p{L}\p{M}\p{N}]+(?:[-./:_][\p{L}\p{M}]*\p{N}+)*)")
_COMMENT, _LINE_COMMENT = regex.compile(r"/\*.*?\*/", regex.S), regex.compile(r"--[^\n]*")
_SEPARATOR = regex.compile(r"[-./:_]")
_SQL = regex.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\p{N}+(?:\.\p{N}+)?|[\p{L}_][\p{L}\p{M}\p{N}_]*|<>|<=|>=|!=|\|\||\S")

# the kinds of a token as the splitters report them: a word seen with or without a capital, a word whose
# capital says nothing, a token that is surely a name or number, one that surely isn't, a word that begins
# a sentence or follows a quote, bracket or dash
LOWER, CAPITAL, UNTOLD, SURE, PLAIN, START = 0, 1, 2, 3, 4, 5
_SURE, _PLAIN = str(SURE), str(PLAIN)
_OPENS = frozenset(".?!:;…\"'“”‘’«»()[]-–—")


def clean(text: str) -> str:
    """One Unicode form, without invisible characters and thousands separators."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _THOUSANDS.sub("", text)


_SEEN: dict[str, tuple[str, bool, bool]] = {}


def _word(w: str) -> tuple[str, bool, bool]:
    """The token of a word, whether it has a digit, whether it begins with a capital; kept for words met before."""
    found = _SEEN.get(w)
    if found is None:
        if len(_SEEN) > 200_000:
            _SEEN.clear()
        found = _SEEN[w] = (_SEPARATOR.sub("", w).casefold(), any(c.isnumeric() for c in w), w[0].isupper())
    return found


def split_question(text: str | None) -> tuple[list[str], list[int], str]:
    """Tokens in lower case, their kinds, and the text that equal questions share."""
    found = _PARTS.findall(clean(text)) if text else []
    words = [_word(w) for _, w in found]
    lower = sum(w[0].islower() for _, w in found)
    told = lower >= 0.4 * len(words) and any(upper for _, _, upper in words[1:])
    tokens, kinds = [], []
    for i, (gap, _) in enumerate(found):
        token, digit, upper = words[i]
        tokens.append(token)
        if digit:
            kinds.append(SURE)
        elif not told:
            kinds.append(UNTOLD)
        elif i == 0 or (gap != " " and not _OPENS.isdisjoint(gap)):
            kinds.append(START)
        else:
            kinds.append(CAPITAL if upper else LOWER)
    return tokens, kinds, " ".join(tokens)


def _mark(m: str) -> str:
    """A mark of a query as equal queries share it."""
    m = m.casefold() if m[0] == "'" else m.strip('"`').casefold()
    return m if m.isalnum() else " ".join(m.split())


def split_query(text: str | None) -> tuple[list[str], list[int], str]:
    """The same of a SQL text; queries that differ in layout, case, comments, aliases, the order of
    conditions or in selecting from a named copy of the table share one text."""
    if not text:
        return [], [], ""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = _COMMENT.sub(" ", _LINE_COMMENT.sub(" ", text))
    marks = [n for m in _SQL.findall(text) if (n := _mark(m))]
    while marks and marks[-1] == ";":
        marks.pop()
    marks = _ordered_conditions(_without_aliases(_without_copy(marks)))
    tokens, kinds = [], []
    for m in marks:
        if m[0] == "'":
            inner = [_SEPARATOR.sub("", w) for w in _TOKEN.findall(m)] or [m.replace(" ", "_")]
            tokens += inner
            kinds += [SURE] * len(inner)
        else:
            tokens.append(m.replace(" ", "_"))
            kinds.append(SURE if m[0].isnumeric() else PLAIN)
    return tokens, kinds, " ".join(marks)


def _without_copy(m: list[str]) -> list[str]:
    """``with x as (select * from t ...) select ... from x ...`` read as a select from t."""
    if m[:1] != ["with"] or m[2:8] != ["as", "(", "select", "*", "from", *m[7:8]]:
        return m
    depth, end = 0, -1
    for i in range(3, len(m)):
        depth += (m[i] == "(") - (m[i] == ")")
        if depth == 0:
            end = i
            break
    name, inner, outer = m[1], m[7:end], m[end + 1 :]
    at = [i for i in range(len(outer) - 1) if outer[i] == "from" and outer[i + 1] == name]
    if end < 0 or len(at) != 1 or outer.count(name) != 1 or "where" in outer or any(w in inner for w in ("group", "order", "limit", "select")):
        return m
    return [*outer[: at[0] + 1], *inner, *outer[at[0] + 2 :]]


def _without_aliases(m: list[str]) -> list[str]:
    out: list[str] = []
    i = 0
    while i < len(m):
        if m[i] == "as" and i + 1 < len(m) and (m[i + 1][0].isalpha() or m[i + 1][0] == "_"):
            i += 2
        elif i + 2 < len(m) and m[i + 1] == "." and (m[i][0].isalpha() or m[i][0] == "_"):
            i += 2
        else:
            out.append(m[i])
            i += 1
    return out


def _ordered_conditions(m: list[str]) -> list[str]:
    """Sorts the and-ed conditions of a single where clause that has no or."""
    if m.count("where") != 1 or "or" in m:
        return m
    a = m.index("where") + 1
    b = next((i for i in range(a, len(m)) if m[i] in ("group", "order", "having", "limit", "union", "intersect", "except")), len(m))
    parts: list[list[str]] = [[]]
    depth, between = 0, False
    for w in m[a:b]:
        depth += (w == "(") - (w == ")")
        if w == "and" and depth == 0 and not between:
            parts.append([])
            continue
        if depth == 0:
            between = w == "between" or (between and w != "and")
        parts[-1].append(w)
    flat = [w for i, p in enumerate(sorted(parts)) for w in (["and"] if i else []) + p]
    return m[:a] + flat + m[b:]


def _slip(a: str, b: str) -> bool:
    """Whether one word is the other with one slip of the hand: a letter too many, too few, wrong or swapped."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    where: dict[str, int] = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << i
    row, full = 0, (1 << len(b)) - 1
    for w in a:
        x = row | where.get(w, 0)
        row = x & ~(x - ((row << 1) | 1)) & full
    return row.bit_count()


def alike(a: list[str], a_names: list[bool], b: list[str], b_names: list[bool]) -> float:
    """0 unless both texts have the same names, numbers, codes and dates; else how much of the shorter
    text's other words stands in the other, in order, slips of the hand allowed (of the longer text's
    words, without any slips, where there are no names)."""
    names = Counter(w for w, n in zip(a, a_names, strict=True) if n)
    if names != Counter(w for w, n in zip(b, b_names, strict=True) if n):
        return 0.0
    x = [w for w, n in zip(a, a_names, strict=True) if not n]
    y = [w for w, n in zip(b, b_names, strict=True) if not n]
    if not names:
        return _common(x, y) / max(len(x), len(y), 1)
    if not x or not y:
        return float(len(x) == len(y)) if min(len(a), len(b)) < 3 else 1.0
    swap = _slips(dict.fromkeys(x), dict.fromkeys(y))
    return _common([swap.get(w, w) for w in x], y) / min(len(x), len(y))


_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _variants(word: str) -> set[int]:
    """Hashes of the word and of all that are left when one letter is taken out; linear in its length."""
    codes = [ord(c) + 1 for c in word]
    after, power = [0] * (len(codes) + 1), [1] * (len(codes) + 1)
    for i in range(len(codes) - 1, -1, -1):
        power[len(codes) - i] = power[len(codes) - i - 1] * _BASE % _PRIME
        after[i] = (codes[i] * power[len(codes) - i - 1] + after[i + 1]) % _PRIME
    out, before = {after[0]}, 0
    for i, c in enumerate(codes):
        out.add((before * power[len(codes) - i - 1] + after[i + 1]) % _PRIME)
        before = (before * _BASE + c) % _PRIME
    return out


def _slips(x: dict[str, None], y: dict[str, None]) -> dict[str, str]:
    """For words of ``x`` that ``y`` lacks, the first word of ``y`` (not in ``x``) that is one slip away.

    Two words one slip apart have a variant in common, so each word meets only those; however many words
    there are.
    """
    lost, spare = [w for w in x if w not in y], [w for w in y if w not in x]
    if not lost or not spare:
        return {}
    where: dict[int, list[int]] = {}
    for i, v in enumerate(spare):
        for h in _variants(v):
            where.setdefault(h, []).append(i)
    out = {}
    for w in lost:
        near = sorted({i for h in _variants(w) for i in where.get(h, ())})
        if (at := next((i for i in near if _slip(w, spare[i])), None)) is not None:
            out[w] = spare[at]
    return out


def same_query(a: list[str], a_names: list[bool], b: list[str], b_names: list[bool]) -> float:
    """1 if the tokens are the same in the same order, but for one slip in words of letters if there are names; else 0."""
    if len(a) != len(b) or a_names != b_names:
        return 0.0
    some = any(a_names)
    for w, v, name in zip(a, b, a_names, strict=True):
        if w != v and not (some and not name and min(len(w), len(v)) > 3 and w.isalpha() and v.isalpha() and _slip(w, v)):
            return 0.0
    return 1.0


def is_name(capital, lower, starts):
    """From how often a word has a capital inside a sentence, none, or begins one."""
    return (capital > 0) & (capital >= starts) & (capital >= NAME_SHARE * (capital + lower))


def passages(tokens: list[str], names: list[bool]) -> list[tuple[str, int, int]]:
    """Texts to look for, each with the tokens (first, one past the last) it stands for."""
    n = len(tokens)
    size = min(n, WINDOW)
    spans = [(i, i + size) for i in range(n - size + 1) if size]
    spans += [(i, i + 1) for i in range(n) if names[i] and size > 1]
    return [(f" {' '.join(tokens[i:j])} ", i, j) for i, j in spans]


def covered(spans: list[tuple[int, int]]) -> int:
    """Tokens in the union of intervals."""
    total, reach = 0, 0
    for i, j in sorted(spans):
        total += max(0, j - max(i, reach))
        reach = max(reach, j)
    return total


_SPLIT = "id string, train boolean, split string, source string, field string, class binary, text string, kinds string"


def _split_all(fields: dict[str, Callable]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.select(["id", "train", "split", "source"])
            for name, split in fields.items():
                parts = [split(t) for t in batch.column(name).to_pylist()]
                keep = pa.array([bool(p[0]) for p in parts])
                out = pa.RecordBatch.from_arrays(
                    [
                        *head.columns,
                        pa.array([name] * len(parts)),
                        pa.array([hashlib.blake2b(f"{name}\0{p[2]}".encode("utf-8", "replace"), digest_size=16).digest() for p in parts], pa.binary()),
                        pa.array([" ".join(p[0]) for p in parts], pa.string()),
                        pa.array(["".join(map(str, p[1])) for p in parts], pa.string()),
                    ],
                    names=["id", "train", "split", "source", "field", "class", "text", "kinds"],
                )
                yield out.filter(keep)

    return run


_PLACED = pa.schema([("field", pa.string()), ("class", pa.binary()), ("in_train", pa.bool_()), ("in_eval", pa.bool_()), ("text", pa.string()), ("names", pa.string()), ("anchor", pa.string())])


def _place(common, strict: frozenset[str]):
    """Marks the names of each class and gives it its shard keys; one row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[str, tuple[int, bool]] = common.value

        def rarity(token: str) -> tuple[int, int, str]:
            return often[token][0] if token in often else 0, zlib.crc32(token.encode("utf-8", "replace")), token

        for batch in batches:
            out: dict[str, list] = {n: [] for n in _PLACED.names}
            for row in batch.to_pylist():
                tokens, rare = row["text"].split(" "), set(row["rare_names"] or ())
                names = [k == _SURE or (k != _PLAIN and (often[w][1] if w in often else w in rare)) for w, k in zip(tokens, row["kinds"], strict=True)]
                if any(names):
                    anchors = [min({w for w, n in zip(tokens, names, strict=True) if n}, key=rarity)]
                elif row["field"] in strict:
                    anchors = [min(set(tokens), key=rarity)]
                else:
                    anchors = dict.fromkeys(sorted(tokens, key=rarity)[: int(len(tokens) * (1 - LEAST_ALIKE_PLAIN) + 1e-9) + 1])
                marks = "".join("1" if n else "0" for n in names)
                for a in anchors:
                    for k, v in zip(_PLACED.names, (row["field"], row["class"], row["in_train"], row["in_eval"], row["text"], marks, a), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, _PLACED)

    return run


_FOUND = pa.schema([("field", pa.string()), ("train_class", pa.binary()), ("eval_class", pa.binary()), ("coverage", pa.float64()), ("alike", pa.float64())])


class Shard:
    """The evaluation classes of one shard and the automaton of their passages."""

    def __init__(self) -> None:
        self.classes: list[tuple[bytes, list[str], list[bool], list[tuple[int, int, int]]]] = []
        self.numbers: dict[str, int] = {}
        self.machine: ahocorasick.Automaton | None = None
        self.opens: list[list[int]] = []

    def add(self, name: bytes, tokens: list[str], names: list[bool]) -> None:
        self.classes.append((name, tokens, names, [(self.numbers.setdefault(text, len(self.numbers)), i, j) for text, i, j in passages(tokens, names)]))

    def close(self) -> None:
        """Builds the automaton, and for each passage the classes that a hit of it leads to."""
        self.machine = ahocorasick.Automaton()
        for text, number in self.numbers.items():
            self.machine.add_word(text, number)
        self.machine.make_automaton()
        often = [0] * len(self.numbers)
        for _, _, _, wanted in self.classes:
            for number in {w[0] for w in wanted}:
                often[number] += 1
        self.opens = [[] for _ in often]
        for at, (_, tokens, names, wanted) in enumerate(self.classes):
            few: set[int] = set()
            covers = 0
            for number, i, j in sorted(wanted, key=lambda w: -often[w[0]]):
                more = covers | ((1 << j) - (1 << i))
                if number not in few and more.bit_count() < LEAST_COVERED * len(tokens):
                    covers = more
                else:
                    few.add(number)
            # every name must be met, so the rarest alone will do where it is rarer than those
            own = [number for number, i, j in wanted if j - i == 1 and names[i]]
            best = min(own, key=lambda k: often[k], default=None)
            if best is not None and often[best] <= sum(often[k] for k in few):
                few = {best}
            for number in few:
                self.opens[number].append(at)

    def candidates(self, tokens: list[str]) -> Iterator[tuple[bytes, list[str], list[bool], float]]:
        """Evaluation classes whose passages, where they stand in the text, cover enough of them."""
        hits = {number for _, number in self.machine.iter(f" {' '.join(tokens)} ")}
        for at in {c for number in hits for c in self.opens[number]}:
            name, e_tokens, e_names, wanted = self.classes[at]
            spans = [(i, j) for number, i, j in wanted if number in hits]
            share = covered(spans) / len(e_tokens)
            if share >= LEAST_COVERED:
                inside = {i for i, j in spans for i in range(i, j)}
                if all(i in inside for i, named in enumerate(e_names) if named):
                    yield name, e_tokens, e_names, share


def _scan(strict: frozenset[str]):
    """Rows sorted by shard, evaluation classes first: automaton, scan, merge, check, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {n: [] for n in _FOUND.names}
        here, shard = None, Shard()
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["field"], row["anchor"], row["cell"])
                if key != here:
                    here, shard = key, Shard()
                tokens, names = row["text"].split(" "), [m == "1" for m in row["names"]]
                if not row["scanned"]:
                    shard.add(row["class"], tokens, names)
                    continue
                if not shard.classes:
                    continue
                if shard.machine is None:
                    shard.close()
                check, least = (same_query, 1.0) if row["field"] in strict else (alike, LEAST_ALIKE if any(names) else LEAST_ALIKE_PLAIN)
                for name, e_tokens, e_names, share in shard.candidates(tokens):
                    # the same class is the same text, whatever the check makes of its order
                    score = 1.0 if name == row["class"] else check(e_tokens, e_names, tokens, names)
                    if score >= least:
                        for k, v in zip(_FOUND.names, (row["field"], row["class"], name, share, score), strict=True):
                            found[k].append(v)
                if len(found["field"]) > 10_000:
                    yield pa.RecordBatch.from_pydict(found, _FOUND)
                    found = {n: [] for n in _FOUND.names}
        yield pa.RecordBatch.from_pydict(found, _FOUND)

    return run


def split_records(records: DataFrame, *, id: Column, split: Column, source: Column, fields: dict[str, tuple[Column, Callable]], train: str = "train") -> DataFrame:
    """One row for each record and field with text: normalised class, tokens and their kinds, one digit each.

    A null split is no split and its records are left out; null, empty and unreadable texts (no letter
    or digit) have no row. Other columns are not read, whatever their names.
    """
    columns = [c.cast("string").alias(n) for n, (c, _) in fields.items()]
    base = records.select(id.cast("string").alias("id"), (split == train).alias("train"), split.alias("split"), source.alias("source"), *columns)
    return base.filter("split is not null").mapInArrow(_split_all({n: f for n, (_, f) in fields.items()}), _SPLIT)


def words_of(rows: DataFrame) -> DataFrame:
    """``token, n, named``: how often each token stands in the corpus and whether it is a name."""
    each = rows.select(F.posexplode(F.split("text", " ")).alias("pos", "token"), "kinds").select("token", F.expr("substring(kinds, pos + 1, 1)").alias("kind"))
    counted = each.groupBy("token").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("kind") == str(CAPITAL)).alias("capital"),
        F.count_if(F.col("kind") == str(LOWER)).alias("lower"),
        F.count_if(F.col("kind") == str(START)).alias("starts"),
    )
    return counted.select("token", "n", is_name(F.col("capital"), F.col("lower"), F.col("starts")).alias("named"))


def overlapping_classes(rows: DataFrame, *, strict_fields: tuple[str, ...] = (), block: int = BLOCK, common: int = COMMON) -> DataFrame:
    """``field, train_class, eval_class, coverage, alike`` for the classes that overlap, over ``split_records``.

    A class is named by 16 bytes that tell its field too. ``rows`` are read several times: write them first.
    Tokens of which there are more than one in ``common`` of all (so at most ``common`` tokens, whatever the
    corpus) are known to every task; of the others, none has more occurrences than that, and they are joined.
    """
    spark = rows.sparkSession
    strict = frozenset(strict_fields)
    words = materialize(words_of(rows), "overlap-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    often = words.filter(F.col("n") > total / common)
    known = spark.sparkContext.broadcast({r.token: (r.n, r.named) for r in often.toLocalIterator()})
    rare_names = words.filter((F.col("n") <= total / common) & F.col("named")).select("token")

    flags = [F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval"), F.min(F.struct("text", "kinds")).alias("t")]
    classes = materialize(rows.groupBy("field", "class").agg(*flags).select("field", "class", "in_train", "in_eval", "t.text", "t.kinds"), "overlap-texts")
    each = classes.filter(F.col("kinds").rlike(f"[^{SURE}{PLAIN}]")).select("class", F.explode(F.array_distinct(F.split("text", " "))).alias("token"))
    each = each.join(F.broadcast(often.select("token")), "token", "left_anti").join(rare_names, "token")
    named = each.groupBy("class").agg(F.collect_list("token").alias("rare_names"))
    placed = classes.join(named, "class", "left").mapInArrow(_place(known, strict), "field string, class binary, in_train boolean, in_eval boolean, text string, names string, anchor string")
    placed = materialize(placed, "overlap-placed")

    # a token that is the anchor of very many classes: blocks of evaluation by blocks of training classes
    size = placed.groupBy("field", "anchor").agg(F.count_if("in_eval").alias("n_eval"), F.count_if("in_train").alias("n_train"))
    size = size.filter("n_eval > 0 and n_train > 0").select(
        "field", "anchor", F.ceil(F.col("n_eval") / block).cast("int").alias("e_blocks"), F.ceil(F.col("n_train") / block).cast("int").alias("t_blocks")
    )
    mine = F.xxhash64("class")
    eb, tb = F.pmod(mine, F.col("e_blocks")), F.pmod(mine, F.col("t_blocks"))
    as_eval = F.when(F.col("in_eval"), F.transform(F.sequence(F.lit(0), F.col("t_blocks") - 1), lambda b: F.struct(F.lit(False).alias("scanned"), (eb * F.col("t_blocks") + b).alias("cell"))))
    as_train = F.when(F.col("in_train"), F.transform(F.sequence(F.lit(0), F.col("e_blocks") - 1), lambda b: F.struct(F.lit(True).alias("scanned"), (b * F.col("t_blocks") + tb).alias("cell"))))
    spots = F.concat(F.coalesce(as_eval, F.array()), F.coalesce(as_train, F.array()))
    sharded = placed.join(size, ["field", "anchor"]).select("field", "anchor", "class", "text", "names", F.explode(spots).alias("s")).select("field", "anchor", "class", "text", "names", "s.scanned", "s.cell")
    sharded = sharded.repartition(shuffle_width(spark), "field", "anchor", "cell").sortWithinPartitions("field", "anchor", "cell", "scanned")
    found = sharded.mapInArrow(_scan(strict), "field string, train_class binary, eval_class binary, coverage double, alike double")
    # texts without names meet once for each token of theirs that opens a shard
    return materialize(found.distinct(), "overlap-classes")


def overlapping_pairs(rows: DataFrame, classes: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``train_id, eval_id``: every pair of records whose classes overlap in some field, once.

    A training class that overlaps with very many evaluation records meets them in blocks, so no task
    makes more than ``block`` pairs for one training record.
    """
    evals = rows.filter("not train").select(F.col("class").alias("eval_class"), F.col("id").alias("eval_id"))
    trains = rows.filter("train").select(F.col("class").alias("train_class"), F.col("id").alias("train_id"))
    met = classes.select("train_class", "eval_class").join(evals, "eval_class").select("train_class", "eval_id")
    blocks = met.groupBy("train_class").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    met = met.join(blocks, "train_class").select("train_class", "eval_id", F.pmod(F.hash("eval_id"), F.col("blocks")).alias("part"))
    trains = trains.join(blocks, "train_class").select("train_class", "train_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    return met.join(trains, ["train_class", "part"]).select("train_id", "eval_id").distinct()


def overlap_report(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Per split and source: records with text, and those that overlap with the other side. No pair is formed."""
    hit = classes.select("field", F.col("train_class").alias("class"), F.lit(True).alias("train")).unionByName(
        classes.select("field", F.col("eval_class").alias("class"), F.lit(False).alias("train"))
    )
    hit = hit.distinct().withColumn("_hit", F.lit(1))
    seen = rows.select("field", "class", "train", "id", "split", "source").join(hit, ["field", "class", "train"], "left")
    per = seen.groupBy("split", "source", "id").agg(F.max("_hit").alias("_any"), F.max(F.when(F.col("field") == "question", F.col("_hit"))).alias("_q"), F.max(F.when(F.col("field") == "reference_sql", F.col("_hit"))).alias("_r"))
    return per.groupBy("split", "source").agg(
        F.count("*").alias("n_records"), F.count("_any").alias("n_overlapping"), F.count("_q").alias("n_by_question"), F.count("_r").alias("n_by_query")
    )
