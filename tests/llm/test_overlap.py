import random

import pytest
from pyspark.sql import functions as F

from quillgate.llm import overlap as O

SCHEMA = "id string, split string, source string, question string, reference_sql string, class int, field string"


def _rows(spark, records):
    df = spark.createDataFrame([(*r, 1, "x") for r in records], SCHEMA)
    fields = {"question": (F.col("question"), O.split_question), "reference_sql": (F.col("reference_sql"), O.split_query)}
    return O.split_records(df, id=F.col("id"), split=F.col("split"), source=F.col("source"), fields=fields)


def _pairs(spark, records, **options):
    rows = _rows(spark, records)
    classes = O.overlapping_classes(rows, strict_fields=("reference_sql",), **options)
    return {(r.train_id, r.eval_id) for r in O.overlapping_pairs(rows, classes, **options).collect()}


BASE = "What is the average freight among orders that Silsnor Traders delivers between 2018-04-09 and 2018-11-28 for each shipper?"
BACKGROUND = [("thx", "train", "s", "Show the list of all shipments that Mordosk Traders delivers for each carrier? Thank you.", None), ("thy", "train", "s", "Show the list of all orders that Velfen Traders delivers for each carrier? Thanks!", None)] + [(f"bg{i}", "train", "s", f"Show the total for shipments that Name{chr(97 + i)}x Traders carries from {i + 10} to {i + 40}, with freight and orders for each shipper?", None) for i in range(12)]


@pytest.mark.parametrize(
    "other",
    [
        BASE,
        BASE.upper(),
        "hello team - " + BASE.lower() + " - urgent",
        BASE.replace("Silsnor", "Sil​snor").replace(" ", " ", 2),
        BASE.replace("average", "mean").replace("What", "Which"),
        BASE.replace("freight", "frieght").replace("delivers", "delvers"),
        "  " + BASE.replace("the ", "").replace("?", "") + " please (same as last week)",
        "“" + BASE + "”",
        BASE + " Thank you.",
        "Hello team - " + BASE + " Thanks!",
    ],
)
def test_small_edits_form_a_pair(spark, other):
    records = [*BACKGROUND, ("t", "train", "s", BASE, None), ("e", "test", "s", other, None)]
    assert _pairs(spark, records) == {("t", "e")}


@pytest.mark.parametrize("old, new", [("Silsnor", "Silsnar"), ("2018-04-09", "2018-04-08"), ("2018-11-28", "2019-11-28"), ("Silsnor Traders", "Velquornx Traders")])
def test_other_names_numbers_and_dates_form_none(spark, old, new):
    records = [*BACKGROUND, ("t", "train", "s", BASE, None), ("e", "test", "s", BASE.replace(old, new), None)]
    assert _pairs(spark, records) == set()


def test_queries_match_up_to_writing(spark):
    q = "SELECT a, AVG(x) FROM T WHERE n = 'Lod Fen' AND d BETWEEN '2018-01-01' AND '2018-02-01' GROUP BY a"
    same = [
        q.lower().replace(" ", "  ") + " ;",
        "-- checked by hand\n" + q,
        "WITH picked AS (SELECT * FROM T WHERE d BETWEEN '2018-01-01' AND '2018-02-01' AND n = 'Lod Fen') SELECT a, AVG(x) AS answer FROM picked GROUP BY a",
        q.replace("FROM T", "FROM T AS t").replace("AVG(x)", "AVG(t.x)"),
    ]
    other = [q.replace("AVG", "MAX"), q.replace("Fen", "Fel"), q.replace("AND d BETWEEN '2018-01-01' AND '2018-02-01' ", ""), q.replace("BETWEEN '2018-01-01' AND '2018-02-01'", "BETWEEN '2018-02-01' AND '2018-01-01'")]
    records = [("t", "train", "s", None, q)]
    records += [(f"same{i}", "dev", "s", "", x) for i, x in enumerate(same)] + [(f"other{i}", "dev", "s", "  ", x) for i, x in enumerate(other)]
    assert _pairs(spark, records) == {("t", f"same{i}") for i in range(len(same))}


def _brute(records):
    """Every train record against every other, by coverage (texts searched one by one) and the exact check alone."""
    from collections import Counter

    capital, lower, starts = Counter(), Counter(), Counter()
    parsed = {}
    for r in records:
        t, k, _ = O.split_question(r[3])
        parsed[r[0]] = (t, k)
        for w, kind in zip(t, k, strict=True):
            capital[w] += kind == O.CAPITAL
            lower[w] += kind == O.LOWER
            starts[w] += kind == O.START
    named = lambda w, k: k == O.SURE or bool(O.is_name(capital[w], lower[w], starts[w]))
    out = set()
    for a in records:
        for b in records:
            if a[1] == "train" and b[1] not in ("train", None):
                (t, tk), (e, ek) = parsed[a[0]], parsed[b[0]]
                if not t or not e:
                    continue
                tn, en = [named(w, k) for w, k in zip(t, tk, strict=True)], [named(w, k) for w, k in zip(e, ek, strict=True)]
                text = f" {' '.join(t)} "
                spans = [(i, j) for x, i, j in O.passages(e, en) if x in text]
                if O.covered(spans) < O.LEAST_COVERED * len(e):
                    continue
                if O.alike(e, en, t, tn) >= (O.LEAST_ALIKE if any(en) else O.LEAST_ALIKE_PLAIN) or t == e:
                    out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize("block", [3, 20_000])
def test_against_brute_force(spark, block):
    rng = random.Random(8)
    names = [a + b for a in ("Dosk", "Vel", "Prun") for b in ("mor", "tan", "fel")]
    shapes = ["show the total of {x} for {n} since {d} please", "what is the mean {x} that {n} has from {d}", "count all {x} of {n} below {d} for the board", "list every {x} we hold for the whole year"]
    records = []
    for i in range(160):
        text = rng.choice(shapes).format(x=rng.choice(["freight", "sales", "orders", "stock"]), n=rng.choice(names), d=rng.choice(["12", "2018-01-02", "77,000"]))
        words = text.split()
        if rng.random() < 0.4:
            words.insert(0, rng.choice(["please", "hello", "quick:"]))
        if rng.random() < 0.3:
            words.pop(rng.randrange(len(words)))
        records.append((f"r{i:03d}", rng.choice(["train", "train", "dev", "test", None]), "s", rng.choice([" ".join(words)] * 9 + [None]), None))
    assert _pairs(spark, records, block=block) == _brute(records)


def test_queries_match_up_to_slips(spark):
    q = "SELECT carrier, SUM(delay_min) FROM departures WHERE carrier = 'Vash Air' AND locid > 40"
    near = [q.replace("departures", "depatures"), q.replace("SELECT", "SELCT")]
    far = [q.replace(">", "<"), q.replace("carrier,", "delay_min,"), q.replace("SUM", "MIN"), q.replace("40", "41"), "SELECT carrier FROM depatures"]
    records = [("t", "train", "s", None, q), ("u", "train", "s", None, "SELECT carrier FROM departures")]
    records += [(f"near{i}", "dev", "s", None, x) for i, x in enumerate(near)] + [(f"far{i}", "dev", "s", None, x) for i, x in enumerate(far)]
    assert _pairs(spark, records) == {("t", "near0"), ("t", "near1")}


def test_pairs_come_from_the_hits(spark, monkeypatch):
    shard = O.Shard()
    tokens = "total freight of silsnor since 2018".split()
    names = [False, False, False, True, False, True]
    shard.add(b"e", tokens, names)
    shard.close()
    assert [(n, share) for n, _, _, share in shard.candidates(tokens)] == [(b"e", 1.0)]
    assert list(shard.candidates("total freight of silsnor".split())) == []  # 2018 isn't met
    shard.machine.clear()
    shard.machine.add_word("nothing", 0)
    shard.machine.make_automaton()
    assert list(shard.candidates(tokens)) == []


def test_lookup_through_rare_passages_loses_nothing():
    rng = random.Random(3)
    words = ["show", "the", "total", "of", "x1", "y2", "for", "all", "and", "more"]
    shard, texts = O.Shard(), []
    for i in range(300):
        t = [rng.choice(words) for _ in range(rng.randrange(1, 14))]
        n = [w in ("x1", "y2") for w in t]
        texts.append((str(i).encode(), t, n))
        shard.add(*texts[-1])
    shard.close()
    for _ in range(60):
        scanned = [rng.choice(words) for _ in range(rng.randrange(1, 16))]
        text, wanted = f" {' '.join(scanned)} ", set()
        for name, t, n in texts:
            spans = [(i, j) for x, i, j in O.passages(t, n) if x in text]
            inside = {i for a, b in spans for i in range(a, b)}
            if O.covered(spans) >= O.LEAST_COVERED * len(t) and all(i in inside for i in range(len(t)) if n[i]):
                wanted.add(name)
        assert {c[0] for c in shard.candidates(scanned)} == wanted


@pytest.mark.parametrize("n", [100, 101, 1500])
def test_slips_in_many_words(n):
    a = ["zed7"] + [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}tail" for i in range(n)]
    b = ["zed7"] + [w + "s" for w in a[1:]]
    names = [True] + [False] * n
    assert O.alike(a, names, b, names) == 1.0


def test_slips_against_all_pairs():
    rng = random.Random(5)
    for _ in range(200):
        x, y = ({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))): None for _ in range(8)} for _ in range(2))
        lost, spare = [w for w in x if w not in y], [w for w in y if w not in x]
        assert O._slips(x, y) == {w: next(v for v in spare if O._slip(w, v)) for w in lost if any(O._slip(w, v) for v in spare)}


def test_one_text_in_very_many_records(spark):
    records = [(f"t{i}", "train", "s", BASE, None) for i in range(40)] + [(f"e{i}", "dev", "s", BASE.lower(), None) for i in range(30)] + BACKGROUND
    assert _pairs(spark, records, block=4) == {(f"t{i}", f"e{j}") for i in range(40) for j in range(30)}


def test_report_nulls_and_empty_table(spark):
    records = [("t", "train", "a", BASE, None), ("t2", "train", "a", None, None), ("e", "test", None, BASE, None), ("n", None, "a", BASE, None), ("w", "dev", "a", "", None), ("x", "dev", "a", "...", " ")]
    rows = _rows(spark, records)
    classes = O.overlapping_classes(rows, strict_fields=("reference_sql",))
    assert {(r.split, r.source, r.n_records, r.n_overlapping, r.n_by_question, r.n_by_query) for r in O.overlap_report(rows, classes).collect()} == {("train", "a", 1, 1, 1, 0), ("test", None, 1, 1, 1, 0)}
    assert _pairs(spark, [("t", "train", "a", "y " * 30_000 + "Zed7", None), ("e", "dev", "a", "y " * 30_000 + "Zed7", None)]) == {("t", "e")}
    assert _pairs(spark, records[1:2]) == set()


def test_intervals_and_slips():
    assert O.covered([(0, 3), (2, 5), (7, 8), (7, 8)]) == 6
    assert O._slip("freight", "frieght") and O._slip("delay", "deay") and O._slip("above", "aboves") and not O._slip("smallest", "largest") and not O._slip("to", "of")
