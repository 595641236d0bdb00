import random
from collections import Counter

from pyspark.sql import functions as F

from quillgate.llm.terms import LastSeen, labels, mark_terms, term_counts, words

SCHEMA = "question string, tags array<string>, term string, records int, field_name string"


def _run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA)
    out = term_counts(df, {"question": (F.col("question"), words), "tags": (F.col("tags"), labels)}, **options)
    return out


def _brute(rows):
    occurrences, records = Counter(), Counter()
    for q, tags in rows:
        for name, found in (("question", words(q)), ("tags", labels(tags))):
            occurrences.update((name, t) for t in found)
            records.update((name, t) for t in set(found))
    return {k: (n, records[k]) for k, n in occurrences.items()}


def test_against_brute_force_with_flushes(spark):
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(300)] + ["the"] * 200
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(0, 12))), rng.choices(["A", " a ", "b", "", None], k=3)) for _ in range(400)]
    rows += [(None, None), ("", []), ("the the the", None), rows[0]]
    for most in (20, 1_000_000):
        got = {(r.field_name, r.term): (r.occurrences, r.records) for r in _run(spark, rows, max_terms=most).collect()}
        assert got == _brute(rows)


def test_words_and_labels():
    assert words("Café CAFÉ  x2-y_z ٤٥") == ["café", "café", "x2", "y", "z", "٤٥"]
    assert words(None) == [] and words(" .,- ") == []
    assert labels([" A", "a\t", "", None, "  "]) == ["a", "a"] and labels(None) == []


def test_last_seen_over_batches():
    import numpy as np

    c = LastSeen()
    c.feed(["a", "a", "b", "a"], np.array([0, 0, 0, 1]))
    c.feed(["a", "b"], np.array([1, 2]))
    batch = c.flush("f").to_pydict()
    assert dict(zip(batch["term"], zip(batch["occurrences"], batch["records"], strict=True), strict=True)) == {"a": (4, 2), "b": (2, 2)}
    assert not c.slots


def test_marks_and_empty_table(spark):
    rows = [("a b", None)] * 2 + [("c", None)] * 3 + [("c d", None)] * 10 + [("x", None)] * 5
    got = {r.term: r.mark for r in mark_terms(_run(spark, rows), 100, rare_most=2).collect()}
    assert got == {"a": "rare", "b": "rare", "c": "common", "d": None, "x": None}
    assert _run(spark, []).count() == 0
    long = "y" * 300_000 + " z"
    assert _run(spark, [(long, None)]).count() == 2
