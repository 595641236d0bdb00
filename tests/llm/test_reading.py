import random

import numpy as np
from pyspark.sql import functions as F

from quillgate.llm import reading as R

EASY = ["The map is on the desk.", "We read it at noon.", "Do not lose the key.", "Why is the box red?", "Ask for it by name."]
PLAIN = ["After the folders have been checked, the owner signs the market and the page goes live.", "If two reports share one answer, only the first is kept."]
HARD = ["Although the preliminary regression preserves most of the observations, it still depends on whether the partition was authorized before the definition changed, which the committee considered immaterial."]
DENSE = ["Interdepartmental nonobservability obfuscates referential systematization, notwithstanding that the jurisdictional particularization of contingencies presupposes evidentiary commensurability, whereas institutional indistinguishability corroborates hyperdetermination."]


def _text(rng, band):
    return " ".join(rng.choices([EASY, PLAIN, HARD, DENSE][band - 1], k=rng.randrange(2, 9)))


def test_levels_are_learnt_and_every_row_comes_out(spark):
    rng = random.Random(6)
    docs = [(i, _text(rng, 1 + i % 4), "x", 1.0) for i in range(400)]
    docs += [(1000, None, "x", 1.0), (1001, "  \n ", "x", 1.0), (1002, "SELECT a FROM t WHERE b = 'c';", "x", 1.0), (1003, "word " * 60_000, "x", 1.0), (1004, EASY[0], None, None), (1004, EASY[0], None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, band string, level double")
    labels = [(i, f"r{r}", min(4, max(1, 1 + i % 4 + (rng.random() < 0.05)))) for i in range(0, 200) for r in range(2)] + [(5, "r9", None), (77777, "r1", 3)]
    featured = R.with_features(df, F.col("doc_id"), F.col("text"))
    model = R.fit_readers(featured, spark.createDataFrame(labels, "doc_id bigint, reader string, band int"))
    got = R.reading_levels(featured, model).collect()
    assert len(got) == len(docs)
    held_out = [r for r in got if 200 <= r.doc_id < 400]
    assert np.mean([r.band == 1 + r.doc_id % 4 for r in held_out]) > 0.97
    assert all(r.band is None and r.level is None for r in got if r.doc_id in (1000, 1001, 1002))
    assert all(r.band in (1, 2, 3, 4) and abs(r.level - r.band) <= 0.5 for r in got if r.band)
    assert R.with_features(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0


def test_sentences_leave_out_what_is_not_running_text():
    text = "We met Drumlin in the hall.\r\nSELECT x FROM t WHERE y = 'z'\nsome_identifier.part\n- first point\n- second point"
    assert R.sentences(text) == [["we", "met", "in", "the", "hall"], ["first", "point"], ["second", "point"]]
    assert R.sentences("THE MARK DID NOT LOAD.") == [["the", "mark", "did", "not", "load"]]
    assert R.sentences(None) == [] and R.sentences("12 + 34 = 46") == []


def test_thresholds_ascend_and_noise_moves_little():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = 1 + (x[:, 0][:, None] * 3 + rng.logistic(size=(4000, 1)) > np.array([[-2, 0, 3]])).sum(1)
    m = R.OrdinalModel.fit(x, y)
    assert (np.diff(m.thresholds) > 0).all() and abs(m.weights[0]) > 10 * np.abs(m.weights[1:]).max()
    assert (np.abs(m.band(x) - y) <= 1).mean() > 0.95


def test_forgetting_changes_nothing(monkeypatch):
    rng = random.Random(9)
    texts = [_text(rng, 1 + i % 4) + f" plus word{chr(97 + i % 26)}{chr(97 + i // 26)} (really, it is)" for i in range(80)] + [None, "", " \n", "A.", "x" * 5000, "(((," * 50]
    whole, buckets = R.features(texts)
    monkeypatch.setattr(R, "MOST_KNOWN", 5)
    for i, t in enumerate(texts):
        x, b = R.features([t])
        assert np.allclose(x[0], whole[i]) and (b[0] is None) == (buckets[i] is None) and (b[0] is None or (b[0] == buckets[i]).all())


def test_clauses_open_and_close():
    depth = lambda t: R._running([t]).depth.tolist()
    assert depth("we wait because it rains, and go") == [0, 0, 1, 1, 1, 0, 0]
    assert depth("the map (which we drew) is old. it is new") == [0, 0, 2, 2, 2, 1, 1, 0, 0, 0]
    assert depth("we know that, if it rains, nobody comes") == [0, 0, 1, 2, 2, 2, 1, 1]
