import random

import pytest
from pyspark.sql import functions as F

from quillgate.operators.sessions import sessionize

GAP = 1800_000_000
DAY = 86_400_000_000


def _brute(events, gap=GAP):
    out = {}
    by = {}
    for who, at, kind in events:
        if who and who.strip() and at is not None:
            by.setdefault(who, []).append((at, kind))
    for who, rows in by.items():
        rows.sort(key=lambda r: r[0])
        open_ = None
        for at, kind in rows:
            if open_ is None or at - open_[1] > gap:
                open_ = [at, at, 0, {}]
                out[(who, at)] = open_
            open_[1] = at
            open_[2] += 1
            if kind is not None:
                open_[3][kind] = open_[3].get(kind, 0) + 1
    return {k: (v[1], v[2], v[3]) for k, v in out.items()}


def _spark(spark, events, **options):
    df = spark.createDataFrame(events, "who string, at bigint, kind string")
    df = df.withColumn("actor", F.lit("clash")).withColumn("start_us", F.lit(1)).withColumn("n", F.lit("x"))
    rows = sessionize(df, actor=F.col("who"), at=F.col("at"), kind=F.col("kind"), **options).collect()
    assert len({(r.actor, r.start_us) for r in rows}) == len(rows)
    assert all(r.duration_us == r.end_us - r.start_us for r in rows)
    return {(r.actor, r.start_us): (r.end_us, r.n_events, r.by_kind) for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    events = []
    for _ in range(1500):
        who = rng.choice(["hot"] * 5 + ["a", "b", "c", "d", " ", "", None])
        at = rng.choice([None, rng.randrange(0, 6 * DAY)]) if rng.random() < 0.1 else rng.randrange(0, 6 * DAY, 60_000_000)
        events.append((who, at, rng.choice(["ok", "error", None])))
    events += events[:50]
    assert _spark(spark, events) == _brute(events)


def test_gap_is_inclusive_and_ties_count(spark):
    events = [("a", 0, "x"), ("a", GAP, "x"), ("a", GAP, "y"), ("a", 2 * GAP + 1, None)]
    assert _spark(spark, events) == {("a", 0): (GAP, 3, {"x": 2, "y": 1}), ("a", 2 * GAP + 1): (2 * GAP + 1, 1, {})}


def test_a_session_runs_over_many_slices(spark):
    step = GAP - 1
    events = [("robot", i * step, "ok") for i in range(500)] + [("robot", -DAY, "ok")]
    assert _spark(spark, events) == {("robot", 0): (499 * step, 500, {"ok": 500}), ("robot", -DAY): (-DAY, 1, {"ok": 1})}
    assert _spark(spark, events, slice_us=2 * 3600_000_000) == _brute(events)


def test_timestamps_without_kind_and_empty_input(spark):
    df = spark.sql("select 'a' as who, timestamp_ntz'2024-01-01 00:00:00' as at union all select 'a', timestamp_ntz'2024-01-01 00:10:00'")
    [row] = sessionize(df, actor=F.col("who"), at=F.col("at")).collect()
    assert (row.start_us, row.end_us, row.n_events, row.by_kind) == (1704067200000000, 1704067800000000, 2, {})
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
    [same] = sessionize(df, actor=F.col("who"), at=F.col("at")).collect()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert same == row
    assert sessionize(df.limit(0), actor=F.col("who"), at=F.col("at")).count() == 0
    with pytest.raises(ValueError):
        sessionize(df, actor=F.col("who"), at=F.col("at"), slice_us=GAP)


def test_workspace_is_cleared(spark):
    from quillgate.workspace import clear_workspace, materialize

    df = materialize(spark.range(3).toDF("a"), "some")
    assert df.count() == 3 and clear_workspace(spark) >= 1 and clear_workspace(spark) == 0
