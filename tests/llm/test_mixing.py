import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgate.llm.mixing import breakpoints, mix_sources, shares


def test_breakpoints_invert_the_distribution():
    u = np.array([0.02, 0.3, 0.5, 0.9, 0.999])
    table = breakpoints(u, 4)
    assert (np.diff(table, axis=1) > 0).all()
    for rate in (0.1, 0.7, 1.0, 2.5, 6.0):
        cdf = np.cumsum([math.exp(-rate) * rate**k / math.factorial(k) for k in range(60)])
        want = np.array([int(np.searchsorted(cdf, x)) for x in u])
        assert ((table <= rate).sum(1) == np.minimum(want, 4)).all()


def _mix(spark, rows, targets, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id bigint, s string, n bigint, source string, copy int")
    return mix_sources(df, doc_id=F.col("id"), source=F.col("s"), size=F.col("n"), targets=targets, **options)


def test_shares_are_met_and_repeats_are_capped(spark):
    rng = random.Random(1)
    rows = [(i, rng.choices(["big", "small", "tiny", "other", None], [70, 20, 2, 6, 2])[0], rng.choice([None, 0] + [rng.randrange(20, 400)] * 20)) for i in range(6000)]
    targets = {"big": (0.6, 1), "small": (0.3, 4), "tiny": (0.1, 2), "absent": (0.0, 3)}
    mix = _mix(spark, rows, targets)
    total = sum(n or 0 for _, s, n in rows if s in targets)
    plan = {p.source: p for p in mix.plan}
    assert plan["tiny"].short and not plan["big"].short and not plan["small"].short and not plan["absent"].short
    got = {r.source: r for r in shares(mix).collect()}
    for s in ("big", "small"):
        assert abs(got[s].mix_tokens - targets[s][0] * total) < 0.004 * total
    for s, (_, most) in targets.items():
        assert got[s].most_used <= most
    size = sum(n or 0 for _, s, n in rows if s == "tiny")
    assert got["tiny"].mix_tokens == 2 * size and got["absent"].copies == 0
    copies = mix.copies.collect()
    assert len({(c.doc_id, c.copy) for c in copies}) == len(copies)
    again = _mix(spark, rows, targets).copies.collect()
    assert sorted(map(str, copies)) == sorted(map(str, again))
    other = _mix(spark, rows, targets, seed=99).copies.collect()
    assert sorted(map(str, copies)) != sorted(map(str, other))


def test_order_hides_source_and_input(spark):
    rows = [(i, "a" if i < 1000 else "b", 10) for i in range(2000)]
    mix = _mix(spark, rows, {"a": (0.5, 1), "b": (0.5, 1)})
    order = [r.source for r in mix.copies.orderBy("position").collect()]
    runs = 1 + sum(x != y for x, y in zip(order, order[1:], strict=False))
    assert runs > len(order) / 3


def test_zero_repeats_empty_table_and_bad_targets(spark):
    mix = _mix(spark, [(1, "a", 10), (2, "b", 30)], {"a": (0.5, 0), "b": (0.5, 1)})
    plan = {p.source: p for p in mix.plan}
    assert plan["a"].short and plan["a"].available == 10 and plan["a"].wanted == 20
    assert [r.source for r in mix.copies.collect()] in (["b"], [])
    empty = _mix(spark, [], {"a": (1.0, 2)})
    assert empty.copies.count() == 0 and not empty.shortfalls()
    with pytest.raises(ValueError):
        _mix(spark, [], {"a": (-1.0, 2)})


def test_many_sources_are_met_as_closely_as_few(spark):
    rows = [(i, f"s{i % 400}", 10 + i % 7) for i in range(40_000)]
    targets = {f"s{k}": (1 / 400, 3) for k in range(400)}
    got = shares(_mix(spark, rows, targets)).collect()
    assert len(got) == 400 and max(abs(r.actual_share * 400 - 1) for r in got) < 0.02
    with pytest.raises(ValueError):
        _mix(spark, [], {str(k): (0.0, 1) for k in range(100_001)})
