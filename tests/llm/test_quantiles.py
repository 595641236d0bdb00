import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgate.llm.quantiles import CELLS, code_of, decode, descend, merge_sketches, percentiles, rank_error, sketch_of, sketches, total


def _codes(values):
    steps = np.round(np.asarray(values) * 1000).astype(np.int64)
    shift = np.maximum(np.array([int(s).bit_length() for s in steps]) - 11, 0)
    return (shift << 10) + (steps >> shift)


def test_codes_keep_order_and_eleven_bits(spark):
    values = [0.0, 0.001, 0.5, 1.023, 1.024, 2.047, 2.048, 17.25, 999.999, 30000.0, 3.6e6, 1e12]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(code_of(F.col("v")).alias("c")).collect()
    codes = [r.c for r in rows]
    assert codes == sorted(codes) == _codes(values).tolist()
    assert np.allclose(decode(np.array(codes)), values, rtol=2**-11, atol=1e-9)
    top = spark.createDataFrame([(2.0**62 * 1e-3,), (1e19,), (1e300,)], "v double").select(code_of(F.col("v")).alias("c")).collect()
    assert {r.c for r in top} == {(51 << 10) + 2047}
    bad = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-1.0,)], "v double").select(code_of(F.col("v")).alias("c")).collect()
    assert all(r.c is None for r in bad)


@pytest.mark.parametrize("shape", ["lognormal", "spikes", "uniform", "one"])
def test_rank_error_stays_within_bound(shape):
    rng = np.random.default_rng(5)
    values = {"lognormal": rng.lognormal(3, 1.6, 200_000), "spikes": rng.choice([5.0, 7.5, 30000.0, *rng.uniform(1, 900, 5000)], 200_000), "uniform": rng.uniform(0, 1e5, 200_000), "one": np.full(200_000, 12.5)}[shape]
    sketch = np.zeros(CELLS, np.int64)
    for part in np.array_split(values, 9):
        sketch += sketch_of(*np.unique(_codes(part), return_counts=True))
    assert total(sketch) == len(values)
    codes, held = np.sort(_codes(values)), rank_error(sketch)
    assert held < 0.02
    for share, code in zip((0.01, 0.5, 0.9, 0.95, 0.99), descend(sketch, [0.01, 0.5, 0.9, 0.95, 0.99]), strict=True):
        low, high = np.searchsorted(codes, code, "left") / len(codes), np.searchsorted(codes, code, "right") / len(codes)
        assert low - held - 1e-4 <= share <= high + held + 1e-4


def test_sketches_are_linear():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50_000, 4000), rng.integers(0, 50_000, 3000)
    one = lambda x: np.ones(len(x), np.int64)
    both = sketch_of(np.concatenate([a, b]), np.ones(7000, np.int64))
    assert (both == sketch_of(a, one(a)) + sketch_of(b, one(b))).all()
    assert (both - sketch_of(b, one(b)) == sketch_of(a, one(a))).all()
    assert total(sketch_of(np.concatenate([a, a]), np.concatenate([one(a), -one(a)]))) == 0


def test_cells_are_those_of_the_whole_sketch(spark):
    values = np.random.default_rng(4).lognormal(3, 2, 500)
    got = np.zeros(CELLS, np.int64)
    for r in sketches(spark.createDataFrame([(float(v),) for v in values], "v double"), {}, F.col("v")).collect():
        got[r.cell] = r.n
    codes = _codes(values)
    assert (got == sketch_of(codes, np.ones(len(codes), np.int64))).all()


def test_days_combine_and_deletions(spark):
    rng = np.random.default_rng(2)
    rows = [(int(d), b, t, float(v), "c", 1) for d, b, t, v in zip(rng.integers(0, 4, 6000), rng.choice(["x", "y"], 6000), rng.choice(["p", "q"], 6000), rng.lognormal(2, 1, 6000), strict=True)]
    rows += [(0, "x", None, None, "c", 1), (0, "x", None, -1.0, "c", 1), (1, None, "p", 4.0, "c", 1)] + rows[:20]
    df = spark.createDataFrame(rows, "d int, b string, t string, v double, sketch string, n int")
    by = {"day": F.col("d"), "b": F.col("b"), "t": F.col("t")}
    groups = {"b": ["b"], "both": ["b", "t"]}
    daily = sketches(df, by, F.col("v"))
    got = {(r.grouping, r.b, r.t): r for r in percentiles(merge_sketches(daily, groups), {"p50": 0.5, "p99": 0.99}).collect()}
    twice = merge_sketches(merge_sketches(daily.filter("day < 2"), {"both": ["b", "t"]}).unionByName(merge_sketches(daily.filter("day >= 2"), {"both": ["b", "t"]})), groups)
    again = {(r.grouping, r.b, r.t): r for r in percentiles(twice, {"p50": 0.5, "p99": 0.99}).collect()}
    assert got == again
    for (g, b, t), r in got.items():
        exact = np.sort([x[3] for x in rows if x[3] is not None and x[3] >= 0 and x[1] == b and (g == "b" or x[2] == t)])
        assert r.n == len(exact)
        for share, value in ((0.5, r.p50), (0.99, r.p99)):
            lo = exact[max(int(np.floor((share - r.rank_error) * r.n)) - 2, 0)]
            hi = exact[min(int(np.ceil((share + r.rank_error) * r.n)) + 1, r.n - 1)]
            assert lo * 0.999 - 0.001 <= value <= hi * 1.001 + 0.001
    gone = sketches(df.unionByName(df.filter("d > 0").withColumn("n", F.lit(-1))), by, F.col("v"), weight=F.col("n"))
    left = {(r.grouping, r.b): r.n for r in percentiles(merge_sketches(gone, {"b": ["b"]}), {"p50": 0.5}).collect()}
    assert left[("b", "x")] == sum(1 for x in rows if x[0] == 0 and x[1] == "x" and x[3] is not None and x[3] >= 0)
    assert ("b", None) not in left
    assert percentiles(merge_sketches(sketches(df.limit(0), by, F.col("v")), groups), {"p50": 0.5}).count() == 0
