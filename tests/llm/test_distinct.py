import random

import pytest
from pyspark.sql import functions as F

from quillgate.llm.distinct import estimate, merge_groupings, merge_registers, register_rows, relative_error


def _registers(df, **options):
    return register_rows(df, {"day": F.col("day"), "tenant": F.col("t")}, {"who": F.col("who"), "what": F.col("what")}, **options)


@pytest.mark.parametrize("n", [1, 40, 3000, 60_000])
def test_error_stays_within_bound(spark, n):
    df = spark.range(2 * n).select(F.lit(1).alias("day"), F.lit("t").alias("t"), (F.col("id") % n).cast("string").alias("who"), F.lit("same").alias("what"))
    got = {r.field_name: r for r in estimate(_registers(df, precision=12), ["day"], precision=12).collect()}
    assert abs(got["who"].estimate - n) <= max(1, 4 * relative_error(12) * n)
    assert got["what"].estimate == 1


def test_partial_results_merge_to_the_same(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.choice(["a", "b", None]), f"u{rng.randrange(500)}", f"q{rng.randrange(2000)}", "x", 1) for _ in range(4000)]
    schema = "day int, t string, who string, what string, register string, rank int"
    whole = _registers(spark.createDataFrame(rows, schema))
    parts = [_registers(spark.createDataFrame(p, schema)) for p in (rows[:1000], rows[1000:], rows[:10])]
    merged = merge_registers(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["day", "tenant"])
    key = ["day", "tenant", "field_name", "register", "rank"]
    assert sorted(map(str, merged.select(key).collect())) == sorted(map(str, whole.select(key).collect()))
    groups = {"day": ["day"], "tenant": ["tenant"], "both": ["day", "tenant"]}
    got = {(r.grouping, r.day, r.tenant, r.field_name): r.estimate for r in estimate(merge_groupings(whole, groups), ["grouping", "day", "tenant"]).collect()}
    for g, keep in (("day", lambda r: (r[0], None)), ("tenant", lambda r: (None, r[1])), ("both", lambda r: (r[0], r[1]))):
        for i, field in ((2, "who"), (3, "what")):
            exact = {}
            for r in rows:
                exact.setdefault(keep(r), set()).add(r[i])
            for (day, tenant), values in exact.items():
                assert abs(got[(g, day, tenant, field)] - len(values)) <= 1 + 0.04 * len(values)


def test_nulls_blanks_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, None, " "), (None, "t", "", None)], "day int, t string, who string, what string")
    assert _registers(df).count() == 0
    assert estimate(_registers(df.limit(0)), ["day"]).count() == 0
    with pytest.raises(ValueError):
        _registers(df, precision=20)
