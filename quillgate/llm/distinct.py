"""Distinct counts over identifier sets too large to hold.

For each group a set is kept as ``2**precision`` log-log registers: the hash of an identifier names
a register and the rank of the first set bit of its rest; a register holds the greatest rank. Here
the registers are rows, so building them is one aggregation with a partial step before the shuffle,
and merging days, groups or earlier results is the same ``max`` again. Only registers that were hit
exist, so a small set is small. The hash is MD5, so that partial results made anywhere merge.

The standard error of a count is ``1.04 / sqrt(2**precision)`` of it. The estimate is the corrected
harmonic mean over the register histogram, which needs no switch between small and large sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAIL_BITS, PRECISION = 52, 14


def relative_error(precision: int) -> float:
    return 1.04 / math.sqrt(1 << precision)


def register_rows(rows: DataFrame, by: dict[str, Column], values: dict[str, Column], *, precision: int = PRECISION) -> DataFrame:
    """``*by, field_name, register, rank``: the registers of each field's values in each group.

    ``precision`` is 4 to 16. Null and blank values count nothing, a null group is a group of
    its own, repeated rows change nothing, an empty table has no registers. Columns of ``rows`` that
    aren't named in ``by`` or ``values`` are not read, whatever their names.
    """
    if not 4 <= precision <= 16:
        raise ValueError("precision must be 4 to 16")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), c.cast("string").alias("value")) for n, c in values.items()]))
    flat = rows.select(*[c.alias(n) for n, c in by.items()], each.alias("_item"))
    flat = flat.select(*by, "_item.field_name", "_item.value").filter(F.col("value").rlike(r"\S"))
    digest = F.md5(F.col("value"))
    tail = F.conv(F.substring(digest, 5, TAIL_BITS // 4), 16, 10).cast("bigint")
    rank = F.when(F.col("_tail") == 0, TAIL_BITS + 1).otherwise(TAIL_BITS + 1 - F.length(F.bin("_tail")))
    hashed = flat.select(*by, "field_name", F.shiftright(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), 16 - precision).alias("register"), tail.alias("_tail"))
    return hashed.groupBy(*by, "field_name", "register").agg(F.max(rank).cast("int").alias("rank"))


def merge_registers(registers: DataFrame, by: list[str]) -> DataFrame:
    """Registers of coarser groups, or of several results put together by union: the greatest rank of each."""
    return registers.groupBy(*by, "field_name", "register").agg(F.max("rank").alias("rank"))


def merge_groupings(registers: DataFrame, groupings: dict[str, list[str]]) -> DataFrame:
    """Registers of several groupings at once, told apart by ``grouping``; keys not grouped by are null."""
    keys = list(dict.fromkeys(k for ks in groupings.values() for k in ks))
    types = {f.name: f.dataType for f in registers.schema}
    copies = F.explode(
        F.array(*[F.struct(F.lit(g).alias("grouping"), *[(F.col(k) if k in ks else F.lit(None).cast(types[k])).alias(k) for k in keys]) for g, ks in groupings.items()])
    )
    spread = registers.select(copies.alias("_g"), "field_name", "register", "rank").select("_g.*", "field_name", "register", "rank")
    return merge_registers(spread, ["grouping", *keys])


def estimate(registers: DataFrame, by: list[str], *, precision: int = PRECISION) -> DataFrame:
    """``*by, field_name, estimate, std_error, relative_error``: one row per group that has a value."""
    m = 1 << precision
    sums = registers.groupBy(*by, "field_name").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("_hit"), F.count("*").alias("_used"))
    empty = (F.lit(m) - F.col("_used")) / F.lit(float(m))
    # sigma(x) = x + sum over k of x**(2**k) * 2**(k-1)
    terms = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.pow(F.col("_empty"), F.pow(F.lit(2.0), k)) * F.pow(F.lit(2.0), k - 1))
    sigma = F.col("_empty") + F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    count = F.lit(m * m / (2 * math.log(2))) / (F.col("_hit") + m * sigma)
    rel = relative_error(precision)
    out = sums.withColumn("_empty", empty).withColumn("_count", count)
    return out.select(
        *by,
        "field_name",
        F.round("_count").cast("bigint").alias("estimate"),
        F.round(F.col("_count") * rel, 1).alias("std_error"),
        F.lit(rel).alias("relative_error"),
    )
