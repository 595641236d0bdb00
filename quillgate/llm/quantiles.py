"""Percentiles of large numeric columns from dyadic Count-sketches.

A value is encoded as an integer code of 16 bits that keeps its order and its first 11 significant
bits (relative error of a decoded value at most 2**-11). A sketch has one signed Count-sketch for each
binary resolution of the codes; where a resolution has no more intervals than its sketch would have
cells it is counted exactly, and the coarser ones are sums of that one (4096 intervals). A percentile
is found by descending the levels, at each going into the half that holds the wanted rank.

A sketch is stored as rows, one a cell that isn't zero, at most ``CELLS`` a group. It is linear: sketches
of days, partitions or groups are merged by adding up cells, which the JVM does before and after the
shuffle, and adding with weight -1 takes records away again. Only a merged sketch reaches Python, a group
at a time, to be descended.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODE_BITS, EXACT_SHIFT, DEPTH, WIDTH_BITS = 16, 4, 3, 11
WIDTH, EXACT, PRIME = 1 << WIDTH_BITS, 1 << (CODE_BITS - EXACT_SHIFT), (1 << 31) - 1
HEAVY = 16
CELLS = EXACT + EXACT_SHIFT * DEPTH * WIDTH


def _multipliers() -> list[tuple[int, int, int, int, int, int]]:
    """(level, row, a, b, c, d): interval x falls into cell (a x + b) mod p mod width, with the sign of (c x + d) mod p mod 2."""
    rng = random.Random(7)
    return [(level, row, *(rng.randrange(1, PRIME) for _ in range(4))) for level in range(EXACT_SHIFT) for row in range(DEPTH)]


HASHES = _multipliers()


def code_of(value: Column, *, unit: float = 1e-3) -> Column:
    """The code of a non-negative number counted in ``unit``s; null for null, NaN, infinite and negative values.

    All numbers of 2**62 units and more share the greatest code.
    """
    most = F.lit(2.0**62 * unit)
    usable = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < F.lit(float("inf")))
    steps = F.when(value >= most, F.lit(2**62 - 1)).otherwise(F.round(value * (1 / unit)).cast("bigint"))
    shift = F.greatest(F.lit(0), F.length(F.bin(steps)) - 11)
    # shiftright takes no column as its second argument in the Python API
    return F.when(usable, F.call_function("shiftleft", shift.cast("int"), F.lit(10)) + F.call_function("shiftright", steps, shift.cast("int"))).cast("int")


def decode(code: np.ndarray, unit: float = 1e-3) -> np.ndarray:
    """The middle of the values that share a code."""
    shift = np.maximum(code // 1024 - 1, 0)
    low = (code - (shift << 10)).astype(np.int64) << shift
    return (low + ((1 << shift) - 1) / 2) * unit


def _places() -> tuple[np.ndarray, np.ndarray]:
    """For each sketched level and row: cell and sign of every interval of that level (shorter levels padded)."""
    cells = np.zeros((EXACT_SHIFT, DEPTH, 1 << CODE_BITS), np.int64)
    signs = np.ones_like(cells)
    for level, row, a, b, c, d in HASHES:
        x = np.arange(1 << (CODE_BITS - level), dtype=np.int64)
        cells[level, row, : len(x)] = EXACT + (level * DEPTH + row) * WIDTH + (a * x + b) % PRIME % WIDTH
        signs[level, row, : len(x)] = 1 - 2 * ((c * x + d) % PRIME % 2)
    return cells, signs


_CELLS, _SIGNS = _places()


def sketch_of(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The whole sketch of codes that occur so often; counts may be negative."""
    out = np.zeros(CELLS, np.int64)
    np.add.at(out, codes >> EXACT_SHIFT, counts)
    for level, row, *_ in HASHES:
        np.add.at(out, _CELLS[level, row, codes >> level], _SIGNS[level, row, codes >> level] * counts)
    return out


def total(sketch: np.ndarray) -> int:
    return int(sketch[:EXACT].sum())


def descend(sketch: np.ndarray, shares: list[float]) -> np.ndarray:
    """For each share the code at the smallest rank that holds it."""
    ranks = np.maximum(np.ceil(np.asarray(shares) * total(sketch) - 1e-9), 1)
    held = np.maximum(sketch[:EXACT], 0)
    sums = np.cumsum(held)
    at = np.minimum(np.searchsorted(sums, ranks), EXACT - 1)
    left_over, parent = ranks - (sums[at] - held[at]), held[at].astype(float)
    for level in range(EXACT_SHIFT - 1, -1, -1):
        low = at * 2
        guess = np.median([sketch[_CELLS[level, r, low]] * _SIGNS[level, r, low] for r in range(DEPTH)], axis=0)
        guess = np.clip(guess, 0, parent)
        right = left_over > guess
        at = low + right
        left_over = np.where(right, left_over - guess, left_over)
        parent = np.where(right, parent - guess, guess)
    return at


def rank_error(sketch: np.ndarray) -> float:
    """Three standard errors of a found rank, as a share of all records.

    The ``HEAVY`` greatest cells of a row are left out: that an interval shares a cell with one of them in
    most rows is much rarer than three standard errors.
    """
    n = total(sketch)
    if n <= 0:
        return 0.0
    squares = np.sort(sketch[EXACT:].reshape(EXACT_SHIFT, DEPTH, WIDTH) ** 2, axis=2)[:, :, :-HEAVY].sum(2)
    return round(float(3 * np.sqrt(np.median(squares, axis=1).sum() / WIDTH) / n), 9)


def sketches(rows: DataFrame, by: dict[str, Column], value: Column, *, unit: float = 1e-3, weight: Column | None = None) -> DataFrame:
    """``*by, cell, n``: a mergeable sketch of the usable values of each group, as its cells that aren't zero.

    Unusable values (null, NaN, infinite, negative) count nothing. ``weight`` (1 unless given) may be
    -1 to delete. A null group is a group of its own; a group without usable values has no row;
    repeated rows and ties all count. Columns that aren't named are not read, whatever their names.
    """
    weight = F.lit(1) if weight is None else weight
    coded = rows.select(*[c.alias(n) for n, c in by.items()], code_of(value, unit=unit).alias("_code"), weight.cast("bigint").alias("_n"))
    counted = coded.filter("_code is not null").groupBy(*by, "_code").agg(F.sum("_n").alias("_n"))
    code = F.col("_code").cast("bigint")
    places = [F.struct(F.shiftright(code, EXACT_SHIFT).cast("int").alias("cell"), F.col("_n").alias("n"))]
    for level, row, a, b, c, d in HASHES:
        x = F.shiftright(code, level)
        cell = F.pmod(F.pmod(x * a + b, F.lit(PRIME)), F.lit(WIDTH)) + EXACT + (level * DEPTH + row) * WIDTH
        odd = F.pmod(F.pmod(x * c + d, F.lit(PRIME)), F.lit(2)) == 1
        places.append(F.struct(cell.cast("int").alias("cell"), F.when(odd, -F.col("_n")).otherwise(F.col("_n")).alias("n")))
    flat = counted.select(*by, F.explode(F.array(*places)).alias("_p")).select(*by, "_p.cell", "_p.n")
    return flat.groupBy(*by, "cell").agg(F.sum("n").alias("n")).filter("n <> 0")


def merge_sketches(cells: DataFrame, groupings: dict[str, list[str]]) -> DataFrame:
    """``grouping, *keys, cell, n``: sketches added up by several groupings at once; keys not grouped by are null.

    Merged sketches merge on.
    """
    keys = list(dict.fromkeys(k for ks in groupings.values() for k in ks))
    types = {f.name: f.dataType for f in cells.schema}
    copies = F.explode(
        F.array(*[F.struct(F.lit(g).alias("grouping"), *[(F.col(k) if k in ks else F.lit(None).cast(types[k])).alias(k) for k in keys]) for g, ks in groupings.items()])
    )
    spread = cells.select(copies.alias("_g"), "cell", "n").select("_g.*", "cell", "n")
    return spread.groupBy("grouping", *keys, "cell").agg(F.sum("n").alias("n")).filter("n <> 0")


def percentiles(cells: DataFrame, shares: dict[str, float], *, unit: float = 1e-3) -> DataFrame:
    """The keys of ``cells``, then ``n``, one column for each share and ``rank_error``.

    A percentile is the value whose rank holds the share, as far as the sketch tells: its rank is off by no
    more than ``rank_error`` of the records, three standard errors. A group all of whose records were taken
    away again has no row.
    """
    keys = [f for f in cells.schema if f.name not in ("cell", "n")]
    names = [f.name for f in keys]
    schema = T.StructType([*keys, T.StructField("n", T.LongType()), *[T.StructField(k, T.DoubleType()) for k in shares], T.StructField("rank_error", T.DoubleType())])

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        sketch = np.zeros(CELLS, np.int64)
        sketch[pdf["cell"].to_numpy()] = pdf["n"].to_numpy()
        n = total(sketch)
        values = decode(descend(sketch, list(shares.values())), unit).tolist() if n > 0 else [None] * len(shares)
        return pdf.iloc[:1][names].assign(n=n, **dict(zip(shares, values, strict=True)), rank_error=rank_error(sketch))

    # a group has at most CELLS rows, however many records it stands for
    return cells.groupBy(*names).applyInPandas(read, schema)


__all__ = ["CELLS", "code_of", "decode", "descend", "merge_sketches", "percentiles", "rank_error", "sketch_of", "sketches", "total"]
