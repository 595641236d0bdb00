"""Packing items into containers of fixed capacity with little room left over.

An item larger than the capacity is cut into full containers and a rest; nothing else is cut. The
items of one shard (a hash share of about ``shard_items`` items, so that no task sees more) are packed
by patterns: lengths are binned upwards to 64ths of the capacity, all multisets of at most four bins
that fill a container exactly are enumerated, their repeat counts are fitted to the length histogram by
non-negative least squares and rounded down, and what the patterns leave over goes, longest first, to
the container it fits best, open pattern containers included. The waste that shards add is at most a
part-filled container each.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.workspace import materialize

UNITS = 64


@functools.lru_cache(1)
def patterns(units: int = UNITS, most: int = 4) -> np.ndarray:
    """One column for each multiset of at most ``most`` bins whose sizes sum to ``units``; rows are bins 1..units."""
    found: list[list[int]] = []

    def grow(parts: list[int], least: int, rest: int) -> None:
        if rest == 0:
            found.append(parts)
        elif len(parts) < most:
            for size in range(least, rest + 1):
                if size == rest or (len(parts) < most - 1 and size <= rest - size):
                    grow([*parts, size], size, rest - size)

    grow([], 1, units)
    matrix = np.zeros((units, len(found)))
    for j, parts in enumerate(found):
        np.add.at(matrix[:, j], np.array(parts) - 1, 1)
    return matrix


def fit_counts(histogram: np.ndarray, matrix: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that least-squares fit ``matrix @ x`` to the histogram (accelerated projected gradient)."""
    gram_norm = np.linalg.norm(matrix @ matrix.T, 2)
    x = y = np.zeros(matrix.shape[1])
    t = 1.0
    for _ in range(steps):
        z = np.maximum(y - matrix.T @ (matrix @ y - histogram) / gram_norm, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = z, z + (t - 1) / t2 * (z - x), t2
    return x


def pack_lengths(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each length (1..capacity), numbers counting from 0."""
    n = len(lengths)
    where = np.full(n, -1, np.int64)
    bins = -(-lengths * UNITS // capacity)
    order = np.lexsort((-lengths, bins))
    starts = np.searchsorted(bins[order], np.arange(1, UNITS + 2))
    heads, ends = starts[:-1].copy(), starts[1:]
    matrix = patterns()
    wanted = np.floor(fit_counts((ends - heads).astype(float), matrix) + 1e-9).astype(np.int64)
    room: list[int] = []
    for j in np.flatnonzero(wanted):
        need = matrix[:, j].astype(np.int64)
        used = np.flatnonzero(need)
        times = min(wanted[j], ((ends - heads)[used] // need[used]).min())
        if times <= 0:
            continue
        first = len(room)
        filled = np.zeros(times, np.int64)
        for b in used:
            for _ in range(need[b]):
                take = order[heads[b] : heads[b] + times]
                where[take] = first + np.arange(times)
                filled += lengths[take]
                heads[b] += times
        room += (capacity - filled).tolist()
    # open[r]: containers with r tokens of room; the set bits of ``have`` are the r in use
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = 0
    for i, r in enumerate(room):
        opened[r].append(i)
        have |= 1 << r
    left = np.flatnonzero(where < 0)
    for i in left[np.argsort(-lengths[left], kind="stable")].tolist():
        size = int(lengths[i])
        fits = have >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = opened[r].pop()
            if not opened[r]:
                have &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        where[i] = b
        opened[r - size].append(b)
        have |= 1 << (r - size)
    return where


def pack(items: DataFrame, *, item: Column, size: Column, capacities: list[int], shard_items: int = 20_000) -> DataFrame:
    """Where each piece goes: ``capacity, bin_id, item, piece, first_token, n_tokens``, for every capacity.

    Every item of positive size is placed once for each capacity, in as many pieces as it must be cut
    into (``piece`` counts from 0); ``bin_id`` is unique within a capacity (by number of shard, and of container in it). Items of null or no size
    take no room and are left out; repeated rows are items of their own; ties are broken by the order
    in a shard; an empty table gives no row. Capacities below 1 are refused. Other columns are not
    read, whatever their names.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    sized = items.select(item.cast("bigint").alias("item"), size.cast("bigint").alias("total")).filter("total > 0")
    # written, so that a row keeps its number when a task runs again; repeats of a row spread over all shards
    sized = materialize(sized.withColumn("row", F.monotonically_increasing_id()), "packing-rows")
    shards = max(1, -(-sized.count() // shard_items))
    each = sized.withColumn("capacity", F.explode(F.array(*[F.lit(int(c)).cast("bigint") for c in sorted(set(capacities))])))
    each = each.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).drop("row")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, shard_no = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
        total = pdf["total"].to_numpy(np.int64)
        cut = total // capacity
        rest, where = total % capacity, np.full(len(total), -1, np.int64)
        where[rest > 0] = pack_lengths(rest[rest > 0], capacity)
        # a full piece owns its container: numbers below 0, counted within the shard
        return pd.DataFrame({"capacity": capacity, "item": pdf["item"], "total": total, "full_from": -(shard_no << 32) - 1 - (np.cumsum(cut) - cut), "bin": where + (shard_no << 32)})

    placed = each.groupBy("capacity", "shard").applyInPandas(place, "capacity bigint, item bigint, total bigint, full_from bigint, bin bigint")
    pieces = placed.withColumn("piece", F.explode(F.expr("sequence(0L, (total - 1) div capacity)")))
    full = F.expr("piece < total div capacity")
    first = F.col("piece") * F.col("capacity")
    return pieces.select(
        "capacity",
        F.when(full, F.col("full_from") - F.col("piece")).otherwise(F.col("bin")).alias("bin_id"),
        "item",
        "piece",
        first.alias("first_token"),
        F.least(F.col("capacity"), F.col("total") - first).alias("n_tokens"),
    )
