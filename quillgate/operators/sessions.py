"""Splitting each actor's events into sessions of activity.

Rows are shuffled once by actor and time slice and sorted by actor and time (the secondary
sort); one linear scan over each partition then emits the sessions, holding no more than the
session it is in. The slice (a day unless given) keeps a very busy actor from landing in one
task. A session that may go on in the next slice is emitted as a fragment, and the few
fragments are put in order and joined by the same scan. The pieces, far fewer than the events, are
written to the shared folder in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.functions.moments import epoch_micros
from quillgate.workspace import materialize

_DAY_US = 86_400_000_000
_PIECE = "actor string, start_us bigint, end_us bigint, n bigint, kinds array<string>, kind_counts array<bigint>"


def _scan(gap_us: int):
    """Over pieces sorted by actor and start: join those at most ``gap_us`` apart.

    An event is a piece of its own (start = end). The one open session is carried from batch to
    batch, with a counter for each kind seen in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        actor, start, end, total, kinds = None, 0, 0, 0, {}

        def add(into: dict, names: list, counts: list) -> None:
            for k, c in zip(names, counts, strict=True):
                into[k] = into.get(k, 0) + c

        for batch in batches:
            if not batch.num_rows:
                continue
            who, codes = _codes(batch.column("actor"))
            begin = batch.column("start_us").to_numpy()
            finish = batch.column("end_us").to_numpy()
            weight = batch.column("n").to_numpy()
            new = np.empty(len(begin), bool)
            new[0] = True
            # pieces are disjoint and in order, so the piece before holds the latest time so far
            new[1:] = (codes[1:] != codes[:-1]) | (begin[1:] - finish[:-1] > gap_us)
            firsts = np.flatnonzero(new)
            lasts = np.append(firsts[1:], len(begin)) - 1
            sums = np.add.reduceat(weight, firsts)
            per_kind = _kinds_of(batch, np.cumsum(new) - 1, len(firsts))
            out: list[tuple] = []
            for i, (a, b) in enumerate(zip(firsts.tolist(), lasts.tolist(), strict=True)):
                name = who[codes[a]]
                if i == 0 and actor is not None and name == actor and begin[a] - end <= gap_us:
                    end, total = int(finish[b]), total + int(sums[i])
                    add(kinds, *per_kind[i])
                else:
                    if actor is not None:
                        out.append((actor, start, end, total, kinds))
                    actor, start, end, total, kinds = name, int(begin[a]), int(finish[b]), int(sums[i]), {}
                    add(kinds, *per_kind[i])
            if out:
                yield _pieces(out)
        if actor is not None:
            yield _pieces([(actor, start, end, total, kinds)])

    return run


def _codes(column: pa.Array) -> tuple[list, np.ndarray]:
    enc = column.dictionary_encode()
    return enc.dictionary.to_pylist(), enc.indices.to_numpy()


def _kinds_of(batch: pa.RecordBatch, group: np.ndarray, groups: int) -> list[tuple[list, list]]:
    """For each session of the batch the kinds in it and how often."""
    lists = batch.column("kinds")
    if not len(lists.flatten()):
        return [([], [])] * groups
    row = pc.list_parent_indices(lists).to_numpy()
    names, codes = _codes(lists.flatten())
    pair = group[row].astype(np.int64) * len(names) + codes
    keys, where = np.unique(pair, return_inverse=True)
    counts = np.bincount(where, batch.column("kind_counts").flatten().to_numpy()).astype(np.int64)
    bounds = np.searchsorted(keys // len(names), np.arange(groups + 1))
    kinds = [names[k] for k in (keys % len(names)).tolist()]
    counts = counts.tolist()
    return [(kinds[a:b], counts[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    actors, starts, ends, totals, kinds = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(actors, pa.string()),
            pa.array(starts, pa.int64()),
            pa.array(ends, pa.int64()),
            pa.array(totals, pa.int64()),
            pa.array([list(k) for k in kinds], pa.list_(pa.string())),
            pa.array([list(k.values()) for k in kinds], pa.list_(pa.int64())),
        ],
        names=["actor", "start_us", "end_us", "n", "kinds", "kind_counts"],
    )


def sessionize(
    events: DataFrame,
    *,
    actor: Column,
    at: Column,
    kind: Column | None = None,
    gap_us: int = 30 * 60 * 1_000_000,
    slice_us: int = _DAY_US,
) -> DataFrame:
    """One row per session: ``actor, start_us, end_us, duration_us, n_events, by_kind``.

    A session is a longest run of one actor's events in which each comes at most ``gap_us`` after
    the one before; ``by_kind`` maps each value of ``kind`` to its number of events (a null kind
    counts in ``n_events`` only). ``at`` is a timestamp or microseconds. Events without actor or
    time belong to no session; a blank actor counts as none. Events at the same instant and
    repeated rows all count. No event gives no row. Other columns of ``events`` are not read,
    whatever their names.
    """
    if slice_us <= gap_us:
        raise ValueError("a slice must be longer than the gap")
    micros = epoch_micros(events.sparkSession, at, events.select(at.alias("at")).schema["at"].dataType)
    kind = F.lit(None).cast("string") if kind is None else kind
    single = events.select(actor.cast("string").alias("actor"), micros.alias("start_us"), kind.cast("string").alias("kind"))
    single = single.filter(F.col("start_us").isNotNull() & F.col("actor").rlike(r"\S"))
    pieces = single.select(
        "actor",
        "start_us",
        F.col("start_us").alias("end_us"),
        F.lit(1).cast("bigint").alias("n"),
        F.when(F.col("kind").isNull(), F.array().cast("array<string>")).otherwise(F.array("kind")).alias("kinds"),
        F.when(F.col("kind").isNull(), F.array().cast("array<bigint>")).otherwise(F.array(F.lit(1).cast("bigint"))).alias("kind_counts"),
        (F.col("start_us") - F.pmod(F.col("start_us"), F.lit(slice_us))).alias("slice"),
    )
    scan = _scan(gap_us)
    parts = pieces.repartition("actor", "slice").sortWithinPartitions("actor", "start_us").drop("slice").mapInArrow(scan, _PIECE)
    # read twice below; written, the events are sorted and scanned once
    parts = materialize(parts, "session-pieces")
    # rows from different slices of one actor can share a task and are then joined at once; what
    # lies within the gap of a slice's border may go on elsewhere
    start_in = F.pmod(F.col("start_us"), F.lit(slice_us))
    end_in = F.pmod(F.col("end_us"), F.lit(slice_us))
    at_border = (start_in < gap_us + 1) | (end_in >= slice_us - gap_us)
    parts = parts.withColumn("open", at_border)
    closed = parts.filter("not open").drop("open")
    joined = parts.filter("open").drop("open").repartition("actor").sortWithinPartitions("actor", "start_us").mapInArrow(scan, _PIECE)
    sessions = closed.unionByName(joined)
    return sessions.select(
        "actor",
        "start_us",
        "end_us",
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        F.col("n").alias("n_events"),
        F.map_from_arrays("kinds", "kind_counts").alias("by_kind"),
    )
