"""How often every distinct term occurs, and in how many records.

Last-seen counters: while the records of a task stream by in order, each term keeps its
occurrences, its records and the ordinal of the record it was last seen in; a record counts for a
term only if it differs from that ordinal, so no set of records is ever held. Counters are flushed
at a record border when they hold ``max_terms`` terms and at the end, and the partial counters
(not the tokens) are hash-partitioned by term and added. A term in every record costs one row a
task, so no term is hot.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RUN = regex.compile(r"[\p{L}\p{N}]+")
_PARTIAL = "field_name string, term string, occurrences bigint, records bigint"


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits after composing accents (NFC) and lower-casing."""
    return _RUN.findall(unicodedata.normalize("NFC", text).lower()) if text else []


def labels(values: list | None) -> list[str]:
    """Each value trimmed and in lower case; null and empty ones left out."""
    return [s for v in values or () if v and (s := v.strip().lower())]


class LastSeen:
    """Counters of one field."""

    def __init__(self) -> None:
        self.slots: dict[str, int] = {}
        self.occurrences = np.zeros(1024, np.int64)
        self.records = np.zeros(1024, np.int64)
        self.last = np.full(1024, -1, np.int64)

    def feed(self, tokens: list[str], record: np.ndarray) -> None:
        """``record``: ordinal of each token's record, ascending."""
        if not tokens:
            return
        slots = self.slots
        slot = np.fromiter((slots.setdefault(t, len(slots)) for t in tokens), np.int64, len(tokens))
        if len(slots) > len(self.last):
            room = max(len(slots), 2 * len(self.last)) - len(self.last)
            self.occurrences = np.concatenate([self.occurrences, np.zeros(room, np.int64)])
            self.records = np.concatenate([self.records, np.zeros(room, np.int64)])
            self.last = np.concatenate([self.last, np.full(room, -1, np.int64)])
        order = np.argsort(slot, kind="stable")
        s, r = slot[order], record[order]
        before = np.empty_like(r)
        before[1:] = r[:-1]
        head = np.ones(len(s), bool)
        head[1:] = s[1:] != s[:-1]
        before[head] = self.last[s[head]]
        n = len(slots)
        self.occurrences[:n] += np.bincount(slot, minlength=n)
        self.records[:n] += np.bincount(s[r != before], minlength=n)
        tail = np.append(head[1:], True)
        self.last[s[tail]] = r[tail]

    def flush(self, field: str) -> pa.RecordBatch:
        n = len(self.slots)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([field] * n, pa.string()), pa.array(list(self.slots), pa.string()), pa.array(self.occurrences[:n]), pa.array(self.records[:n])],
            names=["field_name", "term", "occurrences", "records"],
        )
        self.__init__()
        return batch


def _count(fields: dict[str, Callable], max_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = {name: LastSeen() for name in fields}, 0
        for batch in batches:
            for i, (name, split) in enumerate(fields.items()):
                lists = [split(v) for v in batch.column(i).to_pylist()]
                ordinal = np.repeat(np.arange(seen, seen + len(lists)), [len(x) for x in lists])
                counters[name].feed([t for x in lists for t in x], ordinal)
                if len(counters[name].slots) > max_terms:
                    yield counters[name].flush(name)
            seen += batch.num_rows
        for name, c in counters.items():
            if c.slots:
                yield c.flush(name)

    return run


def term_counts(records: DataFrame, fields: dict[str, tuple[Column, Callable]], *, max_terms: int = 1_000_000) -> DataFrame:
    """``field_name, term, occurrences, records`` of every distinct term, each row of ``records`` being a record.

    ``fields`` maps a field's name to its column and to the function that splits a value into terms
    (``words``, ``labels``). Null and empty values have no terms; a repeated row is a record of its
    own; an empty table gives no row. Other columns are not read, whatever their names.
    """
    if not fields:
        raise ValueError("no field to count")
    columns = [c.alias(f"field_{i}") for i, (c, _) in enumerate(fields.values())]
    partial = records.select(*columns).mapInArrow(_count({n: f for n, (_, f) in fields.items()}, max_terms), _PARTIAL)
    return partial.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, n_records: int, *, rare_most: int = 2, common_share: float = 0.1) -> DataFrame:
    """Adds ``mark``: ``rare`` for a term in at most ``rare_most`` records, ``common`` for one in more
    than ``common_share`` of all ``n_records``, else null. A term that is both is rare."""
    return counts.withColumn(
        "mark",
        F.when(F.col("records") <= rare_most, "rare").when(F.col("records") > common_share * n_records, "common"),
    )
