"""Exactly one copy of every message that was delivered at least once.

A keyed state store remembers the identifiers seen lately, with the row kept for each. The
watermark of event time says when an identifier leaves the store. What the store takes for new or
better it claims, and the claims of a run are settled when it has drained its stream: an identifier that
has left the store and comes again is claimed twice, and one of an earlier run stands in that run's
ledger (the late-arrival lookup). So every identifier is shuffled once a run for the lookup, however many
micro-batches there are. State, offsets and verdicts belong to one micro-batch: the folders are named by
batch number and replaced when a batch is replayed, and a settlement is named by the last batch it
covers, so a restart neither loses nor doubles anything.

The kept row is the one with the smallest delivery number, whatever order rows arrive in: a
smaller number arriving later takes over, and the row kept until then is reported instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgate.functions.moments import epoch_micros
from quillgate.workspace import fresh_dir, shuffle_width

_ENTRY = np.dtype([("key", "S16"), ("kept", "<i8"), ("seen_ms", "<i8")])
_NO_TIME = 2**62
_VERDICT = "verdict string, message binary, delivery bigint"


def absorb(known: np.ndarray, arrived: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge arrivals into the entries known: (entries, delivery numbers that repeat, entries new or changed).

    Linear after one sort; every array is of type ``_ENTRY``. Within a message all rows but the
    one with the smallest delivery number are repeats, also the row that was kept so far.
    """
    rows = np.concatenate([known, arrived])
    order = np.lexsort((rows["kept"], rows["key"]))
    rows, was_known = rows[order], order < len(known)
    if not len(rows):
        return rows, np.empty(0, "<i8"), rows
    head = np.empty(len(rows), bool)
    head[0] = True
    head[1:] = rows["key"][1:] != rows["key"][:-1]
    starts = np.flatnonzero(head)
    entries = rows[starts].copy()
    entries["seen_ms"] = np.maximum.reduceat(rows["seen_ms"], starts)
    return entries, rows["kept"][~head], entries[~was_known[starts]]


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = np.frombuffer(state.get[0], _ENTRY) if state.exists else np.empty(0, _ENTRY)
    for pdf in batches:
        again = pdf["again"].to_numpy(bool)
        if again.any():
            yield pd.DataFrame({"verdict": "repeat", "message": b"", "delivery": pdf["delivery"].to_numpy()[again]})
            pdf = pdf[~again]
        arrived = np.empty(len(pdf), _ENTRY)
        arrived["key"] = np.frombuffer(b"".join(pdf["message"]), "S16")
        arrived["kept"] = pdf["delivery"].to_numpy()
        arrived["seen_ms"] = pdf["event_ms"].to_numpy()
        known, repeats, fresh = absorb(known, arrived)
        raw = fresh["key"].tobytes()
        yield pd.DataFrame(
            {
                "verdict": ["repeat"] * len(repeats) + ["kept"] * len(fresh),
                "message": [b""] * len(repeats) + [raw[i : i + 16] for i in range(0, len(raw), 16)],
                "delivery": np.concatenate([repeats, fresh["kept"]]),
            }
        )
    limit = state.getCurrentWatermarkMs()
    state.update((known[known["seen_ms"] >= limit].tobytes(),))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: of each message in a batch, pass on one row; the others are repeats already."""
    for batch in batches:
        rows = np.empty(batch.num_rows, _ENTRY)
        rows["key"] = np.frombuffer(b"".join(batch.column("message").to_pylist()), "S16")
        rows["kept"] = batch.column("delivery").to_numpy()
        rows["seen_ms"] = batch.column("event_ms").to_numpy()
        entries, repeats, _ = absorb(rows[:0], rows)
        raw = entries["key"].tobytes()
        keys = [raw[i : i + 16] for i in range(0, len(raw), 16)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys + [None] * len(repeats), pa.binary()),
                pa.array(np.concatenate([entries["kept"], repeats])),
                pa.array(np.concatenate([entries["seen_ms"], np.full(len(repeats), _NO_TIME)])),
                pa.array(np.arange(len(keys) + len(repeats)) >= len(keys)),
            ],
            names=["message", "delivery", "event_ms", "again"],
        )


@dataclass(frozen=True)
class DedupRun:
    """Where a run left its results: a folder of verdicts a batch, and of late repeats and the ledger a settlement."""

    root: str
    settled: int

    def repeats(self, spark: SparkSession) -> DataFrame:
        """``delivery bigint``: every row that repeats a message, once."""
        if self.settled < 0:
            return spark.createDataFrame([], "delivery bigint")
        found = spark.read.schema(_VERDICT).parquet(f"{self.root}/verdicts").filter("verdict = 'repeat'").select("delivery")
        late = spark.read.schema("delivery bigint, upto bigint").parquet(f"{self.root}/late").select("delivery")
        return found.unionByName(late).distinct()


def run_dedup(
    stream: DataFrame,
    *,
    message: Column,
    delivery: Column,
    event_time: Column,
    watermark: str = "7 days",
    buckets: int | None = None,
    root: str | None = None,
) -> DedupRun:
    """Drain ``stream`` (whatever is available now) and list the rows that repeat a message.

    ``message`` is 16 bytes or null, ``delivery`` a unique bigint. Rows whose message or delivery
    number is null repeat nothing and are left out; a row without event time is found as any other.
    A time without a zone is read as UTC. An empty stream gives no row.
    Other columns, whatever their names, are not touched. The state is held in ``buckets`` (twice the
    shuffle partitions unless given; fixed for a ``root``), 32 bytes a message seen within the watermark:
    choose as many as keep a bucket at some megabytes (``buckets_for``). The folder ``root`` holds the
    checkpoint: starting again with the same ``root`` continues where the last run ended.
    """
    spark = stream.sparkSession
    root = root or fresh_dir(spark, "dedup")
    buckets = buckets or 2 * shuffle_width(spark)
    # a null event time is later than any watermark, so such rows never leave the store early
    micros = epoch_micros(spark, event_time, stream.select(event_time.alias("at")).schema["at"].dataType)
    event_ms = F.coalesce(F.floor(micros / 1000), F.lit(_NO_TIME)).cast("bigint")
    bucket = F.when(F.col("again"), F.xxhash64("delivery")).otherwise(F.xxhash64("message"))
    rows = (
        stream.select(message.alias("message"), delivery.cast("bigint").alias("delivery"), event_ms.alias("event_ms"))
        .filter("message is not null and delivery is not null")
        .mapInArrow(_combine, "message binary, delivery bigint, event_ms bigint, again boolean")
        .withColumn("event_at", F.when(F.col("event_ms") < _NO_TIME, F.timestamp_millis("event_ms")))
        .withWatermark("event_at", watermark)
        .withColumn("bucket", F.pmod(bucket, F.lit(buckets)))
    )
    verdicts = rows.groupBy("bucket").applyInPandasWithState(
        _watch,
        outputStructType=_VERDICT,
        stateStructType="entries binary",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/verdicts/batch={number}")

    query = (
        verdicts.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return DedupRun(root, _settle(spark, root))


def _settle(spark: SparkSession, root: str) -> int:
    """Looks the claims since the last settlement up among each other and in the ledger; the last batch covered, -1 if none."""
    batches, before = _numbers(spark, f"{root}/verdicts", "batch"), _numbers(spark, f"{root}/ledger", "upto")
    settled = max(before, default=-1)
    new = [b for b in batches if b > settled]
    if not new:
        return settled
    last = max(new)
    claims = spark.read.schema(_VERDICT).parquet(*[f"{root}/verdicts/batch={b}" for b in new]).filter("verdict = 'kept'")
    claims = claims.select("message", "delivery", F.lit(True).alias("new"))
    if before:
        claims = claims.unionByName(_ledger(spark, root, before).select("message", "delivery", F.lit(False).alias("new")))
    told = claims.groupBy("message").agg(F.min("delivery").alias("delivery"), F.count("*").alias("claims"), F.max("new").alias("new"), F.min(F.when(~F.col("new"), F.col("delivery"))).alias("known"))
    told.filter("new").drop("new").write.mode("overwrite").parquet(f"{root}/ledger/upto={last}.part")
    told = spark.read.schema(_LEDGER).parquet(f"{root}/ledger/upto={last}.part")
    # nearly every message is claimed once; of those claimed more often, all claims but the first repeat it
    more = told.filter("claims > 1").select("message", F.col("delivery").alias("first"))
    late = claims.join(more, "message").filter("delivery > first").select("delivery")
    late.write.mode("overwrite").parquet(f"{root}/late/upto={last}")
    files, part = _file_system(spark, f"{root}/ledger/upto={last}.part")
    files.rename(part, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger/upto={last}"))
    return last


_LEDGER = "message binary, delivery bigint, claims bigint, known bigint"


def _ledger(spark: SparkSession, root: str, settlements: list[int]) -> DataFrame:
    """The kept row of every message of earlier settlements, those that a later one has found a better row for too."""
    return spark.read.schema(_LEDGER).parquet(*[f"{root}/ledger/upto={b}" for b in settlements]).filter("known is null or delivery < known")


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers in the names of finished sub-folders such as ``batch=3``."""
    if not _exists(spark, folder):
        return []
    files, target = _file_system(spark, folder)
    found = [s.getPath() for s in files.listStatus(target)]
    done = [p for p in found if p.getName().startswith(f"{name}=") and p.getName().split("=")[1].isdigit() and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


#: Bytes of Parquet for which one bucket of state is made, and that a core gets in one micro-batch.
BUCKET_BYTES, CORE_BYTES = 64 << 20, 32 << 20


def _length(spark: SparkSession, path: str) -> int:
    files, target = _file_system(spark, path)
    return files.getContentSummary(target).getLength()


def buckets_for(spark: SparkSession, path: str) -> int:
    """Buckets of state for a replay of a table: in proportion to its size, twice the shuffle partitions at least."""
    return max(2 * shuffle_width(spark), -(-_length(spark, path) // BUCKET_BYTES))


def stream_table(spark: SparkSession, path: str, *, batch_bytes: int | None = None) -> DataFrame:
    """A Parquet table as a stream of micro-batches of about ``batch_bytes`` (unless given, what keeps all cores busy)."""
    schema = spark.read.parquet(path).schema
    files, target = _file_system(spark, path)
    if files.getFileStatus(target).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only as a pattern
    batch_bytes = batch_bytes or CORE_BYTES * spark.sparkContext.defaultParallelism
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)
