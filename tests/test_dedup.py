import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgate.functions.identity import uuid_value
from quillgate.streaming.dedup import _ENTRY, absorb, run_dedup, stream_table

SCHEMA = "audit_id string, delivery_id bigint, at timestamp, batch string, message string, bucket int"


def _key(i):
    return hashlib.md5(str(i).encode()).hexdigest()


def _found(spark, tmp_path, batches, watermark="1 day", root=None, one_file_a_batch=True):
    path = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).coalesce(1).write.parquet(str(path / f"part={i:03d}"))
    # a batch a file: the smallest size makes every file its own micro-batch
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))
    run = run_dedup(stream, message=uuid_value(F.col("audit_id")), delivery=F.col("delivery_id"), event_time=F.col("at"), watermark=watermark, root=root)
    return sorted(r.delivery for r in run.repeats(spark).collect())


def _expected(batches):
    kept, out = {}, []
    for key, delivery, _ in (r for b in batches for r in b):
        if key and len(key.replace("-", "").strip()) == 32:
            kept.setdefault(key.replace("-", "").strip().lower(), []).append(delivery)
    for v in kept.values():
        out += sorted(v)[1:]
    return sorted(out)


def test_repeats_within_and_across_batches(spark, tmp_path):
    day = "2024-01-01 00:00:00"
    rng = random.Random(4)
    batches, n = [], 0
    for b in range(4):
        rows = []
        for _ in range(60):
            n += 1
            key = _key(rng.randrange(80))
            rows.append((rng.choice([key, key.upper(), f" {key}"]), n, None))
        rows += [(None, 1000 + b, None), ("", 2000 + b, None), ("0" * 32, 3000 + b, None)]
        batches.append([(k, d, __import__("datetime").datetime.fromisoformat(day)) for k, d, _ in rows])
    want = _expected([[r for r in b if r[0] and r[0].strip() and r[0] != "0" * 32] for b in batches])
    assert _found(spark, tmp_path, batches) == want


def test_late_copies_are_found_after_their_state_expired(spark, tmp_path):
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    batches = [
        [(_key(1), 1, at(0)), (_key(2), 2, at(0))],
        [(_key(3), 3, at(30))],
        [(_key(4), 4, at(60))],
        # long out of the state by now, and under another time
        [(_key(1), 5, at(61)), (_key(2), 6, None)],
        [(_key(1), 7, at(90))],
    ]
    assert _found(spark, tmp_path, batches) == [5, 6, 7]


def test_a_smaller_delivery_number_that_comes_later_takes_over(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    old = dt.datetime(2023, 1, 1)
    batches = [[(_key(1), 9, old), (_key(2), 8, t)], [(_key(9), 100, t)], [(_key(1), 4, t), (_key(2), 3, t)], [(_key(1), 6, t), (_key(2), 1, t)]]
    assert _found(spark, tmp_path, batches) == [3, 6, 8, 9]


def test_empty_table_and_resuming(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    run = run_dedup(stream_table(spark, str(tmp_path / "none")), message=uuid_value(F.col("audit_id")), delivery=F.col("delivery_id"), event_time=F.col("at"))
    assert run.repeats(spark).count() == 0
    root = f"file://{tmp_path}/root"
    first = [[(_key(1), 1, None), (_key(1), 2, None)]]
    assert _found(spark, tmp_path, first, root=root) == [2]
    spark.createDataFrame([(_key(1), 3, None, "x", "y", 1)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "part=later"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = run_dedup(stream, message=uuid_value(F.col("audit_id")), delivery=F.col("delivery_id"), event_time=F.col("at"), root=root)
    assert sorted(r.delivery for r in run.repeats(spark).collect()) == [2, 3]


@pytest.mark.parametrize("seed", range(5))
def test_absorb_is_order_free(seed):
    rng = np.random.default_rng(seed)
    rows = np.zeros(300, _ENTRY)
    rows["key"] = [_key(i).encode()[:16] for i in rng.integers(0, 90, 300)]
    rows["kept"] = rng.permutation(300)
    known, repeats = rows[:0], []
    for chunk in np.array_split(rows, 7):
        known, again, _ = absorb(known, chunk)
        repeats += again.tolist()
    best = {}
    for k, d in zip(rows["key"], rows["kept"], strict=True):
        best[k] = min(best.get(k, 10**9), d)
    assert sorted(repeats) == sorted(set(rows["kept"].tolist()) - set(best.values()))
    assert {k: v for k, v in zip(known["key"], known["kept"], strict=True)} == best
