"""An append-only record in which every line vouches for all before it."""

from __future__ import annotations

import fcntl
import hashlib
import hmac
import json
import os
import threading
from pathlib import Path
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCK = threading.Lock()
START = "0" * 64


def _link(before: str, body: str, key: bytes | None) -> str:
    data = f"{before}\n{body}".encode()
    return "m1:" + hmac.new(key, data, hashlib.sha256).hexdigest() if key else "h1:" + hashlib.sha256(data).hexdigest()


def _last_line(f: BinaryIO) -> dict[str, Any] | None:
    """Read from the end, in growing steps, so that adding to a long ledger costs no more than to a short one."""
    size = f.seek(0, os.SEEK_END)
    step = 4096
    while size:
        f.seek(max(0, size - step))
        lines = f.read().splitlines()
        if len(lines) > 1 or step >= size:
            return json.loads(lines[-1])
        step *= 4
    return None


def append(path: str | Path, record: dict[str, Any], key: bytes | None = None) -> str:
    """Adds a record; safe between threads and processes. Gives the new link."""
    body = json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    with _LOCK, open(path, "a+b") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        tail = _last_line(f)
        last, n = (tail["link"], tail["seq"] + 1) if tail else (START, 0)
        link = _link(last, body, key)
        f.write(json.dumps({"seq": n, "body": body, "link": link}).encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())
    return link


def verify(path: str | Path, key: bytes | None = None) -> tuple[bool, int]:
    """Whether the chain holds, and at which line it first doesn't (or how many lines there are)."""
    before, n = START, 0
    if not Path(path).exists():
        return True, 0
    for line in Path(path).read_bytes().splitlines():
        try:
            row = json.loads(line)
        except ValueError:
            return False, n
        if row.get("seq") != n or not hmac.compare_digest(row.get("link", ""), _link(before, row.get("body", ""), key)):
            return False, n
        before, n = row["link"], n + 1
    return True, n


def verify_frame(spark: SparkSession, path: str) -> DataFrame:
    """``seq, holds`` for an unkeyed ledger of any length: each line is joined to the one before by number."""
    lines = spark.read.schema("seq bigint, body string, link string").json(path)
    earlier = lines.select((F.col("seq") + 1).alias("seq"), F.col("link").alias("before"))
    joined = lines.join(earlier, "seq", "left")
    before = F.when(F.col("seq") == 0, F.lit(START)).otherwise(F.col("before"))
    want = F.concat(F.lit("h1:"), F.sha2(F.concat(before, F.lit("\n"), F.col("body")), 256))
    return joined.select("seq", F.coalesce(want == F.col("link"), F.lit(False)).alias("holds"))
