"""Tables of a SQLite file as Parquet tables with types."""

from __future__ import annotations

import hashlib
import sqlite3
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgate.sources.readers import typed_copy

#: Rows that one task reads.
SLICE = 200_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def base_tables(path: str) -> dict[str, list[str]]:
    """Names of the file's own tables (no views, none of the system's) with their columns."""
    with _open(path) as db:
        names = [n for (n,) in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite\\_%' escape '\\' order by name")]
        return {n: [c[1] for c in db.execute(f"pragma table_info({_quoted(n)})")] for n in names}


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table with every column as text, read in ranges of row numbers by as many tasks.

    The file must be where the executors can open it; it is opened for reading only.
    """
    columns = base_tables(path)[table]
    with _open(path) as db:
        low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(table)}").fetchone()
    fields = pa.schema([(c, pa.string()) for c in columns])
    picked = ", ".join(f"cast({_quoted(c)} as text)" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                with _open(path) as db:
                    rows = db.execute(f"select {picked} from {_quoted(table)} where rowid >= ? and rowid < ?", (start, start + SLICE))
                    while part := rows.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*part, strict=True)], schema=fields)

    schema = ", ".join(f"`{c}` string" for c in columns)
    if low is None:
        return spark.createDataFrame([], schema)
    slices = len(range(low, high + 1, SLICE))
    return spark.range(low, high + 1, SLICE, slices).mapInArrow(run, schema)


def import_file(spark: SparkSession, path: str, folder: str, *, sha256: str | None = None) -> dict[str, int]:
    """Copies every base table to ``folder/NAME.parquet`` (names in lower case) and tells their rows.

    With ``sha256`` the file must have that digest.
    """
    if sha256 is not None and hashlib.sha256(Path(path).read_bytes()).hexdigest() != sha256:
        raise ValueError(f"{path} is not the file it should be")
    out = {}
    for table in base_tables(path):
        target = f"{folder}/{table.lower()}.parquet"
        copied = typed_copy(read_table(spark, path, table))
        copied.toDF(*[c.lower() for c in copied.columns]).write.mode("overwrite").parquet(target)
        out[table.lower()] = spark.read.parquet(target).count()
    return out
