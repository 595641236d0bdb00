"""Where tables come from: a registry of formats, and typed copies of untyped files."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Reader = Callable[..., DataFrame]


def _files(kind: str) -> Reader:
    def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: Any) -> DataFrame:
        reader = spark.read.format(kind).options(**options)
        return (reader.schema(schema) if schema else reader).load(path)

    return read


def _csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: Any) -> DataFrame:
    """With a header and, unless a schema is given, every column as text (see ``typed_copy``)."""
    reader = spark.read.options(**{"header": True, **options})
    return (reader.schema(schema) if schema else reader).csv(path)


def _jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 16, timeout_s: int = 30, **options: Any) -> DataFrame:
    """A table of a database, read by ranges of ``partition_column`` where one is named; Spark pushes filters down."""
    settings = {"url": url, "dbtable": table, "queryTimeout": timeout_s, "fetchsize": 10_000, **options}
    if partition_column and bounds:
        settings |= {"partitionColumn": partition_column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions}
    return spark.read.format("jdbc").options(**settings).load()


READERS: dict[str, Reader] = {**{k: _files(k) for k in ("parquet", "orc", "json", "text")}, "csv": _csv, "jdbc": _jdbc}


def register_reader(kind: str, reader: Reader) -> None:
    READERS[kind] = reader


def source(spec: Mapping[str, Any]) -> Callable[[SparkSession], DataFrame]:
    """A source for a governed session: ``{"format": "csv", "path": ..., ...}``."""
    options = dict(spec)
    kind = options.pop("format", "parquet")
    if kind not in READERS:
        raise ValueError(f"no reader for format {kind!r}")
    return lambda spark: READERS[kind](spark, **options)


def typed_copy(df: DataFrame, *, empty_is_null: bool = True) -> DataFrame:
    """Text columns whose every value reads as a whole number become bigint, as a number double; others stay text.

    One pass decides for all columns. A number with leading zeros, such as a postal code, stays text.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    trimmed = {c: (F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if empty_is_null else F.col(f"`{c}`")) for c in texts}
    tests = []
    for i, c in enumerate(texts):
        v = trimmed[c]
        code = v.rlike(r"^[+-]?0\d")
        tests += [
            F.bool_and(v.isNull() | (v.try_cast("bigint").isNotNull() & v.rlike(r"^[+-]?\d+$") & ~code)).alias(f"w{i}"),
            F.bool_and(v.isNull() | (v.try_cast("double").isNotNull() & ~v.rlike("(?i)^[+-]?(nan|inf)") & ~code)).alias(f"n{i}"),
            F.count(v).alias(f"c{i}"),
        ]
    told = df.agg(*tests).first()
    out = []
    for f in df.schema:
        if f.name not in trimmed:
            out.append(F.col(f"`{f.name}`"))
            continue
        i, v = texts.index(f.name), trimmed[f.name]
        kind = "bigint" if told[f"w{i}"] and told[f"c{i}"] else "double" if told[f"n{i}"] and told[f"c{i}"] else None
        out.append((v.try_cast(kind) if kind else F.col(f"`{f.name}`")).alias(f.name))
    return df.select(*out)
