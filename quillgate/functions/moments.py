"""Points in time as numbers."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UTC = {"UTC", "Etc/UTC", "Z", "GMT", "+00:00"}


def epoch_micros(spark: SparkSession, at: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970; a time without a zone is read as UTC, whatever the session's zone, a number is taken as it is."""
    if isinstance(kind, T.IntegralType):
        return at.cast("bigint")
    if isinstance(kind, T.TimestampNTZType) and spark.conf.get("spark.sql.session.timeZone") not in _UTC:
        at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), at)
    return F.unix_micros(at.cast("timestamp"))
