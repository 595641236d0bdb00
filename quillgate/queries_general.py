"""Registered queries of the general training-data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.functions.identity import folded, uuid_value
from quillgate.operators.sessions import sessionize
from quillgate.streaming.dedup import buckets_for, run_dedup, stream_table
from quillgate.workspace import fresh_dir, read_table


def repeated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/audit_record.parquet"
    return _repeats(spark, stream_table(spark, path), buckets=buckets_for(spark, path))


def _repeats(spark: SparkSession, stream: DataFrame, **options) -> DataFrame:
    run = run_dedup(stream, message=uuid_value(F.col("audit_id")), delivery=F.col("delivery_id"), event_time=F.coalesce("timestamp", "received_at"), **options)
    return run.repeats(spark)


def p5_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over ten micro-batches in the order of delivery, with a state of two days: later copies are looked up."""
    path = fresh_dir(spark, "deliveries")
    rows = read_table(spark, sf_dir, "audit_record").select("delivery_id", "audit_id", "timestamp", "received_at")
    rows.repartitionByRange(10, "delivery_id").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _repeats(spark, stream, watermark="2 days").select(F.col("delivery").alias("delivery_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_deliveries(spark, sf_dir).select(F.col("delivery").alias("delivery_id"))


def p5_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows received, kept and dropped per day of receipt."""
    again = repeated_deliveries(spark, sf_dir).withColumn("again", F.lit(1))
    rows = read_table(spark, sf_dir, "audit_record").select("delivery_id", F.to_date("received_at").alias("day"))
    return (
        rows.join(again, rows["delivery_id"] == again["delivery"], "left")
        .groupBy("day")
        .agg(F.count("*").alias("n_received"), F.count("again").alias("n_repeats"))
        .withColumn("n_kept", F.col("n_received") - F.col("n_repeats"))
    )


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = repeated_deliveries(spark, sf_dir)
    rows = read_table(spark, sf_dir, "audit_record").select("delivery_id", "principal_id", "timestamp", "status")
    rows = rows.filter("timestamp is not null and principal_id is not null")
    once = rows.join(again, rows["delivery_id"] == again["delivery"], "left_anti")
    return sessionize(once, actor=F.col("principal_id"), at=F.col("timestamp"), kind=folded(F.col("status")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select(F.col("actor").alias("principal_id"), "start_us", "end_us")


def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each session and status in it; a session whose records have none has one row without."""
    return _sessions(spark, sf_dir).select(
        F.col("actor").alias("principal_id"), "start_us", "end_us", "duration_us", "n_events", F.explode_outer("by_kind").alias("status", "n_status")
    )


QUERIES = {"p1_found": p1_found, "p1_sessions": p1_sessions, "p5_found": p5_found, "p5_in_batches": p5_in_batches, "p5_per_day": p5_per_day}

_AGAIN = r"""
parsed as (
  select *, regexp_replace(regexp_replace(lower(audit_id), '^[\s{("'']*(urn:)?(uuid:|0x)?', ''), '[^0-9a-z]', '', 'g') as bare from audit_record
), keyed as (
  select *, case when regexp_matches(bare, '^[0-9a-f]{32}$') and bare <> repeat(left(bare, 1), 32) then bare end as message from parsed
), again as (
  select delivery_id from (select delivery_id, message, row_number() over (partition by message order by delivery_id) as k from keyed where message is not null) where k > 1
)"""

_SESSIONS = (
    "with"
    + _AGAIN
    + r""", rows as (
  select principal_id, epoch_us("timestamp") as t, nullif(lower(regexp_replace(status, '^\s+|\s+$', '', 'g')), '') as status from keyed
  where delivery_id not in (select delivery_id from again) and "timestamp" is not null and regexp_matches(principal_id, '\S')
), marked as (
  select *, case when t - lag(t) over (partition by principal_id order by t) <= 1800000000 then 0 else 1 end as first from rows
), numbered as (
  select *, sum(first) over (partition by principal_id order by t rows unbounded preceding) as k from marked
), sessions as (
  select principal_id, k, min(t) as start_us, max(t) as end_us, max(t) - min(t) as duration_us, count(*) as n_events from numbered group by principal_id, k
), statuses as (
  select principal_id, k, status, count(*) as n_status from numbered where status is not null group by all
)"""
)

SQL = {
    "p5_found": "with" + _AGAIN + " select delivery_id from again",
    "p5_in_batches": "with" + _AGAIN + " select delivery_id from again",
    "p5_per_day": "with"
    + _AGAIN
    + """ select cast(received_at as date) as day, count(*) as n_received, count(a.delivery_id) as n_repeats, count(*) - count(a.delivery_id) as n_kept
  from audit_record r left join again a on a.delivery_id = r.delivery_id group by 1""",
    "p1_found": _SESSIONS + " select principal_id, start_us, end_us from sessions",
    "p1_sessions": _SESSIONS + " select principal_id, start_us, end_us, duration_us, n_events, status, n_status from sessions left join statuses using (principal_id, k)",
}
