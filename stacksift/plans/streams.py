"""Streaming queries: incremental files read with availableNow triggers, and event-time extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import parquet
from ..streaming.ingest import append_new, run_once, work_folder
from ..streaming.skips import skip_list, state_store
from .registry import query


#: How late an event may come.
LATE = "7 days"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = parquet(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("""select user_id, event_type, count(*) as n from (select distinct user_id, event_type, ts::date from events) group by 1, 2""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of activity by user and type: stateful dedup by key, then a batch count.

    The day is a window of event time, so the state of days more than LATE behind the stream is dropped, and what
    comes for them after that is not taken.
    """
    s = _events(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", LATE)
    s = s.select("user_id", "event_type", F.window("t", "1 day").alias("day")).dropDuplicates(["user_id", "event_type", "day"])
    return run_once(s, "append").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""select event_type, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2""")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over event time (an extension: the catalogue itself has no windows)."""
    s = _events(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp")).groupBy("event_type", F.window("t", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return run_once(s, "complete").select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")


@query("""select event_id, user_id from events where user_id not in (select user_id from events where event_id < 50)""")
def stream_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key was not seen before, tied to the write of the seen set."""
    seen = parquet(spark, sf_dir, "events").where("event_id < 50").select("user_id").distinct()
    s = _events(spark, sf_dir).select("event_id", "user_id").join(seen, "user_id", "left_anti")
    return run_once(s, "append").select("event_id", "user_id")


@query("""select user_id, count(*) as orphans from events where event_type = 'click' and user_id not in (select c_custkey from customer where c_custkey % 2 = 0) group by 1""")
def orphan_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry rows without a parent are dropped on write; this counts them."""
    c = parquet(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey")
    e = parquet(spark, sf_dir, "events").where("event_type = 'click'")
    return e.join(c, F.col("user_id") == F.col("c_custkey"), "left_anti").groupBy("user_id").agg(F.count("*").alias("orphans"))


@query("""select user_id, 'master' as file from events group by 1 union all select user_id, 'delta' from events group by 1""")
def stream_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a stream adds to a master table, and the delta that it writes with it: both have the same."""
    folder = work_folder(spark)
    append_new(_events(spark, sf_dir).select("user_id"), "user_id", f"{folder}/master", f"{folder}/delta", f"{folder}/state", buckets=16, words=1).start().awaitTermination()
    read = lambda name: spark.read.parquet(f"{folder}/{name}").select("user_id", F.lit(name).alias("file"))
    return read("master").unionAll(read("delta"))


@query("""
with recursive a as (select user_id, event_id, ts, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type in ('error', 'purchase', 'click')),
w as (select distinct user_id, 0::bigint as n, null::bigint as attempt, '' as decision, 0 as times, null::date as first_failed, null::date as last_failed from a
 union all select a.user_id, a.n, a.event_id, d, case when d = 'failed' then w.times + 1 when d = 'ok' then 0 else w.times end,
  case when d = 'failed' then coalesce(w.first_failed, a.ts::date) when d <> 'ok' then w.first_failed end, case when d = 'failed' then a.ts::date when d <> 'ok' then w.last_failed end
 from w join (select *, 1 as one from a) a on a.user_id = w.user_id and a.n = w.n + 1,
  lateral (select case when a.ts < w.last_failed + interval 7 day then 'skipped' when a.event_type = 'error' then 'failed' when a.event_type = 'purchase' then 'ok' else 'error' end as d))
select user_id, attempt, decision, times, first_failed, last_failed from w where n > 0
""")
def skip_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts on keys that failed before: skipped within seven days, made after that; success takes a key off the list."""
    outcome = F.when(F.col("event_type") == "error", "bad").when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "click", "error")
    tries = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("attempt"), F.col("ts").alias("at"), outcome.alias("outcome")).where("outcome is not null")
    with state_store(spark):
        return run_once(skip_list(tries, "user_id"), "append").where("attempt is not null")
