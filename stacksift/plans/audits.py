"""Audit and monitoring queries: invariants, differences, runs, throttles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from ..sources.readers import parquet
from .registry import query


@query("""select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)""")
def missing_fallback_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = parquet(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_custkey")
    return parquet(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
with a as (select distinct l_partkey as k from lineitem where l_returnflag = 'A'), b as (select distinct l_partkey as k from lineitem where l_returnflag = 'R')
select k, 'left' as side from a where k not in (select k from b) union all select k, 'right' from b where k not in (select k from a)
""")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = parquet(spark, sf_dir, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("k")) for x in "AR")
    return tables.set_difference(a, b, "k")


@query("""
select l_returnflag, count(distinct l_partkey) as seen, count(*) - count(distinct l_partkey) as repeated, round(count(distinct l_partkey) / (select count(*) from part), 6) as coverage from lineitem group by 1
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = parquet(spark, sf_dir, "part").agg(F.count("*").alias("total"))
    seen = parquet(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("seen"), F.count("*").alias("n"))
    return seen.crossJoin(F.broadcast(total)).select("l_returnflag", "seen", (F.col("n") - F.col("seen")).alias("repeated"), F.round(F.col("seen") / F.col("total"), 6).alias("coverage"))


_DAYS = """days as (select u.user_id, d.day, count(e.event_id) as n from (select distinct user_id from events) u cross join (select unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day))::date as day) d left join events e on e.user_id = u.user_id and e.ts::date = d.day group by 1, 2)"""


@query(f"""
with {_DAYS}, r as (select *, sum(case when n = 0 then 1 else 0 end) over (partition by user_id order by day rows between 13 preceding and current row) as z, count(*) over (partition by user_id order by day rows between 13 preceding and current row) as c from days)
select user_id, day from r where z = 14 and c = 14
""")
def zero_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without an event on 14 days in a row, over a date spine."""
    e = parquet(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    users = e.select("user_id").distinct()
    spine = users.select("user_id", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-30', interval 1 day)")).alias("day"))
    counts = e.groupBy("user_id", "day").agg(F.count("*").alias("k"))
    days = spine.join(counts, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("k", F.lit(0)).alias("n"))
    return tables.zero_runs(days, "user_id", "day", "n", 14)


@query("""
with d as (select distinct event_type, user_id, ts::date as day from events)
select event_type, user_id, day + 1 as day from d where not exists (select 1 from d x where x.event_type = d.event_type and x.user_id = d.user_id and x.day = d.day + 1) and day < date '2024-01-30'
""")
def missing_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that were there on one day and are not on the next."""
    d = parquet(spark, sf_dir, "events").select("event_type", "user_id", F.to_date("ts").alias("day")).distinct()
    want = d.where("day < date'2024-01-30'").withColumn("day", F.date_add("day", 1))
    return want.join(d, ["event_type", "user_id", "day"], "left_anti")


@query("""
with recursive e as (select user_id, ts from events where event_type = 'error'),
r as (select user_id, min(ts) as ts from e group by 1 union all select r.user_id, (select min(e.ts) from e where e.user_id = r.user_id and e.ts >= r.ts + interval 20 hour) from r where r.ts is not null)
select user_id, ts from r where ts is not null
""")
def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of one key at most once in 20 hours."""
    e = parquet(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "ts")
    return tables.throttled(e, "user_id", "ts", 20).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""
with l as (select user_id, max(ts) filter (where event_type = 'purchase') as ok, count(*) filter (where event_type = 'error') as errors from events group by 1)
select user_id, errors, coalesce(ok < timestamp '2024-01-30 12:00:00' - interval 26 hour, true) as stale from l
""")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No success within 26 hours of a given time."""
    e = parquet(spark, sf_dir, "events")
    now = F.lit("2024-01-29 10:00:00").cast("timestamp_ntz")
    made = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("ok"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return made.select("user_id", "errors", F.coalesce(F.col("ok") < now, F.lit(True)).alias("stale"))


@query("""
with base as (select c_custkey as k, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then '' else c_mktsegment end as seg, case when c_custkey % 2 = 0 then c_nationkey end as nat from customer where c_custkey % 5 <> 0),
new as (select c_custkey as k, lower(c_mktsegment) as seg, c_nationkey as nat from customer where c_custkey % 2 = 0)
select b.k, coalesce(nullif(b.seg, ''), n.seg) as seg, coalesce(b.nat, n.nat) as nat from base b left join new n on n.k = b.k
""")
def fill_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that fill gaps and never overwrite."""
    c = parquet(spark, sf_dir, "customer")
    r = F.col("c_custkey") % 3
    base = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.when(r == 0, None).when(r == 1, "").otherwise(F.col("c_mktsegment")).alias("seg"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("nat"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lower("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    both = tables.fill_nulls(base, new, "k", ["seg"], empty_too=True)
    return tables.fill_nulls(both, new, "k", ["nat"])


@query("""
select c_custkey as k, c_name as v, 'old' as origin from customer where c_custkey % 4 <> 0 and c_custkey % 3 <> 0 union all select c_custkey, upper(c_name), 'new' from customer where c_custkey % 3 = 0
""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "customer")
    old = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit("old").alias("origin"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("v"), F.lit("new").alias("origin"))
    return tables.upsert(old, new, ["k"])


@query("""
select c_custkey as k, c_name as v from customer where c_custkey % 4 <> 0 union all select c_custkey, upper(c_name) from customer where c_custkey % 4 = 0
""")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "customer")
    old = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    new = c.select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("v"))
    return tables.insert_if_absent(old, new, ["k"])


@query("""
select count(*) as n, count(*) filter (where o_totalprice > 50000) as ok, count(*) filter (where not coalesce(o_totalprice > 50000, false)) as hold, (select count(*) from lineitem) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as repeated_keys from orders
""")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exclusive split loses nothing; and how far a supposed key repeats."""
    o = parquet(spark, sf_dir, "orders")
    good, rest = tables.split_exclusively(o, F.col("o_totalprice") > 50000)
    li = parquet(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c")).agg((F.sum("c") - F.count("*")).alias("repeated_keys"))
    return o.agg(F.count("*").alias("n")).crossJoin(good.agg(F.count("*").alias("ok"))).crossJoin(rest.agg(F.count("*").alias("hold"))).crossJoin(li)
