"""Catalogue reads. Parts stand for works, line items for editions, suppliers for publishers, customers for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import search
from ..sources.readers import parquet
from .registry import query

DAY = "date_format(l_shipdate, 'yyyy-MM-dd')"


@query("""
with hit as (select p_partkey, p_name from part where contains(lower(p_name), 'ring')),
by_supplier as (select distinct l_partkey from lineitem where l_suppkey between 1 and 5),
newest as (select l_partkey, strftime(max(l_shipdate), '%Y-%m-%d') as newest from lineitem group by 1 having strftime(max(l_shipdate), '%Y-%m-%d') >= '1998' and strftime(max(l_shipdate), '%Y-%m-%d') <= '2001-12-31'),
found as (select p_partkey, p_name, newest from hit join newest on p_partkey = l_partkey where p_partkey in (select l_partkey from by_supplier))
select p_partkey, p_name, newest, (select count(*) from found) as total from found order by newest desc, p_partkey desc limit 20
""")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    works, editions = parquet(spark, sf_dir, "part"), parquet(spark, sf_dir, "lineitem")
    hit = works.where(search.contains_either(F.lower("p_name"), "ring")).select("p_partkey", "p_name")
    by_supplier = editions.where("l_suppkey between 1 and 5").select("l_partkey")
    newest = editions.groupBy("l_partkey").agg(F.max("l_shipdate").alias("d")).select("l_partkey", F.date_format("d", "yyyy-MM-dd").alias("newest")).where(ids.in_years(F.col("newest"), "1998", "2001"))
    found = hit.join(by_supplier, F.col("p_partkey") == by_supplier["l_partkey"], "left_semi").join(newest, F.col("p_partkey") == newest["l_partkey"]).select("p_partkey", "p_name", "newest")
    return search.page_with_total(found, [F.desc("newest"), F.desc("p_partkey")], 1, 20)


@query("""
select count(*) filter (where d >= '1998') as a, count(*) filter (where d >= '1998') as b, count(*) filter (where d >= '1998') as c, count(*) filter (where d >= '1998') as e
from (select o_orderkey, strftime(coalesce(max(l_shipdate), any_value(o_orderdate)), '%Y-%m-%d') as d from orders left join lineitem on l_orderkey = o_orderkey group by 1)
""")
def year_variants_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One count by four formulations: scalar subquery, left join, grouped join with fallback, exists."""
    o, li = parquet(spark, sf_dir, "orders"), parquet(spark, sf_dir, "lineitem")
    newest = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("d"))
    joined = o.join(newest, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    a = joined.where(F.date_format(F.coalesce("d", "o_orderdate"), "yyyy-MM-dd") >= "1998").agg(F.count("*").alias("a"))
    b = joined.where(F.coalesce("d", "o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).agg(F.count("*").alias("b"))
    late = newest.where(F.col("d") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    alone = o.join(newest, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    c = o.join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey").unionAll(alone.select("o_orderkey")).agg(F.count("*").alias("c"))
    some = li.where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("l_orderkey")
    e = o.join(some, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey").unionAll(alone.select("o_orderkey")).agg(F.count("*").alias("e"))
    return a.crossJoin(b).crossJoin(c).crossJoin(e)


@query("""
select n_nationkey, n_name, count(s_suppkey) as n_rich from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 9000 group by 1, 2
""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate of the joined side belongs into the join, so empty categories keep a zero."""
    rich = parquet(spark, sf_dir, "supplier").where("s_acctbal > 9000")
    return parquet(spark, sf_dir, "nation").join(rich, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("n_rich"))


@query("""
select split_part(url, '/', 3) as host, count(distinct page_id) as n_pages, min(url) as first_url, max(length(html)) as longest from pages group by 1
""")
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "pages").groupBy(text.host(F.col("url")).alias("host")).agg(F.count_distinct("page_id").alias("n_pages"), F.min("url").alias("first_url"), F.max(F.char_length("html")).cast("long").alias("longest"))


@query("""
with s as (select s_suppkey, s_name, s_suppkey - s_suppkey % 4 as canonical from supplier)
select c.s_suppkey, c.s_name, count(distinct l_partkey) as works from lineitem join s on l_suppkey = s.s_suppkey join s c on c.s_suppkey = s.canonical group by 1, 2 order by works desc, s_suppkey limit 20
""")
def alias_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of works by publisher after aliases are resolved; the alias table is joined after the count."""
    s = parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (F.col("s_suppkey") - F.col("s_suppkey") % 4).alias("canonical"))
    li = parquet(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    works = li.join(s.select("s_suppkey", "canonical"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("canonical").agg(F.count_distinct("l_partkey").alias("works"))
    named = works.join(s.select("s_suppkey", "s_name"), F.col("canonical") == F.col("s_suppkey")).select("s_suppkey", "s_name", "works")
    return named.orderBy(F.desc("works"), "s_suppkey").limit(20)


@query("""select o_orderkey, o_orderdate, o_totalprice from orders order by o_orderdate desc, o_orderkey desc limit 20""")
def latest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)


@query("""
select user_id, count(*) as clicks from events where event_type = 'click' and ts >= date_trunc('month', timestamp '2024-01-20 12:00:00') and ts < timestamp '2024-01-20 12:00:00' group by 1 order by clicks desc, user_id limit 20
""")
def popular_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    e = parquet(spark, sf_dir, "events").where((F.col("event_type") == "click") & (F.col("ts") >= F.date_trunc("month", now).cast("timestamp_ntz")) & (F.col("ts") < now))
    return e.groupBy("user_id").agg(F.count("*").alias("clicks")).orderBy(F.desc("clicks"), "user_id").limit(20)


@query("""
with li as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey) as n from lineitem)
select o_orderkey, max(case when n = 1 then l_suppkey end) as first_supplier, strftime(max(l_shipdate), '%Y-%m-%d') as newest, string_agg(distinct cast(l_suppkey as varchar), '、' order by cast(l_suppkey as varchar)) as suppliers, count(l_orderkey) as lines
from orders left join li on o_orderkey = l_orderkey group by 1
""")
def work_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First supplier, newest date and the joined list of suppliers of each order, in one aggregation."""
    li = parquet(spark, sf_dir, "lineitem")
    made = li.groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("first_supplier"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("newest"), F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), "、").alias("suppliers"), F.count("*").alias("lines"))
    o = parquet(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(made, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey").withColumn("lines", F.coalesce("lines", F.lit(0)))


@query("""
select c_custkey, '{"name":"' || c_name || '","orders":[' || coalesce(string_agg('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' order by o_orderkey), '') || ']}' as json
from customer left join orders on o_custkey = c_custkey group by c_custkey, c_name
""")
def detail_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document a customer."""
    o = parquet(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))).alias("orders"))
    c = parquet(spark, sf_dir, "customer").select("c_custkey", "c_name")
    none = F.array().cast("array<struct<id: bigint, status: string>>")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.coalesce("orders", none).alias("orders"))).alias("json"))


ROLES = ["1-URGENT", "3-MEDIUM", "2-HIGH"]


@query("""
select o_orderpriority, coalesce(list_position(['1-URGENT', '3-MEDIUM', '2-HIGH'], o_orderpriority), 0) as place, case when coalesce(list_position(['1-URGENT', '3-MEDIUM', '2-HIGH'], o_orderpriority), 0) = 0 then 99 else list_position(['1-URGENT', '3-MEDIUM', '2-HIGH'], o_orderpriority) end as rank, count(*) as n from orders group by 1
""")
def role_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enumerated order: 0 for a missing value, or a default rank of 99."""
    n = parquet(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    place = search.field_order(F.col("o_orderpriority"), ROLES)
    return n.select("o_orderpriority", place.alias("place"), F.when(place == 0, 99).otherwise(place).alias("rank"), "n")


@query("""
select key, src from (
 select *, row_number() over (partition by key order by o) as n from (
  select l_partkey as key, 'direct' as src, 1 as o from lineitem where l_orderkey between 10 and 60
  union all select l_partkey, 'supplier', 2 from lineitem where l_suppkey in (3, 4)
 )) where n = 1
""")
def link_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disjunctive lookup as two scans, first source wins."""
    li = parquet(spark, sf_dir, "lineitem")
    direct = li.where("l_orderkey between 10 and 60").select(F.col("l_partkey").alias("key"), F.lit("direct").alias("src"))
    other = li.where("l_suppkey in (3, 4)").select(F.col("l_partkey").alias("key"), F.lit("supplier").alias("src"))
    return search.union_first([direct, other], "key", "src")


@query("""select p_type, p_name, p_partkey, p_retailprice from (select *, row_number() over (partition by p_type, p_name order by p_retailprice desc, p_partkey) as n from part) where n = 1""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best(parquet(spark, sf_dir, "part").select("p_type", "p_name", "p_partkey", "p_retailprice"), ["p_type", "p_name"], [F.desc("p_retailprice"), F.asc("p_partkey")])


@query("""
with g as (select o_custkey, o_orderstatus, min(o_orderkey) as first_id, count(*) as n, count(distinct (o_orderdate, o_orderpriority)) as pairs from orders group by 1, 2)
select * from g order by first_id limit 25 offset 50
""")
def group_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages over groups by the group's first id, with a distinct count of pairs."""
    g = parquet(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("first_id"), F.count("*").alias("n"), F.count_distinct("o_orderdate", "o_orderpriority").alias("pairs"))
    return g.orderBy("first_id").offset(50).limit(25)


@query("""
select b.p_partkey, a.pos, b.p_name from (select unnest([17, 3, 99, 42, 8]) as id, unnest([1, 2, 3, 4, 5]) as pos) a join part b on b.p_partkey = a.id
""")
def ordered_refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display columns joined after paging, in the order of a given id list."""
    wanted = spark.createDataFrame([(k, i) for i, k in enumerate([17, 3, 99, 42, 8], 1)], "id long, pos int")
    return parquet(spark, sf_dir, "part").join(F.broadcast(wanted), F.col("p_partkey") == F.col("id")).select("p_partkey", "pos", "p_name").orderBy("pos")


@query("""
select n_name, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as done, cast(sum(case when o_totalprice > 200000 then 1 else 0 end) as bigint) as large, count(*) as n, avg(length(c_name)) as name_length
from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1
""")
def conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = parquet(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("d"), F.sum((F.col("o_totalprice") > 200000).cast("long")).alias("l"), F.count("*").alias("k"))
    c = parquet(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.char_length("c_name").alias("len"))
    made = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("d").alias("done"), F.sum("l").alias("large"), F.sum("k").alias("n"), (F.sum(F.col("len") * F.col("k")) / F.sum("k")).alias("name_length"))
    return parquet(spark, sf_dir, "nation").join(made, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "done", "large", "n", "name_length")


@query("""
select o_orderkey, floor((row_number() over (order by o_orderkey) - 1) / 450)::int as file from orders
""")
def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.writers import sitemap_chunks

    return sitemap_chunks(parquet(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("url")), "url", "o_orderkey", 450).select("o_orderkey", "file")


@query("""
select r_name, n_name, 'region' as kind from region join nation on n_regionkey = r_regionkey union all select r_name, null, 'total' from region
""")
def union_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = parquet(spark, sf_dir, "region"), parquet(spark, sf_dir, "nation")
    one = F.broadcast(r).join(n, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", F.lit("region").alias("kind"))
    return one.unionAll(r.select("r_name", F.lit(None).cast("string").alias("n_name"), F.lit("total").alias("kind")))


@query("""
select o_orderdate, n, n - coalesce(lag(n) over (order by o_orderdate), 0) as change from (select o_orderdate, count(*) as n from orders group by 1)
""")
def daily_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of a daily count; the window is over days, a table bounded by the calendar."""
    days = parquet(spark, sf_dir, "orders").groupBy("o_orderdate").agg(F.count("*").alias("n"))
    return days.select("o_orderdate", "n", (F.col("n") - F.coalesce(F.lag("n").over(Window.orderBy("o_orderdate")), F.lit(0))).alias("change"))
