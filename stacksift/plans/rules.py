"""Rule and policy queries: variants, decisions, lookups, merged maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..sources.readers import parquet
from .registry import query


@query("""
with w as (select p_partkey, p_brand, unnest(string_split(p_name, ' ')) as w from part), n as (select p_brand, w, count(distinct p_partkey) as n from w group by 1, 2)
select p_partkey, string_agg(w, ' ' order by w) as tags from (select distinct p_partkey, p_brand, w from w) join n using (p_brand, w) where n = 1 group by 1
""")
def variant_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that only one member of a group has name its variant."""
    w = parquet(spark, sf_dir, "part").select("p_partkey", "p_brand", F.explode(F.split("p_name", " ")).alias("w")).distinct()
    once = w.groupBy("p_brand", "w").agg(F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey")).where("n = 1")
    return once.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("tags"))


@query("""
with l as (select user_id, max(ts) filter (where event_type = 'signup') as restored, max(ts) filter (where event_type = 'purchase') as confirmed from events group by 1)
select user_id from l where restored is not null and (confirmed is null or confirmed <= restored)
""")
def restored_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored and not confirmed after that: a nested negation as two maxima of one pass."""
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    made = parquet(spark, sf_dir, "events").groupBy("user_id").agg(last("signup").alias("restored"), last("purchase").alias("confirmed"))
    return made.where("restored is not null and (confirmed is null or confirmed <= restored)").select("user_id")


@query("""select l_orderkey, count(*) as n from lineitem group by 1 having sum(case when l_returnflag not in ('A', 'R') then 1 else 0 end) = 0""")
def emptied_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that would be empty once some of their rows go."""
    return parquet(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(~F.col("l_returnflag").isin("A", "R")).alias("kept")).where("kept = 0").select("l_orderkey", "n")


@query("""
select l_partkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as lists, count(distinct l_suppkey) as shops from lineitem group by 1
""")
def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists on which an item was seen."""
    return parquet(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("lists"), F.count_distinct("l_suppkey").alias("shops"))


@query("""
with p as (select s_suppkey as simp, s_suppkey + 1 as trad from supplier where s_suppkey % 3 = 0)
select simp as me, trad as other from p union all select trad, simp from p
""")
def symmetric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair table looked up from either side, as a union of both directions."""
    p = parquet(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("simp"), (F.col("s_suppkey") + 1).alias("trad"))
    return p.select(F.col("simp").alias("me"), F.col("trad").alias("other")).unionAll(p.select("trad", "simp"))


@query("""
with c as (select c_custkey, 'a=' || c_mktsegment || ',k=' || c_nationkey as kept, c_nationkey % 2 = 0 as clash from customer)
select c_custkey, kept || case when clash then ',a_dup' || c_custkey || '=x' else ',b=x' end as merged from c
""")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property maps of merged rows; clashing keys are renamed."""
    c = parquet(spark, sf_dir, "customer")
    kept = F.create_map(F.lit("a"), F.col("c_mktsegment"), F.lit("k"), F.col("c_nationkey").cast("string"))
    moved = F.create_map(F.when(F.col("c_nationkey") % 2 == 0, "a").otherwise("b"), F.lit("x"))
    merged = fields.merge_maps(kept, moved, F.col("c_custkey"))
    return c.select("c_custkey", F.array_join(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("merged"))


@query("""
select page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^(?:www|m)\\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') as url_key,
 case when regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) not in ('', '/') and not ends_with(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '/') then url end as cover from pages
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "pages").select("page_id", fields.url_key(F.col("url")).alias("url_key"), fields.cover_url(F.col("url")).alias("cover"))


_SPECS = ["作者：王{k}\n重量: {k}克\n作者: 另一人\nhttp://x", "no labels here", "书名：圣经{k}\n: empty"]


@query("""
select s_suppkey, replace(labels, '{k}', s_suppkey::varchar) as labels, case when form = 0 then s_suppkey::double end as grams, form = 2 as simplified
from supplier join (values (0, '{"作者":"王{k}","重量":"{k}克"}'), (1, '{}'), (2, '{"书名":"圣经{k}"}')) as t(form, labels) on form = s_suppkey % 3
""")
def label_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines as maps, weights and script hints."""
    k = F.col("s_suppkey")
    spec = F.replace(F.get(F.array(*[F.lit(x) for x in _SPECS]), (k % 3).cast("int")), F.lit("{k}"), k.cast("string"))
    df = parquet(spark, sf_dir, "supplier").select("s_suppkey", spec.alias("spec"))
    m = df.select("s_suppkey", fields.label_lines(F.col("spec"), ("http",)).alias("m"), fields.looks_simplified(F.col("spec")).alias("simplified"))
    return m.select("s_suppkey", F.to_json("m").alias("labels"), fields.grams(F.get(F.map_values(F.map_filter("m", lambda k, v: k == "重量")), F.lit(0))).cast("double").alias("grams"), "simplified")


@query("""
with m as (select p_name, p_type, count(*) as n, min(p_partkey) as first from part group by 1, 2), t as (select p_name, p_type from (select *, row_number() over (partition by p_name order by n desc, first) as r from m) where r = 1)
select p_partkey, coalesce(t.p_type, 'none') as by_label from part left join t on t.p_name = part.p_name
""")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's most frequent code, ties to the earliest; looked up for every row."""
    p = parquet(spark, sf_dir, "part")
    m = p.groupBy("p_name", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    top = m.groupBy("p_name").agg(F.max_by("p_type", F.struct("n", -F.col("first"))).alias("by_label"))
    return p.select("p_partkey", "p_name").join(top, "p_name", "left").select("p_partkey", F.coalesce("by_label", F.lit("none")).alias("by_label"))


@query("""
with m as (select s_suppkey as id, s_nationkey as category from supplier where s_acctbal > 0), ok as (select count(*) = count(distinct id) and sum(id) = (select sum(s_suppkey) from supplier where s_acctbal > 0) as fine from m)
select c_custkey, c_nationkey as before, case when (select fine from ok) then coalesce(category, c_nationkey) else c_nationkey end as after from customer left join m on id = c_custkey
""")
def checked_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping is applied only if its count and sum are as expected."""
    m = parquet(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("category"))
    want = m.agg(F.sum("id").alias("want"))
    fine = m.agg((F.count("*") == F.count_distinct("id")).alias("unique"), F.sum("id").alias("total")).crossJoin(want).select((F.col("unique") & (F.col("total") == F.col("want"))).alias("fine"))
    c = parquet(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    out = c.join(m, F.col("c_custkey") == F.col("id"), "left").crossJoin(F.broadcast(fine))
    return out.select("c_custkey", F.col("c_nationkey").alias("before"), F.when(F.col("fine"), F.coalesce("category", "c_nationkey")).otherwise(F.col("c_nationkey")).alias("after"))


@query("""
with r as (select o_orderkey as old, o_custkey as new from orders where o_orderkey % 9 = 0)
select l_orderkey, l_linenumber, l_suppkey, l_partkey, coalesce(new, l_orderkey) as landing from lineitem left join r on old = l_orderkey
""")
def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hop redirects of merged ids."""
    r = parquet(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("old"), F.col("o_custkey").alias("new"))
    li = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return li.join(r, F.col("l_orderkey") == F.col("old"), "left").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.coalesce("new", "l_orderkey").alias("landing"))


@query("""
select conv_id, count(*) as turns, arg_min(text, turn) as opening, count(distinct role) as roles from conversations group by 1
""")
def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First text and size of each conversation."""
    return parquet(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("text", "turn").alias("opening"), F.count_distinct("role").alias("roles"))
