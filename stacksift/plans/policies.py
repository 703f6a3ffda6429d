"""Classification policies and guards, each beside SQL that follows from the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, policies
from ..sources.readers import parquet
from .linking import MAP, RULES, TITLE_ONLY
from .registry import query

_M = "m(code, category, sort_order, unpublish) as (values ('0', 'alpha', 2, false), ('1', 'beta', 1, false), ('2', null, 3, true), ('3', 'alpha', 4, false), ('4', 'gamma', 1, true))"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = parquet(spark, sf_dir, "lineitem")
    sources = li.groupBy(F.col("l_orderkey").alias("item")).agg((F.count_distinct("l_returnflag") == 1).alias("single"))
    items = parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("title")).join(sources, "item")
    return items, li.select(F.col("l_orderkey").alias("item"), (F.col("l_suppkey") % 6).cast("string").alias("code")), F.broadcast(spark.createDataFrame(MAP, "code string, category string, sort_order int, unpublish boolean"))


_POLICY_SQL = """
with {m}, c as (select distinct l_orderkey as item, cast(l_suppkey % 6 as varchar) as code from lineitem),
s as (select l_orderkey as item, count(distinct l_returnflag) = 1 as single from lineitem group by 1),
i as (select o_orderkey as item, single, {special} as special from orders join s on s.item = o_orderkey),
j as (select c.item, c.code, m.category, m.sort_order, coalesce(m.unpublish, false) as stop from c left join m on m.code = c.code),
f as (select item, {rule} as bad from j group by 1),
o as (select item, category, min(sort_order * 1000 + cast(code as int)) as spot from j where category is not null group by 1, 2
  union all select item, special, -1 from i where special is not null),
d as (select item, category, min(spot) as spot from o group by 1, 2),
n as (select item, category, row_number() over (partition by item order by spot) - 1 as place, count(*) over (partition by item) as many from d),
a as (select i.item, i.single, coalesce(bad, false) and special is null and single {and_some} as off, coalesce((select max(many) from n where n.item = i.item), 0) as many from i join f on f.item = i.item)
select a.item, case when off then 'delist' when a.many = 0 then 'none' when single then 'replace' else 'append' end as action, category, place, case when place = 0 then 10 when place > 0 then 5 end as weight
from a left join n on n.item = a.item {and_on}
"""


@query(_POLICY_SQL.format(m=_M, special="case when contains(o_orderpriority, 'URGENT') then 'songs' end", rule="bool_or(stop)", and_some="", and_on="and not off"))
def policy_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delisting code delists, but for titles of the exception and items of several sources."""
    return policies.by_policy(*_inputs(spark, sf_dir), delist="any", exception=("URGENT", "songs"))


@query(_POLICY_SQL.format(m=_M, special="null::varchar", rule="bool_and(stop) filter (where code <> '1')", and_some="and coalesce((select max(many) from n where n.item = i.item), 0) > 0", and_on=""))
def policy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes but the general ones must delist; categories are written all the same, and items without any are left alone."""
    return policies.by_policy(*_inputs(spark, sf_dir), delist="all", parents=("1",), write_when_delisted=True)


@query("""
select p_partkey, case when p_partkey % 7 = 0 and p_partkey % 2 = 0 then 'hand ' || (p_partkey % 3) else p_type end as category, p_partkey % 7 = 0 and p_partkey % 2 = 0 as overridden from part
""")
def url_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories set by hand for the id at the end of an item's address; addresses without an id keep theirs."""
    p = parquet(spark, sf_dir, "part")
    items = p.select("p_partkey", F.col("p_type").alias("category"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://shop.example/book?lang=zh&id="), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("https://shop.example/book/"), F.col("p_partkey").cast("string"))).alias("url"))
    hand = p.where("p_partkey % 7 = 0").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("hand "), (F.col("p_partkey") % 3).cast("string")).alias("override"))
    return policies.with_overrides(items, "url", "id=", "category", hand).select("p_partkey", "category", "overridden")


_SUBS = ["宣教", "輔導與醫治", "社會參與", "倫理", "文字工作", "講道", "職業", "特殊問題", "研經法", "幼兒", "主日學", "紙品", "畫冊", "DVD", "詩歌"]


@query("""
with c as (select p_partkey, lpad(cast(p_partkey % 20 as varchar), 2, '0') || '07' as code, case when p_partkey % 11 = 0 then '大類' else '大類／' || (['""" + "','".join(_SUBS) + """'])[p_partkey % 15 + 1] end as label from part),
s as (select *, left(code, 2) as top, case when contains(label, '／') then split_part(label, '／', 2) else '' end as sub from c)
select p_partkey, case top when '01' then '聖經' when '02' then '聖經研究' when '03' then '神學' when '05' then '教會復興' when '06' then '門徒造就' when '07' then '見證' when '08' then '福音' when '18' then '詩本樂譜'
 when '04' then case when contains(sub, '宣教') then '教會復興' when contains(sub, '輔導') or contains(sub, '醫治') then '心理' when contains(sub, '社會參與') then '社會' when contains(sub, '倫理') then '倫理' when contains(sub, '文字工作') then '傳媒' else '門徒造就' end
 when '09' then case when contains(sub, '職業') then '社會' when contains(sub, '特殊問題') then '心理' when contains(sub, '倫理') then '倫理' else '青少年家庭' end
 when '10' then case when contains(sub, '研經') then '聖經研究' when contains(sub, '幼兒') then '兒童教材' when contains(sub, '主日學') then '兒童主日學' when contains(sub, '紙品') then '綜合其他' else '門徒造就' end
 when '11' then case when contains(sub, '畫冊') then '藝術' when contains(sub, 'DVD') then '兒童教材' else '文學' end else '綜合其他' end as category from s
""")
def code_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    label = F.when(k % 11 == 0, F.lit("大類")).otherwise(F.concat(F.lit("大類／"), F.get(F.array(*[F.lit(s) for s in _SUBS]), (k % 15).cast("int"))))
    code = F.concat(F.lpad((k % 20).cast("string"), 2, "0"), F.lit("07"))
    return parquet(spark, sf_dir, "part").select("p_partkey", policies.tree_category(code, label).alias("category"))


@query("""
with s as (select distinct lpad(cast(p_size % 40 as varchar), 2, '0') || lpad(cast(p_size % 7 as varchar), 2, '0') as code, p_brand || '／' || p_type as label from part where p_partkey % 3 > 0),
l as (select distinct p_brand || '／' || p_type as label from part union select distinct p_brand || '／unknown' from part union select 'nowhere' union select p_brand from part)
select l.label, coalesce((select min(code) from s where s.label = l.label), (select left(min(code), 2) from s where starts_with(s.label, split_part(l.label, '／', 1) || '／'))) as code from l
""")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of labels: by the whole label, else only the top class by its first part."""
    p = parquet(spark, sf_dir, "part")
    label, size = F.concat_ws("／", "p_brand", "p_type"), F.col("p_size")
    subjects = p.where("p_partkey % 3 > 0").select(F.concat(F.lpad((size % 40).cast("string"), 2, "0"), F.lpad((size % 7).cast("string"), 2, "0")).alias("code"), label.alias("label")).distinct()
    wanted = p.select(F.explode(F.array(label, F.concat_ws("／", "p_brand", F.lit("unknown")), F.lit("nowhere"), F.col("p_brand"))).alias("label"))
    return policies.codes_by_label(wanted, subjects)


@query("""
with m as (select p_partkey, p_name || ' ' || p_brand as t, p_name from part),
h as (select p_partkey, 1 as o, 'colour' as c from m where regexp_matches(t, 'red|blue|green') union all select p_partkey, 2, 'size' from m where regexp_matches(t, 'small|large|tiny')
 union all select p_partkey, 3, 'tool' from m where regexp_matches(t, 'bolt|gear|nut') union all select p_partkey, 4, 'ring' from m where contains(p_name, 'ring') union all select p_partkey, 5, 'tool' from m where contains(p_name, 'widget')),
d as (select p_partkey, c, min(o) as o from h group by 1, 2 union all select p_partkey, 'other', 9 from part where p_partkey not in (select p_partkey from h)),
r as (select *, row_number() over (partition by p_partkey order by o) as n, first_value(c) over (partition by p_partkey order by c = 'colour', o) as prime from d)
select p_partkey, c as category, case when n = 1 then 10 else 5 end as weight, c = prime as is_primary from r
""")
def keyword_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword categories with weights: the first one weighs 10, though the primary is the first that is not of low priority."""
    found = parquet(spark, sf_dir, "part").select("p_partkey", classify.matched_rules(F.concat_ws(" ", "p_name", "p_brand"), F.col("p_name"), RULES, TITLE_ONLY, "other").alias("c"))
    rows = found.select("p_partkey", classify.primary(F.col("c"), ["colour"]).alias("prime"), F.posexplode("c").alias("place", "category"))
    return rows.select("p_partkey", "category", F.when(F.col("place") == 0, 10).otherwise(5).alias("weight"), (F.col("category") == F.col("prime")).alias("is_primary"))


@query("""select distinct p_brand || ' ' || p_type as category from part where p_brand || ' ' || p_type not in (select p_brand || ' ' || p_type from part where p_size < 3)""")
def unmapped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of a mapping that the list of categories lacks."""
    p = parquet(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("category"), "p_size")
    return policies.missing_targets(p, p.where("p_size < 3").select("category").distinct())


@query("""
with hit as (select p_partkey, case when contains(p_name, 'ring') or contains(p_name, 'bolt') then 'hide' else 'flag' end as action from part where regexp_matches(p_name, 'ring|bolt|gear|red'))
select p_partkey, action, action = 'hide' as hidden from hit where not exists (select 1 from lineitem where l_partkey = p_partkey and l_linenumber = 7 and (case when l_returnflag = 'R' then 'hide' else 'flag' end) = action)
""")
def guard_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings to hide (first tier) or to flag (second), each action on a listing once: what the log has is not repeated."""
    p = parquet(spark, sf_dir, "part").where(F.col("p_name").rlike("ring|bolt|gear|red"))
    found = p.select("p_partkey", F.when(F.col("p_name").rlike("ring|bolt"), "hide").otherwise("flag").alias("action"))
    log = parquet(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_returnflag") == "R", "hide").otherwise("flag").alias("action"))
    return policies.not_logged(found, log, ["p_partkey", "action"]).withColumn("hidden", F.col("action") == "hide")
