"""Record linkage and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text, titles
from ..operators import classify, linkage, tables
from ..sources.readers import parquet
from .registry import query


@query("""
with d as (select doc_id, source, md5(nullif(lower(regexp_replace(text, '[\\s\\p{Z}\\p{P}\\p{S}]+', '', 'g')), '')) as k from documents),
g as (select k, count(*) as members, count(distinct lang_n) as numbers from (select k, case when source = 'src0' then source end as lang_n from d where k is not null) group by k having count(*) > 1 and count(distinct lang_n) <= 1)
select doc_id, members, numbers, row_number() over (partition by d.k order by case when source = 'src0' then 0 else 1 end, doc_id) as place from d join g on d.k = g.k
""")
def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one loose key whose marked sources agree, the leader first; texts without any key stay apart."""
    d = parquet(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.nullif(text.loose_key(F.col("text")), F.lit(""))).alias("k"))
    d = d.withColumn("number", F.when(F.col("source") == "src0", F.col("source")))
    made = linkage.merge_groups(d, "k", "number", [F.when(F.col("source") == "src0", 0).otherwise(1), F.col("doc_id")])
    return made.select("doc_id", "members", "numbers", F.col("place").cast("long").alias("place"))


@query("""
with recursive e as (select distinct l_suppkey as a, 1000000 + l_partkey as b from lineitem where l_orderkey % 50 = 0),
n as (select a, b from e union select b, a from e),
r as (select a as node, a as root from n union select n.b, r.root from r join n on n.a = r.node)
select node, min(root) as root from r group by node
""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of suppliers and parts of every fiftieth order, as its SQL has it; all orders: components_whole."""
    li = parquet(spark, sf_dir, "lineitem").where("l_orderkey % 50 = 0")
    return linkage.components(li.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000).alias("b")), "a", "b")


@query()
def components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of suppliers and parts of all orders; tested against union-find."""
    li = parquet(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("part"))
    # parts are numbered behind the suppliers, however many there are
    behind = li.agg(F.greatest(F.lit(1_000_000), F.max("a") + 1).alias("behind"))
    edges = li.crossJoin(F.broadcast(behind)).select("a", (F.col("part") + F.col("behind")).alias("b"))
    return linkage.components(edges, "a", "b")


@query("""
select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on length(a.s_name) = length(b.s_name) and a.s_suppkey < b.s_suppkey and hamming(a.s_name, b.s_name) = 1
""")
def wildcard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.wildcard_pairs(parquet(spark, sf_dir, "supplier"), "s_suppkey", "s_name")


@query("""
with n as (select distinct p_name as name from part)
select a.name as a, b.name as b, round(1 - hamming(a.name, b.name) / length(a.name), 6) as ratio from n a join n b on length(a.name) = length(b.name) and left(a.name, 3) = left(b.name, 3) and a.name < b.name where 1 - hamming(a.name, b.name) / length(a.name) >= 0.6
""")
def script_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking by length and prefix, as its SQL has it, then the share of equal places; without the prefix: script_pairs_whole."""
    n = parquet(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("len", F.char_length("name")).withColumn("head", F.left("name", F.lit(3)))
    a, b = n.withColumnRenamed("name", "a"), n.withColumnRenamed("name", "b")
    return a.join(b, ["len", "head"]).where("a < b").withColumn("ratio", F.round(text.same_place_ratio(F.col("a"), F.col("b")), 6)).where("ratio >= 0.6").select("a", "b", "ratio")


@query("""
with n as (select distinct p_name as name from part)
select a.name as a, b.name as b, round(1 - hamming(a.name, b.name) / length(a.name), 6) as ratio from n a join n b on length(a.name) = length(b.name) and a.name < b.name where 1 - hamming(a.name, b.name) / length(a.name) >= 0.6
""")
def script_pairs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of names of one length with six tenths of their places equal."""
    n = parquet(spark, sf_dir, "part").select("p_name").distinct()
    return linkage.same_place_pairs(n, "p_name", 6, 10)


@query("""
with d as (select doc_id, lower(regexp_replace(coalesce(text, ''), '[^0-9A-Za-z]', '', 'g')) as k from documents),
b as (select item_id, lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) as k from benchmark),
j as (select doc_id, item_id, case when d.k = b.k then 'exact' when starts_with(d.k, b.k) or starts_with(b.k, d.k) then 'prefix' when left(d.k, 8) = left(b.k, 8) then 'common' end as level from d join b on left(d.k, 6) = left(b.k, 6) where length(d.k) >= 6)
select doc_id, count(level) as hits, min(level) as level from j where level is not null group by 1
""")
def prefix_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items against known ones in prefix buckets: equal, one a prefix of the other, or eight common characters."""
    key = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[^0-9A-Za-z]", ""))
    d = parquet(spark, sf_dir, "documents").select("doc_id", key("text").alias("k")).where("length(k) >= 6").withColumn("head", F.left("k", F.lit(6)))
    b = parquet(spark, sf_dir, "benchmark").select("item_id", key("text").alias("kb")).withColumn("head", F.left("kb", F.lit(6)))
    level = F.when(F.col("k") == F.col("kb"), "exact").when(F.startswith("k", "kb") | F.startswith("kb", "k"), "prefix").when(F.left("k", F.lit(8)) == F.left("kb", F.lit(8)), "common")
    return d.join(b, "head").withColumn("level", level).where("level is not null").groupBy("doc_id").agg(F.count("level").alias("hits"), F.min("level").alias("level"))


@query("""
with known as (select c_custkey, c_mktsegment || c_nationkey as seg, c_name as nm from customer where c_custkey % 2 = 0),
new as (select c_custkey as id, c_mktsegment || c_nationkey as seg, case when c_custkey % 3 = 0 then replace(c_name, '1', '0') end as nm from customer where c_custkey % 2 = 1),
s1 as (select id, max(c_custkey) as matched from new join known using (nm) group by id),
seg1 as (select seg, max(c_custkey) as matched from known group by seg having count(*) = 1),
s2 as (select id, matched from new join seg1 using (seg) where id not in (select id from s1))
select id, 'name' as stage, matched from s1 union all select id, 'segment', matched from s2 union all select id, 'new', null from new where id not in (select id from s1) and id not in (select id from s2)
""")
def staged_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching cascade: by number, then by a key that must be unique, else new."""
    c = parquet(spark, sf_dir, "customer").withColumn("seg", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")))
    known = c.where("c_custkey % 2 = 0").select("c_custkey", "seg", F.col("c_name").alias("nm"))
    new = c.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("id"), "seg", F.when(F.col("c_custkey") % 3 == 0, F.replace("c_name", F.lit("1"), F.lit("0"))).alias("nm"))
    return linkage.staged_match(new, known, "id", "c_custkey", [("name", "nm", False), ("segment", "seg", True)])


@query("""
with recursive t as (select s_suppkey as k, case when s_suppkey % 7 <> 0 then s_suppkey - 1 end as p from supplier),
r as (select k, k as now from t union all select r.k, t.p from r join t on t.k = r.now where t.p is not null)
select k as s_suppkey, nullif(min(now), k) as canonical from r group by k
""")
def flat_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = parquet(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") - 1).alias("canonical"))
    return linkage.flatten_aliases(s, "s_suppkey", "canonical")


@query("""
with o as (select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders),
p as (select a.o_orderkey as left_id, b.o_orderkey as right_id, abs(a.o_totalprice - b.o_totalprice) as gap from o a join o b on a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey)
select left_id, right_id from (select *, row_number() over (partition by left_id order by gap, right_id) as n from p) where n = 1
""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other row of the same block; ties go to the lower id."""
    o = parquet(spark, sf_dir, "orders")
    return linkage.nearest_in_block(o, "o_custkey", "o_totalprice", "o_orderkey").select(F.col("o_orderkey").alias("left_id"), F.col("nearest").alias("right_id"))


RULES = [("colour", ["red", "blue", "green"]), ("size", ["small", "large", "tiny"]), ("tool", ["bolt", "gear", "nut"])]
TITLE_ONLY = [("ring", ["ring"]), ("tool", ["widget"])]


@query("""
with m as (select p_partkey, p_name || ' ' || p_brand as full_text, p_name from part),
c as (select p_partkey, list_filter([
 case when contains(full_text, 'red') or contains(full_text, 'blue') or contains(full_text, 'green') then 'colour' end,
 case when contains(full_text, 'small') or contains(full_text, 'large') or contains(full_text, 'tiny') then 'size' end,
 case when contains(full_text, 'bolt') or contains(full_text, 'gear') or contains(full_text, 'nut') or contains(p_name, 'widget') then 'tool' end,
 case when contains(p_name, 'ring') then 'ring' end], lambda x: x is not null) as l, contains(full_text, 'bolt') or contains(full_text, 'gear') or contains(full_text, 'nut') as early from m),
s as (select p_partkey, case when len(l) = 0 then ['other'] when list_contains(l, 'tool') and list_contains(l, 'ring') and not early then list_concat(list_filter(l, lambda x: x <> 'tool'), ['tool']) else l end as l from c)
select p_partkey, array_to_string(l, ',') as categories, coalesce(list_filter(l, lambda x: x <> 'colour')[1], l[1]) as prime from s
""")
def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered keyword rules, title-only rules, a catch-all, and a primary that avoids low-priority categories."""
    p = parquet(spark, sf_dir, "part")
    found = p.select("p_partkey", classify.matched_rules(F.concat_ws(" ", "p_name", "p_brand"), F.col("p_name"), RULES, TITLE_ONLY, "other").alias("c"))
    return found.select("p_partkey", F.array_join("c", ",").alias("categories"), classify.primary(F.col("c"), ["colour"]).alias("prime"))


MAP = [("0", "alpha", 2, False), ("1", "beta", 1, False), ("2", None, 3, True), ("3", "alpha", 4, False), ("4", "gamma", 1, True)]


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_suppkey") % 6).cast("string").alias("code"), "l_returnflag")
    sources = li.groupBy("item").agg(F.count_distinct("l_returnflag").alias("n_sources"))
    return li.select("item", "code").distinct().join(sources, "item")


_MAP_SQL = """
with li as (select distinct l_orderkey as item, cast(l_suppkey % 6 as varchar) as code from lineitem),
src as (select l_orderkey as item, count(distinct l_returnflag) as n from lineitem group by 1),
m(code, category, sort_order, unpublish) as (values ('0', 'alpha', 2, false), ('1', 'beta', 1, false), ('2', null, 3, true), ('3', 'alpha', 4, false), ('4', 'gamma', 1, true)),
j as (select item, code, category, sort_order, coalesce(unpublish, false) as stop, m.code is not null as known from li join src using (item) left join m using (code) where n = 1),
f as (select item, {rule} as delisted from j group by 1),
c as (select item, category, min(row(coalesce(sort_order, 999), code)) as spot from j where category is not null group by 1, 2),
r as (select item, category, case when row_number() over (partition by item order by spot, category) = 1 then 10 else 5 end as weight from c)
select f.item, category, weight, delisted from f left join r on f.item = r.item
"""


@query(_MAP_SQL.format(rule="bool_or(stop)"))
def map_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping-table classification, delisted on any delisting code."""
    m = spark.createDataFrame(MAP, "code string, category string, sort_order int, unpublish boolean")
    return classify.by_mapping(_codes(spark, sf_dir), F.broadcast(m), classify.Policy("any"))


@query(_MAP_SQL.format(rule="bool_and(stop)"))
def map_classify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, delisted only if all codes delist."""
    m = spark.createDataFrame(MAP, "code string, category string, sort_order int, unpublish boolean")
    return classify.by_mapping(_codes(spark, sf_dir), F.broadcast(m), classify.Policy("all"))


@query("""
select p_partkey, case when contains(p_name, 'ring') or contains(p_name, 'bolt') then 'A' when contains(p_name, 'gear') or contains(p_name, 'red') then 'B' end as tier,
 case when contains(p_name, 'ring') then 'ring' when contains(p_name, 'bolt') then 'bolt' when contains(p_name, 'gear') then 'gear' else 'red' end as word
from part where (contains(p_name, 'ring') or contains(p_name, 'bolt') or contains(p_name, 'gear') or contains(p_name, 'red')) and p_partkey not in (select l_partkey from lineitem where l_orderkey % 10 = 0)
""")
def guard_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiered word guard over listings that were not decided before."""
    p = parquet(spark, sf_dir, "part").select("p_partkey", "p_name")
    decided = parquet(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 0").select(F.col("l_partkey").alias("p_partkey"))
    hit = p.withColumn("t", titles.tier(F.col("p_name"), ("ring", "bolt"), ("gear", "red"))).where("t is not null")
    return hit.join(decided, "p_partkey", "left_anti").select("p_partkey", "t.tier", "t.word")


@query("""
with l as (select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events)
select user_id, event_type as last, coalesce(event_type = 'signup', false) as locked from l where n = 1
""")
def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parquet(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return classify.latest_decision(e, "user_id", "ts", "event_id", "event_type").select("user_id", F.col("event_type").alias("last"), (F.col("event_type") == "signup").alias("locked"))


@query("""
with k as (select l_orderkey % 100 as parent, l_partkey % 40 as child, min(l_linenumber) as v from lineitem group by 1, 2),
m as (select case when parent >= 50 then parent - 50 else parent end as parent, child, v, parent >= 50 as moved from k)
select parent, child, v from (select *, row_number() over (partition by parent, child order by moved, v) as n from m) where n = 1
""")
def merge_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of merged parents move; where they clash the kept parent's row stays."""
    k = parquet(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("parent"), (F.col("l_partkey") % 40).alias("child")).agg(F.min("l_linenumber").alias("v"))
    mapping = spark.range(50, 100).select(F.col("id").alias("old"), (F.col("id") - 50).alias("new"))
    return tables.move_children(k, F.broadcast(mapping), "parent", "old", "new", ["parent", "child"], [F.col("v")]).select("parent", "child", "v")


@query("""
select a.o_orderkey as a, b.o_orderkey as b, case when a.o_orderpriority is null then 'review' when a.o_orderpriority <> b.o_orderpriority then 'keep' when a.o_orderstatus = b.o_orderstatus then 'review' else 'merge' end as verdict
from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderdate = b.o_orderdate and a.o_orderkey < b.o_orderkey
""")
def pair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings of one key: merge, review or keep, by compatible authors and overlapping sources."""
    o = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.translate("o_orderpriority", "- ", "").alias("author"), F.array("o_orderstatus").alias("src"))
    a = o.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("a"), F.col("author").alias("aa"), F.col("src").alias("sa"))
    b = o.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("b"), F.col("author").alias("ab"), F.col("src").alias("sb"))
    return a.join(b, ["o_custkey", "o_orderdate"]).where("a < b").select("a", "b", names.judge(F.col("aa"), F.col("ab"), F.col("sa"), F.col("sb")).alias("verdict"))


_CREDITS = ["文、圖:王小明", "文:江淑文\\圖:陳嘉鈴", "巴刻著 趙中輝譯", "賴特（N. T. Wright；湯姆）；李四 等", "A&#59;B", "陳志文"]


@query("""
select s_suppkey, place, name, credit, role from supplier join (values (0, 0, '王小明', '王小明', 'author'), (0, 1, '王小明', '王小明', 'illustrator'), (1, 0, '江淑文', '文:江淑文', 'author'), (1, 1, '陳嘉鈴', '圖:陳嘉鈴', 'illustrator'), (2, 0, '巴刻', '巴刻著', 'author'), (2, 1, '趙中輝', '趙中輝譯', 'translator'),
 (3, 0, '賴特（N. T. Wright；湯姆）', '賴特（N. T. Wright；湯姆）', null), (3, 1, '李四', '李四 等', null), (4, 0, 'A', 'A', null), (4, 1, 'B', 'B', null), (5, 0, '陳志文', '陳志文', null)) as t(line, place, name, credit, role) on line = s_suppkey % 6
""")
def name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's credit line split into people with roles."""
    line = F.get(F.array(*[F.lit(c) for c in _CREDITS]), (F.col("s_suppkey") % len(_CREDITS)).cast("int"))
    df = parquet(spark, sf_dir, "supplier").select("s_suppkey", line.alias("credit"))
    return names.people(df, "s_suppkey", "credit").select("s_suppkey", "place", "name", "credit", "role")


@query("""
select p_partkey, p_name, cast(coalesce(search_n, 0) as bigint) as n_suppliers, coalesce(suppliers, '') as suppliers from (select p_partkey, p_name from part) left join (select l_partkey, count(distinct l_suppkey) as search_n, string_agg(distinct cast(l_suppkey as varchar), ' ' order by cast(l_suppkey as varchar)) as suppliers from lineitem group by 1) on l_partkey = p_partkey
""")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The denormalised search column: distinct child values joined in a fixed order."""
    made = parquet(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n_suppliers"), F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), " ").alias("suppliers"))
    made = parquet(spark, sf_dir, "part").select("p_partkey", "p_name").join(made, F.col("l_partkey") == F.col("p_partkey"), "left")
    return made.select("p_partkey", "p_name", F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"), F.coalesce("suppliers", F.lit("")).alias("suppliers"))


@query("""
with a as (select p_name as k, count(*) as n from part group by 1), b as (select split_part(p_name, ' ', 2) as k, count(*) as n from part group by 1)
select p_partkey, a.n as old_size, b.n as new_size, case when b.n > a.n then 'merged' when b.n < a.n then 'split' else 'same' end as impact from part join a on a.k = p_name join b on b.k = split_part(p_name, ' ', 2)
""")
def key_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of a changed key: which rows' groups grow or shrink."""
    p = parquet(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("old"), F.split("p_name", " ")[1].alias("new"))
    old, new = p.groupBy("old").agg(F.count("*").alias("old_size")), p.groupBy("new").agg(F.count("*").alias("new_size"))
    out = p.join(old, "old").join(new, "new")
    return out.select("p_partkey", "old_size", "new_size", F.when(F.col("new_size") > F.col("old_size"), "merged").when(F.col("new_size") < F.col("old_size"), "split").otherwise("same").alias("impact"))


@query("""
select l_partkey, min(l_suppkey) as first_supplier from lineitem where l_partkey in (select p_partkey from part where p_type = 'ECONOMY') and l_partkey not in (select l_partkey from lineitem where l_returnflag = 'R') group by 1
""")
def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = parquet(spark, sf_dir, "lineitem"), parquet(spark, sf_dir, "part").where("p_type = 'ECONOMY'")
    returned = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    kept = li.select("l_partkey", "l_suppkey").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(returned, F.col("l_partkey") == F.col("k"), "left_anti")
    return kept.groupBy("l_partkey").agg(F.min("l_suppkey").alias("first_supplier"))


@query("""select p_partkey, p_name from (select *, row_number() over (partition by p_name order by p_retailprice desc, p_partkey) as n from part) where n <= 2""")
def top_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = parquet(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    w = Window.partitionBy("p_name").orderBy(F.desc("p_retailprice"), "p_partkey")
    return p.withColumn("n", F.row_number().over(w)).where("n <= 2").select("p_partkey", "p_name")


