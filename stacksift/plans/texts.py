"""Text normalisation, numbers, dates, JSON and page queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text, titles
from ..sources.readers import parquet
from .registry import query


@query("""
select doc_id, md5(lower(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}\\p{P}\\p{S}]+', '', 'g'))) as loose, md5(lower(regexp_replace(coalesce(text, ''), '[^0-9A-Za-z\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{f900}-\\x{faff}]', '', 'g'))) as strict,
 md5(lower(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}\\p{P}\\p{S}]+', '', 'g')) || '|' || lower(regexp_replace(source, '[\\s\\p{Z}\\p{P}\\p{S}]+', '', 'g'))) as fuzzy from documents where text <> ''
""")
def norm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parquet(spark, sf_dir, "documents").where("text <> ''")
    return d.select("doc_id", F.md5(text.loose_key(F.col("text"))).alias("loose"), F.md5(text.strict_key(F.col("text"))).alias("strict"), F.md5(text.title_author_key(F.col("text"), F.col("source"))).alias("fuzzy"))


@query("""
with n as (select p_partkey, '97' || (8 + p_partkey % 2) || lpad(cast(p_partkey * 7919 % 10000000000 as varchar), 10, '0') as t, lpad(cast(p_partkey * 104729 % 1000000000 as varchar), 9, '0') || case when p_partkey % 11 = 0 then 'X' else cast(p_partkey % 10 as varchar) end as s from part),
c as (select *, list_sum(list_transform(range(1, 14), lambda i: cast(substr(t, i, 1) as int) * case when i % 2 = 0 then 3 else 1 end)) % 10 = 0 as ok13,
 list_sum(list_transform(range(1, 11), lambda i: case when substr(s, i, 1) = 'X' then 10 else cast(substr(s, i, 1) as int) end * (11 - i))) % 11 = 0 as ok10, '978' || left(s, 9) as core from n)
select p_partkey, ok13, ok10, core || cast((10 - list_sum(list_transform(range(1, 13), lambda i: cast(substr(core, i, 1) as int) * case when i % 2 = 0 then 3 else 1 end)) % 10) % 10 as varchar) as converted from c
""")
def isbn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parquet(spark, sf_dir, "part")
    t = F.concat(F.lit("97"), (8 + F.col("p_partkey") % 2).cast("string"), F.lpad((F.col("p_partkey") * 7919 % 10_000_000_000).cast("string"), 10, "0"))
    s = F.concat(F.lpad((F.col("p_partkey") * 104729 % 1_000_000_000).cast("string"), 9, "0"), F.when(F.col("p_partkey") % 11 == 0, "X").otherwise((F.col("p_partkey") % 10).cast("string")))
    n = p.select("p_partkey", t.alias("t"), s.alias("s"))
    return n.select("p_partkey", ids.is_isbn13(F.col("t")).alias("ok13"), ids.is_isbn10(F.col("s")).alias("ok10"), ids.isbn13_of_10(F.col("s")).alias("converted"))


@query("""
with d as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m') when 2 then strftime(o_orderdate, '%Y') else strftime(o_orderdate, '%Y-%-m-%-d') end as s from orders)
select o_orderkey, case when length(regexp_replace(s, '[^0-9]', '', 'g')) >= 8 then substr(regexp_replace(s, '[^0-9]', '', 'g'), 1, 4) || '-' || substr(regexp_replace(s, '[^0-9]', '', 'g'), 5, 2) || '-' || substr(regexp_replace(s, '[^0-9]', '', 'g'), 7, 2)
 when length(regexp_replace(s, '[^0-9]', '', 'g')) >= 6 then substr(regexp_replace(s, '[^0-9]', '', 'g'), 1, 4) || '-' || substr(regexp_replace(s, '[^0-9]', '', 'g'), 5, 2) when length(regexp_replace(s, '[^0-9]', '', 'g')) >= 4 then substr(regexp_replace(s, '[^0-9]', '', 'g'), 1, 4) end as loose,
 case when o_orderkey % 4 in (0, 3) then (select strftime(o_orderdate, '%Y-%m-%d')) when o_orderkey % 4 = 1 then s else s end as strict,
 case when o_orderkey % 4 in (0, 3) then strftime(o_orderdate, '%Y-%m-%d') else s end between '1996' and '1998-12-31' as in_range from d join orders using (o_orderkey)
""")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = parquet(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    s = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy")).otherwise(F.date_format(d, "yyyy-M-d"))
    n = o.select("o_orderkey", s.alias("s"))
    strict = ids.strict_date(F.col("s"))
    return n.select("o_orderkey", ids.loose_date(F.col("s")).alias("loose"), strict.alias("strict"), ids.in_years(strict, "1996", "1998").alias("in_range"))


@query("""
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, array_to_string(json_keys(props), ',') as keys, '{"events":' || props || ',"' || event_type || '_dup' || event_id || '":"x"}' as merged from events
""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and keys of a JSON column, and a map merged under a fresh key."""
    e = parquet(spark, sf_dir, "events").select("event_id", "event_type", "props")
    fresh = F.concat("event_type", F.lit("_dup"), F.col("event_id").cast("string"))
    merged = F.concat(F.lit('{"events":'), F.col("props"), F.lit(',"'), fresh, F.lit('":"x"}'))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.array_join(F.json_object_keys("props"), ",").alias("keys"), merged.alias("merged"))


@query("""
select page_id, count(distinct link) as n_links, min(link) as first_link from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages) group by 1
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = parquet(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id").agg(F.count_distinct("link").alias("n_links"), F.min("link").alias("first_link"))


@query("""
select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, md5(regexp_replace(regexp_replace(regexp_replace(html, '<(?:script|style)[^>]*>[^<]*(?:<[^/][^<]*|</[^s][^<]*)*</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) as plain from pages
""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and stripped text of every page."""
    bare = F.regexp_replace("html", r"<(?:script|style)[^>]*>[^<]*(?:<[^/][^<]*|</[^s][^<]*)*</(?:script|style)>", " ")
    plain = F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "[ \\t\\r\\n]+", " ")
    return parquet(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.md5(plain).alias("plain"))


@query("""
select lang, 'digits' as pattern, count(*) filter (where regexp_matches(text, '[0-9]{4,}')) as n from documents group by 1
union all select lang, 'mail', count(*) filter (where regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) from documents group by 1
union all select lang, 'license', count(*) filter (where contains(lower(text), 'license')) from documents group by 1
""")
def pattern_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pattern counts: one scan and one aggregate, then a row for each pattern."""
    d = parquet(spark, sf_dir, "documents")
    one = d.groupBy("lang").agg(F.count_if(F.col("text").rlike("[0-9]{4,}")).alias("digits"), F.count_if(F.col("text").rlike("[A-Za-z0-9._]+@[A-Za-z0-9.]+")).alias("mail"), F.count_if(F.contains(F.lower("text"), F.lit("license"))).alias("license"))
    return one.unpivot("lang", ["digits", "mail", "license"], "pattern", "n")


@query("""
select c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) as number, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'none') as segment, case when c_acctbal < 0 then 'debt' when c_acctbal >= 5000 then 'rich' else 'mid' end as level, left(c_name, 5) || '...' as short, replace(c_name, '#', '-') as slug from customer
""")
def scalar_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") >= 5000, "rich").otherwise("mid")
    return parquet(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)$", 1).alias("number"), F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("none")).alias("segment"), level.alias("level"), F.concat(F.left("c_name", F.lit(5)), F.lit("...")).alias("short"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("slug"))


_PROMO = [("路加{k}(79折)", "路加{k}", False), ("聖經故事{k} 特價", "聖經故事{k}", False), ("恩典{k}【首刷優惠套組】", "恩典{k}【首刷優惠套組】", True), ("限量{k}(特價限量)", "限量{k}(特價限量)", True), ("十字架的道路{k}", "十字架的道路{k}", False), ("書 特價", "書 特價", True), ("平安優惠的人生{k}", "平安優惠的人生{k}", True)]


@query("select p_partkey, replace(title, '{k}', p_partkey::varchar) as title, replace(clean, '{k}', p_partkey::varchar) as clean, held from part join (values " + ", ".join(f"({i}, '{t}', '{c}', {h})" for i, (t, c, h) in enumerate(_PROMO)) + f") as t(form, title, clean, held) on form = p_partkey % {len(_PROMO)}")
def title_promo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotional words taken off the titles of all parts, or held."""
    k = F.col("p_partkey")
    title = F.replace(F.get(F.array(*[F.lit(t) for t, _, _ in _PROMO]), (k % len(_PROMO)).cast("int")), F.lit("{k}"), k.cast("string"))
    df = parquet(spark, sf_dir, "part").select("p_partkey", title.alias("title"))
    return df.select("p_partkey", "title", titles.strip_promo(F.col("title")).alias("p")).select("p_partkey", "title", "p.clean", "p.held")


@query("""
with p as (select distinct p_name from part), x as (select a.p_name as a, b.p_name as b from p a join p b on split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) and a.p_name < b.p_name),
s as (select a, b, unnest(range(1, length(a) + 1)) as i from x), t as (select a, b, i, unnest(range(1, length(a) - i + 2)) as n from s)
select a, b, max(case when contains(b, substr(a, i, n)) then n else 0 end) as common from t group by 1, 2
""")
def common_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parquet(spark, sf_dir, "part").select("p_name").distinct().withColumn("tail", F.split("p_name", " ")[1])
    x = p.withColumnRenamed("p_name", "a").join(p.withColumnRenamed("p_name", "b"), "tail").where("a < b")
    return x.select("a", "b", text.common_substring(F.col("a"), F.col("b")).cast("long").alias("common"))


@query("""
with t as (select p_partkey, case p_partkey % 5 when 0 then p_brand || ':' when 1 then ' ' || p_name || ' ' when 2 then '' when 3 then 'a label that is long:' else p_type || '：' end as s from part)
select p_partkey, case when trim(s) <> '' and not regexp_matches(trim(s), '^[^:：]{0,8}[:：]$') then left(trim(s), 12) end as field from t
""")
def tidy_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that hold nothing or only a label become null, others are cut to the width of their column."""
    k = F.col("p_partkey") % 5
    s = F.when(k == 0, F.concat("p_brand", F.lit(":"))).when(k == 1, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(k == 2, "").when(k == 3, "a label that is long:").otherwise(F.concat("p_type", F.lit("：")))
    return parquet(spark, sf_dir, "part").select("p_partkey", text.capped(text.tidy_label(s), 12).alias("field"))


@query("""
with p as (select a.p_partkey as a, b.p_partkey as b, a.p_name as x, b.p_name as y from part a join part b on b.p_partkey = a.p_partkey + 1)
select a, b, len(list_filter(generate_series(1, least(length(x), length(y))::int), lambda i: left(x, i) = left(y, i))) as common from p
""")
def common_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters two neighbouring names begin with in common."""
    p = parquet(spark, sf_dir, "part")
    a, b = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")), p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", text.common_prefix(F.col("x"), F.col("y")).alias("common"))
