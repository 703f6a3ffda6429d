"""Search, paging, deletions, pages of JSON and HTML, and monitoring of list reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import linkage, search, tables, trigrams
from ..sources import readers
from ..sources.readers import parquet
from ..streaming.ingest import work_folder
from .registry import query

_NEWEST = "case l_linenumber % 3 when 0 then strftime(l_shipdate, '%Y') when 1 then strftime(l_shipdate, '%Y-%m') else strftime(l_shipdate, '%Y-%m-%d') end"


@query(f"""
with hit as (select p_partkey from part where p_retailprice > 0 and p_size % 10 > 0 and ((contains(lower(p_name), 'i-ng') or contains(lower(p_name), 'ing')) or (contains(lower(p_brand), 'i-ng') or contains(lower(p_brand), 'ing')) or p_name like '%r_d%')),
al as (select s_suppkey as id, s_suppkey - s_suppkey % 4 as grp from supplier),
ed as (select l_partkey from lineitem where l_suppkey in (select id from al where grp in (select grp from al where id in (1, 2)))),
pe as (select l_partkey from lineitem join orders on o_orderkey = l_orderkey where o_custkey % 3 = 0),
nw as (select l_partkey, max({_NEWEST}) as newest from lineitem group by 1)
select p_partkey, newest from hit left join nw on l_partkey = p_partkey where p_partkey in (select l_partkey from ed) and p_partkey in (select l_partkey from pe) and p_partkey in (select l_partkey from lineitem where l_returnflag = 'A') and p_partkey in (select p_partkey from part where p_type <> 'PROMO')
""")
def facet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published works whose name or brand holds the query, by category, source, person and publisher group; newest partial date as text."""
    p, li, o = (parquet(spark, sf_dir, t) for t in ("part", "lineitem", "orders"))
    hit = p.where("p_retailprice > 0 and p_size % 10 > 0 and p_type <> 'PROMO'").where(search.matches([F.lower("p_name"), F.lower("p_brand")], "i-ng") | search.matches([F.col("p_name")], "r_d", wildcards=True)).select("p_partkey")
    groups = parquet(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") - F.col("s_suppkey") % 4).alias("grp"))
    members = groups.join(groups.where("id in (1, 2)").select("grp").distinct(), "grp", "left_semi").select(F.col("id").alias("l_suppkey"))
    by_publisher = li.select("l_partkey", "l_suppkey").join(members, "l_suppkey", "left_semi")
    by_person = li.select("l_partkey", "l_orderkey").join(o.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    for side in (by_publisher, by_person, li.where("l_returnflag = 'A'")):
        hit = hit.join(side.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    date = lambda f: F.date_format("l_shipdate", f)
    newest = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.when(F.col("l_linenumber") % 3 == 0, date("yyyy")).when(F.col("l_linenumber") % 3 == 1, date("yyyy-MM")).otherwise(date("yyyy-MM-dd"))).alias("newest"))
    return hit.join(newest, "p_partkey", "left")


@query("""
select '42' as q, p_partkey from part where p_partkey = 42 union all select 'ring', p_partkey from part where contains(p_name, 'ring')
union all select '12#3', p_partkey from part where contains(p_name, '12#3') or contains(p_brand, '#3') and false
""")
def query_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number looks up an id, anything else is a text search."""
    p = parquet(spark, sf_dir, "part")
    some = [search.dispatch(p, q, "p_partkey", [F.col("p_name")]).select(F.lit(q.strip()).alias("q"), "p_partkey") for q in (" 42 ", "ring", "12#3")]
    return some[0].unionAll(some[1]).unionAll(some[2])


@query("""
with m as (select max(ts) as now from events)
select '26 hours' as span, event_id from events, m where ts >= now - interval 26 hour union all select 'since', event_id from events where ts >= timestamp '2024-01-20 12:00:00'
""")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last 26 hours, or since a given time; the present is a parameter."""
    e = parquet(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    last = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where(search.within(F.col("ts"), F.col("now"))).select(F.lit("26 hours").alias("span"), "event_id")
    return last.unionAll(e.where(search.within(F.col("ts"), F.lit(None), since=F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))).select(F.lit("since").alias("span"), "event_id"))


@query("""
with n as (select case when c_custkey % 3 = 0 then lower(c_mktsegment) when c_custkey % 3 = 1 then c_mktsegment else c_mktsegment || ' ' end as nm from customer)
select lower(trim(nm)) as folded, count(*) as n, count(distinct nm) as writings, min(nm) as first from n group by 1 having count(distinct nm) > 1
""")
def writings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are equal when folded and not byte by byte."""
    k, s = F.col("c_custkey") % 3, F.col("c_mktsegment")
    n = parquet(spark, sf_dir, "customer").select(F.when(k == 0, F.lower(s)).when(k == 1, s).otherwise(F.concat(s, F.lit(" "))).alias("nm"))
    return n.groupBy(F.lower(F.trim("nm")).alias("folded")).agg(F.count("*").alias("n"), F.count_distinct("nm").alias("writings"), F.min("nm").alias("first")).where("writings > 1")


@query("""select doc_id, coalesce(case when doc_id % 3 = 0 then nullif(source, '') end, left(text, 150)) as summary from documents""")
def card_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short description, or the first 150 characters of the long one."""
    d = parquet(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.nullif("source", F.lit(""))), text.capped(F.col("text"), 150)).alias("summary"))


@query("""
select page, o_orderkey from (select 'first' as page, o_orderkey from orders order by o_orderkey limit 40) union all
select page, o_orderkey from (select 'next' as page, o_orderkey from orders where o_orderkey > (select max(o_orderkey) from (select o_orderkey from orders order by o_orderkey limit 40)) order by o_orderkey limit 40)
""")
def seek_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages in a row, the second from the last key of the first."""
    o = parquet(spark, sf_dir, "orders").select("o_orderkey")
    first = search.seek(o, "o_orderkey", None, 40)
    after = first.agg(F.max("o_orderkey")).first()[0]  # one value
    return first.select(F.lit("first").alias("page"), "o_orderkey").unionAll(search.seek(o, "o_orderkey", after, 40).select(F.lit("next").alias("page"), "o_orderkey"))


@query("""
with k as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2)
select n as rows_a_key, count(*) as n_keys, cast(sum(n - 1) as bigint) as at_risk, round(sum(n - 1) / (select count(*) from lineitem), 6) as share from k group by 1
""")
def sort_key_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pages can lose because the sort key is not unique: all but one of each key's rows."""
    li = parquet(spark, sf_dir, "lineitem")
    k = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    by = k.groupBy(F.col("n").alias("rows_a_key")).agg(F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("at_risk"), F.sum("n").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("rows_a_key", "n_keys", "at_risk", F.round(F.col("at_risk") / F.col("total"), 6).alias("share"))


@query("""
with m as (select 'I' || (p_partkey % 500) as isbn, p_partkey as book, 0 as i from part where p_partkey % 3 > 0 union all select 'I' || (p_partkey % 300), p_partkey, 1 from part where p_partkey % 3 = 0)
select isbn, book from (select *, row_number() over (partition by isbn order by i desc, book desc) as n from m) where n = 1
""")
def number_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps from numbers to books united, a later source over an earlier one."""
    p, k = parquet(spark, sf_dir, "part"), F.col("p_partkey")
    made = lambda rows, n: rows.select(F.concat(F.lit("I"), (k % n).cast("string")).alias("isbn"), k.alias("book"))
    return tables.union_latest([made(p.where("p_partkey % 3 > 0"), 500), made(p.where("p_partkey % 3 = 0"), 300)], "isbn", "book")


@query("""
with gone as (select o_orderkey, p_partkey from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where o_orderstatus = 'F' and p_size > 25)
select l_orderkey, count(*) as kept from lineitem where not exists (select 1 from gone where o_orderkey = l_orderkey and p_partkey = l_partkey) group by 1
""")
def delete_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links deleted by conditions on the tables that they link."""
    li = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    f = parquet(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    big = parquet(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    gone = li.join(f, "l_orderkey", "left_semi").join(big, "l_partkey", "left_semi").distinct()
    return tables.delete_join(li, gone, ["l_orderkey", "l_partkey"]).groupBy("l_orderkey").agg(F.count("*").alias("kept"))


@query("""
with a as (select s_suppkey as id, s_name, s_suppkey - s_suppkey % 4 as grp from supplier)
select coalesce(c.id, a.grp) as publisher, coalesce(max(c.s_name), min(a.s_name)) as name, count(*) as n, cast(sum(k) as bigint) as editions from a left join a c on c.id = a.grp join (select l_suppkey, count(*) as k from lineitem group by 1) on l_suppkey = a.id group by 1
""")
def alias_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the resolved publisher: grouped by the whole expression, not by the column of the same name."""
    a = parquet(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", (F.col("s_suppkey") - F.col("s_suppkey") % 4).alias("grp"))
    c = a.select(F.col("id").alias("grp"), F.col("s_name").alias("canonical"))
    k = parquet(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("k"))
    return a.join(k, "id").join(c, "grp", "left").groupBy(F.col("grp").alias("publisher")).agg(F.coalesce(F.max("canonical"), F.min("s_name")).alias("name"), F.count("*").alias("n"), F.sum("k").alias("editions"))


@query("""
select c_nationkey as page, c_custkey as id, c_name as name, c_custkey % 7 as stock from customer where c_nationkey % 5 > 0
""")
def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of pages of JSON; broken pages give none."""
    c = parquet(spark, sf_dir, "customer")
    item = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct((F.col("c_custkey") % 7).alias("on_hand")).alias("stock"))
    pages = c.groupBy(F.col("c_nationkey").alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("products")).alias("data"))).alias("body"))
    pages = pages.withColumn("body", F.when(F.col("page") % 5 == 0, F.left("body", F.lit(40))).otherwise(F.col("body")))
    return readers.json_pages(pages, "body", "data.products", "id bigint, name string, stock struct<on_hand: bigint>").select("page", "id", "name", F.col("stock.on_hand").alias("stock"))


@query(r"""
with l as (select page_id, html, regexp_extract_all(html, '(?i)href="([^"]*)"', 1) as u from pages),
r as (select page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '') as title,
 nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '') as heading, len(u) as n_links,
 list_sort(list_distinct(list_filter(list_transform(u, lambda x: regexp_extract(x, '/([a-z0-9]+)$', 1)), lambda x: x <> ''))) as ids from l)
select page_id, title, heading, n_links, array_to_string(ids, ',') as products from r
""")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached pages read again: title, heading, and the ids at the end of their links."""
    return readers.page_records(parquet(spark, sf_dir, "pages").select("page_id", "html"), "html", "/([a-z0-9]+)$").drop("html")


@query("""
with p as (select user_id, (row_number() over (partition by user_id order by event_id) - 1) // 4 as page, event_type in ('view', 'click') as seen from events),
s as (select user_id, page, bool_and(seen) as all_seen from p group by 1, 2)
select user_id, coalesce(min(page) filter (where all_seen), max(page)) as last_page from s group by 1
""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a reader of newest-first lists stops: at the first page that has nothing new."""
    from pyspark.sql import Window

    e = parquet(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    pages = e.select("user_id", F.floor((n - 1) / 4).alias("page"), F.col("event_type").isin("view", "click").alias("seen"))
    return tables.stop_early(pages, "user_id", "page", "seen")


@query("""
with f as (select o_custkey as page, count(*) filter (where o_orderstatus = 'F') as n from orders group by 1), a as (select o_custkey as page, count(*) as n from orders where o_totalprice > 150000 group by 1)
select f.page, case when f.n = 0 then coalesce(a.n, 0) else f.n end as n, f.n = 0 as retried from f left join a on a.page = f.page
""")
def retry_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that gave nothing are read once more after the pass."""
    o = parquet(spark, sf_dir, "orders")
    first = o.groupBy(F.col("o_custkey").alias("page")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    again = o.where("o_totalprice > 150000").groupBy(F.col("o_custkey").alias("page")).agg(F.count("*").alias("n"))
    return tables.retry_empty(first, again, "page", "n")


@query("""
with d as (select c.c_nationkey as grp, o_orderdate::date as day, count(*) filter (where o_totalprice > 330000) as n, count(*) filter (where o_totalprice > 40000) as read from orders o join customer c on c.c_custkey = o.o_custkey group by 1, 2),
r as (select *, count(*) filter (where n = 0) over w as z, min(day) over w as first from d window w as (partition by grp order by day rows between 2 preceding and current row))
select grp, day, 'empty list' as reason from r where read = 0 union all select grp, day, 'zero run' from r where read > 0 and z = 3 and day - first = 2
""")
def read_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that were read empty, at once, and runs of three days without anything new."""
    o = parquet(spark, sf_dir, "orders").join(parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("grp")), "o_custkey")
    days = o.groupBy("grp", F.col("o_orderdate").cast("date").alias("day")).agg(F.count_if(F.col("o_totalprice") > 330000).alias("n"), F.count_if(F.col("o_totalprice") > 40000).alias("read"))
    return tables.read_alerts(days, "grp", "day", "n", "read", 3)


@query("""
with a as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT'), b as (select distinct o_custkey as k from orders where o_orderpriority = '5-LOW')
select k, 'left' as side from a where k not in (select k from b) union all select k, 'right' from b where k not in (select k from a)
""")
def set_diff_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with urgent orders only, and with low ones only."""
    o = parquet(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderpriority") == x).select(F.col("o_custkey").alias("k")) for x in ("1-URGENT", "5-LOW"))
    return tables.set_difference(a, b, "k")


@query("""
select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F') and c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')
""")
def with_and_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a finished order and without an urgent one."""
    c, o = parquet(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), parquet(spark, sf_dir, "orders")
    side = lambda condition: o.where(condition).select(F.col("o_custkey").alias("c_custkey"))
    return c.join(side("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(side("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")


@query("""
with recursive t as (select s_suppkey as k, case when s_suppkey % 5 > 0 then s_suppkey - 1 end as p from supplier), r as (select k, k as now, 0 as hops from t union all select r.k, t.p, hops + 1 from r join t on t.k = r.now where t.p is not null)
select k as id, min(now) as target, max(hops) as hops from r group by 1
""")
def redirect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an address leads in the end, over any number of redirects."""
    s = parquet(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_suppkey") - 1).alias("to"))
    flat = linkage.flatten_aliases(s, "id", "to")
    return flat.select("id", F.coalesce("to", "id").alias("target"), (F.col("id") - F.coalesce("to", "id")).alias("hops"))


_TITLES = ["活水集 2（簡體）", "活水集（正體）(簡)", "小傳／簡體字", "A B (繁體) ", "恩典 上/下（簡", "第１２冊 3 3", "年 1998", "中心 07"]


@query("""
with recursive t as (select p_partkey, (['""" + "','".join(_TITLES) + r"""'])[p_partkey % 8 + 1] || case when p_partkey % 3 = 0 then '（正）' else '' end as t from part),
r as (select p_partkey, t, 0 as i from t union all select p_partkey, regexp_replace(t, '[（(/／\-－]\s*(簡體字|繁體字|正體字|簡體|繁體|正體|简体|繁体|正体|簡|繁|正|简)\s*[)）]?\s*$', ''), i + 1 from r where i < 8),
c as (select p_partkey, trim(t) as clean from r where i = 8)
select c.p_partkey, clean, regexp_replace(clean, '[\s\x{3000}]+', '', 'g') as main, array_to_string(regexp_extract_all(t.t, '[0-9０-９]+|[上中下]'), ',') as marks from c join t using (p_partkey)
""")
def title_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without marks of script and version, however many, and the volume marks as they stand."""
    k = F.col("p_partkey")
    t = F.concat(F.get(F.array(*[F.lit(x) for x in _TITLES]), (k % 8).cast("int")), F.when(k % 3 == 0, F.lit("（正）")).otherwise(""))
    rows = parquet(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    return rows.select("p_partkey", text.without_variants(F.col("t")).alias("clean"), text.main_title(F.col("t")).alias("main"), F.array_join(text.volume_marks(F.col("t")), ",").alias("marks"))


@query("""
select p_partkey, '{"@context":"https://schema.org","@graph":[{"@type":"Book","name":"' || p_name || '",' || case when p_partkey % 3 > 0 then '"author":[{"@type":"Person","name":"' || p_brand || '"}],' else '' end || case when p_partkey % 2 = 0 then '"isbn":"I' || p_partkey || '",' else '' end
 || '"url":"/b/' || p_partkey || '"' || case when p_size > 5 then ',"offers":{"@type":"Offer","price":"' || p_size || '","priceCurrency":"TWD","availability":"https://schema.org/' || case when p_size > 20 then 'InStock' else 'OutOfStock' end || '"}' else '' end
 || '},{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Home","item":"/"},{"@type":"ListItem","position":2,"name":"' || p_type || '","item":"/c/' || p_type || '"}]}]}' as json from part
""")
def book_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked data of every book page: book, offer and breadcrumbs."""
    from ..sources import writers

    k = F.col("p_partkey")
    crumb = lambda n, u: F.struct(n.alias("name"), u.alias("url"))
    trail = F.array(crumb(F.lit("Home"), F.lit("/")), crumb(F.col("p_type"), F.concat(F.lit("/c/"), "p_type")))
    authors = F.when(k % 3 > 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    isbn = F.when(k % 2 == 0, F.concat(F.lit("I"), k.cast("string")))
    price = F.when(F.col("p_size") > 5, F.col("p_size"))
    return parquet(spark, sf_dir, "part").select("p_partkey", writers.book_graph(F.col("p_name"), authors, isbn, F.concat(F.lit("/b/"), k.cast("string")), trail, price, F.col("p_size") > 20).alias("json"))


@query("""
select p_partkey, case when p_partkey % 7 = 0 then 'no script' when p_partkey % 7 = 1 then 'no json' when p_partkey % 7 = 2 then 'kind' when p_partkey % 7 = 3 then 'no name' end as reject,
 case when p_partkey % 7 > 3 then p_name end as name, case when p_partkey % 7 > 3 and p_partkey % 2 = 0 then 'I' || p_partkey end as isbn, case when p_partkey % 7 > 3 then cast(p_size as varchar) end as price from part
""")
def checked_linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product data of cached pages, and why a page has none."""
    k = F.col("p_partkey")
    kind = F.when(k % 7 == 2, "Organization").when(k % 2 == 0, "Book").otherwise("Product")
    ld = F.to_json(F.struct(kind.alias("@type"), F.when(k % 7 == 3, " ").otherwise(F.col("p_name")).alias("name"), F.when(k % 2 == 0, F.concat(F.lit("I"), k.cast("string"))).alias("isbn"), F.struct(F.col("p_size").alias("price")).alias("offers")))
    body = F.when(k % 7 == 1, F.left(ld, F.lit(20))).otherwise(F.concat(F.lit("\n"), F.replace(ld, F.lit(","), F.lit(",\n"))))
    html = F.when(k % 7 == 0, F.lit("<p>none</p>")).otherwise(F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>")))
    return readers.checked_linked_data(parquet(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", html.alias("html")), "html").select("p_partkey", "reject", "name", "isbn", "price")


@query("""
select user_id % 200 + 1 as p_partkey, count(*) as clicks, max(event_id) as last from events where event_type = 'click' and user_id % 200 + 1 in (select p_partkey from part where p_size > 10) group by 1
""")
def kept_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks on books that there are, by book."""
    from ..sources import writers

    clicks = parquet(spark, sf_dir, "events").where("event_type = 'click'").select((F.col("user_id") % 200 + 1).alias("p_partkey"), "event_id")
    return writers.keep_clicks(clicks, parquet(spark, sf_dir, "part").where("p_size > 10"), "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("clicks"), F.max("event_id").alias("last"))


#: Substrings that are looked for: common and rare ones, with a hyphen, too short for a gram, and one that is nowhere.
LOOKED_FOR = ("ring", "red-", "steel bolt", "g", "no such part", "-")


@query("select q, p_partkey from part, (select unnest(['" + "', '".join(LOOKED_FOR) + "']) as q) where contains(lower(p_name), q) or contains(lower(p_type), q) or contains(lower(p_name), replace(q, '-', '')) or contains(lower(p_type), replace(q, '-', ''))")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of which the name or type holds a text, by an index of trigrams; the same rows as a scan."""
    p = parquet(spark, sf_dir, "part")
    index = trigrams.TrigramIndex(spark, f"{work_folder(spark)}/grams", buckets=16).build(p, "p_partkey", [F.lower("p_name"), F.lower("p_type")])
    found = [index.search(q).select(F.lit(q).alias("q"), F.col("key").alias("p_partkey")) for q in LOOKED_FOR]
    return reduce(DataFrame.unionByName, found)
