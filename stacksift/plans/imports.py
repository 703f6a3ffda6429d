"""Imports, merges and duplicate reports over listings made from customers by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import imports, ordered_import
from ..sources.readers import parquet
from .registry import query

_BOOKS = """b as (select c_custkey as id, case when c_custkey % 3 = 0 then 'I' || (c_custkey % 200) end as isbn, case when c_custkey % 37 = 0 then '' else 't' || (c_custkey % 30) end as title,
 case when c_custkey % 7 = 0 then '' else 'author' || (c_custkey % 5) end as author, 'p' || (c_custkey % 4) as publisher, 's' || (c_custkey % 3) as source, c_custkey % 11 = 0 as ebook, c_custkey % 13 < 4 as loose from customer)"""


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda head, n: F.concat(F.lit(head), (k % n).cast("string"))
    return parquet(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 3 == 0, part("I", 200)).alias("isbn"), F.when(k % 37 == 0, "").otherwise(part("t", 30)).alias("title"), F.when(k % 7 == 0, "").otherwise(part("author", 5)).alias("author"),
        part("p", 4).alias("publisher"), F.array(part("s", 3)).alias("sources"), (k % 11 == 0).alias("ebook"), (k % 13 < 4).alias("loose"),
    )


@query(f"""
with {_BOOKS}, w as (select *, case when title <> '' and author <> '' then title || '|' || author end as work from b),
n as (select * from w where id % 5 = 0), k as (select * from w where id % 5 > 0),
s1 as (select n.id, max(k.id) as hit from n join k on n.isbn = k.isbn group by 1),
r1 as (select s1.id, s1.hit, n.loose and not coalesce(n.work = k.work, false) as conflict from s1 join n on n.id = s1.id join k on k.id = s1.hit),
s2 as (select n.id, max(k.id) as hit from n join k on n.work = k.work where n.id not in (select id from s1) group by 1),
r2 as (select s2.id, s2.hit from s2 join n on n.id = s2.id join k on k.id = s2.hit where n.isbn is null or k.isbn is null or n.isbn = k.isbn or n.ebook),
r3 as (select n.id, max(k.id) as hit from n join k on n.title = k.title and n.publisher = k.publisher where n.title <> '' and n.id not in (select id from s1) and n.id not in (select id from r2)
 and (n.author = k.author or n.author = '' or k.author = '') and not (n.author = '' and k.author = '') and n.source <> k.source and (n.isbn is null or k.isbn is null or n.isbn = k.isbn or n.ebook) group by 1 having count(*) = 1)
select id, case when conflict then 'isbn_conflict' else 'isbn' end as stage, case when not conflict then hit end as matched from r1
union all select id, 'work', hit from r2 union all select id, 'title_publisher', hit from r3
union all select id, 'new', null from n where id not in (select id from r1) and id not in (select id from r2) and id not in (select id from r3)
""")
def import_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New listings by number (checked where numbers are not unique), by work, by title and publisher, else new."""
    b = _books(spark, sf_dir).withColumn("work", text.title_author_key(F.col("title"), F.col("author")))
    return imports.import_cascade(b.where("id % 5 = 0"), b.where("id % 5 > 0"))


@query()
def import_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of listings against known ones and against its own earlier rows; in the order of the file."""
    b = _books(spark, sf_dir).withColumn("work", text.title_author_key(F.col("title"), F.col("author")))
    file = b.where("id % 5 < 3").select(F.col("id").alias("place"), "isbn", "work", "title", "publisher", "author", F.array(F.lit("own")).alias("sources"), "ebook", "loose")
    return ordered_import.import_in_order(file, b.where("id % 5 >= 3 and id % 30 < 20"))


@query(f"""
with {_BOOKS}, e as (select o_custkey as id, count(*) as n from orders group by 1),
g as (select title, author from b where title <> '' and author <> '' group by 1, 2 having count(*) > 1 and count(distinct isbn) <= 1),
r as (select b.id, first_value(b.id) over (partition by b.title, b.author order by isbn is null, coalesce(e.n, 0) desc, b.id) as keep from b join g on b.title = g.title and b.author = g.author left join e on e.id = b.id)
select keep, id as dup from r where id <> keep
""")
def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of one title and author with one number at most, into the one with a number, most editions, least id."""
    return imports.merge_plan(_books(spark, sf_dir), parquet(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query("""
with p as (select l_partkey as dup, l_suppkey as keep from lineitem where l_linenumber = 1)
select dup, count(*) as lines from p group by 1 having count(*) > 1 or bool_or(dup = keep)
""")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that a reviewed list merges twice, or into themselves."""
    return imports.merge_conflicts(parquet(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("dup"), F.col("l_suppkey").alias("keep")))


@query("""
with clean as (select s_suppkey as dup, s_suppkey + 1 as keep from supplier where s_suppkey % 3 = 0), spoiled as (select * from clean union all select min(dup), 0 from clean)
select 'clean' as list, dup, keep from clean where not exists (select dup from clean group by dup having count(*) > 1)
union all select 'spoiled', dup, keep from spoiled where not exists (select dup from spoiled group by dup having count(*) > 1)
""")
def reviewed_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewed list is taken as a whole or, where one book is named twice, not at all."""
    clean = parquet(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("dup"), (F.col("s_suppkey") + 1).alias("keep"))
    spoiled = clean.unionByName(clean.agg(F.min("dup").alias("dup"), F.lit(0).cast("long").alias("keep")))
    return imports.reviewed_merges(clean).withColumn("list", F.lit("clean")).unionByName(imports.reviewed_merges(spoiled).withColumn("list", F.lit("spoiled")))


@query("""
with b as (select c_custkey as id, case when c_custkey % 3 = 0 then 'I' || c_custkey end as isbn, case when c_custkey % 2 = 0 then c_mktsegment end as segment from customer),
p as (select c_custkey as dup, c_custkey - c_custkey % 4 as keep from customer where c_custkey % 4 > 0 and c_custkey > 4),
c as (select o_orderkey as child, o_custkey as parent, o_orderpriority as url from orders),
m as (select c.child, coalesce(p.keep, c.parent) as parent, c.url, p.keep is not null as moved from c left join p on p.dup = c.parent),
kc as (select parent, count(*) as children, min(child) as first_child from (select *, row_number() over (partition by parent, url order by moved, child) as n from m) where n = 1 group by 1)
select b.id, coalesce(b.isbn, (select arg_min(d.isbn, d.id) from b d join p on p.dup = d.id where p.keep = b.id and d.isbn is not null)) as isbn,
 coalesce(b.segment, (select arg_min(d.segment, d.id) from b d join p on p.dup = d.id where p.keep = b.id and d.segment is not null)) as segment,
 coalesce(children, 0) as children, first_child, (select count(*) from p where p.keep = b.id) as redirects
from b left join kc on kc.parent = b.id where b.id not in (select dup from p)
""")
def merged_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge carried out: children moved without repeats, gaps filled, duplicates gone, redirects written."""
    k = F.col("c_custkey")
    c = parquet(spark, sf_dir, "customer")
    books = c.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("I"), k.cast("string"))).alias("isbn"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    pairs = c.where("c_custkey % 4 > 0 and c_custkey > 4").select((k - k % 4).alias("keep"), k.alias("dup"))
    children = parquet(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("url"))
    kept, moved, redirects = imports.merge_books(books, children, pairs, ["isbn", "segment"])
    by = moved.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"), F.min("child").alias("first_child"))
    to = redirects.groupBy(F.col("new").alias("id")).agg(F.count("*").alias("redirects"))
    return kept.join(by, "id", "left").join(to, "id", "left").select("id", "isbn", "segment", F.coalesce("children", F.lit(0)).alias("children"), "first_child", F.coalesce("redirects", F.lit(0)).alias("redirects"))


@query("""
with recursive b as (select c_custkey as id, case when c_custkey % 5 < 2 then 'I' || (c_custkey // 9) end as isbn from customer),
k as (select id, 'a' || (id // 3) as key from b union all select id, 'b' || (id // 6) from b where id % 6 in (2, 3)),
n as (select distinct x.id as a, y.id as b from k x join k y using (key)),
r as (select a as id, a as root from n union select n.b, r.root from r join n on n.a = r.id),
c as (select id, min(root) as root from r group by 1),
f as (select root from c join b using (id) group by 1 having count(*) > 1 and count(distinct isbn) <= 1 and count(isbn) < count(*))
select root, id from c where root in (select root from f)
""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that share keys through others, without groups of several numbers and groups where all have one."""
    i = F.col("c_custkey")
    b = parquet(spark, sf_dir, "customer").select(i.alias("id"), F.when(i % 5 < 2, F.concat(F.lit("I"), F.floor(i / 9).cast("string"))).alias("isbn"))
    key = lambda head, n: F.concat(F.lit(head), F.floor(F.col("id") / n).cast("string"))
    keys = b.select("id", key("a", 3).alias("key")).unionByName(b.where("id % 6 in (2, 3)").select("id", key("b", 6).alias("key")))
    return imports.duplicate_groups(b, keys)


@query("""
with t as (select p_partkey as id, p_name || ' ' || (p_partkey % 9) as title, cast(p_partkey % 3 as varchar) as volume, p_brand as publisher, case when p_partkey % 2 = 0 then cast(p_partkey // 40 as varchar) end as prefix from part)
select a.id as id_a, b.id as id_b, round(1 - hamming(a.title, b.title) / length(a.title), 6) as ratio from t a join t b on length(a.title) = length(b.title) and a.volume = b.volume and a.id < b.id and (a.publisher = b.publisher or a.prefix = b.prefix)
where round(1 - hamming(a.title, b.title) / length(a.title), 6) >= 0.6
""")
def edition_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of editions: one length, equal volumes, one publisher or number prefix, six tenths of the places equal."""
    k = F.col("p_partkey")
    t = parquet(spark, sf_dir, "part").select(k.alias("id"), F.concat_ws(" ", "p_name", (k % 9).cast("string")).alias("title"), (k % 3).cast("string").alias("volume"), F.concat(F.lit("p:"), "p_brand").alias("publisher"), F.when(k % 2 == 0, F.concat(F.lit("i:"), F.floor(k / 40).cast("string"))).alias("prefix"))
    return imports.edition_pairs(t, "title", F.array("publisher", "prefix"))


@query("""
with t as (select p_partkey as id, case when p_partkey % 9 = 0 then 'I' || (p_partkey % 50) end as isbn, lower(replace(p_name, ' ', '')) || case p_partkey % 4 when 0 then '' when 1 then 'extended' when 2 then cast(p_partkey % 100 as varchar) else '' end as k from part),
n as (select id, isbn, case when id % 50 = 10 then 'xyz' || k else k end as key from t where id % 10 = 0), o as (select isbn, substr(k, 1, case when id % 7 = 0 then 9 else 30 end) as k from t where id % 10 > 0)
select id, case when exists (select 1 from o where o.isbn = n.isbn) then 'isbn' when exists (select 1 from o where o.k = n.key) then 'exact'
 when exists (select 1 from o where length(o.k) >= 6 and length(n.key) >= 6 and (starts_with(o.k, n.key) or starts_with(n.key, o.k))) then 'prefix'
 when exists (select 1 from o where length(n.key) >= 8 and left(o.k, 8) = left(n.key, 8)) then 'common' else 'none' end as level from n
""")
def new_item_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items against known ones: by number, equal, one a beginning of the other, a common beginning, or nothing."""
    i = F.col("p_partkey")
    key = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))), F.when(i % 4 == 1, "extended").when(i % 4 == 2, (i % 100).cast("string")).otherwise(""))
    t = parquet(spark, sf_dir, "part").select(i.alias("id"), F.when(i % 9 == 0, F.concat(F.lit("I"), (i % 50).cast("string"))).alias("isbn"), key.alias("key"))
    new = t.where("id % 10 = 0").withColumn("key", F.when(F.col("id") % 50 == 10, F.concat(F.lit("xyz"), "key")).otherwise(F.col("key")))
    known = t.where("id % 10 > 0").withColumn("key", F.when(F.col("id") % 7 == 0, F.left("key", F.lit(9))).otherwise(F.left("key", F.lit(30))))
    return imports.audit_new(new, known)


@query("""
with t as (select p_partkey as id, p_partkey // 3 as isbn, p_name || ' ' || p_brand || case when p_partkey % 2 = 0 then ' boxed' else '' end as title from part),
w as (select id, isbn, u.word, u.at from (select *, list_distinct(string_split(title, ' ')) as d, string_split(title, ' ') as l from t), lateral (select unnest(d) as word, list_position(l, unnest(d)) as at) u where u.word <> ''),
one as (select isbn, word from w group by 1, 2 having count(*) = 1)
select w.id, string_agg(w.word, ' ' order by w.at) as tags from w join one on one.isbn = w.isbn and one.word = w.word where w.isbn in (select isbn from t group by 1 having count(*) > 1) group by 1
""")
def variant_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that tell a listing from the others of its number."""
    i = F.col("p_partkey")
    title = F.concat_ws(" ", "p_name", "p_brand", F.when(i % 2 == 0, F.lit("boxed")))
    return imports.variant_words(parquet(spark, sf_dir, "part").select(i.alias("id"), F.floor(i / 3).alias("isbn"), title.alias("title")))


@query("""
with t as (select p_partkey as id, case when p_partkey % 4 = 0 then 'B' || (p_partkey - 2) || '-D' || lpad(cast(p_partkey % 1000 as varchar), case when p_partkey % 8 = 0 then 4 else 5 end, '0') when p_partkey % 3 = 0 then 'C' || p_partkey else 'B' || p_partkey end as code from part)
select id, regexp_extract(code, '^(.+)-D[0-9]{4}$', 1) as base from t where regexp_matches(code, '-D[0-9]{4}$') and regexp_extract(code, '^(.+)-D[0-9]{4}$', 1) in (select code from t)
""")
def marked_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second listings by their code, where the first one is there."""
    i = F.col("p_partkey")
    marked = F.concat(F.lit("B"), (i - 2).cast("string"), F.lit("-D"), F.when(i % 8 == 0, F.lpad((i % 1000).cast("string"), 4, "0")).otherwise(F.lpad((i % 1000).cast("string"), 5, "0")))
    code = F.when(i % 4 == 0, marked).when(i % 3 == 0, F.concat(F.lit("C"), i.cast("string"))).otherwise(F.concat(F.lit("B"), i.cast("string")))
    return imports.marked_duplicates(parquet(spark, sf_dir, "part").select(i.alias("id"), code.alias("code")))


@query("""
with a as (select s_suppkey as id, case when s_suppkey % 4 > 0 then s_suppkey - s_suppkey % 4 end as canonical from supplier)
select x.id, y.id as member from a x join a y on coalesce(x.canonical, x.id) = coalesce(y.canonical, y.id) where x.id % 3 = 0
""")
def alias_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids of the alias group of an id."""
    i = F.col("s_suppkey")
    a = parquet(spark, sf_dir, "supplier").select(i.alias("id"), F.when(i % 4 > 0, i - i % 4).alias("canonical"))
    return imports.group_members(a.where("id % 3 = 0"), a)


@query("""
with l as (select distinct l_partkey as work, l_suppkey as edition from lineitem), r as (select s_suppkey as edition, 1000000 + s_suppkey // 2 as new_work from supplier where s_suppkey % 5 = 0)
select edition, work as old_work, coalesce(case when work % 2 = 0 then new_work end, work) as work, work % 2 = 0 and new_work is not null as split from l left join r using (edition)
""")
def reviewed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions that a reviewed list takes out of the work they were joined to by mistake; all others stay."""
    l = parquet(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("old_work"), F.col("l_suppkey").alias("edition")).distinct()  # noqa: E741
    s = parquet(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("edition"), (F.lit(1_000_000) + F.floor(F.col("s_suppkey") / 2)).alias("new_work"))
    made = l.join(s, "edition", "left").withColumn("split", (F.col("old_work") % 2 == 0) & F.col("new_work").isNotNull())
    return made.select("edition", "old_work", F.when(F.col("split"), F.col("new_work")).otherwise(F.col("old_work")).alias("work"), "split")


@query("""
with t as (select p_partkey as id, lower(replace(p_name, ' ', '')) || case p_partkey % 5 when 0 then '' when 1 then 'x' else '' end as title, 'pub' || (p_partkey % 3) as publisher, cast(p_partkey % 2 as varchar) as volume, p_partkey % 4 = 0 as numbered from part),
m as (select * from t where id % 40 = 0 union all select 999999, 'zq', 'pub0', '0', false), o as (select title, publisher, volume, numbered, min(id) as other from t where id % 40 > 0 group by 1, 2, 3, 4),
names as (select distinct m.title as a, o.title as b from m join o on left(m.title, 3) = left(o.title, 3)),
l as (select a, b, (select max(n) from (select unnest(range(1, length(a) + 1)) as n) x where exists (select 1 from (select unnest(range(1, length(a) + 1)) as i) y where i + n - 1 <= length(a) and contains(b, substr(a, i, n)))) as part from names),
j as (select m.id, o.other, o.numbered, contains(m.title, o.title) or contains(o.title, m.title) as holds, coalesce(part, 0) as part, least(length(m.title), length(o.title)) as short, greatest(length(m.title), length(o.title)) as long, m.volume <> o.volume or m.publisher <> o.publisher as doubt
 from m join o on left(m.title, 3) = left(o.title, 3) join l on l.a = m.title and l.b = o.title),
s as (select *, case when holds then 'high' when part >= 3 and part / short >= 0.6 then 'middle' end as first, case when holds then short / long else part / short end as ratio from j),
f as (select id, other, case when doubt then 'review' else first end as level, ratio, numbered from s where first is not null),
r as (select *, row_number() over (partition by id order by case level when 'high' then 300 when 'middle' then 200 else 100 end + round(ratio, 9) * 10 + numbered::int desc, other) as n, count(*) over (partition by id) - 1 as further from f)
select m.id, r.other, coalesce(r.level, 'none') as level, coalesce(r.further, 0) as further from m left join r on r.id = m.id and r.n = 1
""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest known listing for each listing of a source, with the level of confidence."""
    i = F.col("p_partkey")
    t = parquet(spark, sf_dir, "part").select(i.alias("id"), F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))), F.when(i % 5 == 1, "x").otherwise("")).alias("title"), F.concat(F.lit("pub"), (i % 3).cast("string")).alias("publisher"), (i % 2).cast("string").alias("volume"), F.when(i % 4 == 0, i).alias("isbn"))
    extra = spark.createDataFrame([(999_999, "zq", "pub0", "0", None)], t.schema)
    return imports.duplicate_report(t.where("id % 40 = 0").unionByName(extra), t.where("id % 40 > 0"))
