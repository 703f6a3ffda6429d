"""Queries over book numbers and titles that are made from parts by rule: valid, wrong, conflicting, in running text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..sources.readers import parquet
from .registry import query

_digit = lambda c, i: f"cast(substr({c}, {i}, 1) as int)"
#: Check digits of nine digits behind 978, and of the same nine as an old number; the same text in both dialects.
_CHECK13 = "cast((10 - (38 + " + " + ".join(f"{_digit('c', i)} * {3 if i % 2 else 1}" for i in range(1, 10)) + ") % 10) % 10 as string)"
_SUM10 = "(11 - (" + " + ".join(f"{_digit('c', i)} * {11 - i}" for i in range(1, 10)) + ") % 11) % 11"
_NUMBERS = f"""core as (select p_partkey, lpad(cast((p_partkey * 7919) % 1000000000 as string), 9, '0') as c from part),
made as (select p_partkey, '978' || c || {_CHECK13} as a, c || case when {_SUM10} = 10 then 'X' else cast({_SUM10} as string) end as old,
 '978' || c || cast((cast({_CHECK13} as int) + 1) % 10 as string) as wrong from core),
both_ as (select m.*, n.a as b from made m join made n on n.p_partkey = case when m.p_partkey % 2 = 0 then m.p_partkey - 1 else m.p_partkey + 1 end)"""


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, its number a, the same in ten places, one with a wrong check digit, and a neighbour's number b."""
    parquet(spark, sf_dir, "part").createOrReplaceTempView("numbers_part")
    return spark.sql(f"with {_NUMBERS.replace('from part', 'from numbers_part')} select * from both_")


@query(f"""with {_NUMBERS}
select p_partkey, case p_partkey % 6 when 1 then b when 3 then b when 4 then wrong when 5 then null else a end as picked,
 case p_partkey % 6 when 0 then a when 2 then a when 3 then b end as isbn, case p_partkey % 6 when 1 then 'conflict' when 4 then 'invalid' when 5 then 'invalid' else 'ok' end as status from both_""")
def number_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a field and the page's own number: which counts, and whether they are valid and agree."""
    form = F.col("p_partkey") % 6
    field = F.when(form.isin(0, 1), F.col("a")).when(form == 2, F.concat(F.substring("old", 1, 1), F.lit("-"), F.substring("old", 2, 9))).when(form == 4, F.col("wrong")).when(form == 5, "n/a")
    meta = F.when(form.isin(0, 2), F.concat(F.lit("ISBN "), F.col("a"))).when(form.isin(1, 3), F.col("b"))
    r = ids.resolve_isbn(field, meta)
    return _made(spark, sf_dir).select("p_partkey", ids.pick_isbn(field, meta).alias("picked"), r["isbn"].alias("isbn"), r["status"].alias("status"))


@query(f"""with {_NUMBERS} select p_partkey, case when p_partkey % 5 in (0, 2, 4) then a end as isbn from both_""")
def only_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of a text that has one valid number, written once or more; none where it has two, or only wrong ones."""
    form = F.col("p_partkey") % 5
    dashed = F.concat(F.substring("a", 1, 3), F.lit("-"), F.substring("a", 4, 5), F.lit(" "), F.substring("a", 9, 5))
    line = (
        F.when(form == 0, F.concat(F.lit("Order no. 12, ISBN "), F.col("a"), F.lit(", 300 pages"))).when(form == 1, F.concat("a", F.lit(" or "), F.col("b")))
        .when(form == 2, F.concat(dashed, F.lit(" ("), F.col("a"), F.lit(")"))).when(form == 3, F.concat(F.lit("no. "), F.col("wrong"))).otherwise(F.concat("wrong", F.lit(" / "), F.col("a")))
    )
    return _made(spark, sf_dir).select("p_partkey", ids.only_isbn(line).alias("isbn"))


@query("""
with t as (select p_partkey as k, replace(p_name, ' ', '') || case when p_partkey % 4 = 0 then p_brand else '' end as s from part),
n as (select k, lower(regexp_replace(s, '[^0-9A-Za-z]', '', 'g')) as s from t),
p as (select a.k as a, b.k as b, a.s as x, b.s as y from n a join n b on b.k = a.k + 1),
i as (select a, b, x, y, unnest(range(1, length(x) + 1)) as i from p), j as (select *, unnest(range(1, length(x) - i + 2)) as m from i),
c as (select a, b, x, y, max(case when contains(y, substr(x, i, m)) then m else 0 end) as part from j group by 1, 2, 3, 4)
select a, b, x = y or contains(x, y) or contains(y, x) or (part >= 3 and part >= 0.5 * least(length(x), length(y)))
 or (length(x) = length(y) and len(list_filter(range(1, length(x) + 1), lambda q: substr(x, q, 1) = substr(y, q, 1))) >= 0.4 * length(x)) as same from c
""")
def same_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether neighbouring listings name one work: one title in the other, a long common part, or mostly equal characters."""
    p = parquet(spark, sf_dir, "part")
    title = F.lower(F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise("")))
    t = p.select(F.col("p_partkey").alias("k"), title.alias("t"))
    pairs = t.select(F.col("k").alias("a"), F.col("t").alias("x")).join(t.select((F.col("k") - 1).alias("a"), F.col("k").alias("b"), F.col("t").alias("y")), "a")
    none = F.lit(None).cast("string")
    return pairs.select("a", "b", text.same_work(F.col("x"), none, F.col("y"), none).alias("same"))
