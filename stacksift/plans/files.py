"""Queries over files that they write first: lines with bad ones among them, atomic batches, what a catalogue has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import catalogs, record_files
from ..sources.readers import parquet
from ..streaming.ingest import work_folder
from .registry import query


@query("""
select case when c_custkey % 5 = 0 then c_custkey end as id, case when c_custkey % 5 = 0 then c_name end as name, case when c_custkey % 5 = 0 then c_acctbal end as balance,
 case c_custkey % 5 when 1 then '{"id": ' || c_custkey when 2 then '[' || c_custkey || ']' when 3 then '{"id": "' || c_name || '"}' end as bad_line,
 case c_custkey % 5 when 1 then 'no json' when 2 then 'no object' when 3 then 'other type' end as bad_reason from customer where c_custkey % 5 < 4
""")
def record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines by a declared schema, read in byte ranges: blank lines are skipped, others that do not fit are kept with the reason."""
    k, form = F.col("c_custkey").cast("string"), F.col("c_custkey") % 5
    good = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    line = F.when(form == 0, good).when(form == 1, F.concat(F.lit('{"id": '), k)).when(form == 2, F.concat(F.lit("["), k, F.lit("]"))).when(form == 3, F.concat(F.lit('{"id": "'), "c_name", F.lit('"}'))).otherwise("  ")
    folder = f"{work_folder(spark)}/lines"
    parquet(spark, sf_dir, "customer").select(line.alias("value")).write.text(folder)
    return record_files.read_lines(spark, folder, "id bigint, name string, balance double", split_bytes=100_000).select("id", "name", "balance", "bad_line", "bad_reason")


@query("""select s_suppkey, s_name, s_acctbal, case s_nationkey % 4 when 2 then 'fresh' else 'late' end as batch from supplier where s_nationkey % 4 >= 2""")
def atomic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches written as a whole: two appended, one of them tried again, all replaced in one step, and one more appended."""
    rows = parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    some = lambda n: rows.where(F.col("s_nationkey") % 4 == n).drop("s_nationkey")
    path = f"{work_folder(spark)}/table"
    for batch, n, replace in (("first", 0, False), ("second", 1, False), ("second", 3, False), ("fresh", 2, True), ("late", 3, False)):
        record_files.write_batch(some(n), path, batch, replace=replace)
    return record_files.read_table(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("""
select * from (select 'nation' as table_name, count(*) as n_rows, true as there, true as has_key from nation union all select 'supplier', count(*), true, true from supplier union all select 'sponsors', null, false, false)
""")
def known_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables and columns a catalogue has, asked before they are used; what is not there is no error."""
    for name in ("nation", "supplier"):
        parquet(spark, sf_dir, name).createOrReplaceTempView(f"known_{name}")
    parts = [("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("sponsors", "id")]
    found = catalogs.present(spark, {f"known_{t}": [c] for t, c in parts})
    rows = found.select(F.regexp_replace("table_name", "^known_", "").alias("table_name"), F.col("is_there").alias("there"), (F.size("missing") == 0).alias("has_key"))
    sizes = None
    for t, _ in parts:
        n = catalogs.table_or_empty(spark, f"known_{t}", "x int").agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        sizes = n if sizes is None else sizes.unionAll(n)
    return rows.join(sizes, "table_name").withColumn("n_rows", F.when(F.col("there"), F.col("n_rows")))
