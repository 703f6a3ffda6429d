"""Readers: Parquet tables, JSON lines with bad rows kept apart, TSV, release notes, seen keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows by a declared schema, and the lines that are no such JSON; blank lines count as neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    rows = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    good = rows.where("r is not null and r.__bad is null").select("r.*").drop("__bad")
    return good, rows.where("r is null or r.__bad is not null").select("value")


def tsv(spark: SparkSession, path: str, least_columns: int = 1) -> DataFrame:
    """Tab-separated text with a header; a byte-order mark in the first name is dropped."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    if len(df.columns) < least_columns:
        raise ValueError(f"{path}: {len(df.columns)} columns, {least_columns} expected")
    return df


def seen_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.schema(f"{key} string").json(path).where(f"{key} is not null").distinct()


def release_notes(spark: SparkSession, path: str) -> DataFrame:
    """version, date, title and body of each ``## [x.y.z] - date`` section, newest version first."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.explode(F.split("value", r"(?m)^(?=##\s*\[?v?[0-9])")).alias("s")).where(F.col("s").rlike(r"^##\s*\[?v?[0-9]"))
    get = lambda i: F.regexp_extract("s", r"^##\s*\[?v?([0-9]+(?:\.[0-9]+)*)\]?[ \t]*(?:[-–—(]\s*([0-9]{4}-[0-9]{2}-[0-9]{2})\)?)?[ \t]*(?:[-–—]+)?[ \t]*([^\n]*)\n?([\s\S]*)$", i)
    rows = parts.select(get(1).alias("version"), F.nullif(get(2), F.lit("")).alias("date"), F.trim(get(3), F.lit(" \r\t")).alias("title"), F.trim(get(4), F.lit(" \r\n\t")).alias("body"))
    return rows.orderBy(F.desc(F.transform(F.split("version", r"\."), lambda x: x.cast("int"))))


def with_notes(releases: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """``releases`` with the text of ``v<version>.md`` in ``folder`` as note (null: none)."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="v*.md").select(F.regexp_extract(F.col("_metadata.file_name"), r"^v(.+)\.md$", 1).alias("version"), F.col("value").alias("note"))
    return releases.join(files, "version", "left")


def json_pages(df: DataFrame, body: str, items: str, schema: str) -> DataFrame:
    """Rows of the list ``items`` (a path, empty: the body itself is the list) in pages of JSON; pages that are none give no rows."""
    found = F.from_json(F.col(body) if not items else F.get_json_object(body, f"$.{items}"), f"array<struct<{schema}>>")
    return df.select(*[c for c in df.columns if c != body], F.inline(found))


def page_records(df: DataFrame, html: str, product: str = r"[?&]id=([0-9]+)") -> DataFrame:
    """Cached pages read again without fetching: title, first heading, and the product ids that its links carry."""
    tag = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1), "<[^>]*>", ""), r"\s+", " ")), F.lit(""))
    links = F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]*)"'), F.lit(1))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(links, lambda u: F.regexp_extract(u, product, 1)), lambda x: x != "")))
    return df.withColumns({"title": tag("title"), "heading": tag("h1"), "n_links": F.size(links), "products": F.array_join(ids, ",")})


def sitemap(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Locations of sitemap documents."""
    return df.select(F.explode(F.xpath(F.regexp_replace(F.col(xml), r'\sxmlns="[^"]*"', ""), F.lit("//url/loc/text()"))).alias("loc")).distinct()


def checked_linked_data(df: DataFrame, html: str, *, kinds: tuple[str, ...] = ("Book", "Product")) -> DataFrame:
    """``df`` with name, isbn, price of its first ld+json object and ``reject``, why there is none.

    Reasons, in this order: no script, no json (raw line breaks are tolerated), kind (@type is none of ``kinds``), no name.
    """
    raw = F.regexp_extract(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    made = df.withColumn("__raw", F.trim(F.regexp_replace(raw, r"[\r\n\t]+", " ")))
    made = made.withColumn("__ld", F.from_json("__raw", "`@type` string, name string, isbn string, offers struct<price: string>"))
    bad = F.when(F.col("__raw") == "", "no script").when(F.col("__ld").isNull() | F.get_json_object("__raw", "$").isNull(), "no json").when(~F.coalesce(F.col("__ld.@type").isin(*kinds), F.lit(False)), "kind").when(F.coalesce(F.trim("__ld.name"), F.lit("")) == "", "no name")
    made = made.withColumn("reject", bad)
    kept = lambda c: F.when(F.col("reject").isNull(), c)
    return made.withColumns({"name": kept(F.trim("__ld.name")), "isbn": kept(F.col("__ld.isbn")), "price": kept(F.col("__ld.offers.price"))}).drop("__raw", "__ld")


def linked_data(df: DataFrame, html: str, schema: str) -> DataFrame:
    """Objects of ld+json scripts; raw line breaks inside are tolerated."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return df.withColumn("__ld", F.explode(found)).withColumn("ld", F.from_json(F.regexp_replace("__ld", r"[\r\n\t]+", " "), schema)).drop("__ld")
