"""Writers: TSV reports, chunked sitemaps, JSON envelopes, linked data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scrub(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"[\t\r\n]+", " ")


def tsv_report(df: DataFrame, path: str, *, mark: bool = False) -> None:
    """Tab-separated text with a header; with ``mark`` the header begins with a byte-order mark, as spreadsheets expect."""
    names = [("\ufeff" if mark and not i else "") + c for i, c in enumerate(df.columns)]
    df.select(*[scrub(F.col(c)).alias(n) for c, n in zip(df.columns, names, strict=True)]).write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def sitemap_chunks(df: DataFrame, url: str, key: str, size: int = 45_000) -> DataFrame:
    """url and its file number, at most ``size`` a file, by ascending key.

    Keys are dealt into ranges first and offsets come from range counts, so no window covers the table.
    """
    cuts = df.agg(F.percentile_approx(key, [i / 64 for i in range(1, 64)], 1000)).first()[0] or []
    level = F.lit(0)
    for c in sorted(set(cuts)):
        level = level + F.when(F.col(key) > F.lit(c), 1).otherwise(0)
    rows = df.select(url, key, level.alias("__r"))
    counts = rows.groupBy("__r").agg(F.count("*").alias("n"))
    starts = counts.select("__r", (F.sum("n").over(Window.orderBy("__r")) - F.col("n")).alias("start"))  # 64 rows
    placed = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__r").orderBy(key, url))).join(F.broadcast(starts), "__r")
    return placed.select(url, key, F.floor((F.col("start") + F.col("__n") - 1) / size).cast("int").alias("file"))


def envelope(df: DataFrame) -> DataFrame:
    """One row: {"data": [...]} of a bounded result page."""
    return df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias("data"))).alias("json"))


def book_graph(name: Column, authors: Column, isbn: Column, url: Column, trail: Column, price: Column, stock: Column) -> Column:
    """schema.org graph of a book page as JSON: the book, its breadcrumbs (an array of struct(name, url)) and its offer; null fields are left out, and so is an offer without a price."""
    people = F.transform(authors, lambda a: F.struct(F.lit("Person").alias("@type"), a.alias("name")))
    offer = F.when(price.isNotNull(), F.struct(F.lit("Offer").alias("@type"), price.cast("string").alias("price"), F.lit("TWD").alias("priceCurrency"), F.when(stock, F.lit("https://schema.org/InStock")).otherwise(F.lit("https://schema.org/OutOfStock")).alias("availability")))
    book = F.to_json(F.struct(F.lit("Book").alias("@type"), name.alias("name"), F.when(F.size(authors) > 0, people).alias("author"), isbn.alias("isbn"), url.alias("url"), offer.alias("offers")))
    steps = F.transform(trail, lambda t, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), t["name"].alias("name"), t["url"].alias("item")))
    crumbs = F.to_json(F.struct(F.lit("BreadcrumbList").alias("@type"), steps.alias("itemListElement")))
    return F.concat(F.lit('{"@context":"https://schema.org","@graph":['), book, F.lit(","), crumbs, F.lit("]}"))


def keep_clicks(clicks: DataFrame, books: DataFrame, key: str) -> DataFrame:
    """Clicks on books that there are, ready to be appended; others are dropped without an error."""
    return clicks.where(F.col(key).isNotNull()).join(books.select(key).distinct(), key, "left_semi")


def book_linked_data(name: Column, authors: Column, isbn: Column, url: Column) -> Column:
    """schema.org book as JSON; null fields are left out."""
    people = F.transform(authors, lambda a: F.struct(F.lit("Person").alias("@type"), a.alias("name")))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Book").alias("@type"), name.alias("name"), people.alias("author"), isbn.alias("isbn"), url.alias("url")))
