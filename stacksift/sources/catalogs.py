"""What the session's catalogue has: tables and columns that a query may ask for before it uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def present(spark: SparkSession, wanted: dict[str, list[str]]) -> DataFrame:
    """table_name, is_there, missing (columns that it lacks; all of them where there is no such table). A row for each name asked for."""
    rows = []
    for table, columns in wanted.items():
        there = spark.catalog.tableExists(table)
        known = {c.lower() for c in spark.table(table).columns} if there else set()
        rows.append((table, there, [c for c in columns if c.lower() not in known]))
    return spark.createDataFrame(rows, "table_name string, is_there boolean, missing array<string>")


def table_or_empty(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The table, or an empty one of this schema where the catalogue has none: an optional feature then does nothing."""
    return spark.table(table) if spark.catalog.tableExists(table) else spark.createDataFrame([], schema)
