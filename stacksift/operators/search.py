"""Read operators: faceted search, one total with a page, best row of a group, nested detail."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_either(column: Column, q: str) -> Column:
    """Substring search with the query as given or without hyphens; no wildcards."""
    return F.contains(column, F.lit(q)) | F.contains(column, F.lit(q.replace("-", "")))


def matches(columns: list[Column], q: str, *, wildcards: bool = False) -> Column:
    """Any of ``columns`` holds the query as given or without hyphens; with ``wildcards`` its ``%`` and ``_`` stand for any text."""
    if not wildcards:
        return reduce(Column.__or__, [contains_either(c, q) for c in columns])
    return reduce(Column.__or__, [c.like(f"%{p}%") for c in columns for p in (q, q.replace("-", ""))])


def dispatch(df: DataFrame, q: str, key: str, columns: list[Column]) -> DataFrame:
    """Rows of that id if the query is a number of up to nine digits, else rows whose ``columns`` hold it."""
    q = q.strip()
    return df.where(F.col(key) == int(q)) if re.fullmatch("[0-9]{1,9}", q) else df.where(matches(columns, q))


def clamp(value: int | None, least: int, most: int, default: int) -> int:
    """A request parameter within its bounds."""
    return min(most, max(least, default if value is None else value))


def seek(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The next ``n`` rows behind ``after``: a page that costs the same however far back it is. ``key`` must be unique."""
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(n)


def within(at: Column, now: Column, hours: int | None = 26, since: Column | None = None) -> Column:
    """Not older than ``hours`` before ``now``, or than ``since`` where that is given."""
    return at >= (since if since is not None else now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def page_with_total(df: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """One page in a total order, each row with the count of all rows.

    The count is an aggregate beside the page and not a window over the table, so no task sees all rows; it is
    one row, so its broadcast is bounded.
    """
    per_page, page = min(50, max(1, per_page)), max(1, page)
    rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    return rows.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def field_order(column: Column, values: list[str]) -> Column:
    """Place of a value in a list, 0 where it is missing."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), column), F.lit(0))


def union_first(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of several inputs, one a key: of the earliest input, and there the least by ``order``."""
    tagged = [p.withColumn("__source", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    rest = [c for c in out.columns if c not in (key, "__source")]
    return out.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("__source", order)).alias("r")).select(key, "r.*")
