"""Write operators on immutable tables, set differences, conservation checks and run tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import orbit


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.unionByName(target.join(new.select(*keys), keys, "left_anti"))


def delete_join(target: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` without the rows that ``matches`` has by ``keys``; null keys match nothing."""
    return target.join(matches.select(*keys), keys, "left_anti")


def union_latest(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """key and value of several maps, a later one over an earlier one; within one map the greatest value."""
    every = reduce(DataFrame.unionByName, [p.select(key, value, F.lit(i).alias("__i")) for i, p in enumerate(parts)])
    return every.groupBy(key).agg(F.max_by(value, F.struct("__i", value)).alias(value))


def read_alerts(days: DataFrame, group: str, day: str, count: str, read: str, length: int = 14) -> DataFrame:
    """group, day and reason: a list that was read with no row at all at once, else a run of ``length`` days without new rows."""
    empty = days.where(F.col(read) == 0).select(group, day, F.lit("empty list").alias("reason"))
    runs = zero_runs(days, group, day, count, length).join(empty, [group, day], "left_anti")
    return empty.unionByName(runs.withColumn("reason", F.lit("zero run")))


def stop_early(pages: DataFrame, group: str, page: str, seen: str) -> DataFrame:
    """group and the last page that is read: the first whose rows are all seen, else the last one.

    Right only where the list is ordered by the time of listing; else a new row may stand behind it.
    """
    by = pages.groupBy(group, page).agg(F.bool_and(seen).alias("__seen"))
    return by.groupBy(group).agg(F.coalesce(F.min(F.when(F.col("__seen"), F.col(page))), F.max(page)).alias("last_page"))


def retry_empty(first: DataFrame, again: DataFrame, page: str, rows: str) -> DataFrame:
    """Pages of the first pass, and of those that were empty what the second pass gave."""
    side = again.select(page, F.col(rows).alias("__again"))
    return first.join(side, page, "left").withColumn("retried", F.col(rows) == 0).withColumn(rows, F.when(F.col("retried"), F.coalesce("__again", F.lit(0))).otherwise(F.col(rows))).drop("__again")


def fill_nulls(target: DataFrame, new: DataFrame, key: str, columns: list[str], *, empty_too: bool = False) -> DataFrame:
    """Values of ``new`` only where the target has none (or, with ``empty_too``, an empty string)."""
    side = new.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    old = lambda c: F.nullif(F.col(c), F.lit("")) if empty_too else F.col(c)
    out = target.join(side, key, "left")
    return out.select(*[F.coalesce(old(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in target.columns])


def move_children(children: DataFrame, mapping: DataFrame, parent: str, old: str, new: str, unique: list[str], order: list) -> DataFrame:
    """Children follow their parent to the kept one; where two then clash, the kept parent's own row stays."""
    to = mapping.select(F.col(old).alias(parent), F.col(new).alias("__to"))
    moved = children.join(to, parent, "left").withColumn("__moved", F.col("__to").isNotNull()).withColumn(parent, F.coalesce("__to", parent)).drop("__to")
    w = Window.partitionBy(*unique).orderBy("__moved", *order)
    return moved.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__moved")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and side of keys that only one input has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def zero_runs(days: DataFrame, group: str, day: str, count: str, length: int) -> DataFrame:
    """Groups and days that end a run of ``length`` consecutive days, all present and all zero."""
    w = Window.partitionBy(group).orderBy(day).rowsBetween(1 - length, 0)
    made = days.withColumn("__z", F.count_if(F.col(count) == 0).over(w)).withColumn("__first", F.min(day).over(w))
    return made.where((F.col("__z") == length) & (F.date_diff(day, "__first") == length - 1)).select(group, day)


def throttled(alerts: DataFrame, key: str, at: str, hours: int) -> DataFrame:
    """Alerts that are sent: of one key at most one in any ``hours``, counted from the last one sent.

    The key's alerts are dealt by range and each finds the next that may follow it; the sent ones are reached from the
    first by doubled pointers. So a key of very many alerts is worked on by many tasks.
    """
    times = alerts.select(F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("m")).where("m is not null")
    sent = orbit(times, hours * 3600 * 1_000_000)
    return sent.select(F.col("k").alias(key), F.timestamp_micros("m").alias(at))


def split_exclusively(df: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and the rest (null: rest); together they are the input."""
    flag = F.coalesce(ok, F.lit(False))
    return df.where(flag), df.where(~flag)
