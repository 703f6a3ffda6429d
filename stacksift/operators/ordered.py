"""What stands before or behind a row in the order of its key, for keys of any size.

Rows are dealt into ranges of (key, order), so a key of a third of all rows is spread over many tasks. Within a range a
window looks back; what it would find in an earlier range comes from the ranges' edges, one row a range, which the
driver carries from range to range. So no key is gathered in one task, and what is broadcast grows with the number of
ranges alone.

The order should be unique within a key; of rows that are equal in it, which comes first is not defined. Null keys are a
key of their own. Columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoint import cut, written


def _carried(edges: list, forward: bool) -> list[tuple]:
    """(part, key, value): what a range's first key (seen in the direction of the look) has from the ranges before it."""
    out, key, value = [], None, None
    for e in sorted(edges, key=lambda e: e["part"], reverse=not forward):
        first, last, tail = (e["lo"], e["hi"], e["hi_tail"]) if forward else (e["hi"], e["lo"], e["lo_tail"])
        if value is not None and first == key:
            out.append((e["part"], key, value))
        own = tail is not None and tuple(tail)[: len(last)] == tuple(last)
        if own:
            value = tail["v"]
        elif last != key or first != last:
            value = None
        key = last
    return out


def nearest_known(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, *, forward: bool = True) -> DataFrame:
    """``df`` with ``name``: the last value that is not null among the key's rows before each row.

    With ``forward`` False the first such value behind it. The row itself does not count.
    """
    ks, os = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))]
    named = [F.col(c).alias(n) for c, n in zip([*keys, *order], [*ks, *os], strict=True)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *named, value.alias("v"))
    # ranges see both key and order; written once, so that all steps agree on them
    rows = cut(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*ks, *os]]).withColumn("part", F.spark_partition_id()))
    key, known = F.struct(*ks), F.when(F.col("v").isNotNull(), F.struct(*ks, *os, "v"))
    edges = rows.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.min(known).alias("lo_tail"), F.max(known).alias("hi_tail")).collect()
    back = [F.col(c).asc_nulls_first() if forward else F.col(c).desc_nulls_last() for c in os]
    inside = F.last("v", ignorenulls=True).over(Window.partitionBy("part", *ks).orderBy(*back).rowsBetween(Window.unboundedPreceding, -1))
    made = rows.withColumn("seen", inside)
    schema = rows.select("part", F.struct(*ks).alias("k"), "v").schema
    carry = df.sparkSession.createDataFrame([(p, tuple(k), v) for p, k, v in _carried(edges, forward)], schema).select(F.col("part").alias("c_part"), *[F.col(f"k.{c}").alias(f"c_{c}") for c in ks], F.col("v").alias("c_v"))
    meet = F.col("part") == F.col("c_part")
    for c in ks:
        meet = meet & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    made = made.join(F.broadcast(carry), meet, "left")  # at most a row a range
    return made.select("row.*", F.coalesce("seen", "c_v").alias(name))


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: Column, before: str, behind: str) -> DataFrame:
    """``df`` with the value of the row before and of the row behind within the key; null at its ends."""
    one = nearest_known(df, keys, order, F.struct(value.alias("x")), before)
    both = nearest_known(one, keys, order, F.struct(value.alias("x")), behind, forward=False)
    return both.withColumns({before: F.col(before)["x"], behind: F.col(behind)["x"]})


def prefix_roots(df: DataFrame, key: str) -> DataFrame:
    """k and root of each distinct key: the shortest key of the table that it begins with, mostly itself.

    In order, the keys that begin with one of them stand right behind it. A task streams its range and holds the last root;
    a root of an earlier range that a range begins under is carried from its edges, a row a range.
    """
    rows = df.select(F.col(key).alias("k")).where("k is not null").distinct()
    rows = cut(rows.repartitionByRange("k").sortWithinPartitions("k").withColumn("part", F.spark_partition_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = None
        for b in batches:
            roots = []
            for k in b.column(0).to_pylist():
                root = root if root is not None and k.startswith(root) else k
                roots.append(root)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.string())], ["k", "part", "root"])

    local = rows.mapInArrow(run, "k string, part int, root string")
    edges = local.groupBy("part").agg(F.max("k").alias("last"), F.max_by("root", "k").alias("root")).collect()
    carried, before = [], None
    for e in sorted(edges, key=lambda e: e["part"]):
        carried.append((e["part"], before))
        before = before if before is not None and e["last"].startswith(before) else e["root"]
    table = df.sparkSession.createDataFrame(carried, "part int, before string")  # a row a range
    made = local.join(F.broadcast(table), "part", "left")
    return made.select("k", F.when(F.startswith("k", "before"), F.col("before")).otherwise(F.col("root")).alias("root"))


def orbit(points: DataFrame, step: int) -> DataFrame:
    """The points (k, m) that are reached: each key's first, and from a reached one the first that is ``step`` or more behind it.

    Each point gets its follower by one look ahead: points and the places ``step`` behind them, in one order. Only
    points that are a follower can be reached, so the others go; then pointers double, and a chain needs rounds by the
    logarithm of its length.
    """
    points = points.select("k", "m").distinct()
    probes = points.select("k", (F.col("m") + step).alias("at"), F.lit(0).alias("is_point"), "m")
    both = points.select("k", F.col("m").alias("at"), F.lit(1).alias("is_point"), "m").unionByName(probes)
    # a point at the very place of a probe is its follower: probes stand before points
    found = nearest_known(both, ["k"], ["at", "is_point", "m"], F.when(F.col("is_point") == 1, F.col("m")), "to", forward=False)
    follow = written(found.where("is_point = 0 and `to` is not null").select("k", "m", "to"))
    reached = written(points.groupBy("k").agg(F.min("m").alias("m")))
    targets = follow.select(F.col("k").alias("jk"), F.col("to").alias("jm")).unionByName(reached.select(F.col("k").alias("jk"), F.col("m").alias("jm"))).distinct()
    jump = written(follow.join(targets, F.col("k").eqNullSafe(F.col("jk")) & (F.col("m") == F.col("jm")), "left_semi"))
    while jump.limit(1).count():
        ends = jump.select(F.col("k").alias("jk"), F.col("m").alias("jm"), F.col("to").alias("next"))
        more = reached.join(ends, F.col("k").eqNullSafe(F.col("jk")) & (F.col("m") == F.col("jm"))).select("k", F.col("next").alias("m"))
        reached = written(reached.unionByName(more).distinct())
        jump = written(jump.join(ends, F.col("k").eqNullSafe(F.col("jk")) & (F.col("to") == F.col("jm"))).select("k", "m", F.col("next").alias("to")))
    return reached
