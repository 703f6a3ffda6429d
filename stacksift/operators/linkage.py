"""Record linkage: merge groups, staged matching, blocking joins, alias chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import same_place_ratio
from .checkpoint import written
from .components import connected_components
from .ordered import neighbours


def merge_groups(df: DataFrame, key: str, number: str, leader: list) -> DataFrame:
    """Rows of groups that may merge: two rows or more and at most one distinct number; with the group's leader first."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("members"), F.count_distinct(number).alias("numbers")).where("members > 1 and numbers <= 1")
    w = Window.partitionBy(key).orderBy(*leader)
    return df.join(sizes, key).withColumn("place", F.row_number().over(w))


def staged_match(new: DataFrame, known: DataFrame, new_id: str, known_id: str, stages: list[tuple[str, str, bool]]) -> DataFrame:
    """Match in stages (name, key column, must be unique): a row goes to the first stage that finds it; the rest are new.

    Of several known rows with one key the greatest id counts; a stage that must be unique skips keys with
    several. Each stage joins only what those before left.
    """
    rest, found = new, []
    for name, key, unique in stages:
        k = known.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(known_id).alias("matched"), F.count("*").alias("__n"))
        k = k.where("__n = 1") if unique else k
        hit = rest.join(k.select(key, "matched"), key).select(new_id, F.lit(name).alias("stage"), "matched")
        found.append(hit)
        rest = rest.join(hit.select(new_id), new_id, "left_anti")
    found.append(rest.select(new_id, F.lit("new").alias("stage"), F.lit(None).cast(dict(known.dtypes)[known_id]).alias("matched")))
    return reduce(DataFrame.unionAll, found)


def wildcard_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of keys whose texts have one length and differ in one character: joined on the text with each place blanked.

    Texts are made distinct first, so equal ones do not meet; the keys come back to the pairs of texts.
    """
    spots = df.where(F.char_length(text) > 0).select(F.col(text).alias("t")).distinct().select("t", F.explode(F.sequence(F.lit(1), F.char_length("t"))).alias("i"))
    masked = spots.select("t", "i", F.overlay(F.col("t"), F.lit("\0"), F.col("i"), F.lit(1)).alias("m"))
    pairs = masked.withColumnRenamed("t", "ta").join(masked.withColumnRenamed("t", "tb"), ["i", "m"]).where("ta < tb").select("ta", "tb")
    keys = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    both = pairs.join(keys.withColumnsRenamed({"k": "x", "t": "ta"}), "ta").join(keys.withColumnsRenamed({"k": "y", "t": "tb"}), "tb")
    return both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def nearest_in_block(df: DataFrame, block: str, value: str, key: str) -> DataFrame:
    """key and nearest: the other row of the block with the nearest value, of several the least key.

    Rows of one value stand for it with their two least keys, and each value looks at the one before and the one
    behind it, so a block costs its sort and not its pairs; the sort is by ranges, so a large block has many tasks. Rows alone in their block have none and are left out.
    """
    rows = df.where(F.col(block).isNotNull() & F.col(value).isNotNull()).select(block, value, key)
    first = rows.groupBy(block, value).agg(F.min(key).alias("k1"))
    named = rows.join(first, [block, value])
    second = named.where(F.col(key) > F.col("k1")).groupBy(block, value).agg(F.min(key).alias("k2"))
    sides = first.join(second, [block, value], "left").select(block, value, "k1", "k2")
    sides = neighbours(sides, [block], [value], F.struct(F.col(value).alias("v"), F.col("k1").alias("k")), "lo", "hi").drop("k1")
    near = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col(value) - F.col(f"{s}.v")).alias("gap"), F.col(f"{s}.k").alias("k")))
    same = F.when(F.col("k2").isNotNull(), F.struct(F.lit(0.0).alias("gap"), F.when(F.col(key) == F.col("k1"), F.col("k2")).otherwise(F.col("k1")).alias("k")))
    made = named.select(block, value, key, "k1").join(sides, [block, value]).select(key, F.array_min(F.filter(F.array(same, near("lo"), near("hi")), lambda x: x.isNotNull())).alias("best"))
    return made.where("best is not null").select(key, F.col("best.k").alias("nearest"))


def same_place_pairs(df: DataFrame, text: str, num: int, den: int) -> DataFrame:
    """a < b of one length with at least num / den of their places equal, and that share as ratio.

    Candidates are exact: if m places may differ, one of m + 1 parts of the text must be equal.
    """
    n = df.where(F.char_length(text) > 0).select(F.col(text).alias("t"), F.char_length(text).alias("len"))
    n = n.withColumn("parts", F.floor(F.col("len") * (den - num) / den + F.lit(1e-9)).cast("int") + 1)
    n = n.select("t", "len", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    lo = F.floor(F.col("i") * F.col("len") / F.col("parts")).cast("int")
    hi = F.floor((F.col("i") + 1) * F.col("len") / F.col("parts")).cast("int")
    n = n.select("t", "len", "i", F.substring("t", lo + 1, hi - lo).alias("part"))
    pairs = n.withColumnRenamed("t", "a").join(n.withColumnRenamed("t", "b"), ["len", "i", "part"]).where("a < b").select("a", "b").distinct()
    return pairs.withColumn("ratio", F.round(same_place_ratio(F.col("a"), F.col("b")), 6)).where(F.col("ratio") >= num / den)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    return connected_components(edges, left, right)


def flatten_aliases(df: DataFrame, key: str, to: str) -> DataFrame:
    """Every alias points straight at the end of its chain; an alias of itself points nowhere.

    The pointers jump: each round replaces a target by its target's target, so after n rounds a pointer has gone 2 ** n
    steps. Once that is more than there are aliases every chain has come to its end, and what still moves is on a cycle, or
    leads into one: it points at the least member that it has passed, and that one nowhere.
    """
    state = written(df.select(F.col(key).alias("k"), F.when(F.col(to) != F.col(key), F.col(to)).alias("t"), F.col(key).alias("low")))
    most = state.where("t is not null").count().bit_length() + 1
    for _ in range(most):
        far = state.select(F.col("k").alias("t"), F.col("t").alias("far"), F.col("low").alias("far_low"))
        nxt = state.join(far, "t", "left").select("k", F.col("t").alias("was"), F.coalesce("far", "t").alias("t"), F.least("low", F.coalesce("far_low", "low")).alias("low"))
        nxt = written(nxt)
        moved = nxt.where("not (t <=> was)").limit(1).count()
        state = nxt.select("k", "t", "low")
        if not moved:
            break
    # a chain's target is an end, which points nowhere; on a cycle, or on the way into one, the target points on
    beyond = state.select(F.col("k").alias("t"), F.col("t").alias("beyond"))
    least = F.when(F.col("low") != F.col("k"), F.col("low"))
    state = state.join(beyond, "t", "left").select("k", F.when(F.col("beyond").isNotNull(), least).otherwise(F.col("t")).alias("t"))
    return state.select(F.col("k").alias(key), F.col("t").alias(to))
