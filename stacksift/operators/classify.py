"""Classification: mapping tables with policies, ordered keyword rules, guards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """How codes of an item become categories and when it is delisted: on any or on all delisting codes, or never."""

    delist: str = "any"
    single_source: bool = True
    write_when_delisted: bool = True


def by_mapping(codes: DataFrame, mapping: DataFrame, policy: Policy) -> DataFrame:
    """item, category, weight, delisted: mapped categories in sort order without repeats, the first weighs 10, others 5.

    codes: item, code, n_sources. mapping: code, category (may be null), sort_order, unpublish. Unmapped codes
    sort last; ties follow the code. An item without categories has one row with null category.
    """
    m = codes.join(mapping.withColumn("__known", F.lit(True)), "code", "left")
    m = m.where("n_sources = 1") if policy.single_source else m
    stop = F.coalesce(F.col("unpublish"), F.lit(False))
    if policy.delist == "any":
        delisted = F.bool_or(stop)
    elif policy.delist == "all":
        delisted = F.bool_and(stop) & F.bool_or(F.col("__known"))
    else:
        delisted = F.lit(False)
    flags = m.groupBy("item").agg(F.coalesce(delisted, F.lit(False)).alias("delisted"))
    firsts = m.where("category is not null").groupBy("item", "category").agg(F.min(F.struct(F.coalesce("sort_order", F.lit(999)).alias("o"), "code")).alias("at"))
    w = Window.partitionBy("item").orderBy("at.o", "at.code", "category")
    ranked = firsts.select("item", "category", F.when(F.row_number().over(w) == 1, 10).otherwise(5).alias("weight"))
    out = flags.join(ranked, "item", "left")
    if not policy.write_when_delisted:
        out = out.where("not delisted or weight is null or weight = 10").withColumns({c: F.when(~F.col("delisted"), F.col(c)) for c in ("category", "weight")})
    return out.select("item", "category", "weight", "delisted")


def matched_rules(text: Column, title: Column, rules: list[tuple[str, list[str]]], title_only: list[tuple[str, list[str]]], catch_all: str) -> Column:
    """Categories whose keywords occur, in rule order, then title-only ones; the catch-all if there is none."""
    has = lambda where, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(where, w))
    hits = [F.when(has(text, words), F.lit(c)) for c, words in rules] + [F.when(has(title, words), F.lit(c)) for c, words in title_only]
    found = F.array_distinct(F.filter(F.array(*hits), lambda c: c.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(catch_all)))


def primary(matched: Column, low: list[str]) -> Column:
    """The first category that is not of low priority, else the first."""
    return F.coalesce(F.get(F.filter(matched, lambda c: ~c.isin(low)), F.lit(0)), F.get(matched, F.lit(0)))


def latest_decision(log: DataFrame, item: str, at: str, log_id: str, action: str) -> DataFrame:
    """item and its last action, by time and then id."""
    return log.groupBy(item).agg(F.max_by(action, F.struct(at, log_id)).alias(action))
