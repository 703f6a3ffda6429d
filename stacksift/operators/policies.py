"""Category policies over mapping tables, code trees, label look-ups, and decisions that are logged once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Top classes of the code tree with one category each.
DIRECT = {"01": "聖經", "02": "聖經研究", "03": "神學", "05": "教會復興", "06": "門徒造就", "07": "見證", "08": "福音", "18": "詩本樂譜"}
# Top classes whose category follows from words of the sub-label, in order, and their remainder.
BY_WORD = {
    "04": ([(("宣教", "差傳", "教會", "小組", "崇拜", "儀式", "靈恩"), "教會復興"), (("輔導", "醫治"), "心理"), (("社會參與",), "社會"), (("倫理",), "倫理"), (("文字工作",), "傳媒")], "門徒造就"),
    "09": ([(("職業",), "社會"), (("特殊問題",), "心理"), (("倫理",), "倫理")], "青少年家庭"),
    "10": ([(("研經", "歸納法"), "聖經研究"), (("兒童", "幼稚", "幼兒"), "兒童教材"), (("主日學",), "兒童主日學"), (("紙品",), "綜合其他")], "門徒造就"),
    "11": ([(("畫冊",), "藝術"), (("CD", "DVD", "影音"), "兒童教材")], "文學"),
}
OTHER = "綜合其他"


def by_policy(items: DataFrame, codes: DataFrame, mapping: DataFrame, *, delist: str, parents: tuple[str, ...] = (), exception: tuple[str, str] | None = None, write_when_delisted: bool = False) -> DataFrame:
    """item, action, category, place and weight: what a mapping table does to each item that has codes.

    items: item, title, single (is it of one source only). codes: item, code. mapping: code, category (may be
    null), sort_order, unpublish.

    delist ``any``: one delisting code is enough; ``all``: all codes but ``parents`` must be known and delisting, and
    there must be one; ``never``. Items of several sources are never delisted, and get categories appended, where
    those of one source get theirs replaced. A title that matches the exception is not delisted, and its category
    comes first. Categories follow sort_order and code, each once; the first weighs 10, the others 5. Without any
    category the action is none, whatever else holds. What is gathered for an item is bounded by the mapping's categories.
    """
    m = codes.select("item", "code").distinct().join(mapping.withColumn("known", F.lit(True)), "code", "left")
    stop = F.coalesce(F.col("unpublish"), F.lit(False))
    specific = ~F.col("code").isin(*parents) if parents else F.lit(True)
    by = m.groupBy("item", "category").agg(F.min(F.struct(F.coalesce("sort_order", F.lit(999)).alias("o"), "code")).alias("at"), F.bool_or(stop).alias("some"), F.bool_and(~specific | stop).alias("every"), F.bool_or(specific).alias("specific"))
    found = by.groupBy("item").agg(F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("at", "category")))).alias("c"), F.bool_or("some").alias("some"), F.bool_and("every").alias("every"), F.bool_or("specific").alias("specific"))
    rule = {"any": F.col("some"), "all": F.col("every") & F.col("specific"), "never": F.lit(False)}[delist]
    special = F.when(F.col("title").rlike(exception[0]), F.lit(exception[1])) if exception else F.lit(None).cast("string")
    made = items.join(found, "item").withColumn("special", special).withColumn("c", F.transform("c", lambda x: x["category"]))
    made = made.withColumn("c", F.when(F.col("special").isNotNull(), F.array_distinct(F.concat(F.array("special"), "c"))).otherwise(F.col("c")))
    off = rule & F.col("special").isNull() & F.col("single")
    if write_when_delisted:
        off = off & (F.size("c") > 0)
    made = made.withColumn("off", off)
    action = F.when(F.col("off"), "delist").when(F.size("c") == 0, "none").when(F.col("single"), "replace").otherwise("append")
    kept = F.col("c") if write_when_delisted else F.when(~F.col("off"), F.col("c"))
    return made.select("item", action.alias("action"), F.posexplode_outer(kept).alias("place", "category")).withColumn("weight", F.when(F.col("place") == 0, 10).when(F.col("place") > 0, 5))


def with_overrides(items: DataFrame, url: str, mark: str, category: str, overrides: DataFrame) -> DataFrame:
    """``items`` with ``category`` replaced where the id behind ``mark`` in their url has a row (id, override)."""
    tail = F.when(F.contains(F.col(url), F.lit(mark)), F.substring_index(url, mark, -1))
    made = items.withColumn("__tail", tail).join(overrides.select(F.col("id").alias("__tail"), "override"), "__tail", "left")
    return made.withColumn("overridden", F.col("override").isNotNull()).withColumn(category, F.coalesce("override", category)).drop("__tail", "override")


def tree_category(code: Column, label: Column) -> Column:
    """Category of a code by its first two characters, and where that is not enough by words behind the label's slash."""
    top, sub = F.left(code, F.lit(2)), F.when(F.contains(label, F.lit("／")), F.regexp_replace(label, "^[^／]*／", "")).otherwise("")
    out = F.when(F.lit(False), F.lit(""))
    for t, c in DIRECT.items():
        out = out.when(top == t, c)
    for t, (rules, rest) in BY_WORD.items():
        for words, c in rules:
            out = out.when((top == t) & sub.rlike("|".join(words)), c)
        out = out.when(top == t, rest)
    return out.otherwise(OTHER)


def codes_by_label(labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """label and code: of the subject with that label, else the top class of the least code under the label's first part."""
    s = subjects.where("code is not null").groupBy("label").agg(F.min("code").alias("exact"))
    tops = subjects.where("code is not null and contains(label, '／')").groupBy(F.substring_index("label", "／", 1).alias("top")).agg(F.left(F.min("code"), F.lit(2)).alias("by_top"))
    made = labels.select("label").distinct().join(s, "label", "left").withColumn("top", F.substring_index("label", "／", 1)).join(tops, "top", "left")
    return made.select("label", F.coalesce("exact", "by_top").alias("code"))


def missing_targets(mapping: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories that a mapping names and the list does not have; must be empty before the mapping is used."""
    return mapping.where("category is not null").select("category").distinct().join(categories.select("category"), "category", "left_anti")


def not_logged(found: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions that the log does not have yet, each once."""
    return found.join(log.select(*keys), keys, "left_anti").dropDuplicates(keys)
