"""Text keys and similarities as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the two kinds of keys drop or keep.
LOOSE = r"[\s\p{Z}\p{P}\p{S}]+"
KEPT = r"[^0-9A-Za-z\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]"
SCRIPT_TAG = r"[（(/／\-－]\s*(?:简体|簡體|正體|繁體|简|簡)\s*[)）]?\s*$"
VARIANT_TAG = r"[（(/／\-－]\s*(?:簡體字|繁體字|正體字|簡體|繁體|正體|简体|繁体|正体|簡|繁|正|简)\s*[)）]?\s*$"
FULL_WIDTH, ASCII_DIGITS = "０１２３４５６７８９", "0123456789"


def loose_key(s: Column) -> Column:
    """White space, punctuation and symbols dropped, lower case."""
    return F.lower(F.regexp_replace(s, LOOSE, ""))


def strict_key(s: Column) -> Column:
    """Only ASCII letters, digits and Han characters kept, lower case."""
    return F.lower(F.regexp_replace(s, KEPT, ""))


def title_author_key(title: Column, author: Column) -> Column:
    """Fuzzy merge key; null if either part is null or empty."""
    return F.when((title != "") & (author != ""), F.concat(loose_key(title), F.lit("|"), loose_key(author)))


def without_script_tag(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, SCRIPT_TAG, ""))


def without_variants(s: Column, most: int = 8) -> Column:
    """Marks of script and version taken off the end until none is left; ``most`` of them."""
    step = lambda t, _: F.regexp_replace(t, VARIANT_TAG, "")
    return F.trim(F.aggregate(F.sequence(F.lit(1), F.lit(most)), s, step))


def main_title(s: Column) -> Column:
    """The title without marks of script and version, and without white space."""
    return F.regexp_replace(without_variants(s), r"[\s\x{3000}]+", "")


def volume_marks(s: Column) -> Column:
    """Volume marks as they stand, in order and with repeats: numbers and part marks."""
    return F.regexp_extract_all(s, F.lit(r"[0-9０-９]+|[上中下]"), F.lit(0))


def capped(s: Column, n: int) -> Column:
    """At most ``n`` characters."""
    return F.left(s, F.lit(n))


def volume_tokens(s: Column) -> Column:
    """Numbers of at most two digits and part marks, distinct and sorted; full-width digits count as digits."""
    found = F.regexp_extract_all(F.translate(s, FULL_WIDTH, ASCII_DIGITS), F.lit(r"(?<![0-9])([0-9]{1,2})(?![0-9])|([上中下])"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def same_place_ratio(a: Column, b: Column) -> Column:
    """Share of places with the same character; 0 unless the lengths agree."""
    same = F.size(F.filter(F.zip_with(characters(a), characters(b), lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return F.when((F.char_length(a) == F.char_length(b)) & (F.char_length(a) > 0), same / F.char_length(a)).otherwise(F.lit(0.0))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.char_length(a), F.char_length(b))
    step = lambda t, i: F.when((t == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(t)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step)).otherwise(F.lit(0))


def common_substring(a: Column, b: Column) -> Column:
    """Length in characters of the longest common substring, by a fold over the first text's characters."""
    right = characters(b)

    def row(state: Column, c: Column) -> Column:
        runs = F.transform(right, lambda x, j: F.when(x == c, F.when(j == 0, F.lit(1)).otherwise(F.element_at(state["runs"], j.cast("int")) + 1)).otherwise(F.lit(0)))
        return F.transform(F.array(runs), lambda r: F.struct(r.alias("runs"), F.greatest(state["best"], F.coalesce(F.array_max(r), F.lit(0))).alias("best")))[0]

    start = F.struct(F.transform(right, lambda x: F.lit(0)).alias("runs"), F.lit(0).alias("best"))
    return F.coalesce(F.aggregate(characters(a), start, row, lambda s: s["best"]), F.lit(0))


def same_work(title_a: Column, author_a: Column, title_b: Column, author_b: Column) -> Column:
    """Do two listings name one work: equal key, containment, long common part, or mostly equal characters."""
    a, b = (F.regexp_replace(without_script_tag(t), LOOSE, "") for t in (title_a, title_b))
    short = F.least(F.char_length(a), F.char_length(b))
    part = common_substring(a, b)
    by_key = F.coalesce(title_author_key(title_a, author_a) == title_author_key(title_b, author_b), F.lit(False))
    by_title = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | ((part >= 3) & (part / short >= 0.5)) | (same_place_ratio(a, b) >= 0.4))
    return by_key | F.coalesce(by_title, F.lit(False))


def host(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "/", 3), "/", -1)


def tidy_label(s: Column) -> Column:
    """Null where a field holds only a label such as ``author:``."""
    return F.when(~F.trim(s).rlike(r"^[^:：]{0,8}[:：][\s\p{Z}]*$") & (F.trim(s) != ""), F.trim(s))
