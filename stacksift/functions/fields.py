"""Field cleanup: URLs, weights, script hints, label lines, JSON maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that only simplified script has, enough for a hint.
SIMPLIFIED = "们这来对说时个国学会为从后经书与爱圣灵亚约罗马门徒给义论讲导认识轻轮问题传东车马鸟鱼龙"


def cover_url(u: Column) -> Column:
    """An http(s) address with a path that is not empty and names a file; else null."""
    path = F.regexp_extract(u, r"^https?://[^/?#]+(/[^?#]*)", 1)
    return F.when((path != "") & (path != "/") & ~F.endswith(path, F.lit("/")), u)


def url_key(u: Column) -> Column:
    """Host in lower case without ``www.`` or ``m.``, path without a final slash; no scheme, query or fragment."""
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1)), r"^(?:www|m)\.", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(u, r"^[a-z]+://[^/?#]+([^?#]*)", 1), "/+$", ""))


def grams(s: Column) -> Column:
    """The first whole number of a weight such as 850 g, as an int."""
    return F.regexp_extract(s, "([0-9]+)", 1).try_cast("int")


def looks_simplified(s: Column) -> Column:
    """Two simplified-only characters, or one in a text of at most six."""
    hits = F.char_length(s) - F.char_length(F.translate(s, SIMPLIFIED, ""))
    return (hits >= 2) | ((hits >= 1) & (F.char_length(s) <= 6))


def label_lines(s: Column, junk: tuple[str, ...] = ()) -> Column:
    """map of ``label: value`` lines; the first of a label counts, junk labels go."""
    pairs = F.transform(F.regexp_extract_all(s, F.lit(r"(?m)^[ \t]*([^:：\n]{1,20})[:：][ \t]*(\S[^\n]*)$"), F.lit(0)), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^[ \t]*([^:：\n]{1,20})[:：]", 1)).alias("k"), F.trim(F.regexp_extract(x, r"[:：][ \t]*(\S[^\n]*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~p["k"].isin(list(junk)) if junk else F.lit(True))
    none = F.array().cast("array<struct<k:string,v:string>>")
    once = F.aggregate(kept, none, lambda acc, p: F.when(F.exists(acc, lambda q: q["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(once)


def merge_maps(kept: Column, moved: Column, moved_id: Column) -> Column:
    """Both maps; a key of the moved one that the kept one has becomes key_dup<id>, so nothing is lost."""
    free = F.transform_keys(moved, lambda k, v: F.when(F.map_contains_key(kept, k), F.concat(k, F.lit("_dup"), moved_id.cast("string"))).otherwise(k))
    return F.map_concat(kept, free)
