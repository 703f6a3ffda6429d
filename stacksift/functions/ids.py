"""Book numbers and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _weighted(s: Column, n: int, weight) -> Column:
    out = F.lit(0)
    for i in range(n):
        digit = F.substring(s, i + 1, 1)
        out = out + F.when(digit == "X", F.lit(10)).otherwise(digit.try_cast("int")) * weight(i)
    return out


def clean_isbn(s: Column) -> Column:
    """Digits and X only; 13 digits from 978 or 979, or 9 digits and a digit or X; else null. No check digit test."""
    kept = F.upper(F.regexp_replace(s, "[^0-9Xx]", ""))
    return F.when(kept.rlike(r"^97[89][0-9]{10}$") | kept.rlike(r"^[0-9]{9}[0-9X]$"), kept)


def isbn13_of_10(s: Column) -> Column:
    core = F.concat(F.lit("978"), F.substring(s, 1, 9))
    total = _weighted(core, 12, lambda i: 3 if i % 2 else 1)
    return F.concat(core, ((10 - total % 10) % 10).cast("string"))


def isbn13(s: Column) -> Column:
    """The 13-digit form of either number, or null."""
    return _bound(clean_isbn(s), lambda c: F.when(F.length(c) == 13, c).when(F.length(c) == 10, isbn13_of_10(c)))


def is_isbn13(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^97[89][0-9]{10}$") & (_weighted(s, 13, lambda i: 3 if i % 2 else 1) % 10 == 0), F.lit(False))


def is_isbn10(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^[0-9]{9}[0-9X]$") & (_weighted(s, 10, lambda i: 10 - i) % 11 == 0), F.lit(False))


def pick_isbn(field: Column, meta: Column) -> Column:
    """The field's number; the page's own where both exist and differ, or the field has none."""
    a, m = isbn13(field), isbn13(meta)
    return F.when(a.isNotNull() & (m.isNull() | (a == m)), a).otherwise(m)


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is made once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def resolve_isbn(barcode: Column, field: Column) -> Column:
    """struct(isbn, status): ok, conflict or invalid, after check digits."""
    valid = lambda s: _bound(isbn13(s), lambda n: F.when(is_isbn13(n), n))

    def judged(x: Column) -> Column:
        one, two = x["one"], x["two"]
        status = F.when(one.isNull() & two.isNull(), "invalid").when(one.isNotNull() & two.isNotNull() & (one != two), "conflict").otherwise("ok")
        return F.struct(F.when(one.isNull() | two.isNull() | (one == two), F.coalesce(one, two)).alias("isbn"), status.alias("status"))

    return _bound(F.struct(valid(barcode).alias("one"), valid(field).alias("two")), judged)


def only_isbn(text: Column) -> Column:
    """The one valid 13-digit number of a text; null with none or several."""
    found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"97[89](?:[ -]?[0-9]){10}"), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9]", "")), is_isbn13))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def loose_date(s: Column) -> Column:
    """YYYY-MM-DD, YYYY-MM or YYYY from the digits alone, without range checks (an unpadded month is misread)."""
    d = F.regexp_replace(s, "[^0-9]", "")
    part = lambda a, n: F.substring(d, a, n)
    return F.when(F.length(d) >= 8, F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))).when(F.length(d) >= 6, F.concat_ws("-", part(1, 4), part(5, 2))).when(F.length(d) >= 4, part(1, 4))


def strict_date(s: Column) -> Column:
    """Year, month and day split at separators, with range checks; null where they fail."""
    get = lambda i: F.regexp_extract(s, r"^\s*([0-9]{4})(?:[-/.年]\s*([0-9]{1,2})(?:[-/.月]\s*([0-9]{1,2})\s*日?)?月?)?\s*$", i)
    y, m, d = get(1), get(2), get(3)
    fine_m, fine_d = m.try_cast("int").between(1, 12), d.try_cast("int").between(1, 31)
    return F.when(y == "", None).when(m == "", y).when(~fine_m, None).when(d == "", F.concat_ws("-", y, F.lpad(m, 2, "0"))).when(~fine_d, None).otherwise(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def in_years(partial: Column, first: str | None, last: str | None) -> Column:
    """Lexicographic range over partial dates; bounds are four digits, others are ignored."""
    out = partial.isNotNull()
    if first and len(first) == 4 and first.isdigit():
        out = out & (partial >= first)
    if last and len(last) == 4 and last.isdigit():
        out = out & (partial <= f"{last}-12-31")
    return out
