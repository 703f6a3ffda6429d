"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Found and checked: payment cards (13 to 19 digits, Luhn), phone numbers, IPv4 addresses (octets), US
social security numbers (issued ranges), IBANs (mod 97), other international phone numbers, full IPv6
addresses, calendar dates (ISO, dd.mm.yyyy, dd/mm/yyyy) and e-mail addresses. What fails its check stays as it
is; of a card or IBAN with more digits behind it the longest valid beginning counts.

A value is split into two halves, which ROUNDS keyed rounds mix by addition modulo the halves' sizes; so
the result is a permutation of the values of that format. Check digits are computed anew and separators
stay. Dates are permuted as days among the 73,984 from 1900-01-01 on. Equal values get equal pseudonyms in
every document, ``restore`` undoes them with the key. E-mail addresses have no bounded format: they get
keyed digests, the same for equal addresses in either case.

A text is marked up by one regular expression, cut at the marks, and joined again after each marked piece
has been replaced; no row leaves its task and nothing is shuffled.

Defined cases: a null text stays null with counts 0; an empty text stays empty; the mark character U+0001
in a text is kept (it is escaped first). Repeated rows and other columns stay, but columns named n_<kind> are replaced by the counts. The key is a
parameter; where it is not given it is the session's setting spark.stacksift.pii.key, and a key for demonstration
only where that is unset too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

ROUNDS = 10
KEY = "stacksift-demo-key"
FIRST_DAY, DAY_SIDE = "1900-01-01", 272
MARK = "\x01"

# The formats that are looked for, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "intl": r"(?<![\d+(])\+\d{1,3}[ .-]\d{1,5}(?:[ .-]?\d{2,8}){1,4}(?!\d)",
    "ip6": r"(?<![0-9A-Za-z:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9A-Za-z:.])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def feistel(left: Column, right: Column, m: Column, n: Column, key: str, kind: str, back: bool = False) -> Column:
    """struct(x, y): the keyed permutation of (left, right) in [0, m) x [0, n), or its inverse."""

    def draw(i: Column, v: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), v.cast("string"), (m * 0 + m).cast("string"), n.cast("string")), 256), 1, 12), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, m).otherwise(n)  # the half that is changed in this round
        if not back:
            return F.struct(s["y"].alias("x"), F.pmod(s["x"] + draw(i, s["y"]), size).alias("y"))
        return F.struct(F.pmod(s["y"] - draw(i, s["x"]), size).alias("x"), s["x"].alias("y"))

    rounds = list(range(ROUNDS))
    start = F.struct(left.cast("long").alias("x"), right.cast("long").alias("y"))
    return F.aggregate(F.array(*[F.lit(i) for i in (rounds[::-1] if back else rounds)]), start, step)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _sub(s: Column, start, length=None) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    return F.substring(s, start, length if length is not None else F.length(s))


def permute_digits(s: Column, key: str, kind: str, back: bool = False) -> Column:
    """The digits of ``s`` (at most 36) permuted among the strings of as many digits."""
    half = F.floor(F.length(s) / 2).cast("int")
    rest = F.length(s) - half
    made = feistel(_sub(s, 1, half).cast("long"), _sub(s, half + 1).cast("long"), _pow10(half), _pow10(rest), key, kind, back)
    return F.transform(F.array(made), lambda p: F.concat(F.lpad(p["x"].cast("string"), half, "0"), F.lpad(p["y"].cast("string"), rest, "0")))[0]


def luhn_sum(s: Column, shift: int) -> Column:
    """Luhn sum of ``s``; shift 0: its last digit is the check digit, 1: that is still to come."""
    spots = F.sequence(F.lit(1), F.length(s))
    value = lambda i: _sub(s, F.length(s) - i + 1, F.lit(1)).cast("int")
    return F.aggregate(spots, F.lit(0), lambda t, i: t + F.when((i + shift) % 2 == 0, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i)))


def mod97(s: Column) -> Column:
    """Remainder by 97 of a string of digits and capital letters (A: 10 to Z: 35)."""
    spots = F.sequence(F.lit(1), F.length(s))

    def step(t: Column, i: Column) -> Column:
        c = _sub(s, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (t * 10 + c.cast("int")) % 97).otherwise((t * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(spots, F.lit(0), step)


def lay(digits: Column, shape: Column) -> Column:
    """``digits`` put into the places of the digits of ``shape``."""
    spots = F.sequence(F.lit(1), F.length(shape))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, i: Column) -> Column:
        c = _sub(shape, i, F.lit(1))
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(is_digit, _sub(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(spots, start, step, lambda s: s["out"])


def lay_both(digits: Column, letters: Column, shape: Column) -> Column:
    """``digits`` put into the places of the digits of ``shape``, ``letters`` into those of its letters."""
    spots = F.sequence(F.lit(1), F.length(shape))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("d"), F.lit(1).alias("l"))

    def step(s: Column, i: Column) -> Column:
        c = _sub(shape, i, F.lit(1))
        is_digit, is_letter = c.rlike("[0-9]"), c.rlike("[A-Z]")
        new = F.when(is_digit, _sub(digits, s["d"], F.lit(1))).when(is_letter, _sub(letters, s["l"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], new).alias("out"), (s["d"] + is_digit.cast("int")).alias("d"), (s["l"] + is_letter.cast("int")).alias("l"))

    return F.aggregate(spots, start, step, lambda s: s["out"])


def shift_letters(letters: Column, digits: Column, key: str, back: bool) -> Column:
    """Capital letters moved along the alphabet by a keyed draw from the (new) digits and the place: one more round over them."""
    spots = F.sequence(F.lit(1), F.length(letters))

    def one(i: Column) -> Column:
        draw = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("letters"), i.cast("string"), digits), 256), 1, 8), 16, 10).cast("long") % 26
        at = F.ascii(_sub(letters, i, F.lit(1))) - 65
        return F.char(F.pmod(at - draw if back else at + draw, F.lit(26)) + 65)

    return F.when(F.length(letters) > 0, F.array_join(F.transform(spots, one), "")).otherwise("")


def longest_valid(s: Column, valid, swap) -> Column:
    """``swap`` on the longest beginning of ``s`` that ends at a separator, or is all of it, and is valid; the rest stays. Null if none is."""
    ends = F.filter(F.sequence(F.length(s), F.lit(1), F.lit(-1)), lambda i: (i == F.length(s)) | _sub(s, i + 1, F.lit(1)).rlike("[ -]"))
    return _once(F.get(F.filter(ends, lambda i: valid(F.left(s, i))), F.lit(0)), lambda n: F.when(n.isNotNull(), F.concat(swap(F.left(s, n)), F.substr(s, n + 1))))


def _once(value: Column, use) -> Column:
    """``use(value)`` with value computed once."""
    return F.transform(F.array(value), use)[0]


def card(s: Column, key: str, back: bool = False) -> Column:
    def swap(d: Column) -> Column:
        body = permute_digits(_sub(d, 1, F.length(d) - 1), key, "card", back)
        return _once(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 1) % 10) % 10).cast("string")))

    valid = lambda p: _once(_digits(p), lambda d: F.length(d).between(13, 19) & (luhn_sum(d, 0) % 10 == 0))
    return longest_valid(s, valid, lambda p: _once(_once(_digits(p), swap), lambda new: lay(new, p)))


def phone(s: Column, key: str, back: bool = False) -> Column:
    """The last ten digits change, a country code stays."""

    def swap(d: Column) -> Column:
        country = _sub(d, 1, F.length(d) - 10)
        return lay(F.concat(country, permute_digits(F.right(d, F.lit(10)), key, "phone", back)), s)

    return _once(_digits(s), swap)


def ip(s: Column, key: str, back: bool = False) -> Column:
    def swap(o: Column) -> Column:
        made = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip", back)
        text = _once(made, lambda p: F.concat_ws(".", F.floor(p["x"] / 256).cast("string"), (p["x"] % 256).cast("string"), F.floor(p["y"] / 256).cast("string"), (p["y"] % 256).cast("string")))
        return F.when(F.array_max(o) < 256, text)

    return _once(F.transform(F.split(s, r"\."), lambda x: x.cast("int")), swap)


def ssn(s: Column, key: str, back: bool = False) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""

    def swap(d: Column) -> Column:
        area, group, serial = _sub(d, 1, F.lit(3)).cast("int"), _sub(d, 4, F.lit(2)).cast("int"), _sub(d, 6, F.lit(4)).cast("int")
        place = area - 1 - (area > 666).cast("int")
        made = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", back)

        def text(p: Column) -> Column:
            a = F.floor(p["x"] / 99).cast("int") + 1
            return F.concat_ws("-", F.lpad((a + (a >= 666).cast("int")).cast("string"), 3, "0"), F.lpad((p["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["y"] + 1).cast("string"), 4, "0"))

        return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _once(made, text))

    return _once(_digits(s), swap)


def iban(s: Column, key: str, back: bool = False) -> Column:
    """Land stays, digits are permuted, letters moved, both in their places; check digits are computed anew."""
    bare = lambda p: F.regexp_replace(p, " ", "")

    def swap(p: Column) -> Column:
        land, tail = _sub(p, 1, F.lit(2)), _sub(p, 5)
        old = _digits(tail)
        new = F.when(F.length(old) >= 2, permute_digits(old, key, "iban", back)).otherwise(old)

        def whole(n: Column) -> Column:
            letters = shift_letters(F.regexp_replace(tail, "[^A-Z]", ""), old if back else n, key, back)
            body = lay_both(n, letters, tail)
            return _once(body, lambda b: F.concat(land, F.lpad((98 - mod97(F.concat(bare(b), land, F.lit("00")))).cast("string"), 2, "0"), b))

        return _once(new, whole)

    valid = lambda p: _once(bare(p), lambda d: (F.length(d) >= 15) & (mod97(F.concat(_sub(d, 5), _sub(d, 1, F.lit(4)))) == 1))
    return longest_valid(s, valid, swap)


def intl(s: Column, key: str, back: bool = False) -> Column:
    """The digits behind the country code (up to the first separator) change; 6 to 14 of them."""
    code = F.regexp_extract(s, r"^\+\d{1,3}", 0)
    rest = F.substr(s, F.length(code) + 1)
    return F.when(F.length(_digits(rest)).between(6, 14), _once(permute_digits(_digits(rest), key, "intl", back), lambda d: F.concat(code, lay(d, rest))))


def ip6(s: Column, key: str, back: bool = False) -> Column:
    """The network half of the eight groups stays, the other half changes; groups are written without leading zeros."""

    def swap(g: Column) -> Column:
        n = lambda i: F.conv(g[i], 16, 10).cast("long")
        side = 1 << 32
        made = feistel(n(4) * 65536 + n(5), n(6) * 65536 + n(7), F.lit(side), F.lit(side), key, "ip6", back)
        text = lambda v: F.concat_ws(":", F.lower(F.hex(F.floor(v / 65536))), F.lower(F.hex(v % 65536)))
        return F.when(~s.rlike("(?:^|:)0[0-9a-f]"), _once(made, lambda p: F.concat_ws(":", F.slice(g, 1, 4), text(p["x"]), text(p["y"]))))

    return _once(F.split(s, ":"), swap)


def date(s: Column, key: str, back: bool = False) -> Column:
    iso = s.rlike(r"^\d{4}-")
    mid = _sub(s, 3, F.lit(1))
    day = F.when(iso, F.try_to_date(s, "yyyy-MM-dd")).when(mid == ".", F.try_to_date(s, "dd.MM.yyyy")).otherwise(F.try_to_date(s, "dd/MM/yyyy"))

    def swap(n: Column) -> Column:
        made = feistel(F.floor(n / DAY_SIDE), n % DAY_SIDE, F.lit(DAY_SIDE), F.lit(DAY_SIDE), key, "date", back)

        def text(p: Column) -> Column:
            new = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["x"] * DAY_SIDE + p["y"]).cast("int"))
            return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(mid == ".", F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))

        return F.when(n.between(0, DAY_SIDE * DAY_SIDE - 1), _once(made, text))

    return _once(F.date_diff(day, F.lit(FIRST_DAY).cast("date")), swap)


def email(s: Column, key: str, back: bool = False) -> Column:
    if back:
        return F.lit(None).cast("string")
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(s)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@"), F.substring(digest, 17, 8), F.lit(".example"))


def _swap(s: Column, key: str, back: bool) -> Column:
    """struct(kind, text) of a marked piece; kind is null where the check fails and the piece stays."""
    makers = {"email": email, "iban": iban, "phone": phone, "intl": intl, "ip6": ip6, "ip": ip, "ssn": ssn, "date": date, "card": card}
    full = {k: "^(?:" + PATTERNS[k] + ")$" for k in KINDS}
    out = F.lit(None).cast("struct<kind:string,text:string>")
    # a later pattern is tried where the checks of those before fail

    def tried(k: str) -> Column:
        return F.when(s.rlike(full[k]), _once(makers[k](s, key, back), lambda t: F.when(t.isNotNull(), F.struct(F.lit(k).alias("kind"), t.alias("text")))))

    options = [tried(k) for k in KINDS]
    return F.coalesce(*options, out, F.struct(F.lit(None).cast("string").alias("kind"), s.alias("text")))


def pieces(text: Column, key: str, back: bool = False) -> Column:
    """array(struct(kind, text)): the text cut into pieces, personal data replaced."""
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(MARK + "e")), ANY, MARK + "s$0" + MARK + "t")
    plain = lambda t: F.struct(F.lit(None).cast("string").alias("kind"), t.alias("text"))

    def part(p: Column, i: Column) -> Column:
        rest = _sub(p, 2)
        return F.when(i == 0, plain(p)).when(_sub(p, 1, F.lit(1)) == "s", _swap(rest, key, back)).when(_sub(p, 1, F.lit(1)) == "e", plain(F.concat(F.lit(MARK), rest))).otherwise(plain(rest))

    return F.when(text.rlike("[0-9@]"), F.transform(F.split(marked, MARK, -1), part)).otherwise(F.array(plain(text)))


def pseudonymise(docs: DataFrame, key: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and how many values of each kind were replaced (n_<kind>)."""
    key = key or docs.sparkSession.conf.get("spark.stacksift.pii.key", KEY)
    made = docs.select(packed(docs).alias("row"), pieces(F.col("text").cast("string"), key, back).alias("pieces"))
    text = F.col("row")["text"]
    count = lambda k: F.coalesce(F.size(F.filter("pieces", lambda p: p["kind"] == k)), F.lit(0)).cast("long")
    whole = F.when(text.isNotNull(), F.array_join(F.transform("pieces", lambda p: p["text"]), ""))
    new = {"text": whole} | {f"n_{k}": F.when(text.isNotNull(), count(k)).otherwise(F.lit(0).cast("long")) for k in KINDS}
    rest = [c for c in new if c not in docs.columns]
    return made.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in [*docs.columns, *rest]])


def restore(docs: DataFrame, key: str | None = None) -> DataFrame:
    """Undo ``pseudonymise`` (but for e-mail addresses) where the key is known."""
    return pseudonymise(docs, key, back=True)
