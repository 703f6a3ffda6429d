"""Credits: first authors, author compatibility, and the split of a credit line into people by a table function."""

from __future__ import annotations

import html
import re
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.checkpoint import spread
from .persons import LABEL_CUTS, ROLE_WORDS, TAIL_NOTES, name_kind
from .text import loose_key

SPLIT_FIRST = r"[;；、/]"


def first_author(s: Column) -> Column:
    head = F.trim(F.split(F.coalesce(s, F.lit("")), SPLIT_FIRST)[0])
    return loose_key(F.regexp_replace(head, r"\s*等$", ""))


def author_core(s: Column) -> Column:
    """First author without bracketed text, mostly a name in another script."""
    head = F.trim(F.split(F.coalesce(s, F.lit("")), SPLIT_FIRST)[0])
    return loose_key(F.regexp_replace(F.regexp_replace(head, r"[（(][^（）()]*[）)]", ""), r"\s*等$", ""))


def compatible(a: Column, b: Column) -> Column:
    """Blank, equal, or one holds the other, which has at least two characters."""
    holds = F.when(F.char_length(a) <= F.char_length(b), (F.char_length(a) >= 2) & F.contains(b, a)).otherwise((F.char_length(b) >= 2) & F.contains(a, b))
    return (a == "") | (b == "") | (a == b) | holds


def judge(author_a: Column, author_b: Column, sources_a: Column, sources_b: Column) -> Column:
    """merge, review or keep: what to do with two listings of one title and publisher."""
    a, b = first_author(author_a), first_author(author_b)
    match = compatible(a, b) | compatible(author_core(author_a), author_core(author_b))
    return F.when((a == "") & (b == ""), "review").when(~match, "keep").when(F.arrays_overlap(sources_a, sources_b), "review").otherwise("merge")


# What separates people, brackets within which nothing does, and what belongs to the name before a full-width comma.
DELIMITERS = ";；、，"
OPEN, CLOSE = "(（[［【", ")）]］】"
SUFFIXES = re.compile(r"[\s\u3000]*(?:Ph\.?\s?D\.?|Th\.?\s?D\.?|D\.?\s?Min\.?|Ed\.?\s?D\.?|D\.?D\.?|S\.?J\.?|O\.?S\.?B\.?|Jr\.?|Sr\.?|M\.?D\.?|Ltd\.?|Inc\.?)[\s\u3000]*", re.IGNORECASE)
_longest_first = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
_role_start = re.compile(rf"(?:^|(?<=[;；、\\/／\s\u3000,，&＆]))(?=(?:{_longest_first(ROLE_WORDS)})[:：/／])")
_credit_end = re.compile(rf"({'|'.join(n for n in TAIL_NOTES if n != '等')})(?=[\s\u3000/／\\]+(?![(（\[［【])\S)")
_edges = " \t\n\r\f\v\u3000,，、;；/／\\&＆"
_label = re.compile(r"([^:：]{1,12})[:：][ \t\u3000]*(.+)|([^:：/／]{1,12})[/／][ \t\u3000]*(.+)")
_reference = re.compile(r"&(#[0-9]{1,6};?|#x[0-9A-Fa-f]{1,6};?|[A-Za-z][A-Za-z0-9]{1,30};?)")


_written = re.compile("&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def decode_credit(s: str) -> str:
    """HTML references decoded before any split; the named semicolon, and what has no semicolon, stays as it is written."""

    def character(m: re.Match) -> str:
        known = m[0][1] == "#" or (m[0][1:] in html5 and m[0].lower() != "&semi;")
        return html.unescape(m[0]) if known else m[0]

    return _written.sub(character, s) if "&" in s else s


def has_reference(s: str) -> bool:
    """Whether what is left of an HTML reference stands in the text; a name between two people's & is none."""
    return any(m[0] == "#" or m.rstrip(";") + ";" in html5 for m in _reference.findall(s))


def _outside_brackets(s: str) -> list[str]:
    """Split at delimiters outside brackets; where brackets do not pair, at every delimiter. A degree stays with its name."""
    depth, out, full_comma = 0, [""], [False]
    for c in s:
        depth = max(0, depth + (c in OPEN) - (c in CLOSE))
        if c in DELIMITERS and not depth:
            out.append("")
            full_comma.append(c == "，")
        else:
            out[-1] += c
    if depth:
        return re.split(f"[{DELIMITERS}]", s)
    whole: list[str] = []
    for part, by_comma in zip(out, full_comma, strict=True):
        if whole and by_comma and SUFFIXES.fullmatch(part):
            whole[-1] += "，" + part
        else:
            whole.append(part)
    return whole


def _roles(label: str) -> list[str]:
    """The roles of a label; none unless every part of it is a role word."""
    roles = [ROLE_WORDS.get(p) for p in re.split(LABEL_CUTS, re.sub(r"[\s\u3000]+", "", label)) if p]
    return [] if None in roles else roles


def _shared_label(s: str) -> tuple[list[str], str]:
    """Several roles in front of a line that has no other label: they hold for everybody in it."""
    m = _label.match(s)
    roles = _roles(m[1] or m[3]) if m else []
    rest = (m[2] or m[4]).strip() if m else ""
    if len(roles) < 2 or any((o := re.match("([^:：]{1,8})[:：]", p.strip())) and _roles(o[1]) for p in re.split("[、；;]", rest)):
        return [], s
    return list(dict.fromkeys(roles)), rest


def segments(line: str | None) -> tuple[list[str], list[str]]:
    """The pieces of a credit line that name one person each, and the roles that hold for all of them."""
    shared, s = _shared_label(decode_credit(line or "").strip())
    pieces = (credit for part in _outside_brackets(s) for start in _role_start.split(part) for credit in _credit_end.sub("\\1\x02", start).split("\x02"))
    return [p for p in (c.strip(_edges) for c in pieces) if p], shared


class _Credits:
    """Table function: a row for each piece of a credit line."""

    def eval(self, line: str):
        found, shared = segments(line)
        for place, piece in enumerate(found):
            yield place, piece, len(segments(piece)[0]), has_reference(piece), shared or None


# rows go to it in batches; with Arrow each line would be a call of its own, with a frame made of its pieces
credit_pieces = F.udtf(_Credits, returnType="piece_no int, piece string, n_people int, fragment boolean, shared array<string>", useArrow=False)


def people(df: DataFrame, key: str, credit: str) -> DataFrame:
    """key, place, name, credit, role, kind and hold of every person of a credit column.

    A lateral join with a table function gives the pieces of each line; column expressions judge them. Pieces that are
    role words or fillers are nobody. A held piece keeps its name as written and gives no role of its own. Places rise
    along the line; pieces that are nobody leave a gap.
    """
    lines = spread(df.select(F.col(key).alias("of"), F.col(credit).alias("credit_line")))
    cut = lines.lateralJoin(credit_pieces(F.col("credit_line").outer()))
    # a generator gives its rows once; a filter on a column would have the column's expression copied into it
    judged = cut.select("of", "piece_no", "piece", "shared", F.explode(F.array(name_kind(F.col("piece"), F.col("n_people"), F.col("fragment")))).alias("k"))
    held = F.col("k.hold").isNotNull()
    somebody = judged.where(~F.col("k.kind").isin("role_word", "filler") & (held | (F.col("k.clean") != "")))
    name = F.when(held, F.col("piece")).otherwise(F.col("k.clean"))
    roles = F.coalesce("shared", F.array(F.when(~held, F.col("k.role"))))
    rows = somebody.select("of", "piece_no", name.alias("name"), F.col("piece").alias("credit"), F.size(roles).alias("n"), F.posexplode(roles).alias("role_no", "role"), F.col("k.kind").alias("kind"), F.col("k.hold").alias("hold"))
    return rows.select(F.col("of").alias(key), (F.col("piece_no") * F.col("n") + F.col("role_no")).alias("place"), "name", "credit", "role", "kind", "hold")
