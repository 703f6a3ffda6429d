"""Lines that many documents share are dropped from all but one of them. DataFrame functions only.

The lines of a text are exploded and normalised, each key of enough characters is hashed, the distinct documents of
each hash are counted, and what stands in enough documents goes, except in the largest doc_id that holds it.
Other lines stay, in their order.

Only positions travel: a first pass counts (hash, doc_id), a second finds the hashes of dropped keys again and gathers
for each text the positions that go; the text itself is moved once, to meet them. A document is a doc_id: rows of one
doc_id count once. As the decision on a line depends on its doc_id and key alone, rows equal in doc_id and text are
treated alike and nothing has to be numbered.

Defined cases: a null text counts as one empty line and stays null; a null doc_id is one document of its own, below
all others; repeated rows stay, each without the same lines; a text may lose all of its lines and is then empty; columns
of any name pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed by the contract: what is stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MIN_CHARS = 20
MIN_DOCUMENTS = 3


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def line_key(stripped: Column) -> Column:
    """Of a line without blanks at both ends: A to Z lower-cased and other letters as they are."""
    plain = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(plain, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, UPPER.lower()))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashed(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """doc, dg (digest of the text), pos, h: a row for each line whose key is long enough."""
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.col(doc_id).alias("doc"), _digest(body).alias("dg"), body.alias("body"))  # the digest once a text, not once a line
    # lines are stripped before they are exploded, and no column may be null: so the planner repeats none of this in a filter
    lines = whole.select("doc", "dg", F.posexplode(F.transform(lines_of(F.col("body")), bare)).alias("pos", "line"))
    return lines.where(F.char_length("line") >= min_chars).select("doc", "dg", "pos", _digest(line_key(F.col("line"))).alias("h"))


def _digest(value: Column) -> Column:
    """MD5 as 16 bytes."""
    return F.coalesce(F.unhex(F.md5(value)), F.lit(b""))


def shared_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """h (MD5 of the key), n_documents, holder (the largest doc_id): the keys that enough documents share.

    A key of a third of all documents is first reduced to one row for each of them and task, so no task gets them all.
    """
    each = _hashed(docs, doc_id, text, min_chars).groupBy("h", "doc").agg(F.lit(1).alias("one"))
    return each.groupBy("h").agg(F.count("one").alias("n_documents"), F.max("doc").alias("holder")).where(F.col("n_documents") >= min_documents)


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc (the row as it was), kept (its text without the dropped lines), n_lines, n_dropped.

    The dropped keys are written once to the shared checkpoint folder. Then both sides of their join come from plain
    shuffles, and adaptive execution splits a key that stands in very many texts.
    """
    gone = cut(shared_keys(docs, doc_id, text, min_chars, min_documents).select("h", "holder"))
    lines = _hashed(docs, doc_id, text, min_chars)
    dropped = lines.join(gone, "h").where(~F.col("doc").eqNullSafe(F.col("holder")))
    places = dropped.groupBy("doc", "dg").agg(F.collect_set("pos").alias("places"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), _digest(F.coalesce(F.col(text), F.lit(""))).alias("own"))
    met = rows.join(places, F.col("id").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("dg")), "left")
    body = F.col("row")[text]
    split = F.transform(F.array(lines_of(body)), lambda lines: F.struct(F.size(lines).alias("n"), _rest(lines, F.col("places")).alias("rest")))[0]
    whole = met.select("row", F.coalesce(F.size("places"), F.lit(0)).alias("n"), F.when(F.col("places").isNotNull(), split).alias("split"))
    return whole.select(
        F.col("row").alias("doc"),
        F.coalesce(F.col("split")["rest"], body).alias("kept"),
        F.coalesce(F.col("split")["n"], F.size(lines_of(body))).cast("long").alias("n_lines"),
        F.when(F.col("split").isNotNull(), F.col("n")).otherwise(0).cast("long").alias("n_dropped"),
    )


def _rest(lines: Column, places: Column) -> Column:
    """The other lines in their order. The positions are compared as sets, so a text of many lines takes linear time."""
    others = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    return F.array_join(F.transform(others, lambda i: lines[i]), "\n")


def deduplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents, all columns, with the shared lines gone from their texts."""
    out = drop_shared_lines(docs, doc_id, text, min_chars, min_documents)
    return out.select(*[(F.col("kept") if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])
