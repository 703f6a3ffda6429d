"""Import of a file whose earlier rows can be what later rows match.

Row by row, an importer looks up a number, then a work, then a title with its publisher, and what it adds or fills in is
found by the rows behind. Here the rows' outcomes are a fix point: each round evaluates all rows at once against the
outcomes of the round before, looking only at rows before each of them. A row that depends on a chain of n others is
right after n rounds, so the rounds follow the longest chain and not the file, and the last one changes nothing.

What a row sees of the file: the first row that brought its number, as a new book or by filling in the number of a book
without one; the last new book of its work before it; and that book's number at that point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoint import written
from .imports import free_of, title_publisher_hits
from .ordered import nearest_known

MADE = ("new", "isbn_conflict")


def _with_known(new: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with what they find among known books: by number, by work, and by title and publisher."""
    last = lambda key, *more: known.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("found")).agg(F.max_by(F.struct("id", *more), "id").alias("hit"))
    by_isbn = last("isbn", "work").select(F.col("found").alias("isbn"), F.col("hit.id").alias("isbn_book"), F.col("hit.work").alias("isbn_work"))
    by_work = last("work", "isbn").select(F.col("found").alias("work"), F.col("hit.id").alias("work_book"), F.col("hit.isbn").alias("work_isbn"))
    hits = title_publisher_hits(new.withColumnRenamed("place", "id"), known).select(F.col("id").alias("place"), F.col("matched").alias("title_book"))
    return new.join(by_isbn, "isbn", "left").join(by_work, "work", "left").join(hits, "place", "left")


def _numbers(state: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first row to bring each number (isbn, set_at, set_book, set_work), and books whose number was filled in (book, fill_at, fill_isbn).

    ``own`` has book, isbn and work of all books before and in the file.
    """
    merged = state.where(~F.col("stage").isin(*MADE) & F.col("number").isNotNull())
    first = merged.groupBy("book").agg(F.min(F.struct("place", "number")).alias("first"))
    filled = first.join(own.where("own_isbn is null"), "book").select("book", F.col("first.place").alias("fill_at"), F.col("first.number").alias("fill_isbn"), F.col("own_work").alias("fill_work"))
    made = state.where(F.col("stage").isin(*MADE) & F.col("number").isNotNull()).select(F.col("number").alias("isbn"), "place", "book", "work")
    setters = made.unionByName(filled.select(F.col("fill_isbn").alias("isbn"), F.col("fill_at").alias("place"), "book", F.col("fill_work").alias("work")))
    holders = setters.groupBy("isbn").agg(F.min(F.struct("place", "book", "work")).alias("h"))
    return holders.select("isbn", F.col("h.place").alias("set_at"), F.col("h.book").alias("set_book"), F.col("h.work").alias("set_work")), filled.select("book", "fill_at", "fill_isbn")


def _round(rows: DataFrame, state: DataFrame, known: DataFrame) -> DataFrame:
    """Outcomes of all rows, given those of the rows before them."""
    own = known.select(F.col("id").alias("book"), F.col("isbn").alias("own_isbn"), F.col("work").alias("own_work"))
    own = own.unionByName(state.where(F.col("stage").isin(*MADE)).select("book", F.col("number").alias("own_isbn"), F.col("work").alias("own_work")))
    holders, filled = _numbers(state, own)

    latest = F.when(F.col("stage").isin(*MADE), F.struct("book", "number"))
    seen = nearest_known(state.where("work is not null").select("place", "work", "stage", "book", "number"), ["work"], ["place"], latest, "latest").select("place", "latest")
    r = rows.join(seen, "place", "left").join(holders, "isbn", "left")
    early = F.col("set_at") < F.col("place")
    r = r.withColumns({
        "found": F.coalesce("isbn_book", F.when(early, F.col("set_book"))),
        "found_work": F.when(F.col("isbn_book").isNotNull(), F.col("isbn_work")).when(early, F.col("set_work")),
        "candidate": F.coalesce("latest.book", "work_book"),
        "candidate_isbn": F.when(F.col("latest").isNotNull(), F.col("latest.number")).otherwise(F.col("work_isbn")),
    })
    r = r.join(filled.withColumnRenamed("book", "candidate"), "candidate", "left")
    number = F.coalesce("candidate_isbn", F.when(F.col("fill_at") < F.col("place"), F.col("fill_isbn")))
    conflict = F.col("found").isNotNull() & F.col("loose") & ~F.coalesce(F.col("work") == F.col("found_work"), F.lit(False))
    by_work = F.col("candidate").isNotNull() & free_of(number)
    stage = F.when(conflict, "isbn_conflict").when(F.col("found").isNotNull(), "isbn").when(by_work, "work").when(F.col("title_book").isNotNull(), "title_publisher").otherwise("new")
    r = r.withColumn("stage", stage)
    book = F.when(F.col("stage") == "isbn", F.col("found")).when(F.col("stage") == "work", F.col("candidate")).when(F.col("stage") == "title_publisher", F.col("title_book")).otherwise(-F.col("place") - 1)
    return r.select("place", "work", "stage", book.alias("book"), F.when(F.col("stage") != "isbn_conflict", F.col("isbn")).alias("number"))


def import_in_order(new: DataFrame, known: DataFrame, max_rounds: int = 200) -> DataFrame:
    """place, stage, matched (a known book) and matched_place (the row that made the book) of every row of a file.

    new: place (the order, unique, from 0), isbn, work, title, publisher, author, sources, ebook, loose; known: id (from 0)
    and the same without place, ebook and loose. Stages are those of ``imports.import_cascade``. Rows of a file have one
    source, and rows of one source do not merge by title and publisher, so there only known books are looked at.
    """
    rows = written(_with_known(new, known))
    first = rows.where("work is not null").groupBy("work").agg(F.min("place").alias("first"))
    start = rows.join(first, "work", "left")
    alone = F.col("first").isNull() | (F.col("first") == F.col("place"))
    state = written(start.select("place", "work", F.when(alone, "new").otherwise("work").alias("stage"), (-F.coalesce("first", "place") - 1).alias("book"), F.col("isbn").alias("number")))
    for _ in range(max_rounds):
        after = written(_round(rows, state, known))
        old = state.select("place", F.col("stage").alias("old_stage"), F.col("book").alias("old_book"), F.col("number").alias("old_number"))
        moved = after.join(old, "place").where("stage <> old_stage or book <> old_book or not (number <=> old_number)").limit(1).count()
        state = after
        if not moved:
            made = F.col("stage").isin(*MADE)
            return state.select("place", "stage", F.when(~made & (F.col("book") >= 0), F.col("book")).alias("matched"), F.when(~made & (F.col("book") < 0), -F.col("book") - 1).alias("matched_place"))
    raise RuntimeError(f"rows of the file depend on each other in chains of over {max_rounds}")
