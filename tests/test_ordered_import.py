"""Imports in the order of a file against a row-by-row import in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from stacksift.operators import ordered_import
from stacksift.plans import imports, registry

SF = "/root/testdata/sf0.001"


def row_by_row(rows, known):
    """place: (stage, matched, matched_place), one row after the other."""
    by_isbn, by_work, number, work_of = {}, {}, {}, {}
    for k in sorted(known, key=lambda k: k["id"]):
        if k["isbn"]:
            by_isbn[k["isbn"]] = k["id"]
        if k["work"]:
            by_work[k["work"]] = k["id"]
        number[k["id"]], work_of[k["id"]] = k["isbn"], k["work"]
    out = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        isbn, book, stage = r["isbn"], None, "new"
        free = lambda other: not isbn or not other or isbn == other or r["ebook"]  # noqa: B023, E731
        if isbn and isbn in by_isbn:
            book, stage = by_isbn[isbn], "isbn"
            if r["loose"] and not (r["work"] and r["work"] == work_of[book]):
                book, stage, isbn = None, "isbn_conflict", None
        elif r["work"] and r["work"] in by_work and free(number[by_work[r["work"]]]):
            book, stage = by_work[r["work"]], "work"
        else:
            same = [k["id"] for k in known if k["title"] and k["title"] == r["title"] and k["publisher"] == r["publisher"] and (k["author"] or r["author"]) and (k["author"] == r["author"] or not k["author"] or not r["author"]) and not set(k["sources"]) & set(r["sources"]) and free(k["isbn"])]
            if len(same) == 1:
                book, stage = same[0], "title_publisher"
        if book is None:
            own = -r["place"] - 1
            number[own], work_of[own] = isbn, r["work"]
            if isbn:
                by_isbn[isbn] = own
            if r["work"]:
                by_work[r["work"]] = own
            out[r["place"]] = (stage, None, None)
        else:
            if isbn and not number[book]:
                number[book] = isbn
                by_isbn[isbn] = book
            out[r["place"]] = (stage, book if book >= 0 else None, -book - 1 if book < 0 else None)
    return out


FILE = "place long, isbn string, work string, title string, publisher string, author string, sources array<string>, ebook boolean, loose boolean"
KNOWN = "id long, isbn string, work string, title string, publisher string, author string, sources array<string>"


def drawn(seed, n, m):
    draw = random.Random(seed)

    def one(i):
        title, author = draw.choice(["", "t1", "t2", "t3", "t4"]), draw.choice(["", "a1", "a2"])
        work = f"{title}|{author}" if title and author else None
        return i, draw.choice([None, None, "1", "2", "3", "4", "5"]), work, title, draw.choice(["p1", "p2"]), author

    file = [(*one(i), ["own"], draw.random() < 0.1, draw.random() < 0.3) for i in range(n)]
    return file, [(*one(i), [draw.choice(["x", "y"])]) for i in range(m)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_files_of_chains(spark, seed):
    file, known = drawn(seed, 60, 12 if seed > 1 else 0)
    a, b = spark.createDataFrame(file, FILE), spark.createDataFrame(known, KNOWN)
    got = {r["place"]: (r["stage"], r["matched"], r["matched_place"]) for r in ordered_import.import_in_order(a, b).collect()}
    want = row_by_row([r.asDict() for r in a.collect()], [r.asDict() for r in b.collect()])
    assert got == want
    assert sum(w[2] is not None for w in want.values()) > (5 if seed == 1 else 0)  # earlier rows of the file are matched


def test_a_number_is_filled_in_and_found(spark):
    """A row without a number makes a book, one of its work fills it in, a third is found by it, a fourth no longer fits."""
    file = [(0, None, "w", "t", "p", "a", ["own"], False, False), (1, "9", "w", "t", "p", "a", ["own"], False, False), (2, "9", None, "", "p", "", ["own"], False, False), (3, "8", "w", "t", "p", "a", ["own"], False, False), (4, None, "w", "t", "p", "a", ["own"], False, False)]
    got = {r["place"]: (r["stage"], r["matched_place"]) for r in ordered_import.import_in_order(spark.createDataFrame(file, FILE), spark.createDataFrame([], KNOWN)).collect()}
    assert got == {0: ("new", None), 1: ("work", 0), 2: ("isbn", 0), 3: ("new", None), 4: ("work", 3)}
    assert ordered_import.import_in_order(spark.createDataFrame([], FILE), spark.createDataFrame([], KNOWN)).count() == 0


def test_query_row_by_row(spark):
    b = imports._books(spark, SF).withColumn("work", imports.text.title_author_key(F.col("title"), F.col("author"))).collect()
    rows = [r.asDict() | {"place": r["id"], "sources": ["own"]} for r in b if r["id"] % 5 < 3]
    want = row_by_row(rows, [r.asDict() for r in b if r["id"] % 5 >= 3 and r["id"] % 30 < 20])
    got = {r["place"]: (r["stage"], r["matched"], r["matched_place"]) for r in registry.queries()["import_in_order"](spark, SF).collect()}
    assert got == want
