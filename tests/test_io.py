"""Readers, writers and streams on files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacksift.sources import readers, writers
from stacksift.streaming import ingest, skips


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{bad\n{"id": 2}\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    good, bad = readers.json_lines(spark, str(tmp_path / "a.jsonl"), schema)
    assert sorted(r["id"] for r in good.collect()) == [1, 2]
    assert [r["value"] for r in bad.collect()] == ["{bad"]


def test_tsv_with_mark(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("﻿id\tname\n1\tx\n", encoding="utf-8")
    assert readers.tsv(spark, str(tmp_path / "a.tsv"), 2).first().asDict() == {"id": "1", "name": "x"}


def test_release_notes(spark, tmp_path):
    (tmp_path / "r.md").write_text("# Changes\n\n## [1.9.0] - 2026-01-02\n- a\n\n## [1.10.0] - 2026-02-03\n- b\n")
    assert [(r["version"], r["date"], r["body"]) for r in readers.release_notes(spark, str(tmp_path / "r.md")).collect()] == [("1.10.0", "2026-02-03", "- b"), ("1.9.0", "2026-01-02", "- a")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\nc")], "id int, t string")
    writers.tsv_report(df, str(tmp_path / "out"))
    assert readers.tsv(spark, str(tmp_path / "out")).first()["t"] == "a b c"
    assert json.loads(writers.envelope(df).first()["json"])["data"][0]["id"] == 1
    ld = df.select(writers.book_linked_data(F.lit("n"), F.array(F.lit("p")), F.lit(None).cast("string"), F.lit("u")).alias("j")).first()["j"]
    assert "isbn" not in json.loads(ld)


def test_append_new_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"k": 1, "v": "a"}\n{"k": 1, "v": "b"}\n{"k": 2, "v": "c"}\n')

    def run():
        s = spark.readStream.schema("k long, v string").json(str(src))
        ingest.append_new(s, "k", str(tmp_path / "master"), str(tmp_path / "delta"), str(tmp_path / "state")).start().awaitTermination()

    run()
    (src / "2.json").write_text('{"k": 2, "v": "z"}\n{"k": 3, "v": "d"}\n')
    run()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "master")).collect()) == [1, 2, 3]
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "delta")).where("batch = 1").collect()] == [3]


def test_skip_list_over_batches(spark, tmp_path):
    """State lives over batches and restarts: skipped for seven days, tried again, taken off by success; a failed fetch changes nothing."""
    src = tmp_path / "in"
    src.mkdir()
    batches = [
        [("a", 1, "2024-01-01 10:00", "bad"), ("b", 2, "2024-01-01 11:00", "bad"), ("c", 3, "2024-01-01 11:00", "error")],
        [("a", 4, "2024-01-07 23:59", "ok"), ("b", 5, "2024-01-08 00:00", "bad"), ("c", 6, "2024-01-02 00:00", "ok")],
        [("a", 7, "2024-01-08 12:00", "ok"), ("a", 8, "2024-01-08 13:00", "bad"), ("b", 9, "2024-01-14 09:00", "ok"), ("b", 10, "2024-01-15 00:00", "error"), ("b", 11, "2024-01-15 01:00", "ok")],
        [("z", 12, "2024-02-01 00:00", "ok")],
    ]
    out = []
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("k", "attempt", "at", "outcome"), r, strict=True))) for r in rows))
        s = spark.readStream.schema("k string, attempt long, at timestamp, outcome string").option("maxFilesPerTrigger", 1).json(str(src))
        with skips.state_store(spark):
            skips.skip_list(s, "k", late="30 days").writeStream.foreachBatch(lambda b, _: out.extend(tuple(r) for r in b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    day = lambda d: datetime.date(2024, 1, d)
    made = {r[1]: r[2:] for r in out if r[1] is not None}
    assert made[1] == ("failed", 1, day(1), day(1))
    assert made[4] == ("skipped", 1, day(1), day(1))
    assert made[5] == ("failed", 2, day(1), day(8))
    assert made[7] == ("ok", 0, None, None)
    assert made[8] == ("failed", 1, day(8), day(8))
    assert made[9] == ("skipped", 2, day(1), day(8))
    assert made[10] == ("error", 2, day(1), day(8))
    assert made[11] == ("ok", 0, None, None)
    assert (made[3][0], made[6][0], made[12][0]) == ("error", "ok", "ok")
    assert spark.conf.get(skips.PROVIDER, None) is None or "HDFS" in spark.conf.get(skips.PROVIDER)


def test_skip_list_says_what_is_due(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "0.json").write_text('{"k": "a", "attempt": 1, "at": "2024-01-01T10:00:00", "outcome": "bad"}\n{"k": "b", "attempt": 2, "at": "2024-01-20T10:00:00", "outcome": "ok"}')
    s = spark.readStream.schema("k string, attempt long, at timestamp, outcome string").json(str(src))
    with skips.state_store(spark):
        got = [tuple(r) for r in ingest.run_once(skips.skip_list(s, "k"), "append").where("attempt is null").collect()]
    assert got == [("a", None, "due", 1, datetime.date(2024, 1, 1), datetime.date(2024, 1, 1))]


def test_updates_cannot_be_read_back(spark, tmp_path):
    with pytest.raises(ValueError, match="update"):
        ingest.run_once(spark.readStream.schema("k long").json(str(tmp_path)), "update")


def test_seen_and_sitemap(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"u": "x"}\n{"u": "x"}\n{"v": 1}\n')
    assert readers.seen_keys(spark, str(tmp_path / "s.jsonl"), "u").count() == 1
    xml = spark.createDataFrame([('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>a</loc></url><url><loc>b</loc></url></urlset>',)], "xml string")
    assert sorted(r["loc"] for r in readers.sitemap(xml).collect()) == ["a", "b"]
    page = spark.createDataFrame([('<script type="application/ld+json">{"name": "x\ny"}</script>',)], "html string")
    assert readers.linked_data(page, "html", "name string").first()["ld"]["name"] == "x y"


def test_release_titles_and_notes(spark, tmp_path):
    (tmp_path / "r.md").write_text("# Changes\n## [1.2.0] - 2026-03-04 — Faster search\n- a\n## [1.1.0] -- No date\n- b\n## [1.0.0]\n- c\n")
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "v1.2.0.md").write_text("For readers\nmore")
    (tmp_path / "notes" / "other.md").write_text("no")
    made = readers.with_notes(readers.release_notes(spark, str(tmp_path / "r.md")), spark, str(tmp_path / "notes"))
    got = {r["version"]: (r["date"], r["title"], r["body"], r["note"]) for r in made.collect()}
    assert got == {"1.2.0": ("2026-03-04", "Faster search", "- a", "For readers\nmore"), "1.1.0": (None, "No date", "- b", None), "1.0.0": (None, "", "- c", None)}


def test_report_with_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\nc")], "id long, t string")
    writers.tsv_report(df, str(tmp_path / "out"), mark=True)
    assert all(part.read_bytes().startswith(b"\xef\xbb\xbfid\tt") for part in (tmp_path / "out").glob("part-*"))
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "out")).collect()] == [("1", "a b c")]


def test_json_pages_of_bare_lists_and_broken_ones(spark):
    df = spark.createDataFrame([(1, '[{"id": 1}, {"id": 2}]'), (2, "[]"), (3, "[{"), (4, None)], "page int, body string")
    assert [(r["page"], r["id"]) for r in readers.json_pages(df, "body", "", "id bigint").collect()] == [(1, 1), (1, 2)]


def test_bounds_of_parameters():
    from stacksift.operators import search

    assert [search.clamp(v, 1, 50, 20) for v in (None, 0, -3, 7, 99)] == [20, 1, 1, 7, 50]
