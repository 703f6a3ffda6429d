"""Lines read in ranges, and writes that take effect as a whole or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from stacksift.sources import record_files as R

FIELDS = "id bigint, name string, price double, tags array<string>, ok boolean"


def test_lines_in_every_split(spark, tmp_path):
    good = [{"id": i, "name": "名" * (i % 7), "price": i / 2, "tags": ["a", str(i)], "ok": bool(i % 2)} for i in range(200)]
    lines = [json.dumps(g, ensure_ascii=False) for g in good]
    lines[50:50] = ["", "   ", "{broken", "[1, 2]", '{"id": "x"}', '{"id": true}', '{"name": 7, "id": "12"}']
    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + "\r\n".join(lines).encode())
    for split in (1, 17, 64, 1 << 20):
        got = R.read_lines(spark, str(tmp_path), FIELDS, split_bytes=split if split > 1 else 900).collect()
        rows = sorted((r["id"], r["name"], r["price"], tuple(r["tags"]), r["ok"]) for r in got if r["bad_line"] is None and r["tags"])
        assert rows == sorted((g["id"], g["name"], g["price"], tuple(g["tags"]), g["ok"]) for g in good)
        assert [(r["id"], r["name"]) for r in got if r["bad_line"] is None and not r["tags"]] == [(12, "7")]
        assert sorted((r["bad_reason"], r["bad_line"]) for r in got if r["bad_line"]) == [("no json", "{broken"), ("no object", "[1, 2]"), ("other type", '{"id": "x"}'), ("other type", '{"id": true}')]
    report = R.line_counts(R.read_lines(spark, str(tmp_path), FIELDS)).first()
    assert (report["n_read"], report["n_bad"], json.loads(report["reasons"])) == (201, 4, {"no json": 1, "no object": 1, "other type": 2})


def test_ranges_give_each_line_once():
    import io

    body = b"one\n\ntwo\r\n" + b"x" * 40 + b"\nlast"
    whole = list(R.lines_in(io.BytesIO(body), 0, len(body)))
    assert [line for _, line in whole] == [b"one", b"", b"two", b"x" * 40, b"last"]
    for size in range(1, 30):
        assert [x for lo in range(0, len(body), size) for x in R.lines_in(io.BytesIO(body), lo, min(lo + size, len(body)))] == whole


def test_tsv_with_mark_and_few_columns(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("﻿id\tname\tprice\n1\tx\t2.5\n\n2\n3\ty\tmuch\n", encoding="utf-8")
    got = R.read_lines(spark, str(tmp_path), "id bigint, name string, price double", kind="tsv", least_columns=2).collect()
    assert [(r["id"], r["name"], r["price"]) for r in got if not r["bad_reason"]] == [(1, "x", 2.5)]
    assert [(r["bad_reason"], r["bad_line"]) for r in got if r["bad_reason"]] == [("few columns", "2"), ("other type", "3\ty\tmuch")]
    with pytest.raises(Exception, match="4 expected"):
        R.read_lines(spark, str(tmp_path), "id bigint", kind="tsv", least_columns=4).collect()
    (tmp_path / "none").mkdir()
    assert R.read_lines(spark, str(tmp_path / "none"), "id bigint").count() == 0


def test_a_write_counts_as_a_whole_or_not_at_all(spark, tmp_path):
    path, fields = str(tmp_path / "t"), "id bigint, v string"
    df = lambda lo, hi, v: spark.range(lo, hi, numPartitions=3).select("id", F.lit(v).alias("v"))
    read = lambda: sorted((r["id"], r["v"], r["batch"]) for r in R.read_table(spark, path, fields).collect())
    assert read() == []
    R.write_batch(df(0, 4, "a"), path, "one")
    first = [(i, "a", "one") for i in range(4)]
    assert read() == first
    broken = df(4, 40, "b").withColumn("v", F.when(F.col("id") == 39, F.raise_error(F.lit("stop"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        R.write_batch(broken, path, "two")
    assert read() == first  # two of three tasks had written
    with pytest.raises(Exception, match="stop"):
        R.write_batch(broken, path, "two", replace=True)
    assert read() == first
    R.write_batch(df(4, 6, "b"), path, "two")
    R.write_batch(df(4, 9, "again"), path, "two")  # the batch is known
    assert read() == [*first, (4, "b", "two"), (5, "b", "two")]
    R.write_batch(df(7, 8, "c"), path, "three", replace=True)
    assert read() == [(7, "c", "three")]
    assert [(e["batch"], e["rows"], e["replaces"]) for e in R.batches(path)] == [("one", 4, False), ("two", 2, False), ("three", 1, True)]
    R.write_batch(df(0, 0, "none"), path, replace=True)
    assert read() == []


def test_a_writer_that_dies_leaves_nothing_to_read(spark, tmp_path):
    """Files without an entry in the log, and a draft of an entry, are as if they were not there."""
    path = str(tmp_path / "t")
    R.write_batch(spark.range(3).select("id"), path, "one")
    (tmp_path / "t" / "part-dead.jsonl").write_text('{"id": 99}\n')
    (tmp_path / "t" / R.LOG / ".draft").write_text("{")
    assert sorted(r["id"] for r in R.read_table(spark, path, "id bigint").collect()) == [0, 1, 2]
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) >= 2
