"""Searches by the index give the rows of a scan, and read less."""

import random
import re

from pyspark.sql import functions as F

from stacksift.operators import search, trigrams


def test_same_rows_as_a_scan(spark, tmp_path):
    draw = random.Random(4)
    words = ["alpha", "beta", "gamma", "日本語", "é", "x-ray", "ab", "zebra"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 6))), draw.choice([None, "", "side note", "aab"])) for i in range(300)]
    rows += [(300, "the rare wordling", None), (301, "only once: quixotry", "beta"), (None, "no key alpha", "x"), (302, "a" * 20_000 + "needle", "alp\nha"), (303, "ends al", "pha begins")]
    df = spark.createDataFrame(rows, "id long, title string, note string").withColumns({"key": F.lit(1), "text": F.lit("t"), "gram": F.lit("g"), "bucket": F.lit(2)})
    cols = [F.col("title"), F.coalesce("note", F.lit(""))]
    index = trigrams.TrigramIndex(spark, str(tmp_path / "i"), buckets=8).build(df, "id", cols)
    for q in ("alpha", "gamma 日本語", "quixotry", "needle", "xray", "x-ray", "本語", "aab", "a", "é", "nothing like it", "alpha beta gamma", "-", "l pha", "al\x00pha"):
        want = {r["id"] for r in df.where(F.col("id").isNotNull() & search.matches(cols, q)).select("id").collect()}
        got = [r["key"] for r in index.search(q).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want, q
    assert index.search("").count() == 304
    assert index.rarest("nothing like it") == []
    assert index.rarest("al") is None
    assert [g for g, _, _ in index.rarest("the quixotry")][:1] != [] or index.rarest("the quixotry") == []
    empty = trigrams.TrigramIndex(spark, str(tmp_path / "none"), buckets=2).build(df.where("false"), "id", cols)
    assert empty.search("alpha").count() == 0


def test_a_search_reads_few_files(spark, tmp_path):
    df = spark.range(4000).select("id", F.concat(F.lit("row number "), F.col("id").cast("string"), F.lit(" of many")).alias("t"))
    index = trigrams.TrigramIndex(spark, str(tmp_path / "i"), buckets=16).build(df, "id", [F.col("t")])
    found = index._holding("number 3999")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (=|IN)", plan)
    assert [r["key"] for r in found.collect()] == [3999]
    buckets = {r["bucket"] for r in index.candidates("number 3999").select(index._of("key")).collect()}
    assert len(buckets) < 4
    assert index.rarest("number 3999")[0][2] < 400 < index.rarest("number ")[0][2]
