"""The set of seen keys: exact whatever the filters let through, and read by bucket."""

import random

from pyspark.sql import functions as F

from stacksift.streaming import seen


def test_unseen_keys_over_batches(spark, tmp_path):
    draw = random.Random(6)
    for words, kind in ((1, "string"), (4, "bigint")):
        s = seen.SeenKeys(spark, str(tmp_path / kind), "k", kind, buckets=8, words=words)
        known = set()
        for batch in range(2):
            some = {draw.randrange(60_000) for _ in range(8_000)}
            df = spark.createDataFrame([(str(k) if kind == "string" else k, batch) for k in some] + [(None, batch)], f"k {kind}, v int").withColumns({"bucket2": F.lit(1)})
            fresh = s.unseen(df, batch)
            assert fresh.columns == df.columns
            assert {int(r["k"]) for r in fresh.collect()} == some - known
            s.add(fresh, batch)
            s.add(fresh, batch)  # tried again
            assert {int(r["k"]) for r in s.unseen(df, batch).collect()} == some - known  # a batch does not see itself
            known |= some
        assert s.unseen(df).count() == 0
        small = s.compact(str(tmp_path / f"{kind}-small"))
        assert small.unseen(df).count() == 0
        assert {int(r["k"]) for r in small.unseen(spark.range(60_000, 60_050).select(F.col("id").cast(kind).alias("k"))).collect()} == set(range(60_000, 60_050))


def test_a_batch_reads_its_buckets(spark, tmp_path):
    s = seen.SeenKeys(spark, str(tmp_path), "k", "bigint", buckets=64, words=2)
    s.add(spark.range(50_000).select(F.col("id").alias("k")), 0)
    few = spark.createDataFrame([(5,), (6,)], "k bigint")
    placed = s.placed(few)
    assert len(s.known_keys(placed).inputFiles()) > 10  # the folder; what is read is cut down by the filter on its bucket
    plan = s.known_keys(placed)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    buckets = {r["bucket"] for r in placed.collect()}
    rows = s.known_keys(placed).count()
    assert rows == s.placed(spark.range(50_000).select(F.col("id").alias("k"))).where(F.col("bucket").isin(list(buckets))).count() < 50_000 / 8
    strangers = spark.range(100_000, 120_000).select(F.col("id").alias("k"))
    assert seen.false_hits(s, strangers) < 0.01
    assert s.unseen(strangers).count() == 20_000
    tiny = seen.SeenKeys(spark, str(tmp_path / "full"), "k", "bigint", buckets=1, words=1)
    tiny.add(spark.range(20_000).select(F.col("id").alias("k")), 0)
    assert seen.false_hits(tiny, strangers) > 0.3  # far too few words, and still exact
    assert tiny.unseen(strangers).count() == 20_000
