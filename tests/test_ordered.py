"""Looks back and ahead over ranges, nearest rows, throttles: against plain Python, with a key that fills most ranges."""

import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from stacksift.operators import linkage, ordered, tables


@pytest.fixture()
def many_ranges(spark):
    """Ranges stay as many as the shuffle has, so that edges matter."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_looks_over_ranges(many_ranges):
    draw = random.Random(8)
    rows = []
    for i in range(3000):
        k = draw.choice([None, "a", "hot", "hot", "hot", "hot", "z", f"k{draw.randrange(40)}"])
        rows.append((k, i if draw.random() < 0.9 else -i, i if draw.random() < (0.004 if k == "hot" else 0.3) else None))
    df = many_ranges.createDataFrame(rows, "k string, o long, v long").withColumns({c: F.lit(1) for c in ("row", "k0", "o0", "part", "seen", "c_v")})
    by = {}
    for k, o, v in rows:
        by.setdefault(k, []).append((o, v))
    before, behind = {}, {}
    for k, some in by.items():
        some.sort()
        last = None
        for o, v in some:
            before[k, o] = last
            last = v if v is not None else last
        last = None
        for o, v in reversed(some):
            behind[k, o] = last
            last = v if v is not None else last
    got = ordered.nearest_known(df, ["k"], ["o"], F.col("v"), "got")
    assert got.columns == [*df.columns, "got"]
    assert {(r["k"], r["o"]): r["got"] for r in got.collect()} == before
    assert {(r["k"], r["o"]): r["got"] for r in ordered.nearest_known(df, ["k"], ["o"], F.col("v"), "got", forward=False).collect()} == behind
    assert ordered.nearest_known(df.where("false"), ["k"], ["o"], F.col("v"), "got").count() == 0
    sizes = [r["count"] for r in df.where("k = 'hot'").repartitionByRange(F.col("k"), F.col("o")).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 13  # the hot key is in many tasks


def test_neighbours_over_ranges(many_ranges):
    df = many_ranges.range(500).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    got = {r["o"]: (r["lo"], r["hi"]) for r in ordered.neighbours(df, ["k"], ["o"], F.col("o"), "lo", "hi").collect()}
    assert got == {i: (i - 2 if i > 1 else None, i + 2 if i < 498 else None) for i in range(500)}


def test_throttle_of_a_hot_key(many_ranges):
    draw = random.Random(2)
    rows = [("hot", draw.randrange(400_000)) for _ in range(2500)] + [(f"k{draw.randrange(30)}", draw.randrange(400_000)) for _ in range(500)] + [("one", 5), ("two", 5), ("two", 5 + 3600), (None, 7), (None, 8), ("none", None)]
    df = many_ranges.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("at"), "s")
    want = set()
    for k in {k for k, _ in rows}:
        last = None
        for s in sorted(s for x, s in rows if x == k and s is not None):
            if last is None or s - last >= 3600:
                want.add((k, s))
                last = s
    got = [(r["k"], r["s"]) for r in tables.throttled(df, "k", "at", 1).select("k", F.unix_seconds("at").alias("s")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    assert tables.throttled(df.where("false"), "k", "at", 1).count() == 0


def test_nearest_in_a_hot_block(many_ranges):
    draw = random.Random(5)
    rows = [("hot" if draw.random() < 0.7 else f"b{draw.randrange(20)}", draw.randrange(600) / 4, i) for i in range(900)] + [("alone", 1.0, 9999), (None, 1.0, 9998), ("b1", None, 9997)]
    df = many_ranges.createDataFrame(rows, "b string, v double, id long")
    want = {}
    for b, v, i in rows:
        others = [(abs(v - w), j) for c, w, j in rows if c == b and j != i and b is not None and v is not None and w is not None] if b is not None and v is not None else []
        if others:
            want[i] = min(others)[1]
    assert {r["id"]: r["nearest"] for r in linkage.nearest_in_block(df, "b", "v", "id").collect()} == want


def test_carried_values_cross_ranges_of_one_key():
    edge = lambda part, lo, hi, lo_tail=None, hi_tail=None: {"part": part, "lo": (lo,), "hi": (hi,), "lo_tail": lo_tail, "hi_tail": hi_tail}

    class Tail(tuple):
        def __getitem__(self, i):
            return super().__getitem__(-1 if i == "v" else i)

    edges = [edge(0, "a", "b", None, Tail(("b", 1, 10))), edge(1, "b", "b"), edge(2, "b", "c"), edge(3, "c", "c", None, Tail(("c", 2, 7))), edge(4, "c", "d")]
    assert ordered._carried(edges, True) == [(1, ("b",), 10), (2, ("b",), 10), (4, ("c",), 7)]
    assert [a for a, b in pairwise([x[0] for x in ordered._carried(edges, True)]) if a >= b] == []


def test_audit_by_order(many_ranges):
    """A beginning that most keys share: levels as by comparing every pair."""
    from stacksift.operators import imports

    draw = random.Random(3)
    word = lambda: "".join(draw.choice("ab") for _ in range(draw.randint(1, 14)))
    new = [(i, draw.choice([None, str(i % 9)]), draw.choice(["popular", "popular", "", "日本語日本語"]) + word()) for i in range(250)]
    known = [(draw.choice([None, "4", "5"]), draw.choice(["popular", "popular", "", "日本語日本語"]) + word()) for _ in range(250)] + [(None, ""), ("4", None)]
    a, b = many_ranges.createDataFrame(new, "id long, isbn string, key string"), many_ranges.createDataFrame(known, "isbn string, key string")
    want = {}
    for i, isbn, key in new:
        levels = ["none"]
        for other, k in known:
            if isbn and isbn == other:
                levels.append("isbn")
            if k and key == k:
                levels.append("exact")
            if k and len(key) >= 6 and len(k) >= 6:
                if key.startswith(k) or k.startswith(key):
                    levels.append("prefix")
                elif len(key) >= 8 and key[:8] == k[:8]:
                    levels.append("common")
        want[i] = min(levels, key=["isbn", "exact", "prefix", "common", "none"].index)
    assert {r["id"]: r["level"] for r in imports.audit_new(a, b).collect()} == want
    assert len(set(want.values())) == 5
    keys = sorted({k for _, k in known if k})
    got = {r["k"]: r["root"] for r in ordered.prefix_roots(b.where("key <> ''"), "key").collect()}
    assert got == {k: min((p for p in keys if k.startswith(p)), key=len) for k in keys}
    assert imports.audit_new(a, b.where("false")).where("level <> 'none'").count() == 0
