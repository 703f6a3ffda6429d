"""Linkage over whole tables: union-find, and all pairs of names."""

from pyspark.sql import functions as F

from stacksift.operators import linkage
from stacksift.plans import registry

SF = "/root/testdata/sf0.001"


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_of_all_orders(spark, tmp_path):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    want = union_find((r["l_suppkey"], r["l_partkey"] + 1_000_000) for r in li.collect())
    assert {r["node"]: r["root"] for r in registry.queries()["components_whole"](spark, SF).collect()} == want
    # several components, edges of all orders, and supplier numbers beyond a million
    rows = [(k, 1 + k % 7 if k % 2 else 2_000_000 + k % 3, k % 5 if k % 2 else 50 + k % 3) for k in range(1, 40)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    behind = 2_000_003
    got = {r["node"]: r["root"] for r in registry.queries()["components_whole"](spark, str(tmp_path)).collect()}
    want = union_find((s, p + behind) for _, s, p in rows)
    assert got == want
    assert len(set(want.values())) > 1


def test_same_place_pairs(spark):
    names = ["red bolt", "fed bolt", "rad bult", "tiny gear", "tinz gear", "a", "b", "", "ab", "ac", "日本語詩集", "日本詩詩集", "abcde", "abcxy", "abxyz", "12345abcde", "abcde12345", "1x3y5abcde"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    want = {(a, b) for a in names for b in names if a < b and len(a) == len(b) and same(a, b) >= 0.6}
    assert {(r["a"], r["b"]) for r in linkage.same_place_pairs(df, "n", 6, 10).collect()} == want
    assert linkage.same_place_pairs(df.where(F.lit(False)), "n", 6, 10).count() == 0


def test_chains_cycles_and_hubs(spark, monkeypatch):
    """A chain of 10,000 in order and one in disorder, and a hub of all nodes, in rounds by the logarithm of their length."""
    import random

    from stacksift.operators import components

    draw = random.Random(9)
    names = draw.sample(range(100_000, 200_000), 10_000)
    edges = [(i, i + 1) for i in range(10_000)] + [(a + 1_000_000, b + 1_000_000) for a, b in zip(names, names[1:], strict=False)] + [(5_000_000, 5_000_000 + i) for i in range(1, 5_000)]
    rounds = []
    monkeypatch.setattr(components, "written", lambda df, real=components.written: rounds.append(1) or real(df))
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find(edges)
    assert len(rounds) <= 1 + 4 * 16


def test_aliases_on_cycles_end_early(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(linkage, "written", lambda df, real=linkage.written: rounds.append(1) or real(df))
    rows = [(i, i + 1) for i in range(1, 40)] + [(40, None)] + [(100, 101), (101, 102), (102, 100), (103, 100), (104, 103), (105, 105), (110, 111), (111, 110), (112, 113), (113, 114), (114, 110)]
    got = dict(linkage.flatten_aliases(spark.createDataFrame(rows, "k long, t long"), "k", "t").collect())
    assert got == {i: 40 for i in range(1, 40)} | {40: None, 100: None, 101: 100, 102: 100, 103: 100, 104: 100, 105: None, 110: None} | dict.fromkeys((111, 112, 113, 114), 110)
    assert len(rounds) <= 8
