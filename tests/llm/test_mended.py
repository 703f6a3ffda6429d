"""Cases that once went wrong: many hot ids, long common beginnings, sizes of buckets, items without an id, names of columns."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stacksift.llm import decontaminate, fingerprints, hilbert, near_dup, pii, toxicity

SF = "/root/testdata/sf0.001"


def test_many_hot_ids(spark):
    """300 ids of 20 rows each, in more pieces than a plan could list: every row meets the next one."""
    rows = [(i % 300, f"text {i} of id {i % 300}") for i in range(6_000)] + [(None, f"no id {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cuts, hot = fingerprints._cuts(df.select("doc_id"), 1_500)
    assert len(hot) >= 300
    got = fingerprints.edited_fingerprints(df, parts=1_500).select("doc_id", "n_chars", "edited_sha256").collect()
    order = [r["text"] for r in df.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text").collect()]
    import hashlib
    from collections import Counter

    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(order, [*order[1:], order[0]], strict=True)]
    assert Counter(r["edited_sha256"] for r in got) == Counter(hashlib.sha256(e.encode()).hexdigest() for e in edited)


def test_sources_that_begin_alike(spark):
    """Bounds are of whole texts, so sources with one beginning fall on many levels."""
    df = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("https://www.example.org/section-"), (F.col("id") % 16).cast("string")).alias("source"))
    cuts = hilbert._text_cuts(df, "source", 3)
    assert len(cuts) == 7
    below = [df.where(F.col("source") <= c).count() for c in cuts]
    assert all(abs(n - 4_000 * (i + 1) / 8) <= 250 for i, n in enumerate(below))
    one = df.withColumn("source", F.when(F.col("doc_id") < 3_000, "hot").when(F.col("doc_id") < 3_500, None).otherwise(F.col("source")))
    assert hilbert._text_cuts(one, "source", 3)[0] == "hot"
    assert hilbert._text_cuts(df.where("false"), "source", 3) == []
    shards = [r["n"] for r in hilbert.assign(df).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(shards) == 24
    assert max(shards) - min(shards) <= 1


def test_classes_do_not_depend_on_the_size_of_buckets(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    read = lambda: {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(docs).collect()}
    want = read()
    monkeypatch.setattr(near_dup, "SMALL", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    assert read() == want


def test_items_without_an_id(spark):
    item = " ".join(f"bench{i}" for i in range(20))
    short = "only four words here"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "clean text that says nothing of the kind"), (3, f"x {short} y")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, short), (5, "something else entirely that nobody ever wrote")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()) == [(1, None), (3, None)]
    assert [r["doc_id"] for r in decontaminate.drop_leaking(docs, bench).collect()] == [2]


def test_a_phrase_of_the_whole_benchmark(spark):
    """A run of words that all items share leads to few of them, and verbatim and changed items are found all the same."""
    items = [f"what is the answer to question {i} " + " ".join(f"w{i}x{k}" for k in range(14)) for i in range(200)]
    changed = " ".join("other" if k % 8 == 5 else w for k, w in enumerate(items[7].split()))
    docs = spark.createDataFrame([(0, "people often ask what is the answer to question after question and so on " * 20), (1, f"a {items[3]} b"), (2, f"c {changed} d")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {(1, 3), (2, 7)}


def test_columns_of_any_name(spark):
    names = ("__same", "__id", "__digest", "__pii", "row", "pieces", "same", "id", "kept_id", "others", "__tox_row", "__tox_features", "__tox_score", "score")
    df = spark.createDataFrame([(1, "card 4929348385146306"), (2, "one two three four five six"), (3, "one two three four five six")], "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    assert pii.pseudonymise(df).columns[: len(df.columns)] == df.columns
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["__same"], r["__id"]) for r in kept.collect()) == [(1, "__same", "__id"), (2, "__same", "__id")]
    none = spark.createDataFrame([(9, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(df, none).columns == df.columns
    twice = spark.createDataFrame([(1, "same text here", "b"), (1, "same text here", "a")], "doc_id long, text string, note string")
    assert [r["note"] for r in near_dup.keep_one(twice).collect()] == ["a"]


def test_latent_space_is_fitted_on_every_passage(spark, monkeypatch):
    """However few passages are multiplied at once, the singular values are those of the whole matrix."""
    monkeypatch.setattr(decontaminate, "SAMPLE", 4)
    draw = random.Random(5)
    texts = [" ".join(f"w{min(draw.randrange(60), draw.randrange(60))}" for _ in range(150)) for _ in range(40)]
    df, n, passages = decontaminate.count_passages(spark.createDataFrame([(t,) for t in texts], "text string"))
    words = [w for ((_, h, _),) in (decontaminate.folded_words(pa.array([t])) for t in texts) for w in np.array_split(decontaminate._bucket(h), range(decontaminate.LONG, len(h), decontaminate.LONG))]
    assert n == len(words) == 160
    whole = np.array([np.bincount(w, minlength=decontaminate.BUCKETS) for w in words], np.float64)
    assert (df == (whole > 0).sum(axis=0)).all()
    idf = np.log((1.0 + n) / (1.0 + df)) + 1e-3
    whole = whole[:, df > 0] * idf[df > 0]
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    vectors, values = decontaminate.randomised_svd(passages, idf, 3, rounds=4)
    want = np.linalg.svd(whole, compute_uv=False)
    assert np.allclose(values[:20], want[:20], rtol=0.02)
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-4)


def test_windows_without_the_answer_are_not_checked_one_by_one(monkeypatch):
    """Where all is alike in the latent space, only windows with words of a passage's answer get the exact check, and what that finds everywhere is found."""
    draw = random.Random(11)
    some = lambda n: [f"v{draw.randrange(3_000)}" for _ in range(n)]
    items = [some(n) for n in (6, 9, 14, 19, 30, 30, 31, 40, 48)]
    texts = [some(draw.randint(0, 200)) for _ in range(40)]
    for i, item in enumerate(items):
        changed = [w if draw.random() < 0.85 else "other" for w in item]
        texts += [some(i) + item, some(25) + changed + some(i), item[: len(item) // 2] + some(3)]
    texts += [[], items[4] + items[5] + items[4]]
    column = pa.array([" ".join(t) for t in texts])
    hashes = [h for ((_, h, _),) in (decontaminate.folded_words(pa.array([" ".join(i)])) for i in items)]
    vectors = np.ones((decontaminate.BUCKETS, 4), np.float32)
    idf = np.random.default_rng(3).random(decontaminate.BUCKETS).astype(np.float32)
    index = decontaminate.Index(vectors, idf, list(enumerate(hashes)))
    plain, calls = decontaminate.Index._check, []
    monkeypatch.setattr(decontaminate.Index, "_check", lambda self, *x: (calls.append(x), plain(self, *x))[1])
    got = [[(i, share) for i, _, share in found] for found in index.search(column)]
    assert sum(map(len, got)) >= 2 * len(items)
    assert len(calls) < 1_000  # all pairs of a window and a passage near it are over 4,000
    ((_, every, at),) = decontaminate.folded_words(column)
    want = []
    for r in range(len(texts)):
        found = [{}]
        for size, step, which in ((12, 6, (0, 1, 2)), (24, 12, (3, 4, 5)), (48, 24, (6, 7, 8))):
            for start in range(int(at[r]), int(at[r + 1]), step):
                for p in which:
                    plain(index, every, np.array([at[r], at[r + 1]]), start, 0, size, p, 1.0, found)
        index._shared_runs(every[at[r] : at[r + 1]], np.array([0, at[r + 1] - at[r]]), found)
        want.append(sorted((i, share) for i, (_, share) in found[0].items()))
    assert got == want
