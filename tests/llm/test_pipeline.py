"""The corpus pipeline on the smallest tables: each stage's effect, and the end against the tokenizer library."""

import base64
import hashlib
import math
from collections import Counter

import corpus_pipeline
from stacksift.llm import decontaminate, near_dup, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns)
        docs = out.checkpoint()
        counts.append(docs.count())
        assert counts[-1] <= counts[-2], name
    assert counts[2] < counts[1]
    assert near_dup.near_duplicate_classes(docs).where("not is_kept").count() == 0
    assert decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert secrets.scan(docs).where("n_assign + n_access + n_hex > 0").count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    tokens = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert tokens == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}


def near(a, b):
    """Probability Jaccard of the weighted five-word shingles of two texts."""
    def weights(t):
        w = t.split()
        return {k: 1 + math.log2(n) for k, n in Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w).items()}

    x, y = weights(a), weights(b)
    return sum(1 / sum(max(x.get(d, 0) / x[c], y.get(d, 0) / y[c]) for d in {**x, **y}) for c in x if c in y)


def test_pipeline_against_plain_python(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns: the rows that stay, by hand."""
    import public_tokenizers as P
    import tiktoken

    item = " ".join(f"bench{i}" for i in range(20))
    spare = " ".join(f"spare{i}" for i in range(12))
    base = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, None), (2, ""), (3, "one"), (4, "long " * 60_000), (5, "a\x00b c d e f"), (5, "a\x00b c d e f"), (None, "no id here at all"), (None, "another one without an id"),
        (7, base), (8, base.replace("word39", "other")), (9, base), (7, "unlike text under a known id"), (10, f"before {item} after"), (13, f"{spare} of no id"), (11, "here password: hunter2secret and more"), (12, "日本語 テキスト"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, same int, key int, shard int, score string, ids string, `__same` int, `__id` int, `__digest` string, `__pii` int, `row` int, kept int, `__tox_features` int, n_card string"
    made = lambda data: spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, 2, 3, "x", "y", 4, 5, "z", 6, 7, 8, 9, "w") for d, t in data], schema)
    made(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (3, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, spare), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if not any((t or "") == (k or "") or near(t or "", k or "") >= 0.8 for _, k in kept):
            kept.append((d, t))
    kept = [(d, t) for d, t in kept if item not in (t or "") and spare not in (t or "")]
    kept = [(d, "" if t is None else t.replace("password: hunter2secret", "<secret>")) for d, t in kept]
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = Counter((d, hashlib.sha256(",".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in kept)
    got = Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = made(rows)
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, made([]), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, made([]), str(tmp_path)).count() == 0
