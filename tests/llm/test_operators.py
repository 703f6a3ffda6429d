"""The training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, extra columns, brute force."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stacksift.llm import bpe, decontaminate, fingerprints, hilbert, html_crf, licenses, near_dup, pii, secrets, shingles, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "one"), (4, "word " * 30_000), (5, "a\x00b\x01c"), (5, "a\x00b\x01c"), (6, "日本語 テキスト éè"), (7, "   \n\n "), (None, "no id")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, and extra columns with names that operators use."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "score": F.lit("x"), "features": F.lit(1), "same": F.lit(2), "key": F.lit(3), "shard": F.lit(4)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# --- 1 ---------------------------------------------------------------------------------------------------------------
def test_pseudonyms_round_trip(spark):
    rows = ["card 4929348385146306, 4929-3483-8514-6306; bad 4929348385146307", "+1 (017) 555-7713", "ip 10.0.0.1.", "123-45-6789 666-12-1234", "2021-02-28 31.12.1999 30/02/2020", "DE89370400440532013000", "x\x01y 10.0.0.1 \x01", "", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    made = pii.pseudonymise(df)
    got = {r["doc_id"]: r for r in made.collect()}
    back = {r["doc_id"]: r["text"] for r in pii.restore(made.select("doc_id", "text")).collect()}
    assert back == dict(enumerate(rows))
    cards = re.findall(r"[\d-]{16,}", got[0]["text"])
    assert cards[0] == cards[1].replace("-", "") != "4929348385146306"
    assert cards[2] == "4929348385146307"
    assert got[0]["n_card"] == 2
    assert "666-12-1234" in got[3]["text"]
    assert "30/02/2020" in got[4]["text"]
    assert got[4]["n_date"] == 2


def test_pseudonyms_of_more_formats(spark):
    """IBANs with letters, numbers with something behind them, other phones, IPv6: all change, keep their form, and come back."""
    rows = ["GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300 AND MORE", "GB82 WEST 1234 5698 7654 32 AND 12", "card 4111111111111111 123", "+49 30 1234567", "2001:db8:0:1:a:b:c:d", "2001:db8:0:1:0a:b:c:d", "GB82 WEST 1234 5698 7654 33", "AB12 CDEF GHIJ"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(rows)], "doc_id long, text string, n_card int")
    made = pii.pseudonymise(df, "another key")
    got = {r["doc_id"]: r["text"] for r in made.collect()}
    assert [got[i] == rows[i] for i in range(9)] == [False] * 6 + [True] * 3
    shape = lambda t: re.sub("[a-z]", "x", re.sub("[A-Z]", "X", re.sub("[0-9]", "9", t)))
    assert all(shape(got[i]) == shape(rows[i]) for i in range(5))
    value = lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
    for i, n in ((0, 27), (1, 18), (2, 27)):
        iban = got[i][:n].replace(" ", "")
        assert value(iban[4:] + iban[:4]) == 1
    assert got[0] == got[2][:27] != rows[0]
    assert got[3].endswith(" 123")
    assert got[4].startswith("+49 ")
    assert got[5].startswith("2001:db8:0:1:")
    assert {r["doc_id"]: r["text"] for r in pii.restore(made, "another key").collect()} == dict(enumerate(rows))


def test_feistel_is_a_permutation(spark):
    df = spark.range(12 * 7).select(pii.feistel(F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(12), F.lit(7), "k", "t").alias("p"))
    got = {(r["p"]["x"], r["p"]["y"]) for r in df.collect()}
    assert got == {(x, y) for x in range(12) for y in range(7)}


def test_pseudonyms_odd_rows(odd):
    got = pii.pseudonymise(odd)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(ODD)
    assert pii.pseudonymise(odd.where("false")).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------
def test_base_spans():
    t = 'xpassword = "abc" token: abcdef1 API-KEY="qwertyuiop" AKIA' + "A1" * 8 + " " + "0f" * 12 + "g"
    got = sorted((secrets.KINDS[k], t[a:b]) for a, k, b in secrets.base_spans(t))
    assert got == [("access", "AKIA" + "A1" * 8), ("assign", "token: abcdef1"), ("hex", "0f" * 12)]  # three characters are too few, API-KEY is no name


def test_grammar_finds_unseen_credentials():
    model = secrets.train(secrets.labelled_examples())
    fresh = secrets.labelled_examples(30, seed=99)
    found = sum(bool(secrets.grammar_spans(f"see {s} here", model)) for _, s in fresh)
    assert found >= 0.95 * len(fresh)
    draw = random.Random(1)
    plain = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(200)]
    assert sum(bool(secrets.grammar_spans(s, model)) for s in plain) <= 2


@pytest.mark.parametrize("kind", ["uuid", "key"])
@pytest.mark.parametrize("n", [20, 200])
def test_formats_without_a_head(kind, n):
    """UUIDs and keys of 40 random characters: found in text, behind = and in quotes; words and hex strings of 40 are none of the keys."""
    import uuid

    draw = random.Random(5)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    one = lambda: str(uuid.UUID(int=draw.getrandbits(128), version=4)) if kind == "uuid" else "".join(draw.choice(alnum) for _ in range(40))
    model = secrets.train([(kind, one()) for _ in range(n)])
    assert model[kind].literal == 0
    fresh = [one() for _ in range(100)]
    found = sum((4, 3, 4 + len(v)) in secrets.grammar_spans(f"see {v} here", model) for v in fresh)
    found += sum((3, 3, 3 + len(v)) in secrets.grammar_spans(f'k="{v}", /{v}', model) for v in fresh)
    assert found >= 180
    words = " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 14))) for _ in range(5_000))
    assert not secrets.grammar_spans(words, model)
    if kind == "key":
        assert sum(bool(secrets.grammar_spans("".join(draw.choice("0123456789abcdef") for _ in range(40)), model)) for _ in range(100)) <= 5


def test_heads_are_what_strings_share():
    assert [secrets.shared_head(x) for x in (["ghp_a1", "ghp_b2"], ["ghp_a1", "ghs_b2"] * 4, ["abc"], ["xa", "xb"])] == [4, 4, 0, 1]


def test_secret_scan_odd_rows(odd):
    got = secrets.scan(odd).collect()
    assert len(got) == len(ODD)
    assert {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}


# --- 3 ---------------------------------------------------------------------------------------------------------------
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity_scores(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all()
    pos, neg = got[got.toxic == 1].score, got[got.toxic == 0].score
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.75
    assert (neg < 0.5).mean() > 0.95


def test_toxicity_ignores_held_out_labels_and_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(odd, none).collect()
    assert [r["score"] for r in got] == [0.0] * len(ODD)
    assert toxicity.drop_toxic(odd, none).columns == odd.columns


# --- 4 ---------------------------------------------------------------------------------------------------------------
def test_sketches(docs):
    t = list(texts(docs).values())[:60]
    sets = [set(shingles_of(x)) for x in t]
    made = fingerprints.sketches(pa.array(t))
    for a, x in zip(sets, made, strict=True):
        assert abs(fingerprints.distinct_count(x) - len(a)) <= 0.35 * max(3, len(a))
    for i in range(0, 40):
        j = len(sets[i] & sets[i + 1]) / max(1, len(sets[i] | sets[i + 1]))
        assert abs(fingerprints.resemblance(made[i], made[i + 1]) - j) < 0.2
    assert (fingerprints.merge(made[0], made[1]) == fingerprints.sketches(pa.array([t[0] + "\n" + t[1]]))[0]).mean() > 0.9
    assert (fingerprints.decode(fingerprints.encode(made[0])) == made[0]).all()


def shingles_of(t):
    w = t.split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_edited_texts(docs):
    t = texts(docs)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs, parts=7).collect()}
    order = sorted(t, reverse=True)
    assert set(got) == set(t)
    for i, d in enumerate(order):
        a, b = t[d], t[order[(i + 1) % len(order)]]
        assert got[d]["edited_sha256"] == hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()


def test_edited_odd_rows(odd):
    assert len(fingerprints.edited_fingerprints(odd).collect()) == len(ODD)
    assert fingerprints.edited_fingerprints(odd.where("doc_id = 3")).first()["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(odd.where("false")).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------------
def test_main_text(spark):
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <article><h1>Head &amp; tail</h1><p>First   para<br>goes on.<p>Second &lt;b&gt; <b>bold</b></article><div class="ad">Buy now</div>
    <section class="comments"><p>Nice!</p></section><footer>&copy; me</footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "<p"), (3, "u", "<p")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_crf.extract_pages(df).collect())
    assert got[0][1] == "Head & tail\nFirst para goes on.\nSecond <b> bold"
    assert got[1:] == [(2, "", 0), (3, "", 0), (3, "", 0)]


HAND_MADE = {
    "<html><body><nav>Menu</nav><h1>The harbour in winter</h1><p>The boats lay still between the stones, and nobody walked along the quay before noon that day.</p></body></html>": 2,
    "<body><p>We use cookies to improve your experience. Accept all</p><h1>A walk by the sea</h1><p>In the early morning the old road was empty and the light came slowly over the hills, so that the houses looked like paper.</p><p>People in the market said that the winter would be long, and that the river had never been so low in all their years.</p><p>Subscribe to our newsletter for weekly updates!</p><p>Great article, thanks for sharing! I agree with every word.</p></body>": 3,
    "<html><body bgcolor=white><center><font size=5>Old page</font></center><p>This page was written long ago by hand and it has nothing but paragraphs of text in it, as pages then had.</p><p>It ends here, without any menu.</p></body></html>": 3,
    "<body><article><h1>News</h1><p>The council met on Monday and talked about the bridge, which has been closed to lorries since the flood of last spring.</p><p>All rights reserved.</p></article><p>3 comments</p><p>Posted by Ann: nice post</p><footer>Copyright 2020</footer></body>": 3,
}


def test_pages_whose_notices_only_say_so():
    """Menus, notices, calls and comments without telling markup go; of an article nothing goes for its words."""
    field = html_crf.default_field()
    for page, n in HAND_MADE.items():
        got = html_crf.extract(page, field).split("\n")
        every = [b[0] for b in html_crf.blocks(page)]
        assert len(got) == n, got
        assert got == [b for b in every if b in got]
        assert not any(w in " ".join(got) for w in ("Menu", "cookies", "Subscribe", "thanks", "comments", "Posted", "Copyright"))
    test = html_crf.noted_pages(80, seed=92)
    right = [field.decode(html_crf.features(html_crf.blocks(h, field.index))) == y for h, y in test]
    assert np.mean(right) > 0.8


def test_field_against_all_paths():
    """Viterbi and the sums over paths, against every path of short pages."""
    import itertools

    draw = np.random.default_rng(3)
    for n in range(1, 9):
        e, t = draw.normal(size=(n, 2)), draw.normal(size=(2, 2))
        paths = {p: e[range(n), p].sum() + sum(t[a, b] for a, b in itertools.pairwise(p)) for p in itertools.product((0, 1), repeat=n)}
        z, fwd, bwd = html_crf.both_ways(e, t)
        assert abs(z - np.logaddexp.reduce(list(paths.values()))) < 1e-9
        for i in range(n):
            assert abs(np.exp(fwd[i, 1] + bwd[i, 1] - z) - sum(np.exp(s - z) for p, s in paths.items() if p[i])) < 1e-9
        field = html_crf.Field({str(i): i for i in range(n)}, e, t)
        assert tuple(field.decode([[str(i)] for i in range(n)])) == max(paths, key=paths.get)


def test_field_on_unseen_layouts():
    field = html_crf.default_field()
    test = html_crf.labelled_pages(80, seed=91)
    right = [field.decode(html_crf.features(html_crf.blocks(h, field.index))) == y for h, y in test]
    assert np.mean(right) > 0.95


# --- 6 ---------------------------------------------------------------------------------------------------------------
def test_hilbert_curve_is_continuous():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = grid[np.argsort(hilbert.hilbert_index(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_shards(docs, odd):
    for df, n in ((docs, docs.count()), (odd, len(ODD))):
        got = hilbert.assign(df).toPandas()
        sizes = got.groupby("shard").size().reindex(range(24), fill_value=0)
        assert len(got) == n
        assert sizes.max() - sizes.min() <= 1
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert hilbert.assign(odd.where("false")).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------------
def test_leaks(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.orderBy(F.desc(F.length("text"))).first()
    words = item["text"].split()
    changed = " ".join("changed" if i % 9 == 4 else w for i, w in enumerate(words))
    noise = docs.where("doc_id = 1").first()["text"]
    more = spark.createDataFrame([(9_000, f"{noise} {changed} {noise}"), (9_001, noise), (9_002, None), (9_003, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs.select("doc_id", "text").unionAll(more), bench).collect()}
    assert (9_000, item["item_id"]) in got
    assert not any(d in (9_001, 9_002, 9_003) for d, _ in got)
    t = texts(docs)
    whole = {(d, b["item_id"]) for b in bench.collect() for d, x in t.items() if b["text"] in x}
    assert whole <= got
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.leaks(docs.where("false"), bench).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------
def test_licenses(spark, odd):
    rows = [(1, "Some prose.\nReleased under the MIT License.\nMore."), (2, "Licensed under CC BY-NC 4.0."), (3, "Please renew your driving licence before May ends"), (4, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."), (4, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("x"))
    got = sorted((r["doc_id"], r["families"]) for r in licenses.scan(df).collect())
    assert got == [(1, "MIT"), (2, "CC-BY-NC-4.0"), (3, ""), (4, "Apache-2.0,proprietary"), (4, "Apache-2.0,proprietary"), (5, "")]
    assert licenses.scan(odd).count() == len(ODD)


# --- 9 ---------------------------------------------------------------------------------------------------------------
def weighted_set(t):
    return {k: 1 + math.log2(n) for k, n in Counter(shingles_of(t)).items()}


def exact(a, b):
    return sum(1 / sum(max(a.get(d, 0) / a[c], b.get(d, 0) / b[c]) for d in {**a, **b}) for c in a if c in b)


def test_near_duplicates_against_brute_force(docs):
    t = texts(docs)
    sets = {d: weighted_set(x) for d, x in t.items()}
    ids = sorted(t)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if t[a] == t[b] or (sets[a].keys() & sets[b].keys() and exact(sets[a], sets[b]) >= 0.8):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(docs).collect()}
    assert got == {d: find(d) for d in ids}


def test_near_duplicate_blocks(spark, monkeypatch):
    """Large buckets: many versions of one text, compared block by block, give the same classes."""
    draw = random.Random(4)
    base = ["w%d" % draw.randrange(10_000) for _ in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(draw.choice([1, 2, 3])):
            w[draw.randrange(len(w))] = "x%d" % draw.randrange(10_000)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(df).collect()}
    monkeypatch.setattr(near_dup, "SMALL", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(df).collect()} == want


def test_signature_estimates_probability_jaccard():
    draw = random.Random(2)
    words = ["w%d" % draw.randrange(500) for _ in range(300)]
    other = words[:240] + ["v%d" % draw.randrange(500) for _ in range(60)]
    a, b = " ".join(words), " ".join(other)
    ((_, h, at),) = shingles.shingle_rows(pa.array([a, b]))
    s = near_dup.signatures(*near_dup.weighted(h, at), 2, 2_000)
    assert abs((s[0] == s[1]).mean() - exact(weighted_set(a), weighted_set(b))) < 0.05


def test_near_duplicates_odd_rows(odd):
    got = near_dup.near_duplicate_classes(odd).collect()
    assert len(got) == len(ODD)
    by = {(r["doc_id"]): r["class_id"] for r in got}
    assert by[1] == by[2] == 1  # null and empty are equal texts
    assert near_dup.keep_one(odd).columns == odd.columns
    assert near_dup.near_duplicate_classes(odd.where("false")).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------------
def test_tokens(docs, odd, monkeypatch):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, odd):
        want = Counter((r["doc_id"], hashlib.sha256(",".join(map(str, reference.encode_ordinary(r["text"] or ""))).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(df, path, P.PATTERN).collect()) == want
    with open(path, "rb") as f:
        t = bpe.tokenizer(f.read(), P.PATTERN)
    draw = random.Random(4)
    # pieces of every padded size, alone and together, by the tree of one piece and by shared arrays
    more = ["".join(draw.choice("etaoin") for _ in range(draw.randint(1, 180))) for _ in range(600)] + ["".join(draw.choice("ab 中é1.\n") for _ in range(draw.randint(0, 300))) for _ in range(300)] + ["ab" * 3_000, "x" * 126, "x" * 127, " " * 900, "<|endoftext|>"]
    want = [(len(i := reference.encode_ordinary(x)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()) for x in more]
    assert list(zip(*t.digests(more, False)[:3], strict=True)) == want
    t.forget()
    monkeypatch.setattr(bpe, "GROUP", 100)
    monkeypatch.setattr(bpe, "PORTION", 7)
    monkeypatch.setattr(bpe, "MEMO", 10)
    *got, ids = t.digests(more, True)
    assert list(zip(*got, strict=True)) == want
    assert [sum(map(len, x)) for x in ids] == [n for n, _, _ in want]
