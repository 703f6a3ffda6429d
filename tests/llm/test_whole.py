"""Rows and spans that the operators once lost."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stacksift.llm import bpe, decontaminate, fingerprints, hilbert, html_crf, licenses, near_dup, pii, secrets, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_keep_one_by_text_and_id(spark):
    a, b, c, d, e = ("%s word " % x * 3 + " ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    near = a.replace("a29", "other")
    rows = [(None, b), (None, c), (5, d), (5, e), (5, e), (3, a), (5, near), (None, near), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("same", F.lit(1))
    got = Counter((r["doc_id"], r["text"] or "") for r in near_dup.keep_one(df).collect())
    assert got == Counter([(None, b), (None, c), (5, d), (5, e), (3, a), (None, "")])
    twins = spark.createDataFrame([(None, a), (None, near), (7, b), (7, b.replace("b29", "other"))], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in near_dup.keep_one(twins).collect()) == ["7", "None"]


def test_every_benchmark_piece_is_fitted(spark, monkeypatch):
    """Words that only pieces behind the first SAMPLE ones have get a vector, and their verbatim copies are found."""
    monkeypatch.setattr(decontaminate, "SAMPLE", 8)
    text = lambda i: " ".join(f"q{i}x{k}" for k in range(30))
    bench = spark.createDataFrame([(i, text(i)) for i in range(24)], "item_id long, text string")
    rows = [(i, " ".join(f"w{i % 7}y{k}" for k in range(90))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, f"{rows[0][1]} {text(23)} {rows[1][1]}")], "doc_id long, text string")
    index = next(decontaminate.build(docs, bench))
    ((_, hashes, _),) = decontaminate.folded_words(pa.array([text(23)]))
    assert (np.linalg.norm(index.words[decontaminate._bucket(hashes)], axis=1) > 0).all()
    assert (100, 23) in {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}


def test_short_and_unspaced_items(spark, docs):
    """Verbatim items of any length are found, alone or between foreign words; so are short items with a word changed."""
    draw = random.Random(3)
    vocabulary = sorted({w for r in docs.limit(200).collect() for w in r["text"].lower().split() if w.isalpha()})
    some = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = {i: some(6 + i % 4) for i in range(60)} | {60: "zeta quux", 61: "xyzzy", 62: "鋼鐵是怎樣煉成的故事集", 63: "世界の終わりとハードボイルド", 64: "", 65: "?!"}
    rows = [(1_000_000 + i, f"{some(31)} {t} {some(31)}") for i, t in items.items() if i < 62]
    rows += [(1_000_062, "他讀了鋼鐵是怎樣煉成的故事集。"), (1_000_063, "本は世界の終わりとハードボイルドです")]
    rows += [(2_000_000 + i, f"{some(31)} {t.rsplit(' ', 1)[0]} other {some(31)}") for i, t in items.items() if 60 > i and i % 4 == 3]
    rows += [(3_000_000, "zeta other quux"), (3_000_001, "zeta"), (3_000_002, "quux zeta"), (3_000_003, "鋼鐵的故事")]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    more = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs.select("doc_id", "text").unionAll(more), bench).collect()}
    assert {(1_000_000 + i, i) for i in range(64)} <= got
    # the answer check asks for both of a short item's rarest words; where the changed word is none of them the item is found
    index = next(decontaminate.build(docs.select("doc_id", "text").unionAll(more), bench))
    kept = [i for k, i in enumerate(index.items.tolist()) if i < 60 and i % 4 == 3 and int(index.piece(k)[-1]) not in index.ready(k)[1]]
    assert len(kept) >= 5
    assert all((2_000_000 + i, i) in got for i in kept)
    assert not any(d >= 3_000_000 or i in (64, 65) for d, i in got)


@pytest.mark.parametrize("share", [0.0, 0.15, 0.25])
def test_recall_of_changed_passages(spark, docs, share, monkeypatch):
    """Against brute force, which puts the exact check to every place of every text: passages with words replaced or dropped."""
    draw = random.Random(int(share * 100))
    vocabulary = sorted({w for r in docs.limit(200).collect() for w in r["text"].lower().split() if w.isalpha()})
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = {i: some((6, 8, 10, 12, 16, 24, 32, 48, 70)[i % 9]) for i in range(180)}
    rows = []
    for i, words in items.items():
        changed = [x for w in words for x in ([w] if draw.random() >= share else [draw.choice(vocabulary)] if draw.random() < 0.7 else [])]
        rows.append((1_000_000 + i, " ".join([*some(draw.randint(0, 40)), *changed, *some(draw.randint(0, 40))])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    every = docs.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    index = next(decontaminate.build(every, bench))
    want = set()
    for _, hashes, at in decontaminate.folded_words(pa.array([t for _, t in rows])):
        for r in range(len(at) - 1):
            found = [{}]
            for p in range(len(index.items)):
                n = int(index.at[p + 1] - index.at[p])
                for start in range(0, int(at[r + 1] - at[r]), max(1, n // 4)):
                    index._check(hashes[at[r] : at[r + 1]], np.array([0, at[r + 1] - at[r]]), start, 0, n, p, 1.0, found)
            want |= {(rows[r][0], i) for i in found[0]}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(every, bench).where("doc_id >= 1000000").collect()}
    assert len(want) >= (180 if share == 0 else 120 if share < 0.2 else 60)
    assert len(want & got) >= (1.0 if share == 0 else 0.95 if share < 0.2 else 0.9) * len(want)
    monkeypatch.setattr(decontaminate, "BLOCK", 50)  # a benchmark of several passes
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(every, bench).where("doc_id >= 1000000").collect()} == got


def test_credentials_inside_runs_and_without_digits():
    model = secrets.train(secrets.labelled_examples())
    fresh = secrets.labelled_examples(12, seed=5)
    around = ["GH={}", "key/{}", "{}/x", "GH_PAT={}", "https://u.example/{}/log", "x+{}+y", "abc{}", "a.b={}=", "{}"]
    draw = random.Random(8)
    letters = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    fresh += [("pay", "sk_live_" + letters(24)) for _ in range(12)] + [("lab", "glpat-" + letters(20)) for _ in range(12)]
    for form in around:
        found = [secrets.grammar_spans(f"see {form.format(s)} here", model) for _, s in fresh]
        at = 4 + form.index("{")
        assert sum((at, 3, at + len(s)) in f for (_, s), f in zip(fresh, found, strict=True)) >= 0.95 * len(fresh), form
    for n in (35, 37, 40):  # lengths that no labelled string has
        made = ["ghp_" + letters(n) for _ in range(40)]
        assert sum((4, 3, 8 + n) in secrets.grammar_spans(f"see {s}, here", model) for s in made) >= 38
    own = secrets.train([("own", f"key-{letters(7)}") for _ in range(100)])
    assert all(secrets.grammar_spans(f"k='key-{letters(7)}'.", own) for _ in range(40))
    two = f"A={fresh[0][1]}/B={fresh[13][1]}"
    assert [two[a:b] for a, _, b in secrets.grammar_spans(two, model)] == [fresh[0][1], fresh[13][1]]
    assert not any(secrets.grammar_spans(t, model) for t in ("pypi-foo pypi-package-index-mirror-server", "sk_live_mode_on", "AIza eyJh xoxb-1", "ghp_readme_file ghp_x"))
    assert not secrets.grammar_spans("sk_live_ or glpat- in https://example.org/some/long/path/without.any.key", model)


def test_score_is_a_likelihood():
    """Steps and stop of every state sum up to one at most, and merged states were compatible: lengths are told apart by the length factor."""
    model = secrets.train(secrets.labelled_examples())
    for a in model.values():
        assert all(sum(np.exp(p) for _, p in steps.values()) + np.exp(stop) <= 1 + 1e-9 for steps, stop in a.states)
        assert abs(sum(np.exp(a.length(n)) for n in range(1, 4 * max(m for m, _, _ in a.lengths))) - 1) < 0.05
    s = "ghp_" + "aB3" * 12
    assert model["forge"].score(s) > model["forge"].score(s + "aB3") > model["forge"].score(s + "aB3aB3")


def brute_base(text):
    """Spans of the base patterns by plain scanning."""
    token = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low = "".join(c.lower() if c.isascii() else c for c in text)
    out, i = [], 0
    while i < len(text):
        name = next((w for w in ("password", "passwd", "secret", "token", "apikey", "api_key") if low.startswith(w, i)), None)
        end = None
        if name:
            j = i + len(name)
            j += j < len(text) and text[j] in "\"'"
            while j < len(text) and text[j] == " ":
                j += 1
            if j < len(text) and text[j] in ":=":
                j += 1
                while j < len(text) and text[j] == " ":
                    j += 1
                j += j < len(text) and text[j] in "\"'"
                k = j
                while k < len(text) and text[k] in token:
                    k += 1
                if k > j:
                    end = k
                    if k - j >= 6:
                        out.append((i, 0, k))
        i = end or i + 1
    for kind, head, body, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            j = i + len(head)
            while text.startswith(head, i) and j < len(text) and text[j] in body:
                j += 1
            if text.startswith(head, i) and j > i + len(head):
                if j - i >= least:
                    out.append((i, kind, j))
                i = j
            else:
                i += 1
    return sorted(out)


def test_base_spans_by_brute_force(spark, docs):
    draw = random.Random(2)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "API-KEY", ":", "=", " ", '"', "'", "abc123", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "ſecret", "é", ".", "\n", "xyz"]
    made = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(3_000)]
    made += [r["text"] for r in docs.limit(150).collect()]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    hits = 0
    for i, t in enumerate(made):
        want = brute_base(t)
        hits += len(want)
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), t
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert set(said.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert hits > 300


def test_training_rows_are_an_even_sample(monkeypatch):
    monkeypatch.setattr(secrets, "MOST_LABELLED", 40)
    labelled = [("own", f"{h}-{i:012d}-tail") for h in ("aaaa", "zzzz") for i in range(200)]
    heads = secrets.train(labelled)["own"].heads
    assert heads == {"aaaa", "zzzz"}


def test_licenses_without_cue_words_and_wrapped(spark):
    for templates in licenses.FAMILIES.values():
        assert all(re.search(licenses.CUES, t) for t in templates)
    bsd = "Copyright (c) 2019, The Authors. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    rows = {1: "Some prose.\nAvailable under Apache-2.0.\nMore.", 2: "Distributed under the BSD-3-Clause.", 3: "Published under apache-2.0", 4: bsd, 5: bsd.replace("\n\n", "\n"), 6: gpl, 7: "Please renew your driving\nlicence before MIT opens in May\nand version 3 ends"}
    more = {8: "SPDX-License-Identifier: MIT", 9: "Lizenziert unter der Apache-Lizenz, Version 2.0.", 10: "Publié sous licence MIT.", 11: "Publicado bajo la licencia MIT.", 12: "Alle Rechte vorbehalten.", 13: "Todos los derechos reservados", 14: "Apache-2.0", 15: "Licensed under the Apache\nLicense, Version 2.0.", 16: "License is what the MIT asked for", 17: None, 18: "", 19: "La licence de pêche coûte cher"}
    said = {8: "MIT", 9: "Apache-2.0", 10: "MIT", 11: "MIT", 12: "proprietary", 13: "proprietary", 14: "Apache-2.0", 15: "Apache-2.0", 16: "", 17: "", 18: "", 19: ""}
    df = spark.createDataFrame([*rows.items(), *more.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in licenses.scan(df).collect()}
    assert {k: got.pop(k) for k in more} == said
    assert got == {1: "Apache-2.0", 2: "BSD", 3: "Apache-2.0", 4: "BSD,proprietary", 5: "BSD,proprietary", 6: "GPL-3.0", 7: ""}


def test_licenses_against_brute_force(spark):
    """Lines of the documents that have a template's words in order, by plain Python; and fresh examples."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def bare(t):
        return [w for x in re.split(r"[^\w.+-]+", t.lower().replace("_", " ")) if (w := x.strip(".+-"))]

    def inside(template, text):
        if len(template) <= licenses.TOGETHER:
            return any(text[i : i + len(template)] == template for i in range(len(text)))
        it = iter(text)
        return all(w in it for w in template)

    rows = docs.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        for line in re.split(r"\r?\n", r["text"] or ""):
            if re.search(licenses.CUES, line):
                has = bare(line)
                want.update({(r["doc_id"], f) for f, ts in licenses.FAMILIES.items() if any(inside(t.split(), has) for t in ts)})
    got = {(r["doc_id"], f) for r in licenses.scan(docs).where("families <> ''").collect() for f in r["families"].split(",")}
    assert len(want) > 10
    assert got == set(want)
    fresh = licenses.examples(seed=99)
    random.Random(1).shuffle(fresh)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(fresh[:800])], "doc_id long, text string")
    made = {r["doc_id"]: r["families"] or "unknown" for r in licenses.scan(df).collect()}
    assert sum(f in made[i].split(",") for i, (f, _) in enumerate(fresh[:800])) >= 0.97 * 800


STORY = "Once upon a time a miller had three sons, and when he died they shared what he left."
MORE = "The eldest took the mill, the second the donkey, and the youngest got nothing but the cat."

#: Pages written by hand, unlike those of the generator, and their main text.
PAGES = {
    "table": (f'<html><body bgcolor=white><table border=0 width="100%"><tr><td valign=top><a href=a.html>Home</a><br><a href=b.html>News</a><br><a href=c.html>Links</a></td><td><font face=serif><p>{STORY}</p><p>{MORE}</p></font></td></tr><tr><td colspan=2><a href=mail>Contact</a> &copy; 1999</td></tr></table></body></html>', [STORY, MORE]),
    "bare": (f"<p>{STORY}</p>", [STORY]),
    "two bare": (f"<h1>The cat</h1><p>{STORY}<p>{MORE}", ["The cat", STORY, MORE]),
    "text": (STORY, [STORY]),
    "soup": (f'<div id="root"><div class="x1"><a href="/">Start</a> <a href="/n">Neu</a> <a href="/k">Kontakt</a></div><div class="x2"><div class="x3"><div>{STORY}</div><div>{MORE}</div></div></div><div class="x9">&copy; 2021 <a href="/i">Imprint</a></div></div>', [STORY, MORE]),
    "article": (f'<body><header>My site</header><nav><a href="/">Home</a></nav><article><h2>The cat</h2><p>{STORY}</p><div class="advert">Buy shoes</div><p>{MORE}</p></article><div id="comments"><p>Nice one, thanks for it.</p></div><footer>All about cats</footer></body>', ["The cat", STORY, MORE]),
    "long last": (f"<article><p>{'word ' * 5_000}</p><p>{STORY}</p></article>", [("word " * 5_000).strip(), STORY]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_unlike_the_generator(name):
    page, want = PAGES[name]
    assert html_crf.extract(page, html_crf.default_field()).split("\n") == want


def test_each_layout_is_learned():
    field = html_crf.default_field()
    pages = html_crf.labelled_pages(240, seed=92)
    for layout in range(8):
        right = [field.decode(html_crf.features(html_crf.blocks(h, field.index))) == y for h, y in pages[layout::8]]
        assert np.mean(right) >= 0.85, layout


def test_time_is_linear_in_unclosed_elements():
    field = html_crf.default_field()
    page = lambda n: "".join(f'<div class="k{chr(97 + i % 26)}">word {i}</b2>' for i in range(n))

    def seconds(n):
        start = time.process_time()
        html_crf.extract(page(n), field)
        return time.process_time() - start

    seconds(1_000)
    assert seconds(32_000) < 16 * max(0.05, seconds(4_000))


def test_edited_texts_of_hot_ids(spark):
    """A third of the rows under one doc_id and a third without any: split into blocks, every row meets the next one."""
    draw = random.Random(6)
    some = lambda: " ".join("w%d" % draw.randrange(900) for _ in range(draw.randint(0, 30)))
    rows = [(40, some()) for _ in range(120)] + [(None, some()) for _ in range(120)] + [(draw.randrange(-50, 90), some()) for _ in range(120)] + [(40, "same")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [(r["doc_id"], r["text"]) for r in df.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text").collect()]
    want = Counter()
    for i, (d, a) in enumerate(order):
        b = order[(i + 1) % len(order)][1]
        want[d, len(a), hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()] += 1
    for parts in (1, 2, 12, 40):
        got = fingerprints.edited_fingerprints(df, parts=parts)
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got.collect()) == want, parts
    placed, heads = fingerprints._placed(df, 12)
    sizes = [r["count"] for r in placed.groupBy("block").count().collect()]
    assert len(sizes) == len(heads) >= 12
    assert max(sizes) <= 60


def test_levels_follow_the_order_of_values(spark):
    values = ["", "a", "aa", "ab", "b", "news.example", "news.example/x", "z", "é", "日本"]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "source string")
    got = [r["source"] for r in df.orderBy(hilbert._order("source"), "source").collect()]
    assert got == [None, *sorted(values, key=lambda v: v.encode())]


def test_written_shards(spark, tmp_path):
    """Files keep all rows and columns, shards differ by one row at most, and a filter on any dimension can skip most files."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumns({"shard": F.lit("x"), "slot": F.lit(1.5), "at": F.lit(True)})
    docs = docs.unionAll(docs.where("doc_id < 40")).unionAll(docs.where("doc_id < 9").withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    path = str(tmp_path / "shards")
    hilbert.write_shards(docs, path, rows_a_file=20)
    back = spark.read.parquet(path)
    count = lambda df: Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["shard"], r["slot"]) for r in df.collect())
    assert count(back) == count(docs)
    sizes = [r["count"] for r in back.groupBy("shard_id").count().collect()]
    assert len(sizes) == 24
    assert max(sizes) - min(sizes) <= 1
    files = back.groupBy(F.input_file_name().alias("f")).agg(*[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "n_chars", "doc_id") for n, f in (("lo", F.min), ("hi", F.max))]).toPandas()
    middle = back.select("lang", "source", "n_chars", "doc_id").where("lang is not null").orderBy(F.xxhash64("doc_id")).limit(20).collect()
    for c, most in (("lang", 0.75), ("source", 0.75), ("doc_id", 0.6), ("n_chars", 0.6)):
        read = [((files[f"lo_{c}"] <= r[c]) & (files[f"hi_{c}"] >= r[c])).mean() for r in middle]
        assert np.mean(read) < most, (c, np.mean(read))


def test_empty_tables_and_clashing_columns(spark):
    """Every operator gives no rows for an empty table, and reads nothing but its own columns from one with clashing names."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    names = "score string, probability string, family string, bands string, key int, same int, slot int, curve int, spans string, n_card string, fingerprint int, place int, block int, turn int, item_id string, cosine string, features int, label int, word int, n int, passage string, ids int, held_out int, predicted string"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {names}"
    empty = spark.createDataFrame([], schema)
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "seven words that are never found here")], "item_id long, text string")
    clash = spark.createDataFrame([(1, "some words stand here", "en", "s", 21)], "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in names.split(", ")])
    run = [
        lambda d: secrets.scan(d), lambda d: toxicity.toxicity_scores(d, labels), lambda d: licenses.scan(d), lambda d: bpe.encode_documents(d, path, P.PATTERN), lambda d: fingerprints.edited_fingerprints(d),
        lambda d: hilbert.assign(d), lambda d: near_dup.near_duplicate_classes(d), lambda d: pii.pseudonymise(d), lambda d: near_dup.keep_one(d), lambda d: secrets.mask(d),
        lambda d: decontaminate.drop_leaking(d, bench), lambda d: toxicity.drop_toxic(d, labels),
    ]
    for i, f in enumerate(run):
        assert f(empty).count() == 0, i
        assert f(clash).count() == 1, i
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(clash, bench).count() == 0
    pages = spark.createDataFrame([(1, "u", "<p>One paragraph stands here.</p>", 1, "x")], "page_id long, url string, html string, text int, label string")
    assert [r["text"] for r in html_crf.extract_pages(pages).collect()] == ["One paragraph stands here."]
    assert html_crf.extract_pages(pages.where("false")).count() == 0


def test_very_long_texts(spark):
    """A million words, a page of two million characters: worked on whole."""
    item = " ".join(f"bench{i}" for i in range(20))
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{long} {item}"), (2, long), (3, "short")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()] == [(1, 1)]
    story = "A sentence that goes on, and then some more of it. " * 40_000
    pages = spark.createDataFrame([(1, "u", f"<nav><a href=/>Home</a></nav><article><p>{story}</p></article>")], "page_id long, url string, html string")
    assert html_crf.extract_pages(pages).first()["text"] == story.strip()


def test_repeated_items_and_documents(spark):
    item = " ".join(f"bench{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")
    docs = spark.createDataFrame([(5, f"x {item} y"), (5, f"x {item} y"), (None, item)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect())
    assert got == Counter([(5, 1), (5, 2), (None, 1), (None, 2)])


def test_labels_of_unlike_texts_under_one_id(spark):
    """The learned text does not depend on the order of rows: the score of a document is the same in every order."""
    draw = random.Random(5)
    rows = [(i // 2, " ".join(draw.choice(("you idiot scum", "plain words here", "the river runs")) for _ in range(12))) for i in range(400)]
    labels = spark.createDataFrame([(i, 0, int("idiot" in rows[2 * i][1])) for i in range(200)], "doc_id long, quality int, toxic int")
    scores = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        scores.append(Counter((r["doc_id"], round(r["score"], 9)) for r in toxicity.toxicity_scores(df, labels).collect()))
    assert scores[0] == scores[1]


def test_similarity_of_exactly_the_threshold(spark):
    """45 shingles each, 40 of them common: 40 / 50 is 0.8, whatever the order of the sums; one less is below."""
    words = [f"w{i}" for i in range(60)]
    rows, pairs = [], {}
    for k in range(40):
        a = [f"{k}{w}" for w in words[:49]]
        b = a[: 49 - 5] + [f"{k}other{i}" for i in range(5)]
        c = [f"{k}z{w}" for w in words[:49]]
        d = c[: 49 - 6] + [f"{k}other{i}" for i in range(6)]
        rows += [(4 * k, " ".join(a)), (4 * k + 1, " ".join(b)), (4 * k + 2, " ".join(c)), (4 * k + 3, " ".join(d))]
        pairs |= {4 * k: 4 * k, 4 * k + 1: 4 * k, 4 * k + 2: 4 * k + 2, 4 * k + 3: 4 * k + 3}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(df).collect()} == pairs
