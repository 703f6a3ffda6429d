"""Line dedup, conversation repair and hard negatives: against their SQL, against plain Python on odd rows, and in small blocks."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stacksift.llm import conversations, hard_negatives, line_dedup, queries

from ..oracle import from_duckdb, from_spark

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert from_spark(queries.queries()[name](spark, SF)) == from_duckdb(queries.oracle_sql()[name], SF)


# --- 11 --------------------------------------------------------------------------------------------------------------
def kept_lines(rows):
    """(doc_id, n_lines, n_dropped, text) of every row, by hand."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    last = {k: max((d for d in h if d is not None), default=None) for k, h in holders.items() if len(h) >= 3}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in last or last[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return Counter(out)


LONG = "this line is long enough ok"
SHARED = [
    (1, None), (2, ""), (3, f"{LONG}\nother"), (4, f"  {LONG.upper()}\t\r\n{LONG}"), (5, f"a\n\n{LONG}\n"), (6, "ÉCOLE ÉCOLE ÉCOLE ÉCOLE"), (7, "école École ÉCOLE école"), (8, "ÉCOLE ÉCOLE ÉCOLE ÉCOLE "), (9, "ÉCOLE école ÉCOLE ÉCOLE"),
    (None, LONG), (None, LONG), (10, "x" * 19), (11, "x" * 19), (12, "x" * 19), (13, "y" * 20), (13, "y" * 20), (14, "y" * 20), (15, "z" * 20 + "\n" + "z" * 20), (16, "z" * 20), (17, " " + "z" * 20 + " "), (18, "日本語" * 7), (19, "日本語" * 7 + "　"), (20, "日本語" * 7),
    (21, "日本語" * 7), (22, "\n".join(f"row {i}" for i in range(30_000)) + f"\n{LONG}"), (23, "\n".join([LONG] * 3)),
]


def test_shared_lines_by_hand(spark):
    df = spark.createDataFrame(SHARED, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("doc", "row", "dg", "h", "places", "kept", "n_lines", "line")})
    got = Counter((r["doc"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"] or "") for r in line_dedup.drop_shared_lines(df).collect())
    assert got == kept_lines(SHARED)
    whole = line_dedup.deduplicate_lines(df)
    assert whole.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in whole.where("doc_id in (1, 2)").collect()} == {1: None, 2: ""}
    assert line_dedup.drop_shared_lines(df.where("false")).count() == 0
    assert line_dedup.drop_shared_lines(df, min_chars=1, min_documents=2).where("n_dropped > 0").count() > 5


# --- 12 --------------------------------------------------------------------------------------------------------------
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [] if k == 0 else [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def repaired(turns):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired rows) of the rows of one conversation, one row after the other."""
    seen, faults = set(), []
    for _, _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))

    def add(into, roles, element):
        """By what stands last; of equals the least cost and audit."""
        roles = roles if roles in ("", "s") else "u" if roles[-1] == "u" else "ua"
        if roles not in into or element[:2] < into[roles][:2]:
            into[roles] = element

    fits = lambda roles: re.match(r"s?(ua)*u?\Z", roles)

    def grown(states):
        for _ in range(3):
            new = dict(states)
            for roles, (cost, audit, rows) in states.items():
                for role in ("user", "assistant"):
                    if fits(roles + role[0]):
                        add(new, roles + role[0], (cost + 3, audit + "I", [*rows, f"{role}:"]))
            states = new
        return states

    states = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(turns, faults, strict=True):
        new = {}
        for roles, (cost, audit, rows) in grown(states).items():
            add(new, roles, (cost + 4, audit + "D", rows))
            if fault in ("", "t"):
                for edit, to, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if to and fits(roles + to[0]):
                        add(new, roles + to[0], (cost + price + (3 if fault else 0), audit + edit, [*rows, f"{to}:{text}"]))
        states = new
    cost, audit, rows = min((e for roles, e in grown(states).items() if roles == "" or roles.endswith("a")), key=lambda e: e[:2])
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(turns)]
    return faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, rows


def by_hand(rows):
    groups = {c: [] for c, *_ in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = {}
    for c, turns in groups.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        known = [t for _, t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        *counts, text = repaired(turns)
        assert LEGAL.match("".join(x[0] for x in text))
        out[c] = (gaps, *counts, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def drawn_conversations(seed, n=60):
    draw = random.Random(seed)
    texts = ["Hello there.", "What now?", "no end", "", "  \t", "Fine!", "Fine!  ", "x.　", None, "ja。", "a\nb."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "usher"]
    rows = []
    for c in range(n):
        for t in range(draw.randint(1, 9)):
            turn = draw.choice([t, t, t, t * 3, None, 2])
            rows += [(c if c else None, turn, draw.choice(roles), draw.choice(texts))] * draw.choice([1, 1, 1, 2])
    return rows


def test_repairs_by_hand(spark, monkeypatch):
    rows = drawn_conversations(3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "pos", "n", "blk", "seq", "cost", "audit")})
    want = by_hand(rows)
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    read = lambda: {r["conv_id"]: tuple(r[f] for f in fields) for r in conversations.repair(df)[0].collect()}
    assert read() == want
    monkeypatch.setattr(conversations, "BLOCK_BITS", 1)  # blocks of two rows, rounds of two neighbours
    monkeypatch.setattr(conversations, "FAN", 2)
    assert read() == want
    assert conversations.repair(df.where("false"))[0].count() == 0


def test_a_long_conversation(spark, monkeypatch):
    """One conversation over many tasks and blocks, with very long texts and a thousand equal rows."""
    rows = [(7, i, ("user", "assistant")[i % 2 if i % 11 else (i + 1) % 2], f"Turn {i} ends." if i % 7 else f"turn {i} does not end") for i in range(1500)]
    rows += [(7, 40, "user", "The same again.")] * 1000 + [(7, 2000, "user", "long " * 50_000 + ".")]
    monkeypatch.setattr(conversations, "BLOCK_BITS", 6)
    monkeypatch.setattr(conversations, "FAN", 4)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, turns = conversations.repair(df)
    (got,) = report.collect()
    want = by_hand(rows)[7]
    assert tuple(got)[1:] == want
    assert turns.count() == len([c for c in want[6] if c != "D"])
    kept, _ = conversations.repair(df.where("turn < 10"), damaged=False)
    assert kept.first()["gaps"] == 0


# --- 13 --------------------------------------------------------------------------------------------------------------
def mined(rows):
    """Counter of the result's rows, by hand."""
    part = []
    for i, vec, label in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        if i is not None and i % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        part.append((i, [max(-(2**22), min(2**22, math.floor(256 * x))) for x in vec], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = Counter()
    for k, (i, vec, label) in enumerate(part):
        if i is None or i % 100:
            continue
        others = [(dot(vec, v), j, lb) for m, (j, v, lb) in enumerate(part) if m != k]
        for p, pid, _ in sorted((x for x in others if x[2] == label), key=order)[:5]:
            some = sorted((x for x in others if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p), key=order)[:10]
            out += Counter((i, pid, r, j, p, s) for r, (s, j, _) in enumerate(some, 1))
    return out


@pytest.mark.parametrize(("seed", "cells"), [(1, 2**19), (2, 40), (3, 2**19)])
def test_negatives_by_hand(spark, seed, cells):
    draw = random.Random(seed)
    rows = []
    for i in range(700):
        centre = i % 13
        vec = [draw.gauss(1 if k == centre % 8 else 0, 0.3) for k in range(8)]
        rows.append((i * 4, vec, draw.choice([0, 1, 2, 3])))
    rows += [(100, None, 1), (200, [1.0] * 8, None), (300, [math.nan] * 8, 1), (400, [math.inf] + [0.0] * 7, 1), (None, [0.5] * 8, 2), (None, [0.5] * 8, 2), (500, [None] * 8, 0), (600, [], 3), (800, [1.0, 2.0], 2), (900, [3e38] * 8, 1), (903, [1e5] * 8, 2)]
    rows += [(1600, [0.25] * 8, 5)] * 3 + [(k, [0.25] * 8, 6) for k in range(7001, 7021)] + [(2300, [0.0] * 8, -4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("row", "q", "key", "score", "rank", "own")})
    fields = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = Counter(tuple(r[f] for f in fields) for r in hard_negatives.mine(df, block_cells=cells).collect())
    assert got == mined(rows)


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(df).count() == 0
    one = spark.createDataFrame([(100, [1.0], 1), (101, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(one).count() == 0


def test_pairs_go_early_and_none_is_lost():
    """Of vectors with a steep spectrum most pairs go before the last components, and the bound keeps every pair of the band."""
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(5)
    q = np.floor(draw.standard_normal((400, 32)) * 256 * 0.7 ** np.arange(32)).astype("i4")
    axes = np.linalg.eigh((q.T @ q).astype("f8"))[1][:, ::-1]
    table = pa.table({"row": np.arange(50), "vec_id": np.arange(50), "label": np.zeros(50, "i8"), "q": pa.array(q[:50].tolist(), pa.list_(pa.int32()))})
    a = hard_negatives.Anchors(table, axes)
    score = q[:50].astype("i8") @ q.T.astype("i8")
    low = np.quantile(score, 0.99, axis=1)[:, None]
    i, j, s = hard_negatives.survivors(a, (q, *a.rotate(q)), np.arange(50), np.arange(400), low, np.full((50, 1), np.inf), None)
    assert set(zip(*np.nonzero(score >= low), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(i) < 0.2 * score.size
    assert (s == score[i, j]).all()
