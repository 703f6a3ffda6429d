"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Only labelled rows outside the held-out fold are learned from, at most MOST_LABELLED of them (those of
least hash; the bound is a parameter). They are dealt by a hash of doc_id into three parts:
four tenths give the lexicon (words and word heads with large log-odds of a toxic label, beside a
fixed seed list), four tenths the trees, two tenths the isotonic map from the trees' probability to a
calibrated one. The score is 0.98 of the calibrated and 0.02 of the raw probability, so that rows on one
step of the isotonic map keep their order.

Features of a text: size; lexicon and word-head hits, densities, largest and summed log-odds, number of
distinct hits; second-person density and its nearness to a hit; shares of capitals, punctuation,
exclamation marks; rate of symbols or digits inside words, and hits that appear once those are removed.

Defined cases: a null or empty text is scored by its (zero) features; without both classes among the
learning rows every score is the share of toxic labels there (0 with none); labels of null doc_id or
null value are ignored and repeated labels of one doc_id count once, toxic if any is; of several texts under one
doc_id the least one is learned from. Rows are never
joined to be scored, so repeated rows, null ids and any other columns stay as they are.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, packed, small_batches, text_or_empty

MOST_LABELLED = 20_000
MOST_WORDS = 4_000
HEAD = 5
LEAST_DOCS, LEAST_ODDS = 4, 1.5

# Common insults, and second-person words of the languages covered.
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "fool", "garbage", "filth", "imbecile")
SECOND_PERSON = frozenset(("you", "your", "yours", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "tus", "usted", "vosotros"))
SEED_ODDS = 2.5

WORD = re.compile(r"[^\W\d_]+")
INNER = re.compile(r"[^\W\d_][0-9*$#@!%&_.-]+(?=[^\W\d_])")
SOLVE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
MASKED = re.compile(r"(?<!\S)(?=\S*[0-9*$#@!_.-])(?=\S*[^\W\d_])[^\s]{3,}(?!\S)")
N_FEATURES = 17


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point: 1 if upper case, plus 2 if a letter or digit."""
    return np.fromiter((c.isupper() + 2 * c.isalnum() for c in map(chr, range(0x110000))), np.uint8, 0x110000)


def features(text: str, words: dict[str, float], heads: dict[str, float]) -> list[float]:
    if not text:
        return [0.0] * N_FEATURES
    found = WORD.findall(text.lower())
    n, chars = max(1, len(found)), len(text)
    hits = [w for w in found if w in words]
    begun = [h for h in [w[:HEAD] for w in found if len(w) > HEAD - 1] if h in heads]
    second = sum(map(SECOND_PERSON.__contains__, found))
    near = 0.0
    if hits and second:
        last = -1_000
        last_hit = -1_000
        gap = 1_000
        for i, w in enumerate(found):
            if w in SECOND_PERSON:
                gap, last = min(gap, i - last_hit), i
            elif w in words:
                gap, last_hit = min(gap, i - last), i
        near = math.exp(-gap / 5)
    inner = len(INNER.findall(text))
    solved = 0
    if inner:
        for m in MASKED.findall(text):
            w = m.lower()
            if w.translate(SOLVE) in words or re.sub(r"[^\w]|[\d_]", "", w) in words:
                solved += 1
    odds = [words[w] for w in hits]
    head_odds = [heads[h] for h in begun]
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=4).tolist()
    capitals, solid = kinds[1] + kinds[3], kinds[2] + kinds[3]
    blanks = text.count(" ") + text.count("\n")
    return [
        math.log1p(n), math.log1p(len(hits)), len(hits) / n, max(odds, default=0.0), min(50.0, sum(odds)), float(len(set(hits))),
        math.log1p(len(begun)), len(begun) / n, max(head_odds, default=0.0), min(50.0, sum(head_odds)),
        second / n, near, capitals / chars, (chars - solid - blanks) / chars, text.count("!") / chars, inner / n, math.log1p(solved),
    ]


def feature_column(words: dict[str, float], heads: dict[str, float], text="text"):
    @F.pandas_udf("array<double>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t or "", words, heads) for t in texts], dtype=object)

    return made(F.col(text).cast("string"))


def lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of words and word heads, from rows of (text, toxic); counts are made by Spark, the result is bounded."""
    seen = rows.select("toxic", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    both = seen.select("toxic", F.explode(F.array_union("w", F.transform(F.filter("w", lambda x: F.length(x) >= HEAD), lambda x: F.concat(F.lit("^"), F.substring(x, 1, HEAD))))).alias("w")).where("w <> ''")
    total = rows.agg(F.expr("count_if(toxic = 1)").alias("pos"), F.expr("count_if(toxic = 0)").alias("neg")).first()
    counts = both.groupBy("w").agg(F.expr("count_if(toxic = 1)").alias("pos"), F.expr("count_if(toxic = 0)").alias("neg")).where(f"pos >= {LEAST_DOCS}")
    odds = F.log((F.col("pos") + 0.5) / (total["pos"] + 1.0)) - F.log((F.col("neg") + 0.5) / (total["neg"] + 1.0))
    top = counts.select("w", odds.alias("odds")).where(f"odds >= {LEAST_ODDS}").orderBy(F.desc("odds"), "w").limit(MOST_WORDS).collect()
    words = {w: SEED_ODDS for w in SEED_WORDS} | {r["w"]: float(r["odds"]) for r in top if r["w"][0] != "^"}
    return words, {r["w"][1:]: float(r["odds"]) for r in top if r["w"][0] == "^"}


class Model:
    def __init__(self, words, heads, trees=None, calibrated=None, share=0.0):
        self.words, self.heads, self.trees, self.calibrated, self.share = words, heads, trees, calibrated, share

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with a score column."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(float(self.share)))
        made = docs.select(packed(docs).alias("__tox_row"), array_to_vector(feature_column(self.words, self.heads)).alias("__tox_features"))
        made = self.trees.transform(made).withColumn("__tox_raw", vector_to_array("__tox_probability")[1])
        made = self.calibrated.transform(made)
        value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.98 * F.col("__tox_calibrated") + 0.02 * F.col("__tox_raw")))
        return made.select("__tox_row.*", value.alias(name))


def fit(docs: DataFrame, labels: DataFrame, *, most: int = MOST_LABELLED, seed: int = 11) -> Model:
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("__id is not null and toxic in (0, 1)")
    known = known.where(~held_out("__id")).groupBy("__id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), text_or_empty().alias("text")).join(F.broadcast(known), "__id")  # at most `most` ids and labels
    # of several texts under one doc_id the least one
    rows = cut(rows.groupBy("__id", "toxic").agg(F.min("text").alias("text")).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "__id"), F.lit(10))))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    by_part = rows.agg(*[F.expr(f"count_if(toxic = {t} and part between {a} and {b})") for t in (0, 1) for a, b in ((4, 7), (8, 9))]).first()
    if min(by_part) == 0:
        return Model({}, {}, share=sizes.get(1, 0) / max(1, sum(sizes.values())))
    words, heads = lexicon(rows.where("part < 4"))
    made = cut(rows.where("part >= 4").select("part", F.col("toxic").cast("double").alias("__tox_label"), array_to_vector(feature_column(words, heads)).alias("__tox_features")))
    made = made.coalesce(4)
    trees = GBTClassifier(featuresCol="__tox_features", labelCol="__tox_label", predictionCol="__tox_predicted", maxIter=20, maxDepth=4, maxBins=64, stepSize=0.25, minInstancesPerNode=5, seed=seed)
    trees = trees.setProbabilityCol("__tox_probability").setRawPredictionCol("__tox_margin").fit(made.where("part <= 7"))
    raw = trees.transform(made.where("part >= 8")).withColumn("__tox_raw", vector_to_array("__tox_probability")[1])
    calibrated = IsotonicRegression(featuresCol="__tox_raw", labelCol="__tox_label", predictionCol="__tox_calibrated").fit(raw)
    return Model(words, heads, trees, calibrated)


def toxicity_scores(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    scored = fit(docs, labels, **kw).score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """``docs`` without the rows that are scored 0.5 or more."""
    rows = docs.select(packed(docs).alias("row"), F.col("text").alias("text"))
    return fit(docs, labels, **kw).score(rows).where("score < 0.5").select("row.*")
