"""License scans: a trained paragraph classifier, in DataFrame functions and Spark ML only.

A line that has one of the cue words is a candidate; every template has one, so a line without any belongs
to no family. In paragraphs of several lines (blank lines end a paragraph) the lines that hold no template
of their own are joined, and windows of WINDOW words that have all words of a template are candidates too;
they have a negative place, and only those with a family are returned, one a paragraph and family. Candidates are split into words;
hashed one- and two-word grams feed a multinomial logistic regression (L1 and L2, so the weights are sparse)
over licence families and an unknown class. It is trained on examples made by rule from the wording of
public licences, and on unknown examples: sentences that use the same words, and a bounded sample of
candidate paragraphs of the corpus that name no licence (MOST_SAMPLED, a parameter). A fifth of the examples
is held back; on it an isotonic map turns the probability of the likeliest family into the share of such
paragraphs that are of it, the rest being the unknown class: below LEAST a paragraph is unknown. A prediction
counts only if a template of its family confirms it: the template's words must be in the paragraph, in their
order, and side by side if they are few (TOGETHER). The cue words drop nothing that could be confirmed but statements whose cue of two words is torn apart.

Defined cases: null and empty texts have no family; repeated rows each get their result; a paragraph of any
length is used whole; other columns are ignored.
"""

from __future__ import annotations

import itertools
import random
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_or_empty

FEATURES = 1 << 14
MOST_SAMPLED = 1_000
#: Least calibrated probability of a family; below it a paragraph is unknown.
LEAST = 0.5
CONFIRM = 0.99
#: The words of a template of up to so many must stand side by side; those of longer ones in order.
TOGETHER = 3
#: Words of a window over joined lines; half overlapping, so a statement of half as many words is whole in one.
WINDOW = 32

# Names under which public licences are cited; each set of words confirms its family.
FAMILIES = {
    "Apache-2.0": ["apache license version 2.0", "apache license 2.0", "apache-2.0", "apache-lizenz version 2.0", "licence apache version 2.0", "licencia apache version 2.0", "licencia apache versión 2.0"],
    "MIT": ["mit license", "mit licence", "spdx-license-identifier mit", "mit-lizenz", "mit lizenz", "licence mit", "licencia mit", "permission is hereby granted free of charge to any person obtaining a copy"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license as published by the free software foundation either version 3", "gnu gpl version 3", "gpl-3.0", "gplv3", "licence publique générale gnu version 3", "licencia pública general de gnu versión 3", "gnu gpl-lizenz version 3"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license as published by the free software foundation either version 2", "gnu gpl version 2", "gpl-2.0", "gplv2", "licence publique générale gnu version 2", "licencia pública general de gnu versión 2"],
    "LGPL": ["gnu lesser general public license", "lgpl-3.0", "lgpl-2.1"],
    "AGPL-3.0": ["gnu affero general public license", "agpl-3.0"],
    "BSD": ["bsd license", "bsd-lizenz", "licence bsd", "licencia bsd", "bsd 3-clause license", "bsd-3-clause", "bsd 2-clause license", "redistribution and use in source and binary forms with or without modification are permitted"],
    "MPL-2.0": ["mozilla public license version 2.0", "mpl-2.0"],
    "CC-BY-4.0": ["cc by 4.0", "creative commons attribution 4.0 international license", "cc-by-4.0"],
    "CC-BY-SA-4.0": ["cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license", "cc-by-sa-4.0"],
    "CC-BY-NC-4.0": ["cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license", "cc-by-nc-4.0"],
    "CC-BY-ND-4.0": ["cc by-nd 4.0", "creative commons attribution-noderivatives 4.0 international license", "cc-by-nd-4.0"],
    "CC0-1.0": ["cc0 1.0 universal", "cc0-1.0", "dedicated to the public domain"],
    "ISC": ["isc license", "spdx-license-identifier isc", "permission to use copy modify and or distribute this software for any purpose"],
    "Unlicense": ["the unlicense", "this is free and unencumbered software released into the public domain"],
    "proprietary": ["all rights reserved", "proprietary and confidential", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados"],
}
WORDS = r"(?i)\b(?:licen[sc]e[sd]?|licensing|unlicense|copyright|rights\s+reserved|creative\s+commons|public\s+domain|permission|redistribution|proprietary|gplv?[23]?|lgpl|agpl|mpl|cc0|cc[ -]by|licencias?|lizenz|vorbehalten|réservés|reservados)\b"
#: The cue words, and the templates that have none of them.
CUES = "|".join([WORDS, *(r"\b" + re.escape(t).replace(r"\ ", r"\s+") + r"\b" for f in FAMILIES.values() for t in f if not re.search(WORDS, t))])
HEADS = ("Licensed under the", "Licensed under", "Released under the", "This work is licensed under the", "This work is licensed under", "This file is distributed under the terms of the", "Distributed under the", "Available under", "This program is free software under the", "The source code is released under the", "Published under", "Copyright 2019 the authors. Licensed under the", "SPDX-License-Identifier:", "Lizenziert unter der", "Veröffentlicht unter der", "Publié sous", "Distribué selon les termes de la", "Publicado bajo la", "Licenciado bajo la", "")
TAILS = ("", ".", " (see the file LICENSE).", "; you may not use this file except in compliance with it.", ". See the licence for details.", ", or any later version.")
UNKNOWN = ("Please renew your driving licence before {} ends", "The permission of {} is needed for a visit", "No licence is required for {} here", "They asked permission to leave {} early", "The licence fee for {} went up", "The council licensed {} last week", "Copyright law in {} is old", "The redistribution of {} was debated", "A proprietary name for {} was found", "The public domain of {} is large", "Her fishing license covers {}", "Licensing {} takes a month", "The publisher holds a license to print {}", "Subject to the license agreement with {}", "Rights reserved by {} may change", "Die Lizenz für {} ist abgelaufen", "Eine Lizenz von {} braucht man hier nicht", "La licence de {} coûte cher", "Les droits de {} sont réservés aux membres", "La licencia de {} termina pronto", "Los asientos de {} están reservados")

CLASSES = ("unknown", *FAMILIES)


def words(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+"), lambda w: F.regexp_replace(w, r"[.+-]", "") != "")


def grams(text):
    """Words without outer stops, and pairs of neighbours."""
    w = F.transform(words(text), lambda x: F.regexp_replace(x, r"^[.+-]+|[.+-]+$", ""))
    return F.transform(F.array(w), lambda w: F.concat(w, F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))))[0]


def examples(seed: int = 13) -> list[tuple[str, str]]:
    """(class, paragraph): public wording in many settings, and sentences that only use its words."""
    draw = random.Random(seed)
    fill = lambda k: " ".join("".join(draw.choice("abdegilmnoprstu") for _ in range(draw.randint(2, 8))) for _ in range(k))
    out = []
    for family, names in FAMILIES.items():
        # every head with two tails, every tail with a head
        settings = [(h, t) for h in HEADS for t in draw.sample(TAILS, 2)] + [(draw.choice(HEADS), t) for t in TAILS]
        for name, (head, tail) in itertools.product(names, settings):
            around = draw.random()
            text = f"{head} {name}{tail}".strip()
            out.append((family, f"{fill(3)} {text}" if around < 0.15 else f"{text} {fill(4)}" if around < 0.3 else text))
    for sentence in UNKNOWN:
        out += [("unknown", f"{fill(draw.randint(0, 5))} {sentence.format(fill(draw.randint(1, 3)))} {fill(draw.randint(0, 12))}".strip()) for _ in range(60)]
    return out


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash, place and wording of candidate paragraphs; of repeated rows one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(F.col("text").rlike(CUES))
    lines = rows.select("doc_id", F.xxhash64("text").alias("same"), F.posexplode(F.split("text", r"\r?\n")).alias("place", "paragraph"))
    return lines.where(F.col("paragraph").rlike(CUES)).unionAll(_wrapped(rows))


def _wrapped(rows: DataFrame) -> DataFrame:
    """Windows over the joined lines of paragraphs that have all words of a template; place is negative."""
    blocks = rows.select("doc_id", F.xxhash64("text").alias("same"), F.posexplode(F.split("text", r"\r?\n(?:[ \t]*\r?\n)+")).alias("block", "lines"))
    blocks = blocks.where(F.col("lines").rlike(r"\n") & F.col("lines").rlike(CUES))
    every = [t for templates in FAMILIES.values() for t in templates]

    def named(line):
        norm = F.concat(F.lit(" "), F.array_join(_bare(line), " "), F.lit(" "))
        return F.transform(F.array(norm), lambda n: F.exists(F.array(*[F.lit(f" {t} ") for t in every]), lambda t: F.contains(n, t)))[0]

    kept = F.filter(F.split("lines", r"\r?\n"), lambda line: ~named(line))
    split = blocks.select("doc_id", "same", "block", F.split(F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+", " ")), " ").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - WINDOW // 2), F.lit(WINDOW // 2))
    windows = split.select("doc_id", "same", (-1 - F.col("block")).alias("place"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, WINDOW), " "))).alias("paragraph"))
    # all words of a template are there; their order is looked at by ``confirmed``
    wording = F.array(*[F.array(*[F.lit(w) for w in dict.fromkeys(t.split())]) for t in every])
    whole = F.transform(F.array(_bare(F.col("paragraph"))), lambda has: F.exists(wording, lambda t: F.size(F.array_except(t, has)) == 0))[0]
    return windows.where(F.col("paragraph").rlike(CUES)).where(whole)


def _bare(text):
    """Words without outer stops."""
    return F.transform(words(text), lambda x: F.regexp_replace(x, r"^[.+-]+|[.+-]+$", ""))


def train(spark: SparkSession, sampled: DataFrame):
    """The classifier, and the isotonic map from the best family's probability to the share of right ones on held-back rows."""
    made = spark.createDataFrame(examples(), "family string, paragraph string").unionAll(sampled.select(F.lit("unknown").alias("family"), "paragraph"))
    index = F.create_map(*[x for i, c in enumerate(CLASSES) for x in (F.lit(c), F.lit(float(i)))])
    terms = HashingTF(inputCol="__terms", outputCol="__features", numFeatures=FEATURES, binary=True)
    rows = terms.transform(made.select(index[F.col("family")].alias("__label"), "paragraph", grams(F.col("paragraph")).alias("__terms")))
    rows = cut(rows.withColumn("__fold", F.pmod(F.xxhash64("paragraph"), F.lit(5)))).coalesce(4)
    model = LogisticRegression(featuresCol="__features", labelCol="__label", predictionCol="__predicted", probabilityCol="__probability", rawPredictionCol="__margin", family="multinomial", regParam=2e-3, elasticNetParam=0.3, maxIter=60)
    model = model.fit(rows.where("__fold <> 0"))
    back = best_family(model.transform(rows.where("__fold = 0"))).select((F.col("__best.at") == F.col("__label")).cast("double").alias("__label"), F.col("__best.p").alias("__p"))
    calibrated = IsotonicRegression(featuresCol="__p", labelCol="__label", predictionCol="__calibrated").fit(back)
    return terms, model, calibrated


def best_family(scored: DataFrame) -> DataFrame:
    """With __best: probability and place of the likeliest class that is not unknown; of equal ones the last."""
    families = F.slice(vector_to_array("__probability"), 2, len(FAMILIES))
    return scored.withColumn("__best", F.array_max(F.transform(families, lambda p, i: F.struct(p.alias("p"), (i + 1).alias("at")))))


def confirmed(text, family):
    """Share of the best template's words that the paragraph has in the template's order, over the family's templates."""
    wording = F.create_map(*[x for name, templates in FAMILIES.items() for x in (F.lit(name), F.array(*[F.array(*[F.lit(w) for w in t.split()]) for t in templates]))])

    def share(has, t):
        # the next word of the template is waited for, so a template that is wholly there is found whole; a short one starts anew
        step = lambda k, w: F.when(k >= F.size(t), k).when(w == F.get(t, k), k + 1).when(F.size(t) <= TOGETHER, (w == F.get(t, F.lit(0))).cast("int")).otherwise(k)
        return F.aggregate(has, F.lit(0), step) / F.size(t)

    best = F.transform(F.array(_bare(text)), lambda has: F.array_max(F.transform(F.element_at(wording, family), lambda t: share(has, t))))[0]
    return F.coalesce(best, F.lit(0.0))


def license_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, same, place, paragraph, family (unknown if none), probability, match of every candidate paragraph."""
    found = cut(paragraphs(docs).dropDuplicates(["doc_id", "same", "place", "paragraph"]))
    named = F.lit(False)
    for templates in FAMILIES.values():
        for t in templates:
            named = named | F.lower("paragraph").contains(t)
    # lines of a text with a wrapped statement may be parts of it, so they are no unknown examples
    wrapped = found.where("place < 0").select("same").distinct()
    sampled = found.where("place >= 0").where(~named).join(wrapped, "same", "left_anti").select("paragraph").distinct().orderBy(F.xxhash64("paragraph"), "paragraph").limit(MOST_SAMPLED)
    terms, model, calibrated = train(docs.sparkSession, sampled)
    scored = best_family(model.transform(terms.transform(found.withColumn("__terms", grams(F.col("paragraph"))))))
    names = F.array(*[F.lit(c) for c in CLASSES])
    scored = scored.select("doc_id", "same", "place", "paragraph", F.get(names, F.col("__best.at")).alias("predicted"), F.col("__best.p").alias("__p"))
    scored = calibrated.transform(scored).withColumn("probability", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "__calibrated")))
    scored = scored.withColumn("match", F.when(F.col("probability") >= LEAST, confirmed(F.col("paragraph"), F.col("predicted"))).otherwise(0.0))
    scored = scored.withColumn("family", F.when((F.col("probability") >= LEAST) & (F.col("match") >= CONFIRM), F.col("predicted")).otherwise(F.lit("unknown")))
    scored = scored.select("doc_id", "same", "place", "paragraph", "probability", "match", "family")
    joined = scored.where("place < 0 and family <> 'unknown'").dropDuplicates(["doc_id", "same", "place", "family"])
    return scored.where("place >= 0").unionByName(joined)


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: n_candidates, n_licensed, families (sorted, comma-joined), the likeliest family and its probability."""
    found = license_paragraphs(docs)
    best = F.max(F.when(F.col("family") != "unknown", F.struct("probability", "family")))
    by = found.groupBy("doc_id", "same").agg(
        F.count("*").alias("n_candidates"),
        F.count_if(F.col("family") != "unknown").alias("n_licensed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") != "unknown", F.col("family")))), ",").alias("families"),
        best.alias("best"),
    )
    by = by.select(F.col("doc_id").alias("__id"), F.col("same").alias("__same"), "n_candidates", "n_licensed", "families", "best")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("same"))
    joined = rows.join(by, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("same") == F.col("__same")), "left")
    return joined.select("doc_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce(F.col("best.family"), F.lit("none")).alias("family"), F.coalesce(F.col("best.probability"), F.lit(0.0)).alias("probability"))
