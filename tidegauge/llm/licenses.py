"""Licence notices in texts, paragraph by paragraph, in built-in operations only.

A logistic regression on the words and word pairs of a paragraph names a licence family or `unknown`. It is trained on
the notices below, cut and shortened in many ways, against paragraphs of the given documents and sentences that merely
use the same words. The licences together need a probability above what held-out unknown paragraphs reach; then the
likeliest is named, and the paragraph is compared with its notices: it must share enough word pairs with one of them, and
one that at most MOST_OWNERS families have (those of every SPDX line name none).

Every paragraph is scored. Pairs of two FUNCTION words are left out of the comparison, so one with fewer than LEAST_SHARED
other pairs of the notices cannot come out as a licence, whatever the model says. The ones that the model takes for a
licence and no notice of that family confirms are unknown notices.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import pick, run_folder, stored

BUCKETS = 1 << 13  # hashed features
NEGATIVES = 4_000  # most paragraphs of documents the fit sees, half of them out of the comparable ones
SHARED = 0.6  # of the pairs of the paragraph or the notice, whichever has fewer
LEAST_SHARED = 2
MOST_OWNERS = 2  # families with a pair that still tells them from the rest
LEAST_PROBABILITY = 0.5
QUANTILE = 0.999  # of held-out unknown paragraphs stay below the threshold
STEPS = 100_000  # of the probability, which the quantile's counters are kept for
UNKNOWN = "unknown"

# The short notices by which works name their licence.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 License."),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License.",
    ),
    "CC0": ("Released under CC0 1.0.", "This work is dedicated to the public domain under the CC0 1.0 License."),
}
# Other uses of the same words.
OTHER_USES = (
    "All rights reserved.", "The driver showed a license at the gate.", "The license plate was missing.",
    "A fishing licence costs ten in this county.", "Permission to land was granted to the crew.",
    "They released the record under a new name.", "Version 3 of the plan was free of charge.",
    "The licence was revoked in May.", "Use of the source is permitted with or without a ticket.",
    "The public was under the impression of free software.", "Copyright 2020 by the authors.",
    "The terms of the general contract are published here.", "You may obtain a copy of the report at the desk.",
    "The library is open to the public.", "This work is done.", "This program is about birds.",
)
# Words that any text is full of.
FUNCTION = frozenset(
    "a and any are as at by can in is it may not of or that the this to under use with without work you".split()
)


def _all_pairs(notice: str) -> set[str]:
    """What `pairs` gives for a notice, which is ASCII."""
    words = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", notice.lower())
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def _notice_pairs(notice: str) -> set[str]:
    """What `telling` gives for a notice."""
    return {p for p in _all_pairs(notice) if not FUNCTION.issuperset(p.split())}


VOCABULARY = sorted({p for notices in NOTICES.values() for n in notices for p in _all_pairs(n)})
TELLING = sorted({p for notices in NOTICES.values() for n in notices for p in _notice_pairs(n)})
_FAMILY_PAIRS = {family: {p for n in notices for p in _notice_pairs(n)} for family, notices in NOTICES.items()}
OWN_PAIRS = {
    family: {p for p in own if sum(p in other for other in _FAMILY_PAIRS.values()) <= MOST_OWNERS}
    for family, own in _FAMILY_PAIRS.items()
}
TELLING_WORDS = sorted({w for p in TELLING for w in p.split() if w not in FUNCTION})
# one of these stands in every pair of TELLING; numbers are cut at their dots
MARKS = sorted({part for p in TELLING for w in p.split() if w not in FUNCTION for part in w.split(".")})


def word_list(paragraph: Column) -> Column:
    """Words of letters, digits, dots inside numbers; A-Z lowered."""
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"([\p{L}\p{N}]+(?:\.[0-9]+)*)"), F.lit(1))


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _neighbours(words: Column) -> Column:
    """Neighbouring words, joined by a blank, repeats and all."""
    return _bound(words, lambda w: _bound(F.greatest(F.size(w) - 1, F.lit(0)), lambda n: F.zip_with(
        F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)
    )))


def pairs(words: Column) -> Column:
    """Distinct neighbouring words, joined by a blank."""
    return F.array_distinct(_neighbours(words))


def telling(own: Column) -> Column:
    """Pairs without those of two function words."""
    return F.filter(own, lambda p: ~p.isin([f"{a} {b}" for a in sorted(FUNCTION) for b in sorted(FUNCTION)]))


def _marked(paragraph: Column) -> Column:
    """Whether a word of MARKS stands in a paragraph: no other one is `_comparable`. Cut without regard to other alphabets."""
    return F.exists(F.split(F.lower(paragraph), "[^a-z0-9]+"), lambda w: w.isin(MARKS))


def _comparable(own: Column) -> Column:
    """Whether pairs could be enough of any notice: an exact bound on `_confirmed`."""
    return F.size(F.filter(own, lambda p: p.isin(TELLING))) >= LEAST_SHARED


def _features(words: Column) -> Column:
    return F.concat(words, _neighbours(words))  # the table is binary: repeats add nothing


def _hashed(frame: DataFrame) -> DataFrame:
    table = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="terms__", outputCol="features__")
    return table.transform(frame.withColumn("terms__", _features(F.col("words__"))))


def _with_odds(frame: DataFrame, regression: LogisticRegressionModel) -> DataFrame:
    """`frame` with likely__, the probability of each class by its words__. Nothing else of the model is computed."""
    odds = regression.copy().setRawPredictionCol("").setPredictionCol("")
    return odds.transform(_hashed(frame)).withColumn("likely__", vector_to_array("probability__")).drop(
        "terms__", "features__", "probability__"
    )


def _literal_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("notice")) for a, b in rows])
    return spark.range(1, numPartitions=1).select(F.explode(listed).alias("r")).select("r.family", "r.notice")


def _variants(notices: DataFrame) -> DataFrame:
    """Each notice whole, without each single word, and its stretches of 60 to 90 % of the words, with words around."""
    words = word_list(F.col("notice"))
    size = F.size("w")
    less_one = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(
        F.slice("w", 1, i - 1), F.slice("w", i + 1, F.greatest(size - i, F.lit(0)))
    ))
    stretches = F.flatten(F.array(*[
        F.transform(
            F.sequence(F.lit(0), size - F.ceil(size * share).cast("int")),
            lambda i, s=share: F.slice("w", i + 1, F.ceil(size * s).cast("int")),
        )
        for share in (0.6, 0.75, 0.9)
    ]))
    around = F.array(*[
        F.concat(F.split(F.lit(a), " "), F.col("w"), F.split(F.lit(b), " "))
        for a, b in (("c 2021 the authors", "see the file"), ("note this file is", "and so on"), ("project", "thanks"))
    ])
    made = F.concat(F.array("w"), less_one, stretches, around)
    return notices.select("family", words.alias("w")).select("family", F.explode(F.array_distinct(made)).alias("words__"))


@dataclass
class LicenceModel:
    families: list[str]  # by class number; the first is UNKNOWN
    regression: LogisticRegressionModel
    threshold: float


def _paragraphs(text: str) -> Column:
    return F.split(F.coalesce(pick(text).cast("string"), F.lit("")), r"\n")


def train(docs: DataFrame, text: str = "text", negatives: int = NEGATIVES) -> LicenceModel:
    """Fit on the notices and on at most `negatives` paragraphs of `docs`, in the order of a hash.

    A paragraph of `docs` is unknown if no notice shares enough pairs with it. Half of `negatives` are taken from all
    paragraphs, half from the comparable ones. A third of all unknown paragraphs, by hash, is held out from the fit, and
    so is a third of the sentences of other uses. The threshold is the QUANTILE of the licence probabilities of everything
    held out (cut to STEPS), and at least LEAST_PROBABILITY. Without paragraphs the sentences of other uses are the unknown
    class alone.
    """
    spark = docs.sparkSession
    families = [UNKNOWN, *NOTICES]
    notices = _literal_rows(spark, [(f, n) for f, texts in NOTICES.items() for n in texts])
    others = _literal_rows(spark, [(UNKNOWN, n) for n in OTHER_USES])
    held = F.pmod(F.hash("words__"), F.lit(3)) == 0
    first = lambda rows: rows.orderBy(F.xxhash64("p"), "p").limit(negatives // 2)

    def unknown(rows: DataFrame) -> DataFrame:
        cut = rows.withColumn("words__", word_list(F.col("p")))
        return cut.filter(~_confirmed(None, telling(pairs(F.col("words__"))))).select(
            F.lit(UNKNOWN).alias("family"), "p", "words__"
        )

    lines = docs.select(F.explode(F.filter(_paragraphs(text), lambda p: F.length(p) > 0)).alias("p"))
    marked = docs.select(F.explode(F.filter(_paragraphs(text), _marked)).alias("p"))
    comparable = marked.filter(_comparable(pairs(word_list(F.col("p")))))
    kept = stored(unknown(comparable), f"{run_folder(spark)}/comparable")
    fitted = unknown(first(lines)).unionByName(first(kept)).filter(~held).drop("p")
    rows = _variants(notices).unionByName(_variants(others).filter(~held)).unionByName(fitted)
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    ready = _hashed(rows.withColumn("label", label.cast("double"))).select("features__", "label").coalesce(1).persist()
    try:
        regression = LogisticRegression(
            featuresCol="features__", labelCol="label", probabilityCol="probability__", maxIter=40, regParam=1e-3,
            family="multinomial",
        ).fit(ready)
    finally:
        ready.unpersist()
    # paragraphs that are not comparable are unknown without a look at the notices, the others are in `kept`; words are cut
    # inside explode, as a filter on a plain column would cut them once more
    cut = F.transform(F.filter(_paragraphs(text), lambda p: F.length(p) > 0), word_list)
    plain = docs.select(F.explode(cut).alias("words__")).select(F.lit(UNKNOWN).alias("family"), "words__").filter(held)
    told = F.exists("words__", lambda w: w.isin(TELLING_WORDS))
    other = ~F.when(told, _comparable(pairs(F.col("words__")))).otherwise(F.lit(False))
    apart = _variants(others).unionByName(kept.drop("p")).filter(held).unionByName(plain.filter(other))
    licence = F.floor((1 - F.col("likely__")[0]) * STEPS) / STEPS
    seen = _with_odds(apart.select("words__"), regression).select(licence.alias("licence"))
    reached = seen.agg(F.percentile("licence", F.lit(QUANTILE)).alias("q")).first()["q"]
    return LicenceModel(families, regression, max(LEAST_PROBABILITY, reached or 0.0))


def _confirmed(family: Column | None, own: Column) -> Column:
    """Whether a notice of the family (of any, if None) shares enough pairs with the paragraph, and the family one of its own."""
    agreed = F.lit(False)
    for name, notices in NOTICES.items():
        for notice in notices:
            wanted = sorted(_notice_pairs(notice))
            both = F.size(F.array_intersect(own, F.array(*[F.lit(p) for p in wanted])))
            enough = (both >= LEAST_SHARED) & (both >= SHARED * F.least(F.size(own), F.lit(len(wanted))))
            enough = enough & F.arrays_overlap(own, F.array(*[F.lit(p) for p in sorted(OWN_PAIRS[name])]))
            agreed = agreed | (enough if family is None else (family == name) & enough)
    return agreed


def scan_licences(docs: DataFrame, model: LicenceModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, licences (sorted, comma-joined), n_licence and n_unknown paragraphs, for every row of `docs`.

    A paragraph is a line, and every one is scored. n_unknown counts those the model takes for a licence, but no notice of the
    family it names confirms; their words must speak for a licence, so that the licences together have more than without any
    words, by the intercepts alone. Null and empty texts have neither. Rows repeated or without an id stay rows of their own;
    other columns are not read.
    """
    # numbered in a step of its own: beside explode, its outcome would be numbered
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), pick(doc_id).alias("doc_id"),
        F.filter(_paragraphs(text), lambda p: F.length(p) > 0).alias("paragraphs"),
    ).select("row", "doc_id", F.posexplode_outer("paragraphs").alias("place", "paragraph"))
    scored = _with_odds(rows.withColumn("words__", word_list(F.coalesce("paragraph", F.lit("")))), model.regression)
    likely = F.col("likely__")
    wordless = 1 - float(model.regression.predictProbability(Vectors.sparse(BUCKETS, [], []))[0])
    licence = F.slice(likely, 2, len(model.families) - 1)
    best = F.array_max(licence)
    names = F.array(*[F.lit(f) for f in model.families[1:]])
    family = F.when(
        (1 - likely[0] >= model.threshold) & (best > 0),
        F.get(names, (F.array_position(licence, best) - 1).cast("int")),
    )
    # on go the paragraphs the model names, and the first of each row; a filter on plain columns would score them once more
    told = 1 - likely[0] > wordless
    named_words = F.when(family.isNotNull(), F.col("words__"))
    kept = F.filter(
        F.array(F.struct(family.alias("family"), "place", told.alias("told"), named_words.alias("words__"))),
        lambda r: r["family"].isNotNull() | (F.coalesce(r["place"], F.lit(0)) == 0),
    )
    own = F.when(F.col("r.family").isNotNull(), telling(pairs(F.col("r.words__"))))
    named = scored.select("row", "doc_id", F.explode(kept).alias("r")).select(
        "row", "doc_id", "r.family", "r.told", own.alias("own")
    )
    sure = F.when(F.col("family").isNotNull() & _confirmed(F.col("family"), F.col("own")), F.col("family"))
    # folded before the shuffle; a row's paragraphs stand in one task anyway
    return named.select("row", "doc_id", "family", "told", sure.alias("sure")).groupBy("row", "doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("sure")), ",").alias("licences"),
        F.count("sure").alias("n_licence"),
        F.count_if(F.col("family").isNotNull() & F.col("sure").isNull() & F.col("told")).alias("n_unknown"),
    ).drop("row")
