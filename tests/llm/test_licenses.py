from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(
        [(n, f"Ofthe thn{n} est the in {n}.\nNd ing the version {n % 7} of under a hen.") for n in range(600)],
        "doc_id long, text string",
    )
    return licenses.train(docs)


def found(docs, model):
    rows = licenses.scan_licences(docs, model).collect()
    return sorted((r["doc_id"] or 0, r["licences"], r["n_licence"], r["n_unknown"]) for r in rows)


def test_families_and_other_uses(docs_of, model):
    rows = [
        (1, "Xy zz.\nLicensed under the Apache License, Version 2.0.\nabc"),
        (2, "(c) 2019 me. Released under the MIT License. thanks"),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "licensed under CC BY-NC 4.0"),
        (5, "The license of the driver was old.\nA licence plate."),
        (6, "Released under the MIT License.\nLicensed under CC BY 4.0.\nReleased under the MIT License."),
        (7, None), (8, ""), (None, "no cue at all"), (9, "the license " * 30_000),
        (10, "Released under the MIT License."), (10, "Released under the MIT License."),
        (11, "Public License, Software Foundation, GNU Affero, GNU General, Apache License"),
        (12, "SPDX-License-Identifier: Quux-9.1"),
    ]
    assert found(docs_of(rows), model) == sorted([
        (1, "Apache-2.0", 1, 0), (2, "MIT", 1, 0), (3, "GPL-3.0", 1, 0), (4, "CC-BY-NC", 1, 0), (5, "", 0, 0),
        (6, "CC-BY,MIT", 3, 0), (7, "", 0, 0), (8, "", 0, 0), (0, "", 0, 0), (9, "", 0, 0),
        (10, "MIT", 1, 0), (10, "MIT", 1, 0), (11, "", 0, 1), (12, "", 0, 1),
    ])


def test_every_notice_is_recognised(docs_of, model):
    rows, want = [], []
    for family, notices in licenses.NOTICES.items():
        for notice in notices:
            want.append((len(rows) + 1, family, 1, 0))
            rows.append((len(rows) + 1, f"see {notice}"))
    assert found(docs_of(rows), model) == want


def telling_pairs(text):
    """By plain Python: words, neighbours, and which neighbours tell something."""
    words = re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower())
    return {f"{a} {b}" for a, b in zip(words, words[1:]) if {a, b} - licenses.FUNCTION}


def test_no_paragraph_that_could_be_named_goes_unscored(docs_of):
    rng = random.Random(5)
    words = sorted({w for p in licenses.VOCABULARY for w in p.split()}) + ["zu", "élan", "漢字", "x9"]
    pairs = licenses.VOCABULARY + ["of the", "in the"]
    rows = []
    for n in range(1500):
        parts = [rng.choice(pairs if rng.random() < 0.4 else words) for _ in range(rng.randrange(7))]
        if n % 5 == 0:  # a stretch of a notice
            notice = rng.choice([t for texts in licenses.NOTICES.values() for t in texts]).split()
            at = rng.randrange(len(notice))
            parts = parts[:2] + notice[at : at + rng.randrange(2, 9)]
        rows.append((n, "".join(p.upper() if rng.random() < 0.2 else p + rng.choice([" ", " ", ", ", ".", "-", ""]) for p in parts)))
    own = licenses.pairs(licenses.word_list(F.col("text")))
    got = docs_of(rows).select(
        "doc_id", licenses._marked(F.col("text")).alias("marked"), licenses._comparable(own).alias("scored"),
        licenses.telling(own).alias("own"), licenses._confirmed(None, licenses.telling(own)).alias("named"),
    ).collect()
    pairs_of = {f: set().union(*map(telling_pairs, notices)) for f, notices in licenses.NOTICES.items()}
    own_of = {f: {p for p in own if sum(p in o for o in pairs_of.values()) <= 2} for f, own in pairs_of.items()}
    texts, scored, named = dict(rows), 0, 0
    for r in got:
        want = telling_pairs(texts[r["doc_id"]])
        assert set(r["own"]) == want and len(r["own"]) == len(want)
        assert r["scored"] == (len(want & set(licenses.VOCABULARY)) >= 2)
        enough = any(
            len(want & telling_pairs(notice)) >= max(2, 0.6 * min(len(want), len(telling_pairs(notice))))
            and want & own_of[family]
            for family, notices in licenses.NOTICES.items() for notice in notices
        )
        assert r["named"] == enough
        assert r["marked"] or not r["scored"]
        assert r["scored"] or not r["named"]
        scored, named = scored + r["scored"], named + r["named"]
    assert scored > 100 and named > 20


def test_empty_table_and_plan(docs_of, model):
    assert licenses.scan_licences(docs_of([]), model).count() == 0
    plan = licenses.scan_licences(docs_of([(1, "x")]), model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan


def test_training_on_nothing(docs_of):
    assert licenses.train(docs_of([])).threshold >= licenses.LEAST_PROBABILITY
