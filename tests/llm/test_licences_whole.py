"""Every paragraph meets the model, also one that no notice could confirm."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.ml.feature import HashingTF

from tidegauge.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    rows = [(n, f"Ofthe thn{n} est the in {n}.\nNd ing the version {n % 7} of under a hen.") for n in range(600)]
    return licenses.train(spark.createDataFrame(rows, "doc_id long, text string"))


def words(text):
    return re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower())


def telling_pairs(text):
    own = words(text)
    return {f"{a} {b}" for a, b in zip(own, own[1:]) if {a, b} - licenses.FUNCTION}


def confirmed(family, text):
    """By plain Python: whether a notice of the family shares enough pairs."""
    own = telling_pairs(text)
    return bool(own & licenses.OWN_PAIRS[family]) and any(
        len(own & telling_pairs(n)) >= max(2, 0.6 * min(len(own), len(telling_pairs(n)))) for n in licenses.NOTICES[family]
    )


def test_a_notice_with_one_telling_pair_is_unknown(docs_of, model):
    rows = [(1, "abc\nYou may not use this file.\nabc"), (2, "Released under the MIT License.\nyou may not use this file")]
    got = licenses.scan_licences(docs_of(rows), model).collect()
    assert sorted((r["doc_id"], r["licences"], r["n_licence"], r["n_unknown"]) for r in got) == [(1, "", 0, 1), (2, "MIT", 1, 1)]


def test_a_confirmed_notice_needs_the_threshold_alone(docs_of, model):
    """As before: a notice in a long line, with less than a line without words has, is still one."""
    low = licenses.LicenceModel(model.families, model.regression, 0.0)
    line = "Released under the MIT License. " + "Ofthe est the in nd ing the version of under a hen. " * 2
    rows = [(1, line), (2, "---\n?"), (3, "no cue at all\nthe license the license")]
    got = licenses.scan_licences(docs_of(rows), low).collect()
    assert sorted((r["doc_id"], r["licences"], r["n_licence"], r["n_unknown"]) for r in got) == [
        (1, "MIT", 1, 0), (2, "", 0, 0), (3, "", 0, 0),
    ]


def test_lines_without_words_are_no_notices(docs_of, model):
    rows = [(1, "---\n\n ?!\n\t"), (2, "\n"), (3, None), (4, "...\nReleased under the MIT License.\n***")]
    got = licenses.scan_licences(docs_of(rows), model).collect()
    assert sorted((r["doc_id"], r["n_licence"], r["n_unknown"]) for r in got) == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0)]


def test_counts_are_those_of_every_paragraph_scored_alone(spark, docs_of, model):
    rng = random.Random(8)
    known = sorted({w for p in licenses.VOCABULARY for w in p.split()}) + ["ofthe", "hen", "zu", "élan", "漢字"]
    notices = [n.split() for texts in licenses.NOTICES.values() for n in texts]

    def line():
        if rng.random() < 0.2:
            return rng.choice(["", " ", "--"])
        notice = rng.choice(notices)
        at = rng.randrange(len(notice))
        return " ".join(rng.choices(known, k=rng.randrange(4)) + notice[at : at + rng.randrange(5)])

    rows = [(n % 300, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for n in range(400)]
    lines = sorted({p for _, text in rows for p in text.split("\n")})
    terms = [(p, words(p) + [f"{a} {b}" for a, b in zip(words(p), words(p)[1:])]) for p in lines + ["?"]]
    table = HashingTF(numFeatures=licenses.BUCKETS, binary=True, inputCol="terms", outputCol="features__")
    frame = spark.createDataFrame(terms, "p string, terms array<string>")
    odds = {r["p"]: list(r["probability__"]) for r in model.regression.transform(table.transform(frame)).collect()}
    want, alone = [], 0
    for n, text in rows:
        named, unknown = [], 0
        for p in text.split("\n"):
            best = max(odds[p][1:])
            if 1 - odds[p][0] >= model.threshold:
                family = model.families[odds[p].index(best, 1)]
                if confirmed(family, p):
                    named.append(family)
                elif odds[p][0] < odds["?"][0]:
                    unknown += 1
                    alone += len(telling_pairs(p) & set(licenses.TELLING)) < 2
        want.append((n, ",".join(sorted(set(named))), len(named), unknown))
    got = licenses.scan_licences(docs_of(rows), model).collect()
    assert sorted((r["doc_id"], r["licences"], r["n_licence"], r["n_unknown"]) for r in got) == sorted(want)
    assert alone > 20 and sum(w[2] for w in want) > 20


def test_the_scan_computes_each_probability_once(docs_of, model):
    plan = licenses.scan_licences(docs_of([(1, "x")]), model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
