"""Paragraphs without a cue word: scored like others, and part of the unknown class."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import licenses

UNCUED = "Creative Commons Attribution-ShareAlike 4.0"
WRAPPED = 'of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
NEAR = "Take the license to the desk and you may obtain a copy of the paper"


@pytest.fixture(scope="module")
def docs(spark):
    text = "Ofthe thn{0} est the in {0}.\nNd ing the version of {0} hens."
    rows = [(n, text.format(n)) for n in range(600)] + [(1000 + n, f"{NEAR} {n}") for n in range(200)]
    rows += [(2000, UNCUED), (2001, "x y z\n" + WRAPPED), (2002, "deal in the morning"), (2003, UNCUED + "\n" + UNCUED)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_parts_of_notices_without_a_cue_are_found(docs):
    wanted = docs.filter("doc_id >= 2000")
    rows = licenses.scan_licences(wanted, licenses.train(docs)).collect()
    assert sorted((r["doc_id"], r["licences"], r["n_licence"], r["n_unknown"]) for r in rows) == [
        (2000, "CC-BY-SA", 1, 0), (2001, "MIT", 1, 0), (2002, "", 0, 0), (2003, "CC-BY-SA", 2, 0),
    ]


def test_vocabulary_is_what_spark_pairs(spark):
    rows = licenses._literal_rows(spark, [(f, n) for f, texts in licenses.NOTICES.items() for n in texts])
    found = rows.select(F.explode(licenses.pairs(licenses.word_list(F.col("notice")))).alias("p")).distinct().collect()
    assert sorted(r["p"] for r in found) == licenses.VOCABULARY


def test_cue_lines_count_for_the_threshold(docs, monkeypatch):
    seen = []
    fit = licenses._hashed
    monkeypatch.setattr(licenses, "_hashed", lambda frame: seen.append(frame) or fit(frame))
    licenses.train(docs)
    words = [" ".join(r["words__"]) for r in seen[-1].collect()]
    assert any(w.startswith("take the license to the desk") for w in words) and any(w.startswith("ofthe") for w in words)
    assert not any(w.startswith("creative commons attribution sharealike") for w in words)
