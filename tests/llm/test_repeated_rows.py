"""Rows repeated with an id, and copies without one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.llm import exact_dedup

ROWS = [(None, "x"), (1, "x"), (None, "y"), (None, "y"), (2, "z"), (2, "z"), (3, "z"), (3, "z"), (4, ""), (4, None), (5, "s")]


def test_one_row_of_each_text_stays(docs_of):
    docs = docs_of(ROWS)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    want = [(0, "y"), (1, "x"), (3, "z"), (4, ""), (5, "s")]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == want
    twice = docs.unionByName(docs).repartition(5)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in exact_dedup.drop_copies(twice).collect()) == want


def test_texts_of_one_digest_are_told_apart(docs_of):
    weak = lambda content: F.octet_length(content).cast("string").cast("binary")
    kept = exact_dedup.drop_copies(docs_of([(1, "aa"), (1, "aa"), (2, "bb"), (3, "c"), (3, "c")]), digest=weak)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "aa"), (2, "bb"), (3, "c")]
