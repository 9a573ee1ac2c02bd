from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidegauge.llm import exact_dedup

ROWS = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b" * 300_000), (6, "b" * 300_000), (7, "A"), (8, "a ")]


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_largest_id_of_equal_texts_stays(docs_of):
    found = by_id(exact_dedup.mark_copies(docs_of(ROWS)))
    assert {i: r["keep_id"] for i, r in found.items()} == {1: 2, 2: 2, 3: 4, 4: 4, 5: 6, 6: 6, 7: 7, 8: 8}
    assert [i for i, r in sorted(found.items()) if r["kept"]] == [2, 4, 6, 7, 8]
    assert found[4]["text_sha256"] == hashlib.sha256(b"").hexdigest() and found[5]["group_size"] == 2


def test_drop_keeps_rows_and_columns(docs_of):
    docs = docs_of(ROWS)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 6, 7, 8]


def test_equal_digests_do_not_make_equal_texts(docs_of):
    weak = lambda content: F.octet_length(content).cast("string").cast("binary")
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c"), (5, "d"), (6, "eee")]
    found = by_id(exact_dedup.mark_copies(docs_of(rows), digest=weak))
    assert {i: r["keep_id"] for i, r in found.items()} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
    kept = exact_dedup.drop_copies(docs_of(rows), digest=weak)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 6]


def test_missing_and_repeated_ids(docs_of):
    docs = docs_of([(None, "x"), (1, "x"), (None, "y"), (None, "y"), (2, "z"), (2, "z")])
    found = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["kept"]) for r in exact_dedup.mark_copies(docs).collect())
    assert found == [(0, 0, True), (0, 0, True), (0, 1, False), (1, 1, True), (2, 2, True), (2, 2, True)]


def test_empty_table(docs_of):
    assert exact_dedup.mark_copies(docs_of([])).count() == 0
    assert exact_dedup.drop_copies(docs_of([])).count() == 0


def test_no_python_in_the_plan(docs_of):
    plan = exact_dedup.mark_copies(docs_of(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan
