from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import queries, repeats


def covered(texts, length):
    """Flags of the bytes that strings found elsewhere cover."""
    places = defaultdict(list)
    for n, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            places[t[a : a + length]].append((n, a))
    flags = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for n, a in found:
                flags[n][a : a + length] = b"\1" * length
    return flags


def brute(rows, length):
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, f in zip(rows, texts, covered(texts, length)):
        kept = bytes(c for c, gone in zip(t, f) if not gone)
        runs = sum(1 for n, gone in enumerate(f) if gone and not (n and f[n - 1]))
        out.append((i, len(t), sum(f), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def prose(rng, n, letters="abcdé \0"):
    return "".join(rng.choice(letters) for _ in range(n))


def mixed_rows(rng):
    """Copies, shared passages, near copies, repeated lines, runs of one letter, nulls, empty and repeated rows."""
    shared = [prose(rng, rng.randint(10, 60)) for _ in range(4)]
    rows = []
    for i in range(70):
        text = prose(rng, rng.randint(0, 80))
        if i % 3 == 0:
            text += rng.choice(shared) + prose(rng, rng.randint(0, 30))
        if i % 5 == 0 and rows:
            old = rng.choice(rows)[1] or ""
            cut = rng.randint(0, len(old))
            text = old[:cut] + rng.choice("xyz") + old[cut + 1 :]
        rows.append((i, text))
    rows += [(100, "line of text\n" * 9), (101, "q" * 90), (102, "q" * 40), (103, None), (104, ""), (None, rows[3][1]), (5, rows[5][1])]
    return rows + [rows[7]]


@pytest.mark.parametrize("length, limit", [(12, 1000), (25, 1000), (25, 2), (13, 5), (2, 3)])
def test_against_all_strings(docs_of, length, limit):
    rows = mixed_rows(random.Random(length))
    assert found(repeats.repeated_spans(docs_of(rows), length=length, limit=limit)) == brute(rows, length)


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(queries.QUERIES["op11_repeats"](spark, sf)) == brute(rows, 200)


def test_very_long_texts_and_hot_passages(docs_of):
    rng = random.Random(9)
    passage = prose(rng, 230)
    rows = [(i, prose(rng, 40) + passage + prose(rng, 40)) for i in range(60)]
    rows += [(100, "a" * 300_000), (101, "word " * 30_000), (102, prose(rng, 100_000)), (103, passage[:199])]
    wanted = {r[0]: r[1:] for r in brute([r for r in rows if r[0] not in (100, 101, 102)], 200)}
    for limit in (4096, 8):
        got = {r[0]: r[1:] for r in found(repeats.repeated_spans(docs_of(rows), limit=limit))}
        assert {i: got[i] for i in wanted} == wanted
        assert got[100][1:3] == (300_000, 1) and got[101][1:3] == (150_000, 1) and got[102][1:3] == (0, 0)


def test_groups_are_the_maximal_repeats_with_all_occurrences(docs_of):
    rng = random.Random(4)
    rows = [(i, t) for i, t in mixed_rows(rng) if i is not None and i < 60]
    rows = list(dict(rows).items())
    length = 20  # repeats reach no further than the pieces here
    texts = {i: (t or "").encode() for i, t in rows}
    got = defaultdict(set)
    for r in repeats.repeat_groups(docs_of(rows), length=length).collect():
        text = texts[r["doc_id"]][r["start"] : r["start"] + r["n_bytes"]]
        assert len(text) == r["n_bytes"] >= length
        got[r["repeat"], text].add((r["doc_id"], r["start"]))
    assert got and len({name for name, _ in got}) == len(got)
    for (_, text), places in got.items():
        everywhere = {(i, a) for i, t in texts.items() for a in range(len(t) - len(text) + 1) if t[a : a + len(text)] == text}
        assert places == everywhere and len(places) > 1
    # together they cover what strings of that length cover
    flags = {i: bytearray(len(t)) for i, t in texts.items()}
    for (_, text), places in got.items():
        for i, a in places:
            flags[i][a : a + len(text)] = b"\1" * len(text)
    assert list(flags.values()) == covered(list(texts.values()), length)


def test_remains_keep_rows_and_other_columns(docs_of):
    rows = mixed_rows(random.Random(1))
    docs = docs_of(rows)
    out = repeats.remove_repeats(docs, length=15)
    assert out.columns == [*docs.columns, "kept"] and out.count() == len(rows)
    wanted = sorted(r[4] for r in brute(rows, 15))
    assert sorted(r[0] for r in out.select(F.sha2("kept", 256)).collect()) == wanted
    replaced = repeats.remove_repeats(docs, column="TEXT", length=15)
    assert sorted(replaced.columns) == sorted([c for c in docs.columns if c != "text"] + ["TEXT"])


def test_empty_table(docs_of):
    assert repeats.repeated_spans(docs_of([])).collect() == []
    assert repeats.repeat_groups(docs_of([])).collect() == []
    assert found(repeats.repeated_spans(docs_of([(1, None), (2, "")]))) == brute([(1, None), (2, "")], 200)


def test_equal_strings_have_the_same_anchors():
    rng = random.Random(2)
    passage = bytes(rng.randrange(256) for _ in range(200))
    seen = set()
    for _ in range(50):
        front = bytes(rng.randrange(256) for _ in range(rng.randrange(300)))
        data = front + passage + bytes(rng.randrange(256) for _ in range(rng.randrange(300)))
        at, keys = repeats.anchors(data, 200, 64)
        inside = [(a - len(front), k) for a, k in zip(at.tolist(), keys.tolist()) if len(front) <= a <= len(front) + 136]
        least = repeats.anchors(passage, 200, 64)
        seen.add((int(least[0][0]), int(least[1][0])))
        assert (int(least[0][0]), int(least[1][0])) in inside
    assert len(seen) == 1
