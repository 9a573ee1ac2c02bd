from __future__ import annotations

import random

import pytest
from public_tokenizers import path

from tidegauge.llm import token_counts as tc

FILE = path("piece_bpe_32k.model")


def brute(word, scores, byte_score):
    """Best split by a plain table over one word."""
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = []
        for begin in range(end):
            piece = scores.get(word[begin:end])
            if piece is not None:
                options.append((best[begin][0] + piece, -(best[begin][1] + 1)))
        if word[end - 1] not in scores:
            size = len(word[end - 1].encode())
            options.append((best[end - 1][0] + size * byte_score, -(best[end - 1][1] + size)))
        top = max(options)
        best[end] = (top[0], -top[1])
    return best[-1][1]


@pytest.fixture(scope="module")
def scores():
    return tc.piece_scores(FILE)


def test_equals_a_table_for_each_word(scores):
    rng = random.Random(1)
    words = {"".join(rng.choice("▁abthene漢ñ🙂1") for _ in range(rng.randrange(1, 25))) for _ in range(800)}
    words |= {"▁the", "▁", "▁international", "▁internationally", "x" * 500}
    low = min(scores.values()) - tc.BYTE_PENALTY
    assert dict(tc.trie_counts(words, tc.piece_trie(scores), low)) == {w: brute(w, scores, low) for w in words}


def test_documents_add_up(spark, docs_of, scores):
    rows = [(1, "the cat\tthe\n cat"), (2, None), (3, ""), (4, "naïve 漢字 " * 4000), (4, "the"), (None, " x ")]
    low = min(scores.values()) - tc.BYTE_PENALTY
    got = docs_of(rows).select("doc_id", tc.token_counts(spark, FILE).alias("c")).collect()
    want = []
    for _, text in rows:
        cut = (text or "").split()
        want.append((len(cut), sum(brute("▁" + w, scores, low) for w in cut)))
    assert [(r["c"]["n_pretokens"], r["c"]["n_tokens"]) for r in got] == want
    assert docs_of([]).select(tc.token_counts(spark, FILE)).count() == 0
