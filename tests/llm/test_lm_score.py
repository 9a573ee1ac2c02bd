from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import lm_score as lm


def corpus(n=300, seed=1):
    """Sentences in which each word mostly calls for the next one of a ring."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at, out = rng.randrange(50), []
        for _ in range(rng.randrange(1, 80)):
            at = (at + 1) % 50 if rng.random() < 0.8 else rng.randrange(50)
            out.append(f"W{at}")
        rows.append((i, " ".join(out)))
    return rows + [(1000, None), (1001, ""), (1002, "Zz zz\tZZ"), (None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2")]


def tokens_of(text):
    return (text or "").lower().split() + [None]


def brute(rows, weights):
    learn = [tokens_of(t) for i, t in rows if not (i is not None and i % 10 == 0)]
    one = Counter(w for t in learn for w in t)
    two = Counter(p for t in learn for p in zip(["<s>", *t[:-1]], t))
    context = Counter(one)
    context["<s>"] = one[None]
    many, distinct = sum(one.values()), len(one)
    out = []
    for i, text in rows:
        t = tokens_of(text)
        base = told = 0.0
        for h, w in zip(["<s>", *t[:-1]], t):
            base += math.log10((one[w] + 0.1) / (many + 0.1 * (distinct + 1)))
            c = context[h]
            mix = weights[c.bit_length()]
            told += math.log10(mix[0] / (distinct + 1) + mix[1] * one[w] / many + mix[2] * two[h, w] / max(c, 1))
        out.append((-1 if i is None else i, len(t), sum(one[w] > 0 for w in t), many, base, told))
    return sorted(out)


@pytest.fixture
def seen_weights(monkeypatch):
    kept = {}
    learn = lm.learn_weights

    def remember(*args):
        kept["weights"] = learn(*args)
        return kept["weights"]

    monkeypatch.setattr(lm, "learn_weights", remember)
    return kept


@pytest.mark.parametrize(("parts", "block_bytes"), [(3, 4000), (8, 1 << 20)])
def test_equals_plain_counting(docs_of, folder, spark, seen_weights, parts, block_bytes):
    docs_of(corpus()).write.parquet(folder + "/d")
    docs = spark.read.parquet(folder + "/d")
    held = F.col("doc_id") % 10 == 0
    got = lm.score_texts(docs, held, parts=parts, block_bytes=block_bytes).collect()
    want = brute(corpus(), seen_weights["weights"])
    have = sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        for r in got
    )
    assert [h[:4] for h in have] == [w[:4] for w in want]
    assert np.allclose([h[4:] for h in have], [w[4:] for w in want])
    assert all(r["held_out"] == (r["doc_id"] is not None and r["doc_id"] % 10 == 0) for r in got)


def test_pairs_help_on_held_out_texts(docs_of, folder, spark):
    docs_of(corpus(600)).write.parquet(folder + "/d")
    rows = lm.score_texts(spark.read.parquet(folder + "/d"), F.col("doc_id") % 10 == 0, block_bytes=4000).filter("held_out")
    sums = rows.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert sums["s"] / sums["n"] > sums["b"] / sums["n"] + 0.3


def test_weights_find_the_mixture_that_made_the_events():
    rng = np.random.default_rng(0)
    word, pair = 2.0 ** -8, 2.0 ** -1
    n = 100_000
    from_pair = rng.random(n) < 0.7  # such events have a pair estimate, most others none
    level = lambda p: int(-math.log2(p) * lm.GRID)
    cell = lambda p2: (5 * (lm.CELLS + 1) + level(word)) * (lm.CELLS + 1) + p2
    hits = int(from_pair.sum())
    weights = lm.learn_weights(
        np.array([cell(level(pair)), cell(lm.CELLS)]), np.array([float(hits), float(n - hits)]), 10**6
    )
    assert abs(weights[5, 2] - 0.7) < 0.02 and abs(weights[5].sum() - 1) < 1e-9
    assert weights[0, 2] == 0 and np.allclose(weights[9], 1 / 3)


def test_empty_and_unlearned(docs_of, folder, spark):
    assert lm.score_texts(docs_of([]), F.lit(False)).count() == 0
    docs_of([(1, "a b")]).write.parquet(folder + "/d")
    row = lm.score_texts(spark.read.parquet(folder + "/d"), F.lit(True)).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["score"] == 0.0
