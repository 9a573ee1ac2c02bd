"""Near copies below op1's 0.85: the pipeline's stage, and the operator's `similar`."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tidegauge.llm import minhash


def pair_of(rng, n_words, changed):
    """Two texts of distinct words; the second has other words at its end."""
    base = [f"x{rng.randrange(10**9)}" for _ in range(n_words)]
    return " ".join(base), " ".join(base[: n_words - changed] + [f"y{rng.randrange(10**9)}" for _ in range(changed)])


def shared(a, b):
    one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(one & two) / len(one | two)


def texts_between(low, high, n_words, changed, count=20):
    rng = random.Random(n_words)
    pairs = [pair_of(rng, n_words, changed) for _ in range(count)]
    assert all(low <= shared(a, b) < high for a, b in pairs)
    return [(2 * n + i, t) for n, pair in enumerate(pairs) for i, t in enumerate(pair)]


def test_the_stage_drops_copies_of_eight_tenths(spark, docs_of):
    rows = texts_between(0.80, 0.85, 204, 20) + [(1000 + i, t) for i, t in texts_between(0.7, 0.8, 304, 50)]
    kept = corpus_pipeline.drop_near_copies(spark, docs_of(rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i, _ in rows if i >= 1000 or i % 2 == 0]


def test_sketches_of_similar_pairs_stay_below_the_bound():
    rng = minhash.np.random.default_rng(2)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype="uint64")
    for part in (85, 80, 70, 60):
        both, apart = 10 * part, 5 * (100 - part)
        most = minhash.sketch_apart((part, 100))
        for _ in range(20):
            core = draw(both)
            a, b = (minhash.sketch(minhash.np.concatenate([core, draw(apart)])) for _ in range(2))
            assert sum(bin(x).count("1") for x in (a ^ b).view("uint64").tolist()) <= most
    assert minhash.sketch_apart((85, 100)) <= 47 < minhash.sketch_apart((80, 100)) < minhash.sketch_apart((70, 100))


def test_keys_follow_the_threshold(docs_of):
    missed = lambda s, n: 1 - (1 - (1 - s**minhash.ROWS) ** n) ** 2
    for part in (85, 80, 70, 60, 50):
        assert missed(part / 100, minhash.keys_a_side((part, 100))) <= minhash.TABLE_MISSES
    assert minhash.keys_a_side((85, 100)) == 12 and minhash.keys_a_side((80, 100)) == 16
    for bad in ((20, 100), (0, 100), (101, 100)):
        with pytest.raises(ValueError):
            minhash.near_groups(docs_of([]), similar=bad)


def test_a_lower_threshold_finds_its_pairs(docs_of):
    rows = texts_between(0.60, 0.65, 404, 92)
    kept = minhash.drop_near_copies(docs_of(rows), similar=(60, 100)).collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i, _ in rows if i % 2 == 0]


def brute_groups(rows, part):
    """{id: smallest id reachable} over all pairs of texts."""
    sets = [(i, {tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))}) for i, t in rows for w in [t.split()]]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if 100 * len(a & b) >= part * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("part", [80, 85])
def test_groups_around_the_threshold_against_all_pairs(docs_of, part):
    """Copies of copies whose similarities lie on both sides of the threshold; several groups, one far larger."""
    rng = random.Random(part)
    rows = []
    for size in (150, 12, 5, 2):
        base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        for _ in range(size):
            words = list(base)
            for place in rng.sample(range(120), rng.randint(0, 4)):
                words[place] = f"v{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(docs_of(rows), similar=(part, 100)).collect()}
    wanted = brute_groups(rows, part)
    assert got == wanted and 4 < len(set(wanted.values())) < len(rows)


def test_a_clashing_name_and_nulls_pass_the_stage(spark):
    text = " ".join(f"w{n}" for n in range(40))
    rows = [(1, text, 7, None), (2, text, 8, None), (3, None, None, None), (None, "", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone__ int, half string")
    kept = minhash.drop_near_copies(docs, similar=(80, 100))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["gone__"] or 0) for r in kept.collect()) == [(0, 9), (1, 7), (3, 0)]
