from __future__ import annotations

import random

import pytest

from tidegauge.llm import minhash
from tidegauge.llm.graph import components


def shingle_set(text):
    found = (text or "").lower().split()
    if not found:
        return set()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


def corpus(seed=3):
    rng = random.Random(seed)
    pool = [f"w{n}" for n in range(400)]
    make = lambda n: [rng.choice(pool) for _ in range(n)]
    texts = []
    for _ in range(25):
        base = make(rng.choice([60, 120, 400]))
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 50))):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            texts.append(" ".join(copy))
    chain = make(200)  # each step is a near copy of the one before, the ends are not
    for step in range(12):
        chain = chain[:-3] + make(3) if step % 2 else make(3) + chain[3:]
        texts.append(" ".join(chain))
    texts += ["One two", "one TWO", "one two three four five", "", "\n\t", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    return [(3 * n + 1, t) for n, t in enumerate(texts)] + [(0, None)]


def test_equals_brute_force(docs_of):
    rows = corpus()
    assert found(minhash.near_groups(docs_of(rows))) == brute(rows)


def test_links_that_asking_misses_are_found_at_the_end(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "ASKING_ROUNDS", 1)
    rows = corpus(8)
    assert found(minhash.near_groups(docs_of(rows))) == brute(rows)


def test_parities_bound_the_difference():
    rng = minhash.np.random.default_rng(1)
    for size, changed in ((50, 5), (400, 60), (3000, 900)):
        a = rng.integers(0, 1 << 63, size, dtype="uint64")
        b = minhash.np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed // 2, dtype="uint64")])
        apart = sum(bin(x).count("1") for x in (minhash.parity(a) ^ minhash.parity(b)).view("uint64").tolist())
        assert 0 < apart <= changed + changed // 2


def test_one_of_each_group_stays(docs_of):
    rows = corpus(5)
    docs = docs_of(rows)
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, _, k in brute(rows) if k]


def test_missing_and_repeated_ids_and_long_texts(docs_of):
    long = " ".join(f"v{n}" for n in range(60_000))
    rows = [(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"),
            (9, long), (8, long + " end")]
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_groups(docs_of(rows)).collect())
    assert got == [
        (0, None, True), (0, None, True), (2, 2, True), (2, 2, True), (4, 2, False), (8, 8, True), (9, 8, False),
    ]
    assert sorted(r["doc_id"] or 0 for r in minhash.drop_near_copies(docs_of(rows)).collect()) == [0, 0, 2, 2, 8]


def test_empty_table(docs_of):
    assert minhash.near_groups(docs_of([])).count() == 0
    assert minhash.drop_near_copies(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, folder, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(n, n + 1) for n in range(400, 440)]
    edges += [(500, n) for n in range(501, 560)] + [(7, 7)]
    label = {n: n for e in edges for n in e}
    for _ in range(60):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    got = components(spark.createDataFrame(edges, "u long, v long"), folder + "/c")
    assert sorted(tuple(r) for r in got.collect()) == sorted((n, r) for n, r in label.items() if n != r)
