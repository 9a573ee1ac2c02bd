from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import toxicity as tx
from tidegauge.llm.common import in_hash_share

WORDS = [f"w{n}" for n in range(60)]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        text = [rng.choice(WORDS) for _ in range(rng.randrange(10, 60))]
        if bad:
            text += rng.sample(["grunkle", "blorted", "blorting", "snarfy"], 2)
        if bad and rng.random() < 0.7 or rng.random() < 0.02:
            text.append("muslims")  # the group is named mostly in toxic texts
        rng.shuffle(text)
        rows.append((i, " ".join(text).capitalize() + ".", int(bad)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (10**6, 1)], "doc_id long, toxic int")
    return docs, labels


def test_held_out_texts_are_told_apart(spark, tables):
    docs, labels = tables
    held = in_hash_share(F.col("doc_id"), 3, 1)
    model = tx.train(docs, labels.filter(~held))
    rows = docs.filter(held).select("doc_id", tx.toxicity(spark, model).alias("s")).collect()
    assert len(rows) > 200
    assert all((r["s"] >= tx.THRESHOLD) == (r["doc_id"] % 5 == 0) for r in rows)
    for i, text, _ in corpus()[:20]:
        got = docs.filter(f"doc_id = {i}").select(tx.toxicity(spark, model).alias("s")).first()["s"]
        assert abs(got - model.score(tx.text_words(text.encode()))) < 1e-12
    assert tx.train(docs, labels.filter(~held)) == model


def test_swapping_groups_hardly_moves_the_score():
    rows = corpus()
    lists = [tx.features(tx.text_words(t.encode())) for _, t, _ in rows]
    labels = tx.np.array([float(y) for *_, y in rows])
    swaps = [s for _, t, _ in rows for s in tx.swaps(t.encode())]
    assert swaps and all(b"muslims" in a and b"muslims" not in b for a, b in swaps)
    feats = lambda t: tx.features(tx.text_words(t))
    pairs = [(tx.np.setdiff1d(feats(a), feats(b)), tx.np.setdiff1d(feats(b), feats(a))) for a, b in swaps]
    free, held = tx.fit(lists, labels, []), tx.fit(lists, labels, pairs)
    logit = lambda p: tx.np.log(p / (1 - p))
    moved = lambda m: logit(m.score({b"the", b"muslims", b"met"})) - logit(m.score({b"the", b"jews", b"met"}))
    assert moved(free) > 1 and abs(moved(held)) < moved(free) / 4
    assert held.score({b"grunkle", b"snarfy"}) > 0.7


def test_null_empty_long_and_repeated_rows(spark, docs_of, tables):
    model = tx.train(*tables)
    docs = docs_of([(1, None), (1, ""), (2, "grunkle snarfy"), (2, "grunkle snarfy"), (3, "w1 " * 200_000), (None, "w2")])
    kept = tx.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 3]
    assert tx.drop_toxic(docs_of([]), model).count() == 0


def test_without_labels_or_classes(spark, tables):
    docs, labels = tables
    none = tx.train(docs, labels.limit(0))
    assert none.weights == {} and none.score({b"grunkle"}) < 1e-3
    one = tx.train(docs, labels.filter("toxic = 0"))
    assert one.weights == {} and one.score(set()) < 0.01


def test_the_sample_is_bounded(tables):
    docs, labels = tables
    small = tx.train(docs, labels, sample=40)
    assert len(small.weights) < len(tx.train(docs, labels).weights) + 1


def test_counting_holds_little_beside_the_features(monkeypatch):
    """Same counts as one by one, in a few times the memory of the features; free memory goes back at the end."""
    import tracemalloc

    rng = tx.np.random.default_rng(2)
    lists = [tx.np.unique(rng.integers(0, 60_000, 1500, dtype=tx.np.uint32)) for _ in range(1000)]
    batch = tx.pd.DataFrame({"label": [int(n % 7 == 0) for n in range(1000)], "features": [x.tobytes() for x in lists]})
    given = []
    monkeypatch.setattr(tx, "give_back", lambda: given.append(1))
    tracemalloc.start()
    (got,) = tx._counted(iter([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5 * sum(x.nbytes for x in lists) and given == [1]
    every = tx.np.concatenate(lists)
    assert got["n"].sum() == len(every) and (got["feature"].to_numpy() == tx.np.unique(every)).all()
    for row in got.iloc[::5000].itertuples():
        have = [row.feature in x for x in lists]
        assert (row.n, row.hits) == (sum(have), sum(h for h, y in zip(have, batch["label"]) if y))
    (clean,) = tx._counted(iter([batch[batch["label"] == 0]]))
    assert clean["hits"].sum() == 0
