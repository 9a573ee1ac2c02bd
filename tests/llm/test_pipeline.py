"""The stages over planted rows, each against what a plain program would keep, and the whole run."""

from __future__ import annotations

import random

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from test_decontaminate import brute as brute_hits
from test_minhash import brute as brute_near


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    pool = [f"w{n}" for n in range(500)]
    make = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(n, " ".join(make(15))) for n in range(8)]
    rows, labels = [], []
    for n in range(240):
        text = make(rng.randrange(30, 200))
        toxic = n % 6 == 0
        if toxic:
            text += rng.sample(["grunkle", "blorted", "snarfy"], 2)
        if n % 11 == 5:
            text += items[n % 8][1].upper().split()
        rng.random()
        rows.append((n, " ".join(text)))
        if n % 4 != 1:
            labels.append((n, int(n % 3 == 0), int(toxic)))
    clean = [t for n, t in rows if n % 6]
    rows += [(1000 + n, t) for n, t in enumerate(clean[:20])]  # exact copies
    rows += [(2000 + n, t + " more") for n, t in enumerate(clean[20:40])]  # near copies
    rows += [(3000, ""), (3001, None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    return folder, rows, items


def test_each_stage_keeps_what_a_plain_program_keeps(spark, tables, folder):
    where, rows, items = tables
    docs = spark.read.parquet(where + "/documents.parquet")
    columns = docs.columns
    kept = dict(rows)
    expected = {
        "toxicity": lambda now: {i: t for i, t in now.items() if "snarfy" not in (t or "") and "grunkle" not in (t or "")
                                 and "blorted" not in (t or "")},
        "exact_dedup": lambda now: {i: t for i, t in now.items() if i == max(j for j, u in now.items() if (u or "") == (t or ""))},
        "minhash": lambda now: {i: now[i] for i, _, _, own in brute_near(list(now.items())) if own},
        "decontaminate": lambda now: {i: t for i, t in now.items() if not brute_hits(t, items, 10)[1]},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, where).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        before, kept = kept, expected[name](kept)
        assert docs.columns == columns
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept and len(kept) < len(before)
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, where).collect()
    sizes = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == sizes
    assert sum(r["length"] for r in pieces) == sum(sizes.values())
    whole = corpus_pipeline.run(spark, where).collect()
    assert sum(r["length"] for r in whole) == sum(sizes.values()) and {r["doc_id"] for r in whole} == set(kept)
