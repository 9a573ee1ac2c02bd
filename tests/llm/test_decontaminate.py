from __future__ import annotations

import random
import re

from tidegauge.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    have = folded(text)
    hit, names = set(), set()
    for name, item in items:
        want = folded(item)
        for a in range(max(1, len(want) - window + 1) if want else 0):
            w = want[a : a + window]
            for p in range(len(have) - len(w) + 1):
                if have[p : p + len(w)] == w:
                    hit.update(range(p, p + len(w)))
                    names.add(name or "")
    return len(have), len(hit), sorted(names)


def data():
    rng = random.Random(5)
    pool = ["ab", "c", "Dé", "e1", "ñ"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(f"i{n}", text(rng.choice([0, 1, 3, 6, 12, 30]))) for n in range(14)]
    items += [("i3", items[3][1]), (None, "zz yy xx ww vv uu"), ("short", "qq"), ("null", None)]
    rows = []
    for n in range(120):
        parts = [text(rng.randrange(40))]
        if n % 3 == 0:
            parts.insert(0, rng.choice(items)[1] or "")
        if n % 7 == 0:
            parts.append("-- ZZ yy, xx/ww vv_uu! Qq")
        rows.append((n, "\n".join(parts)))
    return rows + [(900, None), (901, ""), (902, "...")], items


def check(spark, docs_of, window, block_bytes):
    rows, items = data()
    tests = spark.createDataFrame(items, "item_id string, text string")
    docs = docs_of(rows)
    found = decontaminate.with_matches(docs, tests, "f", window=window, block_bytes=block_bytes)
    assert found.columns == docs.columns + ["f"]
    texts = dict(rows)
    seen = 0
    for row in found.collect():
        f = row["f"]
        assert (f["n_words"], f["n_hit"], list(f["items"])) == brute(texts[row["doc_id"]], items, window)
        have = folded(texts[row["doc_id"]])
        for m in f["matches"]:
            wanted = [folded(t) for name, t in items if (name or "") == m["item"]]
            got = have[m["start"] : m["start"] + m["length"]]
            assert any(w[m["item_start"] : m["item_start"] + m["length"]] == got for w in wanted)
            seen += 1
    assert seen


def test_equals_brute_force(spark, docs_of):
    check(spark, docs_of, 5, 1 << 20)


def test_blocks_of_items_give_the_same(spark, docs_of):
    check(spark, docs_of, 5, 200)


def test_matches_are_as_long_as_they_can_be(spark, docs_of):
    item = " ".join(f"w{n}" for n in range(30))
    docs = docs_of([(1, "x " + " ".join(f"w{n}" for n in range(4, 25)) + " y")])
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    match = decontaminate.with_matches(docs, tests, "f").first()["f"]["matches"][0]
    assert (match["start"], match["item_start"], match["length"]) == (1, 4, 21)


def test_affected_documents_go(spark, docs_of):
    item = " ".join(f"w{n}" for n in range(12))
    docs = docs_of([(1, item), (2, item.upper() + "!"), (3, "w1 w2 w3"), (4, None)])
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, tests)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4]


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs_of([(1, "a b")]), none).count() == 1
    tests = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(docs_of([]), tests).count() == 0
