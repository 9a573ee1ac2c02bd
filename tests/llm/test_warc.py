from __future__ import annotations

import base64
import gzip
import hashlib
import random
from pathlib import Path

from tidegauge.llm import warc

SCHEMA = "page_id long, url string, html string, size long, digest string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


ROWS = [
    (5, "http://b.example/x", "same"), (3, "http://www.a.example/", "same"), (9, "http://a.example/", "same"),
    (1, None, ""), (2, "u\nv", None), (4, "https://é.example/ü?b=1&a=2", "WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n" * 3),
    (6, "http://a.example/", "long é " * 30_000), (7, "not a url", "\r\n\r\n"), (8, "http://[bad", "one"),
]


def test_round_trip(spark, folder):
    warc.write_archives(pages_of(spark, ROWS), folder + "/w", records_per_file=2)
    payloads = {}
    for file in Path(folder, "w").glob("*.gz"):
        for fields, _, _, http, payload in warc.parse_archive(gzip.decompress(file.read_bytes())):
            payloads[int(fields["WARC-Record-ID"][10:-1])] = (fields["WARC-Type"], payload.decode())
    first = {}
    for i, _, html in sorted(ROWS):
        first.setdefault(html or "", i)
    for i, _, html in ROWS:
        assert payloads[i] == (("response", html or "") if first[html or ""] == i else ("revisit", ""))


def test_index_gives_digests_and_references(spark, folder):
    index = warc.archive_index(pages_of(spark, ROWS), folder + "/i", records_per_file=2)
    rows = {r["page_id"]: r for r in index.collect()}
    assert len(rows) == len(ROWS)
    for i, _, html in ROWS:
        data = (html or "").encode()
        assert rows[i]["payload_bytes"] == len(data)
        assert rows[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert [rows[i]["refers_to"] for i in (3, 5, 9, 1, 2)] == [None, 3, 3, None, 1]
    assert rows[1]["url"] is None and rows[2]["url"] == "u%0Av"


def test_histories_are_ordered_over_all_files(spark, folder):
    rng = random.Random(2)
    rows = [(n, f"http://h{rng.randrange(4)}.example/{rng.randrange(3)}", str(n % 50)) for n in range(600)]
    index = warc.archive_index(pages_of(spark, rows).repartition(5), folder + "/i", records_per_file=40)
    merged = [tuple(r) for part in index.rdd.glom().collect() for r in part]
    assert len({r[0] for r in merged}) > 10
    keys = [warc._order(r[2:])[:4] for r in merged]
    assert keys == sorted(keys) and len(keys) == 600


def test_small_payloads_may_stay_responses(spark, folder):
    rows = warc.archive_index(pages_of(spark, ROWS), folder + "/i", least_bytes=5).collect()
    assert all(r["record_type"] == "response" for r in rows)


def test_missing_and_repeated_ids(spark, folder):
    rows = [(None, "u", "a"), (2, "u", "a"), (2, "u", "a"), (None, "v", "b"), (None, "v", "b")]
    got = sorted((r["page_id"] or 0, r["record_type"]) for r in warc.archive_index(pages_of(spark, rows), folder + "/i").collect())
    assert got == [(0, "response"), (0, "response"), (0, "revisit"), (2, "response"), (2, "response")]


def test_empty_table(spark, folder):
    assert warc.archive_index(pages_of(spark, []), folder + "/i").count() == 0


def test_loser_tree_merges_runs_of_any_number():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.A.example:8080/B?z=1&a=2#f") == "example,a:8080)/b?a=2&z=1"
