"""Secrets that start inside a match that fails its test."""

from __future__ import annotations

from tidegauge.llm import secrets

JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.sig"


def test_a_failing_match_hides_no_right_one(docs_of):
    body = b"0123456789abcdefghijKLMNOPQRST"
    good = "ghp_" + (body + secrets._crc62(body)).decode()
    fake = "ghp_" + "Z" * 33 + good  # the first match ends in the second one's "ghp"
    docs = docs_of([(1, "eyJx." + JWT), (2, fake), (3, "token=a token=" + "b" * 8), (4, JWT + "." + JWT)])
    got = {r["doc_id"]: [tuple(s) for s in r["s"]] for r in docs.select("doc_id", secrets.secret_spans().alias("s")).collect()}
    assert got[1] == [("jwt", 5, 5 + len(JWT))]
    assert got[2] == [("github", 37, 77)]
    assert got[3] == [("assign", 8, 22)]
    assert got[4] == [("jwt", 0, len(JWT)), ("jwt", len(JWT) + 1, 2 * len(JWT) + 1)]
    clean = {r["doc_id"]: r["clean"] for r in secrets.mask_secrets(docs, "clean").collect()}
    assert clean[1] == "eyJx.[secret]"
