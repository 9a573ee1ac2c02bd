from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from tidegauge.llm import packing

FILE = path("byte_bpe_50k.json")
TEXTS = [
    (1, "Hello  world, it's\n\n\tme: 12345 ñandú — 漢字 🙂  "), (2, None), (3, ""), (4, "a" * 60_000), (5, "w1 " * 3000),
    (None, "x<|endoftext|>y"), (7, "same"), (7, "same"), (8, " \n \r\n x y z ..!!  ’s 'S 're"),
]


def test_pieces_cover_every_id_once_and_leave_no_padding(docs_of):
    rows = packing.pack_documents(docs_of(TEXTS).coalesce(1), FILE, PATTERN, with_ids=True).collect()
    tok = Tokenizer.from_file(FILE)
    want = [tok.encode(t or "", add_special_tokens=False).ids + [1] for _, t in TEXTS]
    parts = defaultdict(list)
    for r in rows:
        parts[r["doc_id"], r["doc_tokens"]].append(r)
        assert r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
    for (doc, text), ids in zip(TEXTS, want):
        own = sorted(parts[doc, len(ids)], key=lambda r: r["start"])
        joined = [i for r in own for i in r["ids"]]
        assert joined == (ids + ids if doc == 7 else ids) or doc == 7 and sorted(joined) == sorted(ids + ids)
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert sum(map(len, want)) == sum(r["length"] for r in rows)


def test_costs_are_even():
    lengths = [1 + (n * 37) % 900 for n in range(400)]
    cost, size = defaultdict(float), defaultdict(int)
    for _, _, n, at, offset in packing.balanced(lengths):
        assert offset == size[at]
        size[at] += n
        cost[at] += n + n * n / 2048
    full = [c for at, c in cost.items() if size[at] == 2048]
    assert max(full) < 1.15 * min(full)


def test_groups_and_empty_table(docs_of):
    rows = [(n, "word " * (n % 90)) for n in range(300)]
    found = packing.pack_documents(docs_of(rows).coalesce(1), FILE, PATTERN, group_tokens=4000).collect()
    at = defaultdict(list)
    for r in found:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) == max(o + n for o, n in p) <= 2048 for p in at.values())
    assert packing.pack_documents(docs_of([]), FILE, PATTERN).count() == 0


def test_pieces_outlive_a_turn_of_the_memory(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_PIECES", 3)
    code = packing.Encoder(FILE, PATTERN)
    merged, piece = [], code._piece
    monkeypatch.setattr(code, "_piece", lambda p: merged.append(p) or piece(p))
    tok = Tokenizer.from_file(FILE)
    for text in ("hot a b c", "hot d", "hot e f g", "hot h", "", "hot a"):
        ids = np.frombuffer(code.encode(text), "<u4").tolist()
        assert ids == tok.encode(text, add_special_tokens=False).ids
    assert merged.count("hot") == 1 and merged.count(" a") == 2
    assert len(code.known) + len(code.older) <= 2 * (3 + 4)


def test_latin_texts_are_cut_by_the_faster_matcher(monkeypatch):
    """The same pieces, hence ids, for every pair of characters it takes; other texts and patterns go the general way."""
    code = packing.Encoder(FILE, PATTERN)
    assert packing.BYTE_LEVEL == PATTERN
    letters = [chr(n) for n in range(0x250)]
    text = "".join(f"{a}{b} {a}'s  {b}{a}\n" for a in letters for b in " \n\x1c\x85\xa0aZé9½²_.'’"[:-1])
    general = code.any_pieces
    assert code.pieces(text) == general(text)
    monkeypatch.setattr(code, "any_pieces", lambda t: general(t) if "’" in t else pytest.fail("matched the slow way"))
    tok = Tokenizer.from_file(FILE)
    for t in (text, "it’s 漢字 ½ ٣\u2003 x", " a", ""):
        assert np.frombuffer(code.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert packing.Encoder(FILE, r"\S+|\s+").pieces("ab c's") == ["ab", " ", "c's"]
