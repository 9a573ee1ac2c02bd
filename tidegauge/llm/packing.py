"""Cost-balanced packing of token ids into sequences of a fixed length.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention stays inside a piece). The documents of a
group are taken in descending length, each to the sequence of lowest cost that still has room; what does not fit
goes on to the next one. A group is what a task holds at a time, so no row is shuffled and memory is bounded.

The capacities of a group add up to its tokens exactly: full sequences, then one of each power of two that the
rest needs. Sequences that are a power of two long need no padding, so none is left at all.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegauge.llm.common import give_back, pick, utf8

SEQUENCE = 2048
END_ID = 1
GROUP_TOKENS = 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
KNOWN_PIECES = 150_000  # in each of the two generations a task remembers
_ENCODERS: dict[str, Encoder] = {}

# The letters byte-level vocabularies are written in: visible Latin-1 bytes stand for themselves, the others, in
# order, for the letters from 256 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(_HIDDEN)}
_LETTER_OF = "".join(chr(_BYTE_LETTERS.get(b, b)) for b in range(256))

# The pattern of byte-level vocabularies, and the same for texts of letters below U+0250 with its classes spelt out:
# `re` matches it more than twice as fast as `regex`.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = [chr(n) for n in range(0x250)]
_LETTERS, _NUMBERS = ("".join(c for c in _LATIN if unicodedata.category(c)[0] == kind) for kind in "LN")
_BLANKS = r"\t-\r \x85\xa0"
_LATIN_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
    f"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)
_BEYOND = re.compile("[^\0-\u024f]")


class Encoder:
    """Ids of whole texts as little-endian bytes, by the tokenizer's own pre-tokens; those seen before are looked up."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.any_pieces = regex.compile(pattern).findall
        self.latin = pattern == BYTE_LEVEL
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a pre-token: the model alone merges its bytes."""
        letters = codecs.charmap_decode(piece.encode("utf-8", "replace"), "strict", _LETTER_OF)[0]
        return struct.pack(f"<{len(merged := self.merge(letters))}I", *[t.id for t in merged])

    def pieces(self, text: str) -> list[str]:
        return _LATIN_PIECES.findall(text) if self.latin and not _BEYOND.search(text) else self.any_pieces(text)

    def encode(self, text: str) -> bytes:
        """The ids of `text`, exactly as the tokenizer gives them for the whole text."""
        if any(s in text for s in self.special):
            return self._whole(text)  # a special token's text is cut out before the pattern is applied
        found = self.pieces(text)
        known, older = self.known, self.older
        for p in set(found).difference(known):
            ids = older.get(p)
            known[p] = self._piece(p) if ids is None else ids
        out = b"".join(map(known.__getitem__, found))
        if len(known) > KNOWN_PIECES:  # pieces met again before the next turn move over, the rest is forgotten then
            self.known, self.older = {}, known
        return out

    def forget(self) -> None:
        """Gives the memory to the tasks of other stages."""
        self.known, self.older = {}, {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process and file."""
    key = f"{path}\n{pattern}"
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, pattern)
    return _ENCODERS[key]


def capacities(total: int, sequence: int = SEQUENCE) -> list[int]:
    """Full sequences and the powers of two that make up the rest."""
    rest = total % sequence
    return [sequence] * (total // sequence) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def balanced(lengths: list[int], sequence: int = SEQUENCE) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; costs are kept even over the sequences."""
    room = capacities(sum(lengths), sequence)
    full = list(room)
    heap = [(0.0, n) for n in range(len(room))]
    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, left = 0, lengths[doc]
        while left:
            cost, at = heapq.heappop(heap)
            take = min(left, room[at])
            yield doc, start, take, at, full[at] - room[at]
            room[at] -= take
            start, left = start + take, left - take
            if room[at]:
                heapq.heappush(heap, (cost + LINEAR * take + QUADRATIC * take * take, at))


def pack_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    doc_id: str = "doc_id",
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    group_tokens: int = GROUP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, on request).

    A null or empty text is the end id alone. Rows repeated or without an id are packed as they are, each for itself;
    other columns are not read. An empty table gives no pieces. `sequence_id` joins the task's number and a counter, so
    a task that runs again gives the same rows. Groups end at `group_tokens`, or after the document that passes it.
    """
    kind = docs.schema[doc_id].dataType
    fields = [T.StructField("doc_id", kind)] + [
        T.StructField(n, T.LongType())
        for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(names: list, ids: list[bytes], first: int, id_type: pa.DataType) -> tuple[pa.RecordBatch, int]:
        lengths = [len(b) // 4 for b in ids]
        pieces = np.array(list(balanced(lengths, sequence)), dtype=np.int64).reshape(-1, 5)
        cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n in pieces[:, :3].tolist()]
        columns = [
            pa.array([names[d] for d in pieces[:, 0].tolist()], type=id_type),
            pieces[:, 1], pieces[:, 2],
            np.array([zlib.crc32(b) for b in cut], dtype=np.int64),
            np.array(lengths, dtype=np.int64)[pieces[:, 0]],
            pieces[:, 3] + first, pieces[:, 4],
        ]
        if with_ids:
            columns.append(pa.array([np.frombuffer(b, "<u4").astype(np.int64) for b in cut], type=pa.list_(pa.int64())))
        used = len(capacities(sum(lengths), sequence))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.name for f in fields]), used

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        next_id = TaskContext.get().partitionId() << 40
        names, ids, held, id_type = [], [], 0, None
        for name, data in chain.from_iterable(zip(b.column(0), b.column(1)) for b in batches):
            id_type = name.type
            names.append(name.as_py())
            ids.append(code.encode(data.as_py().decode("utf-8", "replace")) + end)
            held += len(ids[-1]) // 4
            if held >= group_tokens:
                batch, used = rows(names, ids, next_id, id_type)
                yield batch
                names, ids, held, next_id = [], [], 0, next_id + used
        if names:
            yield rows(names, ids, next_id, id_type)[0]
        code.forget()
        give_back()

    picked = docs.select(pick(doc_id).alias("doc_id"), utf8(text).alias("text"))
    return picked.mapInArrow(pack, T.StructType(fields))
