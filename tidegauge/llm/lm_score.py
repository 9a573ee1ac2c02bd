"""Log-probabilities of texts under a word bigram model with deleted interpolation.

P(w | h) = l0 / (V + 1) + l1 * c(w) / N + l2 * c(h, w) / c(h); the weights l depend on how often the context h was
seen (one bucket per power of two) and are learned by expectation-maximisation on deleted counts: a training text is
predicted from the counts of all other blocks of documents, so that every block is held out once.

1. Tasks cut their documents into blocks and count the words and pairs of each. What a block needs to know travels as
   packed keys, one row per block and part of the key space; a part adds up the counts of all blocks and sends
   each block the totals of its own keys. A very common word is one key per block, so no part grows with it.
2. Blocks meet their totals. Each token is stored with c(w) and c(h, w), and the deleted estimates are counted in cells.
3. The cells (a number bounded by the grid) go to the driver, which runs the expectation-maximisation.
4. One pass over the stored counts gives the scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import pick, run_folder, stored, utf8, words

BLOCK_BYTES = 8 << 20  # text of a block, about
KNOWN_WORDS = 300_000
BUCKETS = 48
GRID = 4  # cells per power of two
CELLS = 160
EM_STEPS = 40
PRIOR = 3.0  # events each bucket's weights start from

_END = xxhash.xxh64_intdigest(b"\nend")  # holds a blank, so no word has it
_START = np.uint64(xxhash.xxh64_intdigest(b"\nstart"))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Block:
    """The words and pairs of some documents: distinct keys in the order of parts, and each token's place among them."""

    def __init__(self, texts: list[bytes], learn: np.ndarray, parts: int, known: _Words):
        coded = [
            np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found)) for found in map(words, texts)
        ]
        self.sizes = np.array([len(c) + 1 for c in coded], dtype=np.int64)
        end = np.array([_END], dtype=np.uint64)
        tokens = np.concatenate([x for c in coded for x in (c, end)])
        first = np.cumsum(self.sizes) - self.sizes
        context = np.roll(tokens, 1)
        context[first] = _START
        pairs = context * _ODD[0] + tokens * _ODD[1]
        pairs = (pairs ^ (pairs >> np.uint64(32))) * _ODD[2]
        one, self.word = np.unique(tokens, return_inverse=True)
        two, pair = np.unique(pairs ^ (pairs >> np.uint64(29)), return_inverse=True)
        self.pair = pair + len(one)
        # a word is the context of the token behind it; the start of a text occurs as often as its end
        self.context = np.roll(self.word, 1)
        self.context[first] = np.searchsorted(one, end[0])
        self.learn = np.repeat(learn, self.sizes)
        self.own = np.bincount(np.concatenate([self.word[self.learn], self.pair[self.learn]]), minlength=len(one) + len(two))
        self.keys = np.concatenate([one, two])
        part = self.keys % np.uint64(parts)
        self.order = np.argsort(part, kind="stable")
        self.ends = np.searchsorted(part[self.order], np.arange(parts + 1))
        self.n_words = np.bincount(part[: len(one)].astype(np.int64), minlength=parts)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """Rows of a task in blocks of about `block_bytes` of text, numbered by task and place: the same in each pass."""
    number, rows, held = TaskContext.get().partitionId() << 24, [], 0
    for batch in batches:
        begin = 0
        for at, size in enumerate(pc.binary_length(batch.column("data")).to_pylist(), 1):
            held += size
            if held >= block_bytes:
                rows.append(batch.slice(begin, at - begin))
                yield number, pa.Table.from_batches(rows)
                number, rows, held, begin = number + 1, [], 0, at
        if begin < len(batch):
            rows.append(batch.slice(begin))
    if rows:
        yield number, pa.Table.from_batches(rows)


def _packed(counts: np.ndarray) -> bytes:
    """One byte a count where all fit."""
    return counts.astype("u1" if not len(counts) or counts.max() < 256 else "<u4").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="u1" if len(data) == n else "<u4").astype(np.int64)


_REQUEST = "part long, block long, n_words long, keys binary, own binary"
_ANSWER = "part long, block long, crc long, totals binary, words long, tokens long"


def _requests(docs: DataFrame, parts: int, block_bytes: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for number, table in _blocks(batches, block_bytes):
            block = Block(table["data"].to_pylist(), table["learn"].to_numpy(), parts, known)
            keys, own = block.keys[block.order], block.own[block.order]
            cuts = list(zip(block.ends[:-1].tolist(), block.ends[1:].tolist()))
            full = [p for p, (a, b) in enumerate(cuts) if b > a]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(full, pa.int64()),
                "block": pa.array([number] * len(full), pa.int64()),
                "n_words": pa.array(block.n_words[full], pa.int64()),
                "keys": pa.array([keys[a:b].tobytes() for a, b in (cuts[p] for p in full)], pa.binary()),
                "own": pa.array([_packed(own[a:b]) for a, b in (cuts[p] for p in full)], pa.binary()),
            })

    return docs.mapInArrow(ask, _REQUEST)


def _answer(table: pa.Table) -> pa.Table:
    """Totals of a part's keys, row by row in the order asked; its distinct training words and their tokens once."""
    rows = table.sort_by("block").to_pydict()
    keys = [np.frombuffer(k, dtype=np.uint64) for k in rows["keys"]]
    own = np.concatenate([_unpacked(o, len(k)) for o, k in zip(rows["own"], keys)])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, own, len(distinct)).astype(np.int64)
    is_word = np.zeros(len(distinct), dtype=bool)
    ends = np.cumsum([len(k) for k in keys])
    for end, k, n in zip(ends, keys, rows["n_words"]):
        is_word[place[end - len(k) : end - len(k) + n]] = True
    rest = [0] * (len(keys) - 1)
    return pa.table({
        "part": pa.array(rows["part"], pa.int64()),
        "block": pa.array(rows["block"], pa.int64()),
        "crc": pa.array([zlib.crc32(k) for k in rows["keys"]], pa.int64()),
        "totals": pa.array([_packed(totals[place[e - len(k) : e]]) for e, k in zip(ends, keys)], pa.binary()),
        "words": pa.array([int(np.count_nonzero(totals[is_word])), *rest], pa.int64()),
        "tokens": pa.array([int(totals[is_word].sum()), *rest], pa.int64()),
    })


_COUNTED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("learn", T.BooleanType()),
    T.StructField("word", T.BinaryType()), T.StructField("pair", T.BinaryType()),
    T.StructField("cells", T.BinaryType()), T.StructField("events", T.BinaryType()),
])


def _cells(block: Block, totals: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells (bucket, word estimate, pair estimate) of the block's training tokens, by the counts of the other blocks."""
    left = totals - block.own
    at = block.learn
    word, pair, context = left[block.word[at]], left[block.pair[at]], left[block.context[at]]
    all_others = max(tokens - int(np.count_nonzero(at)), 1)
    cell = (_bucket(context) * (CELLS + 1) + _level(word / all_others)) * (CELLS + 1)
    return np.unique(cell + _level(pair / np.maximum(context, 1)), return_counts=True)


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the power of two."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def _level(p: np.ndarray) -> np.ndarray:
    """Grid step of a probability; CELLS stands for 0."""
    found = np.full(len(p), CELLS, dtype=np.int64)
    found[p > 0] = np.minimum(-np.log2(p[p > 0]) * GRID, CELLS - 1).astype(np.int64)
    return found


def _counted(docs: DataFrame, answers: DataFrame, parts: int, block_bytes: int, tokens: int) -> DataFrame:
    """A row per document with the counts of its tokens, and a row per block with its cells."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, table in _blocks(batches, block_bytes):
            for batch in table.add_column(0, "block", pa.array([n] * len(table), pa.int64())).to_batches():
                yield batch

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place")
        block = Block(left["data"].to_pylist(), left["learn"].to_numpy(), parts, _Words())
        totals = np.zeros(len(block.keys), dtype=np.int64)
        keys = block.keys[block.order]
        for row in right.select(["part", "crc", "totals"]).to_pylist():
            a, b = block.ends[row["part"]], block.ends[row["part"] + 1]
            if zlib.crc32(keys[a:b].tobytes()) != row["crc"]:
                raise ValueError("the documents came in another order than before; store the table first")
            totals[block.order[a:b]] = _unpacked(row["totals"], b - a)
        cells, events = _cells(block, totals, tokens)
        ends = np.cumsum(block.sizes)[:-1]
        cut = lambda counts: [c.astype("<u4").tobytes() for c in np.split(counts, ends)]
        return pa.table({
            "doc_id": pa.array(left["doc_id"].to_pylist() + [None], pa.int64()),
            "learn": pa.array(left["learn"].to_pylist() + [None], pa.bool_()),
            "word": pa.array(cut(totals[block.word]) + [None], pa.binary()),
            "pair": pa.array(cut(totals[block.pair]) + [None], pa.binary()),
            "cells": pa.array([None] * len(left) + [cells.astype("<i8").tobytes()], pa.binary()),
            "events": pa.array([None] * len(left) + [events.astype("<i8").tobytes()], pa.binary()),
        })

    placed = docs.withColumn("place", F.monotonically_increasing_id())
    numbered = placed.mapInArrow(number, "block long, doc_id long, learn boolean, data binary, place long")
    asked = answers.select("block", "part", "crc", "totals")
    return numbered.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(meet, _COUNTED)


def _cell_table(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All cells with their events; there are at most BUCKETS * (CELLS + 1)**2."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells, events in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(cells, "<i8")), pa.array(np.frombuffer(events, "<i8"))],
                    names=["cell", "events"],
                )

    rows = (
        counted.filter("cells IS NOT NULL").select("cells", "events").mapInArrow(unpack, "cell long, events long")
        .groupBy("cell").agg(F.sum("events").alias("events")).orderBy("cell").collect()
    )
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([float(r[1]) for r in rows])


def learn_weights(cells: np.ndarray, events: np.ndarray, words: int, steps: int = EM_STEPS) -> np.ndarray:
    """Weights (uniform, word, pair) for each bucket of context counts, by expectation-maximisation.

    Every bucket starts from PRIOR events spread evenly, so one that was never held out keeps even weights; the pair
    has none where the context was never seen.
    """
    bucket, rest = np.divmod(cells, (CELLS + 1) ** 2)
    levels = np.stack(np.divmod(rest, CELLS + 1), axis=1)
    parts = np.full((len(cells), 3), 1.0 / (words + 1))
    parts[:, 1:] = np.where(levels < CELLS, 2.0 ** (-(levels + 0.5) / GRID), 0.0)
    start = np.full((BUCKETS, 3), 1 / 3)
    start[0] = 1 / 2, 1 / 2, 0
    if not words:
        start[:] = 1, 0, 0  # nothing was learned
    weights = start
    for _ in range(steps):
        share = weights[bucket] * parts
        share *= (events / share.sum(axis=1))[:, None]
        got = np.stack([np.bincount(bucket, share[:, n], BUCKETS) for n in range(3)], axis=1) + PRIOR * start
        weights = got / got.sum(axis=1, keepdims=True)
    return weights


@dataclass
class Corpus:
    """What the scores rest on besides the stored counts."""

    tokens: int
    words: int
    weights: np.ndarray


def _scored(counted: DataFrame, corpus: Corpus) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, uniform = max(corpus.tokens, 1), 1.0 / (corpus.words + 1)
        for batch in batches:
            out = []
            for w, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                word, pair = np.frombuffer(w, "<u4").astype(np.int64), np.frombuffer(p, "<u4")
                context = np.roll(word, 1)  # the last token is the end, as frequent as the start
                mix = corpus.weights[_bucket(context)]
                told = mix[:, 0] * uniform + mix[:, 1] * word / many + mix[:, 2] * pair / np.maximum(context, 1)
                base = (word + 0.1) / (corpus.tokens + 0.1 * (corpus.words + 1))
                out.append((len(word), int(np.count_nonzero(word)), float(np.log10(base).sum()), float(np.log10(told).sum())))
            size, seen, base, told = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([not x for x in batch.column(1).to_pylist()], pa.bool_()),
                    pa.array(size, pa.int64()), pa.array(seen, pa.int64()),
                    pa.array([corpus.tokens] * len(size), pa.int64()), pa.array(base, pa.float64()),
                    pa.array(told, pa.float64()),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return counted.filter("word IS NOT NULL").select("doc_id", "learn", "word", "pair").mapInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def score_texts(
    docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", parts: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    Rows where `held_out` is not true are learned from. A null or empty text is its end token alone. Rows repeated or
    without an id are texts of their own. Other columns are not read; an empty table gives no rows, and with nothing
    to learn from every token has probability 1 / (V + 1) = 1. `docs` is read twice and has to come in the same order,
    as stored tables do; a change is noticed and raises an error. `parts` is the number of pieces of the key
    space, by default four times spark.sql.shuffle.partitions (several meet in a task, which evens them out).
    """
    spark = docs.sparkSession
    folder = run_folder(spark) + "/lm"
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        pick(doc_id).cast("long").alias("doc_id"), (~F.coalesce(held_out, F.lit(False))).alias("learn"),
        utf8(text).alias("data"),
    )
    asked = _requests(rows, parts, block_bytes)
    answers = stored(asked.groupBy("part").applyInArrow(_answer, _ANSWER), f"{folder}/answers")
    seen = answers.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    tokens, distinct = seen["tokens"] or 0, seen["words"] or 0
    counted = stored(_counted(rows, answers, parts, block_bytes, tokens), f"{folder}/counted", "zstd")
    weights = learn_weights(*_cell_table(counted), distinct)
    return _scored(counted, Corpus(tokens, distinct, weights))
