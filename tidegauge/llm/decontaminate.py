"""Benchmark passages inside training documents, found by binary search in suffix arrays of the documents.

Each task cuts its documents into shards and sorts the suffixes of a shard, to the depth of the window. Every
suffix of the test items is then looked up in all shards; hits that follow each other on both sides are joined
into the longest verbatim matches, with their places. Suffixes that hold a word no item has within the window
can't match and are left out of the array.

The test items are the query set: they reach the tasks in blocks of stated size, all documents pass every block,
and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import free_name, pick, run_folder, stored, utf8

WINDOW = 10
BLOCK_BYTES = 32 << 20  # test text held by a task at a time
SHARD_WORDS = 1 << 18

# Lower-cases A-Z and turns everything but letters, digits and bytes from 0x80 on into blanks.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)

MATCHES = "array<struct<item:string,start:bigint,item_start:bigint,length:bigint>>"
FOUND = f"struct<n_words:bigint,n_hit:bigint,items:array<string>,matches:{MATCHES}>"


def item_words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class TestSuffixes:
    """The windows of a block of items as sortable keys; equal windows stand once and list their places."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        texts = [(name, item_words(data)) for name, data in items]
        self.window = window
        self.ids = {w: n for n, w in enumerate(sorted(set(chain.from_iterable(t for _, t in texts))), 1)}
        self.names = sorted({name for name, found in texts if found})
        number = {name: n for n, name in enumerate(self.names)}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for name, found in texts:
            coded = [self.ids[w] for w in found]
            for at in range(max(1, len(coded) - window + 1) if coded else 0):
                places.setdefault(tuple(coded[at : at + window]), []).append((number[name], at))
        windows = list(places)
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if windows else 0
        table = np.zeros((len(windows), window), dtype=">u4")
        last = np.full((len(windows), window), 0xFFFFFFFF, dtype=">u4")
        for n, w in enumerate(windows):
            table[n, : len(w)] = last[n, : len(w)] = w
        self.low, self.high = _keys(table), _keys(last)
        uses = [np.array(places[w], dtype=np.int64) for w in windows]
        self.first_use = np.cumsum([0, *map(len, uses)])
        self.uses = np.concatenate(uses) if uses else np.zeros((0, 2), dtype=np.int64)


def _keys(table: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which sort as the rows do."""
    return np.ascontiguousarray(table).view(f"S{4 * table.shape[1]}").ravel()


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... counts[0] of them, then those of first[1], and so on."""
    ends = np.cumsum(counts)
    return np.repeat(first - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def shard_matches(codes: np.ndarray, tests: TestSuffixes) -> np.ndarray:
    """Longest matches in a shard as rows (start, item, item start, length); code 0 never matches."""
    none = np.zeros((0, 4), dtype=np.int64)
    if not len(tests.lengths):
        return none
    breaks = np.flatnonzero(codes == 0)
    starts = np.flatnonzero(codes)
    room = np.append(breaks, len(codes))[np.searchsorted(breaks, starts)] - starts
    fit = room >= tests.shortest
    starts, room = starts[fit], room[fit]
    if not len(starts):
        return none
    depth = np.arange(tests.window)
    padded = np.concatenate([codes, np.zeros(tests.window, dtype=codes.dtype)])
    table = np.where(depth < room[:, None], padded[starts[:, None] + depth], 0).astype(">u4")
    keys = _keys(table)
    order = np.argsort(keys, kind="stable")  # the suffix array
    keys, starts = keys[order], starts[order]
    low = np.searchsorted(keys, tests.low, "left")
    counts = np.searchsorted(keys, tests.high, "right") - low
    found = np.flatnonzero(counts)
    if not len(found):
        return none
    at = starts[_spread(low[found], counts[found])]
    which = np.repeat(found, counts[found])
    # every use of the window in the items, beside every place in the shard
    many = tests.first_use[which + 1] - tests.first_use[which]
    use = tests.uses[_spread(tests.first_use[which], many)]
    at, length = np.repeat(at, many), np.repeat(tests.lengths[which], many)
    order = np.lexsort((at, at - use[:, 1], use[:, 0]))
    at, item, place, length = at[order], use[order, 0], use[order, 1], length[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return np.stack([at[first], item[first], place[first], at[last] + length[last] - at[first]], axis=1)


def _shards(texts: pd.Series, ids: dict[bytes, int]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Word counts of some documents, and their codes with a 0 after each."""
    sizes, codes, total = [], [], 0
    for data in texts:
        found = item_words(data)
        sizes.append(len(found))
        codes.append(np.fromiter(map(ids.get, found, repeat(0)), dtype=np.uint32, count=len(found)))
        codes.append(np.zeros(1, dtype=np.uint32))
        total += len(found)
        if total >= SHARD_WORDS:
            yield sizes, np.concatenate(codes)
            sizes, codes, total = [], [], 0
    if sizes:
        yield sizes, np.concatenate(codes)


def _described(sizes: list[int], matches: np.ndarray, names: list[str]) -> list[tuple]:
    firsts = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
    owner = np.searchsorted(firsts, matches[:, 0], "right") - 1
    out: list[tuple] = [(n, 0, [], []) for n in sizes]
    for doc in np.unique(owner):
        rows = matches[owner == doc]
        begin = rows[:, 0] - firsts[doc]
        steps = np.zeros(sizes[doc] + 1, dtype=np.int64)
        np.add.at(steps, begin, 1)
        np.add.at(steps, begin + rows[:, 3], -1)
        listed = sorted(
            (int(b), names[i], int(p), int(n)) for b, i, p, n in zip(begin, rows[:, 1], rows[:, 2], rows[:, 3])
        )
        out[doc] = (
            sizes[doc],
            int(np.count_nonzero(np.cumsum(steps[:-1]))),
            sorted({i for _, i, _, _ in listed}),
            [{"item": i, "start": b, "item_start": p, "length": n} for b, i, p, n in listed],
        )
    return out


def _finder(tests):
    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        block = tests.value
        for texts in batches:
            rows: list[tuple] = []
            for sizes, codes in _shards(texts, block.ids):
                rows += _described(sizes, shard_matches(codes, block), block.names)
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "matches"])

    return find


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    column: str,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` with a struct `column`: n_words, n_hit, items (sorted as strings), matches (the longest ones).

    Words are runs of letters, digits and bytes from 0x80 on, A-Z lowered. A document word counts as hit inside
    any occurrence of `window` consecutive item words; an item with fewer words is one window. Null or empty texts
    have no words and match nothing, on either side; items without an id go by the name "". Repeated items or ids
    count once in `items`. An empty benchmark gives zeros. All other columns pass through.

    A block's items are collected: at most about `block_bytes` of text (and one item); with more than one block
    the documents are written to the shared folder between the passes.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(pick(item_id).cast("string"), F.lit("")).alias("name"), utf8(item_text).alias("data")
    ).filter(F.length("data") > 0)
    size = items.agg(F.sum(F.length("data") + F.length("name"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out, parts = docs, []
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("name", "data"), F.lit(blocks)) == block)
        tests = TestSuffixes([(r["name"], bytes(r["data"])) for r in mine.distinct().collect()], window)
        parts.append(free_name(out, f"{column}_{block}") if blocks > 1 else column)
        out = out.withColumn(parts[-1], _finder(spark.sparkContext.broadcast(tests))(utf8(text)))
        if blocks > 1:
            out = stored(out, run_folder(spark) + f"/block-{block}")
    if blocks == 1:
        return out
    every = lambda name: F.array(*[F.col(f"`{p}`.{name}") for p in parts])
    matches = F.flatten(every("matches"))
    # words hit by several blocks count once: lengths of the joined spans, in order of their starts
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["length"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    covered = F.aggregate(spans, zero, lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"),
        F.greatest(s["to"], x["b"]).alias("to"),
    ))["n"]
    return out.withColumn(column, F.struct(
        F.col(f"`{parts[0]}`.n_words").alias("n_words"),
        covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(every("items")))).alias("items"),
        matches.alias("matches"),
    )).drop(*parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of any item, unchanged."""
    column = free_name(docs, "found__")
    found = with_matches(docs, benchmark, column, **options)
    return found.filter(F.col(f"`{column}`.n_hit") == 0).drop(column)
