"""Passages that occur more than once in a corpus, byte for byte, found as maximal repeats in enhanced suffix arrays.

A suffix array of the whole corpus fits nowhere, so it is dealt out by content. Every string of `length` bytes holds an
anchor, the place where the hash of the next CORE bytes is least, and equal strings hold the same one. Anchors whose bytes
occur once are dropped by a count. Around each other anchor a piece is cut that reaches as far as any string of `length`
bytes with it; equal pieces of a task are folded. Spark sorts the pieces by anchor and following bytes, which is the suffix
array of the anchors. A task scans it:

1. Common prefixes of neighbours and a stack give the tree of common-prefix intervals.
2. In each interval the pieces are put in the order of what stands before the anchor, and the common extensions to the left
   of neighbours in that order are taken. Where they end, left contexts differ: members that agree on enough bytes for
   `length` in all, and on no more to the left, are the occurrences of one maximal repeat.

A core that occurs more than LIMIT times, a licence line in a third of all texts for example, is split by content before
anything is gathered: into longer cores around it, each with a part of the strings that hold the anchor, again where still
needed, down to whole strings of `length` bytes, which are counted by Spark alone. Nothing is left out at any step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import free_name, give_back, pick, run_folder, stored, utf8

LENGTH = 200
CORE = 64
LIMIT = 50_000  # occurrences of a core whose pieces a task may hold, some 20 MB; copies of a text count once
SALTS = 8
_CHUNK = 1 << 20  # strings hashed at a time
_PLACE = np.uint64((1 << 24) - 1)
_FOLDED = 20_000  # pieces a task folds before it passes them on
_MEMBERS = 1 << 19  # interval members looked at together
_BASE = 0x9E3779B97F4A7C15
_SPANS = "array<struct<start:int,stop:int>>"


def core_sizes(length: int) -> list[int]:
    """Bytes of a core, level by level; the last are whole strings."""
    slack = length - (CORE if length >= 2 * CORE else (length + 1) // 2)
    sizes = []
    while True:
        sizes.append(length - slack)
        if not slack:
            return sizes
        slack //= 5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            grown = np.full((2, max(count, 2 * len(self.up))), _BASE, dtype=np.uint64)
            grown[1] = pow(_BASE, -1, 1 << 64)
            grown[:, 0] = 1
            self.up, self.down = np.multiply.accumulate(grown, axis=1)
        return self.up[:count], self.down[:count]


_POWERS = _Powers()


def _run_hashes(data: bytes, size: int) -> np.ndarray:
    """A hash of each run of `size` bytes; equal runs, equal hashes."""
    up, down = _POWERS.of(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(np.frombuffer(data, dtype=np.uint8) * down, out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * up[size - 1 :])


def anchors(data: bytes, length: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the cores that are least, the first of equal ones, in some string of `length` bytes."""
    places, hashes = [], []
    window = length - core + 1
    for begin in range(0, len(data) - length + 1, _CHUNK):
        found = _run_hashes(data[begin : begin + _CHUNK + length - 1], core)
        least, size = (found & ~_PLACE) | np.arange(len(found), dtype=np.uint64), 1
        strings = len(found) - window + 1
        while 2 * size <= window:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        least = np.minimum(least[:strings], least[window - size : window - size + strings])
        at = (least & _PLACE).astype(np.int64)
        at = at[np.append(True, at[1:] != at[:-1])]
        places.append(at + begin)
        hashes.append(found[at])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    where, first = np.unique(np.concatenate(places), return_index=True)
    return where, np.concatenate(hashes)[first].view(np.int64)


def cores_at(data: bytes, sizes: list[int], level: int, hot: list) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's cores of a level; hot[n] lists the cores of level n that are to be split."""
    length = sizes[-1]
    at, keys = anchors(data, length, sizes[0])
    for n in range(1, level + 1):
        parents = at[np.isin(keys, np.asarray(hot[n - 1], dtype=np.int64))]
        slack, finer = length - sizes[n - 1], length - sizes[n]
        shifts = np.arange(0, slack + 1, finer + 1)
        at = np.unique(parents[:, None] - shifts)
        at = at[(at >= 0) & (at + sizes[n] <= len(data))]
        found = [xxhash.xxh3_64_intdigest(data[a : a + sizes[n]]) for a in at.tolist()]
        keys = np.array(found, dtype=np.uint64).view(np.int64)
    return at, keys


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _sketched(sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row: digest of the text, its size, its distinct cores and how often it has each."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, bytes_, cores, times = [], [], [], []
            for value in batch.column(1):
                data = value.as_py()
                digests.append(hashlib.sha256(data).digest())
                bytes_.append(len(data))
                own, many = np.unique(anchors(data, sizes[-1], sizes[0])[1], return_counts=True)
                cores.append(own)
                times.append(many)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(digests, pa.binary()), pa.array(bytes_, pa.int64()),
                _lists(cores, pa.int64()), _lists(times, pa.int64()),
            ], names=["doc_id", "digest", "n_bytes", "cores", "times"])
        give_back()

    return sketch


def _split(sizes: list[int], level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cores of a level of texts that have hot ones of the level before."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores, times = [], []
            for value, hot in zip(batch.column(2), batch.column(3)):
                own, many = np.unique(cores_at(value.as_py(), sizes, level, hot.as_py())[1], return_counts=True)
                cores.append(own)
                times.append(many)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(cores, pa.int64()), _lists(times, pa.int64())],
                names=["key", "n", "cores", "times"],
            )
        give_back()

    return split


def _pieces(folded: dict) -> pa.RecordBatch:
    keys = list(folded)
    held = list(folded.values())
    return pa.RecordBatch.from_arrays([
        pa.array([k for k, _, _ in keys], pa.int64()), pa.array([r for _, r, _ in keys], pa.binary()),
        pa.array([b for _, _, b in keys], pa.binary()), pa.array([h[0] for h in held], pa.int64()),
        pa.array([h[1] for h in held], pa.list_(pa.binary())), pa.array([h[2] for h in held], pa.list_(pa.int32())),
    ], names=["core", "following", "before", "n", "owners", "places"])


_PIECES = "core long, following binary, before binary, n long, owners array<binary>, places array<int>"


def _cut(sizes: list[int], level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces around the chosen cores of texts: the bytes from the core on, and those before it, nearest first.

    On the last level a piece is the string itself, of any hot core, and nothing stands before it.
    """
    length, slack, last = sizes[-1], sizes[-1] - sizes[level], level + 1 == len(sizes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: dict[tuple, list] = {}
        for batch in batches:
            for owner, n, value, hot, chosen in zip(*(c.to_pylist() for c in batch.columns)):
                at, keys = cores_at(value, sizes, level, hot)
                if not last:
                    mine = np.isin(keys, np.asarray(chosen, dtype=np.int64))
                    at, keys = at[mine], keys[mine]
                for a, key in zip(at.tolist(), keys.tolist()):
                    piece = key, value[a : a + length], value[max(0, a - slack) : a][::-1]
                    if len(piece[1]) + len(piece[2]) < length:
                        continue
                    held = folded.setdefault(piece, [0, [], []])
                    held[0] += n
                    held[1].append(owner)
                    held[2].append(a)
                if len(folded) >= _FOLDED:
                    yield _pieces(folded)
                    folded = {}
        yield _pieces(folded)
        give_back()

    return cut


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width)


def _common(table: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours; -1 between groups."""
    if not table.shape[1]:
        return np.where(groups[1:] == groups[:-1], 0, -1)
    same = table[1:] == table[:-1]
    first = np.where(same.all(axis=1), table.shape[1], (~same).argmax(axis=1))
    return np.where(groups[1:] == groups[:-1], np.minimum(first, np.minimum(sizes[1:], sizes[:-1])), -1)


def stack_scan(common: np.ndarray, least: int) -> np.ndarray:
    """Rows (depth, first, last) of the common-prefix intervals at least that deep, inner ones first."""
    out, stack = [], []
    for n, depth in enumerate([*common.tolist(), -1]):
        first = n
        while stack and stack[-1][0] > depth:
            held, first = stack.pop()
            out.append((held, first, n))
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


class _Minima:
    """Least values of ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.steps = [np.append(values, -1)]
        while 2 ** len(self.steps) <= len(values):
            half, before = 2 ** (len(self.steps) - 1), self.steps[-1]
            self.steps.append(np.minimum(before[:-half], before[half:]))

    def between(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of values[first:end], which must not be empty."""
        step = np.frexp((end - first).astype(np.float64))[1] - 1
        out = np.empty(len(first), dtype=np.int64)
        for s in np.unique(step):
            mine = step == s
            out[mine] = np.minimum(self.steps[s][first[mine]], self.steps[s][end[mine] - 2**s])
        return out


class PieceTree:
    """Enhanced suffix array of pieces that stand in the order of (core, following)."""

    def __init__(self, core: np.ndarray, following: list[bytes], before: list[bytes], length: int, least: int):
        sizes = np.array([len(s) for s in following], dtype=np.int64)
        self.length, self.common = length, _common(_padded(following, length), sizes, core)
        self.intervals = stack_scan(self.common, least)
        width = max(map(len, before), default=0)
        left, left_sizes = _padded(before, width), np.array([len(s) for s in before], dtype=np.int64)
        whole = np.concatenate([
            core.astype(">i8").view(np.uint8).reshape(-1, 8), left,
            (left_sizes + 1).astype(">i4").view(np.uint8).reshape(-1, 4),
        ], axis=1)
        order = np.argsort(np.ascontiguousarray(whole).view(f"S{width + 12}").ravel(), kind="stable")
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.left = _Minima(_common(left[order], left_sizes[order], core[order]))

    def by_left(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Interval members in the order of their left contexts: pieces, depths, common bytes to the left with the next
        member (-1 after the last one of an interval). Some intervals at a time."""
        sizes = self.intervals[:, 2] - self.intervals[:, 1] + 1
        blocks = np.cumsum(sizes) // _MEMBERS
        for block in np.unique(blocks):
            depth, first, last = self.intervals[blocks == block].T
            many = last - first + 1
            which = np.repeat(np.arange(len(many)), many)
            piece = np.arange(len(which)) + np.repeat(first - (np.cumsum(many) - many), many)
            order = np.lexsort((self.rank[piece], which))
            piece, which = piece[order], which[order]
            shared = np.full(len(piece), -1, dtype=np.int64)
            near = np.flatnonzero(which[1:] == which[:-1])
            if len(near):
                shared[near] = self.left.between(self.rank[piece[near]], self.rank[piece[near + 1]])
            yield piece, depth[which], shared

    def extents(self, n: np.ndarray, following: list[bytes], before: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes before and after the start of each piece's core that repeats of `length` bytes cover; n: occurrences."""
        left, right = np.zeros((2, len(n)), dtype=np.int64)
        often = n > 1
        left[often] = np.array([len(s) for s in before], dtype=np.int64)[often]
        right[often] = np.array([len(s) for s in following], dtype=np.int64)[often]
        for piece, depth, shared in self.by_left():
            most = np.maximum(shared, np.append(-1, shared[:-1]))
            enough = (most >= 0) & (most + depth >= self.length)
            np.maximum.at(left, piece[enough], most[enough])
            np.maximum.at(right, piece[enough], depth[enough])
        return left, right

    def groups(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Maximal repeats: bytes before and after the start of the core, and all pieces with them."""
        right = _Minima(self.common)
        for piece, depth, shared in self.by_left():
            for left, first, last in stack_scan(shared[:-1], 0).tolist():
                members = piece[first : last + 1]
                if left + depth[first] < self.length:
                    continue
                low, high = members.min(), members.max()
                # all in one inner interval: there they have more bytes in common to the right
                if right.between(np.array([low]), np.array([high]))[0] == depth[first]:
                    yield int(left), int(depth[first]), members


def _whole_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of a task in blocks that end between cores."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cores = batch.column(0).to_numpy()
        turn = np.flatnonzero(cores[1:] != cores[:-1])
        same = bool(held) and held[-1].column(0)[-1].as_py() == cores[0]
        end = int(turn[-1]) + 1 if len(turn) else 0 if same else -1
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if end > 0:
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held = []
        held.append(batch.slice(max(end, 0)))
    if held:
        yield pa.Table.from_batches(held)


def _scanned(length: int, core: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, start, stop): what repeats cover around each occurrence of a core."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cores(batches):
            cores, n = (table.column(c).to_numpy() for c in ("core", "n"))
            following, before, owners, places = (table.column(c).to_pylist() for c in ("following", "before", "owners", "places"))
            left, right = PieceTree(cores, following, before, length, core).extents(n, following, before)
            hit = np.flatnonzero(right)
            many = np.array([len(places[h]) for h in hit], dtype=np.int64)
            at = np.array([p for h in hit for p in places[h]], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([o for h in hit for o in owners[h]], pa.binary()),
                pa.array(at - np.repeat(left[hit], many), pa.int32()), pa.array(at + np.repeat(right[hit], many), pa.int32()),
            ], names=["key", "start", "stop"])
        give_back()

    return scan


def _grouped(length: int, core: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(repeat, n_bytes, key, start): the members of maximal repeats."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cores(batches):
            cores, n = (table.column(c).to_numpy() for c in ("core", "n"))
            following, before, owners, places = (table.column(c).to_pylist() for c in ("following", "before", "owners", "places"))
            # one row an occurrence, two for the only one in a text that has copies
            twice = [2 if len(o) == 1 and m > 1 else len(o) for o, m in zip(owners, n)]
            source = np.repeat(np.arange(len(cores)), twice)
            nth = np.arange(len(source)) - np.repeat(np.cumsum(twice) - twice, twice)
            following, before = [following[s] for s in source], [before[s] for s in source]
            out: tuple[list, ...] = ([], [], [], [])
            for left, right, members in PieceTree(cores[source], following, before, length, core).groups():
                text = before[members[0]][:left][::-1] + following[members[0]][:right]
                name = xxhash.xxh3_64_intdigest(text)
                for s, k in zip(source[members].tolist(), nth[members].tolist()):
                    k = min(k, len(owners[s]) - 1)
                    for column, value in zip(out, (name, left + right, owners[s][k], places[s][k] - left)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(out[0], dtype=np.uint64).view(np.int64)), pa.array(out[1], pa.int64()),
                pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32()),
            ], names=["repeat", "n_bytes", "key", "start"])
        give_back()

    return scan


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping spans joined, and the digest of what remains of a text."""
    for batch in batches:
        removed, runs, digests, spans = [], [], [], []
        for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            joined = joined_spans([(s["start"], s["stop"]) for s in found])
            removed.append(sum(b - a for a, b in joined))
            runs.append(len(joined))
            digests.append(hashlib.sha256(without(data, joined)).digest())
            spans.append([{"start": a, "stop": b} for a, b in joined])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
            pa.array(digests, pa.binary()), pa.array(spans, kind),
        ], names=["key", "n_removed", "n_spans", "kept", "spans"])
    give_back()


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        else:
            out.append((start, stop))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *[place for span in spans for place in span], len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def _text_key(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, 16)


def _chosen(rows: DataFrame, limit: int) -> DataFrame:
    """Per key the cores that occur more than once: `cores`, in up to `limit` places of distinct texts, and `split`, in more."""
    each = rows.select("key", "n", F.explode(F.arrays_zip("cores", "times")).alias("z")).select(
        "key", "n", F.col("z.cores").alias("core"), F.col("z.times").alias("times")
    )
    many = each.groupBy("core").agg(F.sum(F.col("n") * F.col("times")).alias("total"), F.sum("times").alias("pieces"))
    found = each.select("key", "core").join(many.filter("total > 1").select("core", "pieces"), "core")
    return found.groupBy("key").agg(
        F.collect_list(F.when(F.col("pieces") <= limit, F.col("core"))).alias("cores"),
        F.collect_list(F.when(F.col("pieces") > limit, F.col("core"))).alias("split"),
    )


class _Corpus:
    """Texts with repeated cores, level by level; `pieces` is what a scan takes, `strings` what is left to count."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str, length: int, limit: int):
        if length < 2:
            raise ValueError("a repeat has at least 2 bytes")
        self.sizes, self.folder = core_sizes(length), run_folder(docs.sparkSession) + "/repeats"
        self.kind = docs.select(pick(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
        rows = docs.select(pick(doc_id).alias("doc_id"), utf8(text).alias("data"))
        schema = f"doc_id {self.kind}, digest binary, n_bytes long, cores array<long>, times array<long>"
        self.rows = stored(rows.mapInArrow(_sketched(self.sizes), schema), f"{self.folder}/rows")
        distinct = self.rows.groupBy(F.substring("digest", 1, 16).alias("key")).agg(
            F.count("*").alias("n"), F.first("cores").alias("cores"), F.first("times").alias("times")
        )
        found = _chosen(stored(distinct, f"{self.folder}/distinct"), limit)
        found = stored(found, f"{self.folder}/cores-0")
        folded = rows.groupBy(_text_key(F.col("data")).alias("key")).agg(F.first("data").alias("data"), F.count("*").alias("n"))
        texts = folded.join(found, "key").select("key", "n", "data", F.array().cast("array<array<long>>").alias("hot"), "cores", "split")
        self.texts = stored(texts, f"{self.folder}/texts-0")
        self.levels = [self.texts]
        while len(self.levels) < len(self.sizes):
            hot = self.levels[-1].filter(F.size("split") > 0)
            if hot.isEmpty():
                break
            level = len(self.levels)
            texts = hot.select("key", "n", "data", F.concat("hot", F.array("split")).alias("hot"))
            if level + 1 == len(self.sizes):
                texts = texts.withColumns({"cores": F.array().cast("array<long>"), "split": F.array().cast("array<long>")})
            else:
                parts = texts.mapInArrow(_split(self.sizes, level), "key binary, n long, cores array<long>, times array<long>")
                texts = texts.join(_chosen(stored(parts, f"{self.folder}/parts-{level}"), limit), "key")
            self.levels.append(stored(texts, f"{self.folder}/texts-{level}"))

    def _cut(self, level: int) -> DataFrame:
        texts = self.levels[level].select("key", "n", "data", "hot", "cores")
        return texts.mapInArrow(_cut(self.sizes, level), _PIECES)

    def pieces(self) -> Iterator[tuple[DataFrame, int]]:
        """Sorted pieces of each level with the size of its cores; whole strings are left out."""
        for level in range(min(len(self.levels), len(self.sizes) - 1)):
            pieces = self._cut(level)
            yield pieces.repartition("core").sortWithinPartitions("core", "following"), self.sizes[level]

    def strings(self) -> DataFrame | None:
        """(following, key, place): strings that occur more than once, of cores split to the end."""
        if len(self.levels) < len(self.sizes):
            return None
        pieces = stored(self._cut(len(self.sizes) - 1).drop("core", "before"), f"{self.folder}/strings")
        many = pieces.groupBy("following").agg(F.sum("n").alias("total")).filter("total > 1").select("following")
        each = pieces.join(many, "following").select("following", F.explode(F.arrays_zip("owners", "places")).alias("z"))
        return each.select("following", F.col("z.owners").alias("key"), F.col("z.places").alias("place"))


def repeated_spans(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, limit: int = LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: one row per row of `docs`.

    `spans` are the maximal runs of bytes [start, stop) covered by strings of `length` bytes that also start anywhere else in
    the table, in the same text too; `kept_sha256` is the digest of the other bytes (lower-case hex). Texts count as UTF-8;
    null and empty ones have no bytes and no spans, nor have texts shorter than `length`. Rows with equal texts are occurrences
    of each other, whatever their ids; so are rows repeated as a whole. Rows without an id are treated like others. Other
    columns are not read; an empty table gives no rows. A text's own anchors and spans are held in memory, 2 GB at most.
    """
    corpus = _Corpus(docs, text, doc_id, length, limit)
    covered = None
    for pieces, core in corpus.pieces():
        spans = pieces.mapInArrow(_scanned(length, core), "key binary, start int, stop int")
        covered = spans if covered is None else covered.union(spans)
    strings = corpus.strings()
    if strings is not None:
        covered = covered.union(strings.select("key", F.col("place").alias("start"), (F.col("place") + length).cast("int").alias("stop")))
    spans = stored(covered.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("found")), f"{corpus.folder}/spans")
    texts = corpus.texts.select("key", "data").join(spans, "key")
    found = texts.mapInArrow(_kept, f"key binary, n_removed long, n_spans long, kept binary, spans {_SPANS}")
    # a text with many copies meets its spans in SALTS tasks
    found = stored(found, f"{corpus.folder}/found").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    rows = corpus.rows.select("doc_id", "digest", "n_bytes", F.substring("digest", 1, 16).alias("key"), salt.alias("salt"))
    return rows.join(found, ["key", "salt"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.lower(F.hex(F.coalesce("kept", "digest"))).alias("kept_sha256"),
        F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"),
    )


def repeat_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, limit: int = LIMIT
) -> DataFrame:
    """repeat (hash of its bytes), n_bytes, doc_id, start: every occurrence of every maximal repeat of `length` bytes or more.

    Repeats are looked at within the reach of an anchor (`length` bytes from it on, `length` less its core before it), so a
    longer passage shows as several overlapping repeats. Rows as in `repeated_spans`; rows repeated as a whole stand once.
    """
    corpus = _Corpus(docs, text, doc_id, length, limit)
    groups = None
    for pieces, core in corpus.pieces():
        found = pieces.mapInArrow(_grouped(length, core), "repeat long, n_bytes long, key binary, start int")
        groups = found if groups is None else groups.union(found)
    strings = corpus.strings()
    if strings is not None:
        groups = groups.union(strings.select(
            F.xxhash64("following").alias("repeat"), F.lit(length).cast("long").alias("n_bytes"), "key", F.col("place").alias("start")
        ))
    ids = corpus.rows.select("doc_id", F.substring("digest", 1, 16).alias("key"))
    return groups.distinct().join(ids, "key").select("repeat", "n_bytes", "doc_id", "start").distinct()


def _remains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *rest, texts, spans = batch.columns
        out = [without(t, [(s["start"], s["stop"]) for s in f or ()]) for t, f in zip(texts.to_pylist(), spans.to_pylist())]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.binary())], names=[str(n) for n in range(len(rest) + 1)])


def remove_repeats(
    docs: DataFrame, column: str = "kept", text: str = "text", length: int = LENGTH, limit: int = LIMIT
) -> DataFrame:
    """`docs` with a binary `column`: the bytes of the text that no string of `length` bytes found elsewhere covers.

    All occurrences go, so a passage found twice is kept nowhere. A cut may fall inside a character. A `column` that exists
    already (Spark ignores case) is replaced. Other columns and the number of rows stay.
    """
    data = free_name(docs, "data__")
    key = free_name(docs, "key__")
    spans = free_name(docs, "spans__")
    keyed = docs.withColumn(data, utf8(text)).withColumn(key, _text_key(F.col(data)))
    found = repeated_spans(keyed, text, key, length, limit).filter("n_spans > 0").select(
        F.col("doc_id").alias(key), F.col("spans").alias(spans)
    )
    found = found.groupBy(key).agg(F.first(spans).alias(spans))
    joined = keyed.join(found, key, "left")
    names = [c for c in docs.columns if c.lower() != column.lower()]
    rows = joined.select(*[pick(c) for c in names], pick(data), pick(spans))
    schema = docs.select(*[pick(c) for c in names]).schema
    plain = rows.toDF(*[str(n) for n in range(len(names) + 2)])
    kept = type(schema)([type(f)(str(n), f.dataType, True) for n, f in enumerate(schema.fields)]).add(str(len(names)), "binary")
    return plain.mapInArrow(_remains, kept).toDF(*names, column)
