"""Near-duplicates by MinHash with tensored tables, confirmed on whole shingle sets.

Two collections of n keys, each made of ROWS minimum hashes, give n**2 tables: table (i, j) has the key (left i, right j).
So 2 * 12 * 3 = 72 minimum hashes do the work of 144 tables with 6 rows each, which would take 864. Two texts of similarity
s meet in a table with probability (1 - (1 - s**3)**n)**2; n follows the threshold so that all but 0.002 % of the pairs
that are just similar do: 12 at 0.85, 16 at 0.8.

1. Texts become sets of 64-bit shingle hashes; equal sets are one representative from here on.
2. Halves of keys that no other representative has are dropped, the rest combine into the tables' keys.
3. Links are confirmed in rounds. In each, a representative asks one member of the leading component of a bucket it is in,
   the one it meets in most buckets. Confirmed links join components, and buckets of one component are done with.
4. What is still apart after the rounds is compared across components: the pairs of a bucket whose sizes and sketches allow
   the similarity, each once, found by the half keys of one collection. The parity sketch (bit h(x) flips for each shingle x) bounds the shingles that only one side
   has from below, so it drops no link; the 256-bit MinHash sketch serves where sets are large. So a large group of copies
   costs a few comparisons for each member, and no link that the tables find between components is left unconfirmed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import free_name, give_back, pick, run_folder, stored, utf8, words
from tidegauge.llm.graph import components

SHINGLE = 5
TABLE_MISSES = 2.5e-5  # share of just similar pairs that may meet in no table
MOST_KEYS = 100  # on either side; enough from similarity 0.5 on
ROWS = 3  # minimum hashes in half a key
SIMILAR = (85, 100)  # intersection to union, at least
ASKING_ROUNDS = 4
SKETCH_BITS = 256
SKETCH_MISSES = 1e-8  # share of just similar pairs whose sketches may differ in more bits than `sketch_apart` allows
PARITY_BITS = 1024
_SKETCHES = [f"s{n}" for n in range(SKETCH_BITS // 64)]
_PARITIES = [f"o{n}" for n in range(PARITY_BITS // 64)]
KNOWN_WORDS = 100_000
ROWS_AT_ONCE = 500  # texts whose sets a task holds
_CHUNK = 2048

_RNG = np.random.Generator(np.random.PCG64(20240101))
_ODD = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASHES = 2 * MOST_KEYS * ROWS  # hash functions of keys; those of the sketch follow
_FACTOR = _RNG.integers(0, 1 << 63, (_HASHES + SKETCH_BITS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, (_HASHES + SKETCH_BITS, 1), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(data: bytes, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words; of all words as one run, if there are fewer."""
    found = words(data)
    if not found:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(SHINGLE, len(found))
    runs = np.full(len(found) - width + 1, width, dtype=np.uint64)
    for n in range(width):
        runs += codes[n : len(codes) - width + 1 + n] * _ODD[n]
    return np.unique(_mixed(runs))


def minima(hashes: np.ndarray, first: int, count: int) -> np.ndarray:
    """The least value of each of `count` hash functions over a set."""
    least = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        values = hashes[at : at + _CHUNK] * _FACTOR[first : first + count]
        values += _SHIFT[first : first + count]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def keys_a_side(similar: tuple[int, int]) -> int:
    """The fewest keys on either side that leave at most TABLE_MISSES of the pairs that are just similar apart."""
    part, whole = similar
    for n in range(1, MOST_KEYS + 1):
        if 0 < part <= whole and 1 - (1 - (1 - (part / whole) ** ROWS) ** n) ** 2 <= TABLE_MISSES:
            return n
    raise ValueError(f"similar = {similar}: not a share, or one too low for {MOST_KEYS} keys to find")


def half_keys(least: np.ndarray) -> np.ndarray:
    """Rows of minimum hashes to rows of half keys, each of which names its place in the collections."""
    parts = least.reshape(len(least), least.shape[1] // ROWS, ROWS)
    keys = np.arange(parts.shape[1], dtype=np.uint64) * _ODD[8]
    for n in range(ROWS):
        keys = keys + parts[:, :, n] * _ODD[9 + n]
    return _mixed(keys).view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit of each of SKETCH_BITS more minimum hashes, as four longs."""
    bits = _mixed(minima(hashes, _HASHES, SKETCH_BITS)) >> np.uint64(63)
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketch_apart(similar: tuple[int, int]) -> int:
    """In how many bits the sketches of a similar pair differ at most: more happens to SKETCH_MISSES of the pairs that are
    just similar. Each bit differs with a probability of half the dissimilarity: 19 of 256 on average at 0.85, 26 at 0.8."""
    part, whole = similar
    differs = (whole - part) / (2 * whole)
    chance = lambda n: comb(SKETCH_BITS, n) * differs**n * (1 - differs) ** (SKETCH_BITS - n)
    most, beyond = SKETCH_BITS, 0.0
    while most and beyond + chance(most) <= SKETCH_MISSES:
        beyond += chance(most)
        most -= 1
    return most


def parity(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of PARITY_BITS places, as longs."""
    odd = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _described(n_keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    hashes = 2 * n_keys * ROWS

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sizes, digests, least = [], [], []
            for data in batch.column(1):
                found = shingles(data.as_py(), known)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                least.append(minima(found, 0, hashes))
            keys = half_keys(np.array(least, dtype=np.uint64).reshape(-1, hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(list(keys))],
                names=["doc_id", "n_shingles", "digest", "halves"],
            )
        give_back()

    return describe


_DESCRIBED = "doc_id long, n_shingles long, digest binary, halves array<long>"


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    names = [*_SKETCHES, *_PARITIES]
    for batch in _in_slices(batches):
        sets = [shingles(data.as_py(), known) for data in batch.column(1)]
        bits = np.array([np.concatenate([sketch(s), parity(s)]) for s in sets], dtype=np.int64).reshape(-1, len(names))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)]
            + [pa.array(bits[:, n]) for n in range(len(names))],
            names=["rep", "size", "set", *names],
        )
    give_back()


_WHOLE_SETS = ", ".join(["rep long, size long, set array<long>", *[f"{n} long" for n in [*_SKETCHES, *_PARITIES]]])


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once."""
    return rows.join(rows.groupBy(key).count().filter("count > 1").select(key), key, "left_semi")


def _buckets(reps: DataFrame, n_keys: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rep, left, right): half keys that others have too; (key, rep): members of the tables' buckets with at least two."""
    halves = reps.select(F.col("doc_id").alias("rep"), F.posexplode("halves").alias("slot", "half"))
    sides = stored(
        _shared(halves, "half").groupBy("rep").agg(
            F.collect_set(F.when(F.col("slot") < n_keys, F.col("half"))).alias("left"),
            F.collect_set(F.when(F.col("slot") >= n_keys, F.col("half"))).alias("right"),
        ),
        f"{folder}/sides",
    )
    keyed = sides.select("rep", "right", F.explode("left").alias("l")).select("rep", "l", F.explode("right").alias("r"))
    return sides, stored(_shared(keyed.select(F.xxhash64("l", "r").alias("key"), "rep"), "key"), f"{folder}/buckets")


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough: part * i >= whole ... solved for the intersection i."""
    part, whole = similar
    a = sets.select(F.col("rep").alias("a"), F.col("size").alias("size_a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("size").alias("size_b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return (
        pairs.join(a, "a").join(b, "b")
        .filter((whole + part) * both >= part * (F.col("size_a") + F.col("size_b")))
        .select("a", "b")
    )


def _asked(members: DataFrame, tested: DataFrame | None, turn: int) -> DataFrame:
    """(a, b): for each representative outside the leading component of a bucket one of that component's members."""
    heads = members.groupBy("key").agg(
        F.min(F.struct("label", F.xxhash64("rep", F.lit(turn)).alias("draw"), "rep")).alias("head"),
        F.max("label").alias("last"),
    ).filter("last > head.label")
    asked = (
        members.join(heads.select("key", F.col("head.label").alias("lead"), F.col("head.rep").alias("head")), "key")
        .filter("label <> lead").groupBy("rep", "head").count()
        .select("rep", "count", F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b"))
    )
    if tested is not None:
        asked = asked.join(tested, ["a", "b"], "left_anti")
    best = asked.groupBy("rep").agg(F.max(F.struct("count", "a", "b")).alias("p"))
    return best.select("p.a", "p.b").distinct()


def _left_over(
    sides: DataFrame, labels: DataFrame, sets: DataFrame, tested: DataFrame, similar: tuple[int, int]
) -> DataFrame:
    """(a, b): pairs of a bucket in different components that sizes and sketches allow, not compared so far.

    Who shares a bucket shares a half key of either collection. So rows meet by their left halves, a pair at the least one it
    has in common only, and the right halves are looked at there. In the rows of a half only those outside its commonest
    component meet the others: a large component costs each of them once, and nothing among its own.
    """
    part, whole = similar
    facts = sets.drop("set").join(sides, "rep").join(labels, "rep")
    rows = facts.withColumn("half", F.explode("left"))
    leads = rows.groupBy("half", "label").count().groupBy("half").agg(
        F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("labels")
    ).filter("labels > 1").select("half", F.col("most.label").alias("lead"))
    rows = rows.join(leads, "half")
    named = lambda df, side: df.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns])
    one, two = named(rows.filter("label <> lead"), "a"), named(rows, "b")
    differ = lambda names: reduce(add, [F.bit_count(F.col(f"{n}_a").bitwiseXOR(F.col(f"{n}_b"))) for n in names])
    fits = (
        (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("lead_b")) | (F.col("rep_a") < F.col("rep_b")))
        & (whole * F.least("size_a", "size_b") >= part * F.greatest("size_a", "size_b"))
        # of similar sets at most this share of all shingles stands on one side only
        & ((whole + part) * differ(_PARITIES) <= (whole - part) * (F.col("size_a") + F.col("size_b")))
        & (differ(_SKETCHES) <= sketch_apart(similar))
        & F.arrays_overlap("right_a", "right_b")
        & (F.array_min(F.array_intersect("left_a", "left_b")) == F.col("half_a"))
    )
    pairs = one.join(two, (F.col("half_a") == F.col("half_b")) & fits).select(
        F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")
    )
    return pairs.join(tested, ["a", "b"], "left_anti")


def _joined(labels: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """Labels after the components at the ends of links have become one."""
    ends = links.join(labels.select(F.col("rep").alias("a"), F.col("label").alias("u")), "a").join(
        labels.select(F.col("rep").alias("b"), F.col("label").alias("v")), "b"
    )
    roots = components(ends.select("u", "v"), f"{folder}/graph")
    moved = labels.join(roots, labels["label"] == roots["node"], "left")
    return stored(moved.select("rep", F.coalesce("root", "label").alias("label")), f"{folder}/labels")


def _labels(sides: DataFrame, buckets: DataFrame, sets: DataFrame, similar: tuple[int, int], folder: str) -> DataFrame:
    """(rep, label): the component of every representative in a bucket."""
    labels = sets.select("rep", F.col("rep").alias("label")).distinct()
    tested: DataFrame | None = None
    for turn in range(ASKING_ROUNDS):
        pairs = stored(_asked(buckets.join(labels, "rep"), tested, turn), f"{folder}/asked-{turn}/pairs")
        if pairs.isEmpty():
            break
        tested = pairs if tested is None else tested.union(pairs)
        links = stored(_confirmed(pairs, sets, similar), f"{folder}/asked-{turn}/links")
        if links.isEmpty():
            break
        labels = _joined(labels, links, f"{folder}/asked-{turn}")
    if tested is None:
        return labels  # no bucket at all
    pairs = stored(_left_over(sides, labels, sets, tested, similar), f"{folder}/rest/pairs")
    if pairs.isEmpty():
        return labels
    links = stored(_confirmed(pairs, sets, similar), f"{folder}/rest/links")
    return labels if links.isEmpty() else _joined(labels, links, f"{folder}/rest")


def near_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: tuple[int, int] = SIMILAR
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), kept (whether that is its own id).

    Texts are linked if part / whole of their shingles agree (`similar`, confirmed on the whole sets). Null, empty and
    wordless texts have no shingles and stay alone. Ids are whole numbers. Rows without an id stay alone too, with a null
    component, and are kept. Rows repeated with an id share its component; with different texts they join the groups of
    all of them. Other columns are not read; an empty table gives no rows. The lower `similar`, the more tables: 144 at 0.85,
    256 at 0.8; ValueError where MOST_KEYS are too few.
    """
    n_keys = keys_a_side(similar)
    folder = run_folder(docs.sparkSession) + "/near"
    rows = docs.select(pick(doc_id).cast("long").alias("doc_id"), utf8(text).alias("data"))
    described = stored(rows.mapInArrow(_described(n_keys), _DESCRIBED), f"{folder}/described")
    full = described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), f"{folder}/classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sides, buckets = _buckets(reps, n_keys, folder)
    members = buckets.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_hash")
    sets = stored(rows.join(members, "doc_id", "left_semi").mapInArrow(_whole_sets, _WHOLE_SETS), f"{folder}/sets")
    labels = _labels(sides, buckets, sets, similar, folder)
    grouped = (
        full.select("doc_id", "n_shingles", "digest").join(classes, "digest")
        .join(labels, "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    )
    alone = described.filter("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return grouped.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: tuple[int, int] = SIMILAR
) -> DataFrame:
    """The documents near_groups keeps, one of each group, with all their columns."""
    name = free_name(docs, "gone__")
    gone = near_groups(docs, text, doc_id, similar).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("shuffle_hash"), pick(doc_id).cast("long") == F.col(name), "left_anti")
