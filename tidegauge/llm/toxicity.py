"""A linear toxicity classifier that is held to the same score when a group is named by another one.

Features are the distinct words of a text and the first bytes of its longer words (stems). The loss is the weighted
logistic loss plus, for sentences that name a group, the squared change of the score when the identity term is swapped
for others of its kind; so no weight can rest on the mere mention of a group.

The model learns from at most `sample` labelled texts, taken in the order of a hash of their ids; it holds at most
FEATURES weights. Spark extracts, counts and picks the features; the driver gets only the picked ones of each text, and
the swapped pairs grouped by what they change. Scoring is one pass over all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import free_name, give_back, pick, run_folder, stored, utf8

SAMPLE = 20_000  # most labelled texts the fit sees
FEATURES = 1 << 16  # most weights of a model
LEAST_TEXTS = 3  # a feature in fewer sampled texts has no weight
CHANCE = 6.0  # log-likelihood a feature must have beyond what chance gives
STEPS = 200
PENALTY = 1e-5  # of squared weights
SWAP_PENALTY = 1.0  # of squared changes of the score
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
KNOWN_WORDS = 100_000

# Terms that name groups, by kind and form; a term is swapped for the others of its line.
IDENTITY_TERMS = (
    "women men girls boys", "woman man girl boy", "female male", "gay lesbian bisexual straight transgender",
    "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
    "black white asian latino african european", "immigrants refugees foreigners natives citizens",
    "femmes hommes filles garçons", "musulmans chrétiens juifs", "immigrés étrangers réfugiés",
    "frauen männer mädchen jungen", "muslime christen juden", "einwanderer ausländer flüchtlinge",
    "mujeres hombres chicas chicos", "musulmanes cristianos judíos", "inmigrantes extranjeros refugiados",
)
_KIND = {w: line.split() for line in IDENTITY_TERMS for w in line.split()}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SENTENCE = re.compile(rb"[.!?\n]+")


def word_features(word: bytes) -> list[int]:
    """32-bit hashes of the word and of its stems."""
    return [zlib.crc32(word)] + [zlib.crc32(b"%d " % n + word[:n]) for n in PREFIXES if len(word) > n]


def text_words(data: bytes) -> set[bytes]:
    return set(_WORD.findall(data.lower()))


def features(found: set[bytes]) -> np.ndarray:
    return np.array(sorted(set(chain.from_iterable(map(word_features, found)))), dtype=np.uint32)


def swaps(data: bytes) -> list[tuple[bytes, bytes]]:
    """Each sentence that names a group, beside itself with the term swapped for another of its kind."""
    out = []
    for sentence in _SENTENCE.split(data.lower()):
        found = _WORD.findall(sentence)
        for at, word in enumerate(found):
            name = word.decode("utf-8", "replace")
            for other in _KIND.get(name, ()):
                if other != name:
                    out.append((b" ".join(found), b" ".join([*found[:at], other.encode(), *found[at + 1 :]])))
    return out


def _extracted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for data in texts:
            pairs = list(dict.fromkeys(swaps(data)))
            rows.append((
                features(text_words(data)).tobytes(),
                [
                    {"a": np.setdiff1d(x, y).tobytes(), "b": np.setdiff1d(y, x).tobytes()}
                    for x, y in ((features(text_words(a)), features(text_words(b))) for a, b in pairs)
                ],
            ))
        yield pd.DataFrame(rows, columns=["features", "pairs"])
    give_back()


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts of a batch, and in how many toxic ones, each feature is."""
    for batch in batches:
        lists = [_ids(f) for f in batch["features"]]
        every, counts = np.unique(np.concatenate(lists), return_counts=True)
        toxic = [found for found, label in zip(lists, batch["label"]) if label]
        hits = np.zeros(len(every), dtype=np.int64)
        if toxic:
            found, times = np.unique(np.concatenate(toxic), return_counts=True)
            hits[np.searchsorted(every, found)] = times
        yield pd.DataFrame({"feature": every.astype(np.int64), "n": counts, "hits": hits})
    give_back()


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint32)


def told(counts: np.ndarray, hits: np.ndarray, base: float) -> np.ndarray:
    """Log-likelihood ratio of features against the classes: how much they can tell. `base` is the share of toxic texts."""
    share = np.clip(hits / counts, 1e-9, 1 - 1e-9)
    return hits * np.log(share / base) + (counts - hits) * np.log((1 - share) / (1 - base))


def _places(found: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where features stand in the sorted array, and whether they do."""
    at = np.minimum(np.searchsorted(kept, found), max(len(kept) - 1, 0))
    return at, kept[at] == found if len(kept) else np.zeros(len(found), dtype=bool)


class Rows:
    """Sparse 0/1 rows over the kept features."""

    def __init__(self, lists: list[np.ndarray], kept: np.ndarray):
        columns = []
        for found in lists:
            at, there = _places(found, kept)
            columns.append(at[there])
        self.size, self.width = len(lists), len(kept)
        self.columns = np.concatenate(columns) if columns else np.zeros(0, dtype=np.int64)
        self.row = np.repeat(np.arange(self.size), [len(c) for c in columns])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.columns], self.size)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, values[self.row], self.width)


@dataclass
class Model:
    """Weights by feature hash, and the weight every text has."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, found: set[bytes]) -> float:
        own = {f for w in found for f in word_features(w) if f in self.weights}
        return _sigmoid(self.bias + sum(self.weights[f] for f in sorted(own)))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def constant(texts: int, toxic: float) -> Model:
    """What there is to say without texts of both classes: the smoothed share of toxic ones."""
    rate = (toxic + 0.5) / (texts + 1.0) if texts else 1e-6
    return Model(float(np.log(rate / (1 - rate))))


def fit(
    lists: list[np.ndarray], toxic: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], **options
) -> Model:
    """A model of texts held in memory; `train` does the same on tables."""
    if not 0 < toxic.sum() < len(toxic):
        return constant(len(toxic), float(toxic.sum()))
    every, counts = np.unique(np.concatenate(lists), return_counts=True)
    found, times = np.unique(np.concatenate([x for x, y in zip(lists, toxic) if y]), return_counts=True)
    hits = np.zeros(len(every))
    hits[np.searchsorted(every, found)] = times
    tell = told(counts, hits, toxic.mean())
    usable = np.flatnonzero(counts >= LEAST_TEXTS)
    usable = usable[tell[usable] > _least_told(len(usable))]
    usable = usable[np.argsort(-tell[usable], kind="stable")[:FEATURES]]
    return descend(every[np.sort(usable)], lists, toxic, [(a, b, 1) for a, b in pairs], **options)


def _least_told(features: int) -> float:
    """Of so many features that tell nothing, hardly one reaches this by chance."""
    return float(np.log(max(features, 1)) + CHANCE)


def descend(
    kept: np.ndarray, lists: list[np.ndarray], toxic: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray, int]],
    steps: int = STEPS, penalty: float = PENALTY, swap_penalty: float = SWAP_PENALTY,
) -> Model:
    """Adam on texts of both classes; `kept` are the features with weights, pairs come with how often they occur."""
    base = toxic.mean()
    x, left, right = Rows(lists, kept), Rows([a for a, _, _ in pairs], kept), Rows([b for _, b, _ in pairs], kept)
    often = np.array([n for *_, n in pairs], dtype=float)
    weights, bias = np.zeros(len(kept)), float(np.log(base / (1 - base)))
    # toxic texts are few; the fourth root of the ratio lifts them a little, and scores stay near probabilities
    heavy = np.where(toxic > 0, ((1 - base) / base) ** 0.25, 1.0)
    heavy /= heavy.sum()
    first, second = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, steps + 1):
        off = (_sigmoid(x.times(weights) + bias) - toxic) * heavy
        grad = x.back(off) + penalty * weights
        if pairs:
            change = (left.times(weights) - right.times(weights)) * often / often.sum()
            grad += 2 * swap_penalty * (left.back(change) - right.back(change))
        grad = np.append(grad, off.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    strong = np.abs(weights) > 1e-3
    return Model(float(bias), dict(zip(kept[strong].tolist(), weights[strong].tolist())))


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
    sample: int = SAMPLE, **options,
) -> Model:
    """Fit on the labelled documents. Labels without id or value are left out; of several for an id the largest counts;
    labels without a document, and documents without a label, play no part."""
    chosen = (
        labels.select(pick(doc_id).alias("doc_id"), pick(label).cast("int").alias("label")).dropna()
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # at most `sample` ids of eight bytes and a label: small enough for every task
    rows = docs.select(pick(doc_id).alias("doc_id"), utf8(text).alias("data")).join(F.broadcast(chosen), "doc_id")
    extract = F.pandas_udf(_extracted, "struct<features:binary,pairs:array<struct<a:binary,b:binary>>>")
    folder = run_folder(docs.sparkSession) + "/toxicity"
    found = stored(
        rows.select("doc_id", (F.col("label") > 0).cast("int").alias("label"), extract("data").alias("x"))
        .select("doc_id", "label", "x.features", "x.pairs"),
        f"{folder}/found",
    )
    texts, toxic = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < texts:
        return constant(texts, toxic)
    kept = _picked(found, toxic / texts, f"{folder}/counts")
    picked = _only(docs.sparkSession.sparkContext.broadcast(kept))
    got = found.select("doc_id", "label", picked("features").alias("features")).collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["features"])))
    # two terms change the same features in any sentence but for words that stand there too: few groups
    pairs = (
        found.select(F.explode("pairs").alias("p")).select(picked("p.a").alias("a"), picked("p.b").alias("b"))
        .groupBy("a", "b").count().collect()
    )
    return descend(
        kept, [_ids(r["features"]) for r in got], np.array([float(r["label"]) for r in got]),
        sorted([(_ids(p["a"]), _ids(p["b"]), p["count"]) for p in pairs], key=lambda p: (p[0].tobytes(), p[1].tobytes())),
        **options,
    )


def _picked(found: DataFrame, base: float, folder: str) -> np.ndarray:
    """The features that get a weight: those that tell most, FEATURES at most."""

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tell = told(batch["n"].to_numpy(), batch["hits"].to_numpy(), base)
            yield pd.DataFrame({"feature": batch["feature"], "tell": tell})

    parts = found.select("label", "features").mapInPandas(_counted, "feature long, n long, hits long")
    counts = stored(
        parts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).filter(F.col("n") >= LEAST_TEXTS),
        folder,
    )
    least = _least_told(counts.count())
    strong = counts.mapInPandas(weigh, "feature long, tell double").filter(F.col("tell") > least)
    best = strong.orderBy(F.desc("tell"), "feature").limit(FEATURES).collect()
    return np.sort(np.array([r["feature"] for r in best], dtype=np.uint32))


def _only(kept):
    """Column function: of features held as bytes only those in the broadcast array."""

    def only(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([f[_places(f, kept.value)[1]].tobytes() for f in map(_ids, batch)])

    return F.pandas_udf(only, "binary")


class _Active(dict):
    """Word -> its features that have a weight, filled in as words come."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(f for f in word_features(word) if f in self.weights)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found
        return found


def _scorer(model):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, weights = model.value.bias, model.value.weights
        active = _Active(weights)
        for texts in batches:
            sums = [
                # summed in one order, so that a text always has the same score
                sum(map(weights.__getitem__, sorted(set(chain.from_iterable(map(active.__getitem__, text_words(d)))))))
                for d in texts
            ]
            yield pd.Series(_sigmoid(np.array(sums, dtype=float) + bias))
        give_back()

    return F.pandas_udf(score, "double")


def toxicity(spark, model: Model, text: str = "text") -> Column:
    """Score 0 to 1 of a text column; null and empty texts get the score of a text without features."""
    return _scorer(spark.sparkContext.broadcast(model))(utf8(text))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, unchanged."""
    column = free_name(docs, "toxicity__")
    scored = docs.withColumn(column, toxicity(docs.sparkSession, model, text))
    return scored.filter(F.col(column) < threshold).drop(column)
