"""Token counts of a unigram model, with one dynamic program for all words that share a prefix.

A word's tokens are those of its most probable split into pieces. The forward score of a prefix (the best
split of its first n characters) does not depend on what follows. Each task takes the distinct pre-tokens of
a batch as a trie, walks it depth first, and computes every prefix once; the counts at the ends of the words are kept for
later batches. Documents then add up the counts of their words, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.llm.common import utf8

COUNTS = "struct<n_pretokens:bigint,n_tokens:bigint>"
MARK = "▁"  # stands for the blank before a word
KNOWN_WORDS = 500_000  # counts remembered by a task
BYTE_PENALTY = 10.0


def piece_scores(path: str) -> dict[str, float]:
    """Log-probabilities of a sentencepiece vocabulary by Zipf's law over its ranks; bytes and markers are left out.

    The public files carry ranks but no probabilities, so rank r counts as 1 / (r + 1), normalised.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [
        i for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = math.log(sum(1.0 / n for n in range(1, len(ids) + 1)))
    return {model.id_to_piece(i): -math.log(n) - total for n, i in enumerate(ids, 1)}


def piece_trie(scores: dict[str, float]) -> dict:
    """Nested dicts by character; the key "" holds the score of the piece that ends there."""
    root: dict = {}
    for piece, score in scores.items():
        node = root
        for char in piece:
            node = node.setdefault(char, {})
        node[""] = score
    return root


def trie_counts(words: Iterable[str], pieces: dict, byte_score: float) -> Iterator[tuple[str, int]]:
    """(word, tokens of its best split). The words' trie is walked depth first, which is their sorted order.

    A state of the walk holds the prefix's best score and count, and the pieces begun but not ended: (piece node, score,
    count before the piece). Of equally probable splits the one with fewer tokens counts. A character that is no piece
    by itself may also be spelled in UTF-8 bytes of `byte_score` each.
    """
    path: list[tuple[float, int, list]] = [(0.0, 0, [])]
    before = ""
    for word in sorted(words):
        shared = len(commonprefix((before, word)))
        del path[shared + 1 :]
        score, count, begun = path[-1]
        for char in word[shared:]:
            best, fewest, going = -math.inf, 0, []
            for node, s, c in [*begun, (pieces, score, count)]:
                node = node.get(char)
                if node is None:
                    continue
                going.append((node, s, c))
                own = node.get("")
                if own is not None and (s + own > best or s + own == best and c + 1 < fewest):
                    best, fewest = s + own, c + 1
            if char not in pieces or "" not in pieces[char]:
                size = len(char.encode("utf-8", "surrogatepass"))
                if score + size * byte_score > best:
                    best, fewest = score + size * byte_score, count + size
            score, count, begun = best, fewest, going
            path.append((score, count, begun))
        before = word
        yield word, count


def _counter(scores):
    @F.pandas_udf(COUNTS)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = scores.value
        pieces, byte_score = piece_trie(table), min(table.values(), default=0.0) - BYTE_PENALTY
        known: dict[bytes, int] = {}
        for texts in batches:
            if len(known) > KNOWN_WORDS:
                known.clear()
            new = set()
            for data in texts:
                new.update(data.split())
            new = [w for w in new if w not in known]
            named = dict(zip((MARK + w.decode("utf-8", "replace") for w in new), new))
            for word, n in trie_counts(named, pieces, byte_score):
                known[named[word]] = n
            for w in new:  # words whose broken bytes look alike share an entry above
                if w not in known:
                    known[w] = known[named[MARK + w.decode("utf-8", "replace")]]
            rows = []
            for data in texts:
                found = data.split()
                rows.append((len(found), sum(map(known.__getitem__, found))))
            yield pd.DataFrame(rows, columns=["n_pretokens", "n_tokens"])

    return count


def token_counts(spark, path: str, text: str = "text") -> Column:
    """A struct (n_pretokens, n_tokens) of each whole text, under the vocabulary in `path`.

    Pre-tokens are the words between the blanks 0x20 and 0x09-0x0D, each with a leading mark. Null and empty texts give
    zeros. Every row stands for itself: repeated rows, ids and other columns play no part.
    """
    return _counter(spark.sparkContext.broadcast(piece_scores(path)))(utf8(text))
