"""Secrets in texts: a keyword automaton finds where to look, patterns are tried at those places only, and tokens
with a built-in checksum must carry the right one.

A pattern that starts with a keyword can only match where the automaton reports that keyword, so trying it there, from
left to right and behind the previous match, gives the leftmost non-overlapping matches of a whole scan. Runs of hex
digits have no keyword; they are found by one scan for runs of the least length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import utf8

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
BASE_KINDS = ("assign", "access", "hex")  # fixed by the contract, in this order

_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc62(data: bytes) -> bytes:
    """CRC-32 in six base-62 digits, the last part of GitHub's and npm's tokens."""
    value, out = zlib.crc32(data), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit : digit + 1] + out
    return out


def _long_value(match: re.Match) -> bool:
    return len(match[2]) >= 8


def _sixteen(match: re.Match) -> bool:
    return len(match[0]) >= 16


def _checksummed(match: re.Match) -> bool:
    return _crc62(match[1][:-6]) == match[1][-6:]


def _signed_token(match: re.Match) -> bool:
    """The first part is base64url of a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(match[1] + b"=" * (-len(match[1]) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


# Fixed formats: kind, keywords (lower case), pattern anchored at the keyword, test of the match.
RULES: tuple[tuple[str, tuple[str, ...], re.Pattern, Callable[[re.Match], bool]], ...] = (
    (
        "assign", ("password", "passwd", "secret", "token", "api_key", "apikey"),
        re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
        _long_value,
    ),
    ("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), _sixteen),
    (
        "github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _checksummed,
    ),
    ("npm", ("npm_",), re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _checksummed),
    (
        "jwt", ("eyj",),
        # a header is at most 4,096 characters
        re.compile(rb"(eyJ[A-Za-z0-9_-]{1,4093}+)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"), _signed_token,
    ),
)
_ORDER = {kind: n for n, kind in enumerate((*BASE_KINDS, "github", "npm", "jwt"))}
_HEX = re.compile(rb"[0-9a-f]{32,}")
_RUN = re.compile(rb"[A-Za-z0-9_-]*+")
_REST = re.compile(rb"\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]")
_HEADER = 4096


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for rule, (_, keys, _, _) in enumerate(RULES):
        for key in keys:
            found.add_word(key, (rule, len(key)))
    found.make_automaton()
    return found


def scan(data: bytes, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then by kind."""
    spans = [("hex", m.start(), m.end()) for m in _HEX.finditer(data)]
    behind = [0] * len(RULES)
    # one character for each byte, so that the automaton's places are places in `data`
    for last, (rule, size) in keywords.iter(data.lower().decode("latin-1")):
        start = last - size + 1
        if start < behind[rule]:
            continue
        kind, _, pattern, valid = RULES[rule]
        match = pattern.match(data, start)
        if not match and kind == "jwt":
            # whatever starts in this run of characters goes on as it does: without the other parts none matches, with
            # them none that starts too early
            end = _RUN.match(data, start).end()
            behind[rule] = max(start + 1, end - _HEADER) if _REST.match(data, end) else max(start + 1, end)
        if match:
            right = valid(match)
            # the contract of the base kinds drops short matches after a whole scan; of the others a match that fails
            # its test is none, and may hide a right one that starts inside it
            if right or kind in BASE_KINDS:
                behind[rule] = match.end()
            if right:
                spans.append((kind, start, match.end()))
    if not spans:
        return spans
    spans.sort(key=lambda s: (s[1], _ORDER[s[0]]))
    if not data.isascii():
        points = _points(data, sorted({place for _, a, b in spans for place in (a, b)}))
        spans = [(kind, points[a], points[b]) for kind, a, b in spans]
    return spans


def _points(data: bytes, places: list[int]) -> dict[int, int]:
    """The code points before each of the rising places, in one pass over the text."""
    points, before, behind = {}, 0, 0
    for place in places:
        before += len(data[behind:place].decode("utf-8", "replace"))
        points[place] = before
        behind = place
    return points


def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    keywords = _automaton()
    for texts in batches:
        yield pd.Series([
            [{"kind": k, "start": a, "end": b} for k, a, b in scan(data, keywords)] for data in texts
        ], dtype=object)


def secret_spans(text: str = "text") -> Column:
    """All secrets of a text column as an array of (kind, start, end), by start and then in the order of kinds.

    Places are code points, the end is exclusive. Null and empty texts have none. Of one kind, matches don't overlap;
    those of different kinds may. Each row is scanned for itself, so repeated rows and other columns change nothing.
    """
    return F.pandas_udf(_spans, SPANS)(utf8(text))


def mask_secrets(docs: DataFrame, column: str, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with `column`: the text with each stretch that secrets cover (overlaps joined) replaced by `mark`."""
    source = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    done = F.aggregate(secret_spans(text), empty, lambda s, x: F.struct(
        F.concat(
            s["out"],
            F.when(x["start"] >= s["at"], F.concat(
                F.substring(source, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit(mark)
            )).otherwise(F.lit("")),
        ).alias("out"),
        F.greatest(s["at"], x["end"]).alias("at"),
    ))
    return docs.withColumn(column, F.concat(
        done["out"], F.substring(source, done["at"].cast("int") + 1, F.length(source))
    ))
