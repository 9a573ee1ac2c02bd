"""WARC archives: write captures with their repeats as revisits, read them back, and merge the capture indexes.

Writing: equal payloads meet by digest; the smallest id of each stays a response, the others refer to it. Records
are rows of a text table whose line end is the last line end of a record, so a part file is a gzipped WARC file.

Reading: every file gives a run of index entries, sorted in its task by URL key and time and stored. The runs
are dealt out by ranges of (URL key, time, id), so that a URL with very many captures is cut too, and in each range a
tournament tree of losers merges the runs into one ordered history.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import pick, run_folder, stored

EPOCH = 1_704_067_200  # time of the first capture where a table has none: 2024-01-01
RECORDS_PER_FILE = 1000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"

ENTRY = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("place", T.LongType()),  # rank in the run
    T.StructField("url_key", T.StringType()),
    T.StructField("captured", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("offset", T.LongType()),  # in the unpacked file
    T.StructField("length", T.LongType()),
])


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, without a scheme before it."""
    digits = F.sha1(payload)
    five = [F.conv(F.substring(digits, 1 + 10 * n, 10), 16, 10).cast("bigint") for n in range(4)]  # 40 bits each
    return F.concat(*[
        F.substring(
            F.lit(_BASE32), F.shiftright(part, 35 - 5 * n).bitwiseAND(F.lit(31).cast("bigint")).cast("int") + 1, F.lit(1)
        )
        for part in five for n in range(8)
    ])


def _classified(pages: DataFrame, text: str, page_id: str, url: str, captured: Column | None, least: int) -> DataFrame:
    payload = F.coalesce(pick(text).cast("string"), F.lit(""))
    number = pick(page_id).cast("bigint")
    time = captured if captured is not None else F.lit(EPOCH) + F.coalesce(number, F.lit(0))
    rows = pages.select(
        number.alias("page_id"),
        # a line end in an address would end the header
        F.regexp_replace(F.regexp_replace(pick(url).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        payload.alias("payload"),
        F.date_format(F.timestamp_seconds(time), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        F.octet_length(payload).cast("bigint").alias("size"),
        F.unhex(F.sha2(payload, 256)).alias("digest"),
    )
    first = rows.groupBy("digest", "size").agg(F.min("page_id").alias("first_id"))
    return rows.join(first, ["digest", "size"]).withColumn(
        "refers_to",
        F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")),
    ).withColumn(
        "revisit", (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id")),
    )


def _record() -> Column:
    """One record without its last line end, which the text sink adds."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.col("size").cast("string"), F.lit(_CRLF + _CRLF),
    )
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    revisit = F.when(F.col("revisit"), F.concat(
        F.lit("WARC-Refers-To: <urn:page:"), number(F.col("refers_to")), F.lit(f">{_CRLF}"),
        F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}"),
    )).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), kind,
        F.lit(f"{_CRLF}WARC-Record-ID: <urn:page:"), number(F.col("page_id")),
        F.lit(f">{_CRLF}WARC-Date: "), F.col("captured"), F.lit(_CRLF),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit(_CRLF)), F.lit("")),
        revisit,
        F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload")),
        F.lit(f"{_CRLF}Content-Type: application/http;msgtype=response{_CRLF}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(_CRLF + _CRLF), block, F.lit(_CRLF),
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    text: str = "html",
    page_id: str = "page_id",
    url: str = "url",
    captured: Column | None = None,
    least_bytes: int = 0,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write a record per row into gzipped WARC files under `folder`.

    A null payload is empty. Payloads of `least_bytes` or more that are equal have one response, the row of the smallest
    id; rows repeated with that id are responses too. Rows without an id refer to a row that has one; if none has, all
    are responses. `captured` is in seconds since 1970; without it, captures are a second apart by id. A null URL leaves
    the header out, line ends in a URL are percent-encoded. Other columns are not read. An empty table writes no record.
    """
    rows = _classified(pages, text, page_id, url, captured, least_bytes)
    (
        rows.select(_record().alias("value")).write
        .option("lineSep", _CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
        .text(folder)
    )


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query: captures of a site stand together. Broken URLs stay as they are."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return (url or "").lower()
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){unquote(parts.path) or '/'}{query}".lower()


def _number(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes, bytes]]:
    """(headers, offset, length, HTTP head, payload) of every record; lengths come from the headers alone."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8", "replace").split(_CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin, size = head + 4, int(fields["Content-Length"])
        http, _, payload = data[begin : begin + size].partition(b"\r\n\r\n")
        yield fields, at, begin + size + 4 - at, http, payload
        at = begin + size + 4


def _run(name: str, data: bytes) -> list[tuple]:
    """The index entries of a file in the order of URL key, time and id."""
    rows = []
    for fields, offset, length, http, payload in parse_archive(data):
        kind = fields["WARC-Type"]
        said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "revisit":
            lines = dict(x.split(": ", 1) for x in http.decode().split(_CRLF)[1:])
            size = int(lines["Content-Length"])
        else:
            size = len(payload)
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != said:
                raise ValueError(f"{name}: the payload at byte {offset} differs from its digest")
        url = fields.get("WARC-Target-URI")
        rows.append((
            url_key(url), fields["WARC-Date"], _number(fields["WARC-Record-ID"]), url, kind,
            _number(fields.get("WARC-Refers-To")), size, said, offset, length,
        ))
    rows.sort(key=_order)
    return [(name, n, *row) for n, row in enumerate(rows)]


def _order(entry: tuple) -> tuple:
    """URL key, time, id (rows without one first), place in the file."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[8]


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.StringType: pa.string(), T.LongType: pa.int64()}
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=kinds[type(f.dataType)]) for c, f in zip(columns, schema)], names=schema.fieldNames()
    )


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One sorted run of index entries per archive file; response payloads are checked against their digests."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1)):
                yield _batch(_run(path.as_py(), gzip.decompress(data.as_py())), ENTRY)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInArrow(runs, ENTRY)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, so a step replays one path only."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.heads = [key(run[0]) if run else None for run in runs]
        self.losers = [-1] * len(runs)
        for run in range(len(runs) - 1, -1, -1):
            self._replay(run)

    def _wins(self, a: int, b: int) -> bool:
        """Whether run a comes before run b; run -1 comes before all (only while the tree is set up)."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _replay(self, run: int) -> None:
        node = (run + len(self.runs)) // 2
        while node:
            if self._wins(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[best := self.losers[0]] is not None:
            yield self.runs[best][self.at[best]]
            self.at[best] += 1
            run = self.runs[best]
            self.heads[best] = self.key(run[self.at[best]]) if self.at[best] < len(run) else None
            self._replay(best)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All entries in the order of URL key, time and id: by partitions, and by `place` inside each.

    Ranges are cut by (URL key, time, id), so no key has to fit into one task. `run` names the archive file.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(row[0], []).append(row)
        rows = []
        for n, row in enumerate(LoserTree(list(parts.values()), lambda r: _order(r[2:]))):
            rows.append((row[0], n, *row[2:]))
            if len(rows) == 10_000:
                yield _batch(rows, ENTRY)
                rows = []
        yield _batch(rows, ENTRY)

    dealt = runs.repartitionByRange("url_key", "captured", "page_id", "run", "place")
    return dealt.sortWithinPartitions("run", "place").mapInArrow(merged, ENTRY)


def archive_index(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the archives, read them back, and merge their runs into ordered capture histories.

    Archives and runs are kept under `folder`, by default a new one in the shared folder.
    """
    spark = pages.sparkSession
    folder = folder or run_folder(spark)
    write_archives(pages, folder + "/warc", **options)
    return merge_runs(stored(read_runs(spark, folder + "/warc"), folder + "/runs"))
