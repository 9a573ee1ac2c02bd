"""The registered queries of the text operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import (
    clusters, decontaminate, exact_dedup, licenses, lm_score, minhash, packing, repeats, secrets, token_counts, toxicity, warc,
    whitening,
)
from tidegauge.llm.common import in_hash_share

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, [x FOR x IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')
    IF x <> ''] AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM texts, range(1, greatest(2, len(w) - 3)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
agreed AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM agreed JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)""")
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"))


@query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(_table(spark, sf_dir, "documents"))


@query()
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(_table(spark, sf_dir, "documents"), in_hash_share(F.col("doc_id"), 10, 0))


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    counts = token_counts.token_counts(spark, tokenizer_path("piece_bpe_32k.model"))
    return docs.select("doc_id", counts.alias("c")).select("doc_id", "c.n_pretokens", "c.n_tokens")


@query("""
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS d,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
bits AS (
  SELECT *, [('0x' || d[1 + 10 * i : 10 + 10 * i])::BIGINT FOR i IN range(4)] AS fives FROM digests)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[1 + ((fives[1 + n // 8] >> (35 - 5 * (n % 8))) & 31)]
                        FOR n IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_index(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), PATTERN
    )


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_hash_share(F.col("doc_id"), 3, 1)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.toxicity(spark, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query()
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan_licences(docs, licenses.train(docs))


@query(r"""
WITH folded AS (
  SELECT doc_id AS id, 'd' AS side, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT item_id, 'i', coalesce(text, '') FROM benchmark),
cut AS (
  SELECT id, side, [x FOR x IN string_split_regex(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    IF x <> ''] AS w FROM folded),
texts AS (SELECT id AS doc_id, w FROM cut WHERE side = 'd'),
items AS (SELECT CAST(id AS VARCHAR) AS item, w FROM cut WHERE side = 'i'),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS key
  FROM items, range(1, greatest(2, len(w) - 8)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS key
  FROM texts, sizes, range(1, len(w) + 2 - n) AS r(i)),
hits AS (SELECT doc_id, i, n, item FROM places JOIN windows USING (n, key)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, range(i, i + n) AS r(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, array_to_string(list(item ORDER BY item), ',') AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.with_matches(docs.select("doc_id", "text"), benchmark, "found")
    return found.select(
        "doc_id", "found.n_words", "found.n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def _listed(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query()
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", secrets.secret_spans().alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.filter("s", lambda x: x["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("s")).alias("spans"),
    )


@query("""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS MATERIALIZED (
  SELECT row_id, place, md5(substring(h, 2 * place + 1, 400)) AS s FROM texts, range(0, length(h) // 2 - 199) AS r(place)),
many AS (SELECT s FROM places GROUP BY s HAVING count(*) > 1),
hits AS (SELECT row_id, place FROM places WHERE s IN (FROM many)),
runs AS (
  SELECT row_id, min(place) AS a, max(place) + 200 AS b
  FROM (SELECT row_id, place, sum(new) OVER (PARTITION BY row_id ORDER BY place) AS run
        FROM (SELECT row_id, place, CASE WHEN place - lag(place) OVER (PARTITION BY row_id ORDER BY place) <= 200 THEN 0 ELSE 1 END AS new
              FROM hits))
  GROUP BY row_id, run),
spans AS (SELECT row_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops, sum(b - a) AS gone FROM runs GROUP BY row_id),
cut AS (
  SELECT doc_id, h, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(len(starts), 0) AS n_spans,
         list_prepend(0, coalesce(stops, [])) AS f, list_append(coalesce(starts, []), length(h) // 2) AS t
  FROM texts LEFT JOIN spans USING (row_id))
SELECT doc_id, n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string([substring(h, 2 * f[i] + 1, 2 * (t[i] - f[i])) FOR i IN range(1, len(f) + 1)], '')))
         AS kept_sha256
FROM cut""")
def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(_table(spark, sf_dir, "documents")).drop("spans")


def _clusters_sql() -> str:
    """Ten rounds in longs, one pair of tables a round."""
    squared = "list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, 65)])"
    parts = ["""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, [CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT) FOR y IN embedding] AS x
  FROM embeddings WHERE len(embedding) = 64 AND len([y FOR y IN embedding IF isfinite(y)]) = 64)""",
    """c0 AS MATERIALIZED (
  SELECT place - 1 AS k, x AS c
  FROM (SELECT x, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) AS place FROM kept)
  WHERE place <= 8)"""]
    nearest = lambda n: f"""a{n} AS MATERIALIZED (
  SELECT row_id, any_value(vec_id) AS vec_id, any_value(x) AS x, min((d, k)) AS best
  FROM (SELECT row_id, vec_id, x, k, CAST({squared} AS BIGINT) AS d FROM kept, c{n}) GROUP BY row_id)"""  # noqa: E731
    for n in range(clusters.ROUNDS):
        parts += [nearest(n), f"""m{n} AS MATERIALIZED (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
  FROM (SELECT best[2] AS k, i, sum(x[i]) AS s, count(*) AS n FROM a{n}, range(1, 65) AS r(i) GROUP BY best[2], i)
  GROUP BY k)""", f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (k))"]
    last = clusters.ROUNDS
    return f"""WITH {", ".join([*parts, nearest(last)])}
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance,
       CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON k = best[2]"""


@query(_clusters_sql())
def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_table(spark, sf_dir, "embeddings"))


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))
