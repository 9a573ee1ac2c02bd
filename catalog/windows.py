"""Window bookkeeping and the further window features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.features import GAPS_SQL, feature_rows
from catalog.registry import query
from catalog.views import (
    GROUP_SQL,
    KEY_SQL,
    SIZES,
    WINDOWED_SQL,
    comparable,
    messages,
)
from tidegauge.operators import extras
from tidegauge.operators import windows as win

AS_OF = 1705276800  # 2024-01-15
SPAN_SQL = """CAST(window_size AS BIGINT) AS window_size,
       CAST(window_start AS BIGINT) AS window_start"""


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.assign_windows(messages(spark, sf_dir), SIZES)


@query(f"""
WITH {WINDOWED_SQL}
SELECT {KEY_SQL}, CAST(min(ts_us) AS BIGINT) AS first_us, CAST(max(ts_us) AS BIGINT) AS last_us,
       count(*) AS message_count
FROM windowed GROUP BY {GROUP_SQL}""")
def window_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(win.window_bounds(windowed(spark, sf_dir)))


@query(f"""
WITH {WINDOWED_SQL}
SELECT {KEY_SQL}, count(*) AS message_count
FROM windowed WHERE window_start + window_size <= {AS_OF} GROUP BY {GROUP_SQL}""")
def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that have ended by the given moment."""
    closed, _ = win.close_windows(win.window_bounds(windowed(spark, sf_dir)), AS_OF)
    return comparable(closed.drop("first_us", "last_us"))


@query(f"""
WITH {WINDOWED_SQL}, arrived AS (
  SELECT msg_id, window_size, window_start, ts_us + (msg_id % 7) * 3600000000 AS arrival_us FROM windowed)
SELECT msg_id, {SPAN_SQL} FROM arrived
WHERE arrival_us >= (window_start + window_size + 600) * 1000000""")
def late_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive more than ten minutes after the end of their window."""
    rows = windowed(spark, sf_dir).withColumn(
        "arrival_us", F.col("ts_us") + F.col("msg_id") % 7 * 3600 * win.MICROS
    )
    _, late = win.split_late(rows, 600)
    return comparable(late.select("msg_id", "window_size", "window_start"))


@query(f"""
WITH {WINDOWED_SQL},
held AS (SELECT {GROUP_SQL}, count(*) AS n FROM windowed
         WHERE window_start + window_size > {AS_OF} GROUP BY {GROUP_SQL})
SELECT CAST(window_size AS BIGINT) AS window_size, count(*) AS active_windows,
       CAST(sum(n) AS BIGINT) AS total_buffered_messages
FROM held GROUP BY window_size""")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(win.window_stats(windowed(spark, sf_dir), AS_OF))


@query(f"""
WITH {WINDOWED_SQL}
SELECT {SPAN_SQL}, count(*) AS msg_count, CAST(sum(payload_size) AS BIGINT) AS bytes_total,
       count(DISTINCT src_ip) AS unique_sources, count(DISTINCT dst_ip) AS unique_destinations,
       count(DISTINCT src_ip || dst_ip) AS unique_pairs,
       count(DISTINCT function_code) AS unique_function_codes
FROM windowed GROUP BY window_size, window_start""")
def diversity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(extras.diversity_features(windowed(spark, sf_dir)))


@query(f"""
WITH {WINDOWED_SQL} {GAPS_SQL}
SELECT {KEY_SQL}, round(avg(CASE WHEN gap < iat_median / 10 THEN 1.0 ELSE 0.0 END), 3) AS burst_score,
       round(max(iat_std / iat_mean), 3) AS iat_cv,
       round(1 / (1 + max(iat_std / iat_mean)), 3) AS periodicity_score
FROM gaps JOIN timing USING ({GROUP_SQL}) WHERE gap IS NOT NULL GROUP BY {GROUP_SQL}""")
def burst_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(extras.burst_features(messages(spark, sf_dir), SIZES))


@query(f"""
WITH {WINDOWED_SQL}, counted AS (
  SELECT {GROUP_SQL}, count(*) AS n, count_if(function_code IN (1, 2, 3, 4)) AS r,
         count_if(function_code IN (5, 6, 15, 16)) AS w, count_if(is_exception) AS e,
         count(DISTINCT start_address) AS u, max(start_address) - min(start_address) AS g
  FROM windowed GROUP BY {GROUP_SQL})
SELECT {KEY_SQL}, CAST(r AS BIGINT) AS read_count, CAST(w AS BIGINT) AS write_count,
       round(r / greatest(w, 1), 3) AS read_write_ratio, CAST(e AS BIGINT) AS error_count,
       round(e / n, 3) AS error_rate, u AS unique_registers, CAST(g AS BIGINT) AS register_range
FROM counted""")
def register_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(extras.register_behaviour(windowed(spark, sf_dir)))


KNOWN_SQL = "(src_ip, dst_ip) IN (SELECT src_ip, dst_ip FROM messages WHERE msg_id % 9 = 0 AND function_code = 1)"


def _known(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("msg_id") % 9 == 0) & (F.col("function_code") == 1))


@query(f"""
WITH {WINDOWED_SQL}, pairs AS (
  SELECT DISTINCT window_size, window_start, src_ip, dst_ip, NOT ({KNOWN_SQL}) AS fresh
  FROM windowed)
SELECT {SPAN_SQL}, CAST(count_if(fresh) AS BIGINT) AS new_pairs_count,
       round(count_if(fresh) / count(*), 3) AS topology_change_score,
       round(count(*) / count(DISTINCT src_ip), 3) AS fan_out_ratio,
       round(count(*) / count(DISTINCT dst_ip), 3) AS fan_in_ratio
FROM pairs GROUP BY window_size, window_start""")
def topology_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windowed(spark, sf_dir)
    return comparable(extras.topology_features(rows, _known(messages(spark, sf_dir))))


@query(f"""
WITH {WINDOWED_SQL}
SELECT DISTINCT src_ip, dst_ip FROM messages
WHERE (src_ip, dst_ip) NOT IN (SELECT src_ip, dst_ip FROM messages WHERE function_code = 1 AND unit_id = 1 AND msg_id % 50 = 0)""")
def new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs missing from a baseline of a few plain reads to unit 1."""
    rows = messages(spark, sf_dir)
    known = rows.filter((F.col("function_code") == 1) & (F.col("unit_id") == 1) & (F.col("msg_id") % 50 == 0))
    return extras.new_pairs(rows, known)


@query(f"""
WITH {WINDOWED_SQL}, grouped AS (
  SELECT src_ip, window_size, window_start, count(DISTINCT dst_ip) AS d,
         max(CAST(right(dst_ip, 1) AS INT)) - min(CAST(right(dst_ip, 1) AS INT)) + 1 AS reach,
         count(DISTINCT function_code) AS c, (max(ts_us) - min(ts_us)) / 1e6 AS dur
  FROM windowed GROUP BY src_ip, window_size, window_start)
SELECT src_ip, {SPAN_SQL}, d AS destinations,
       round(CAST(CASE WHEN d > 1 AND d / reach >= 0.9 THEN 0.3 ELSE 0 END
         + CASE WHEN d >= 3 THEN 0.3 ELSE 0 END + CASE WHEN c = 1 THEN 0.2 ELSE 0 END
         + CASE WHEN dur <= 600 THEN 0.2 ELSE 0 END AS DOUBLE), 3) AS scan_score
FROM grouped""")
def scan_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(extras.scan_score(windowed(spark, sf_dir), 3, 0.9, 600.0))


@query(f"""
WITH {WINDOWED_SQL}, vals AS (SELECT {GROUP_SQL}, CAST(unnest(vals) AS DOUBLE) AS x FROM windowed),
base AS (SELECT {GROUP_SQL}, count(*) AS n, avg(x) AS mu, stddev_pop(x) AS sd, max(x) - min(x) AS rg
         FROM vals GROUP BY {GROUP_SQL}),
moments AS (
  SELECT {GROUP_SQL}, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4,
         count_if(abs(x - mu) > 3 * sd) AS outside
  FROM vals JOIN base USING ({GROUP_SQL}) GROUP BY {GROUP_SQL}),
freq AS (SELECT {GROUP_SQL}, x, count(*) AS c FROM vals GROUP BY {GROUP_SQL}, x),
ent AS (SELECT {GROUP_SQL}, -sum(c / n * log2(c / n + 1e-10)) AS e
        FROM freq JOIN base USING ({GROUP_SQL}) GROUP BY {GROUP_SQL})
SELECT {KEY_SQL}, n AS value_count, round(mu, 3) AS value_mean, round(sd, 3) AS value_std,
       round(CASE WHEN n > 2 AND sd > 0 THEN m3 / pow(sd, 3) ELSE 0 END, 3) AS value_skewness,
       round(CASE WHEN n > 3 AND sd > 0 THEN m4 / pow(sd, 4) - 3 ELSE 0 END, 3) AS value_kurtosis,
       round(e, 3) AS value_entropy, CAST(rg AS BIGINT) AS value_range,
       CAST(outside AS BIGINT) AS out_of_range_count
FROM base JOIN moments USING ({GROUP_SQL}) JOIN ent USING ({GROUP_SQL})""")
def value_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(extras.value_statistics(windowed(spark, sf_dir)))


@query(f"""
WITH {WINDOWED_SQL}, counted AS (
  SELECT {GROUP_SQL}, count(*) AS n, CAST(sum(payload_size) AS BIGINT) AS b
  FROM windowed GROUP BY {GROUP_SQL})
SELECT a.src_ip, a.dst_ip, a.protocol, CAST(a.window_start AS BIGINT) AS window_start,
       a.n AS message_count_1h, a.b AS bytes_total_1h, m.n AS message_count_6h,
       m.b AS bytes_total_6h, z.n AS message_count_24h, z.b AS bytes_total_24h
FROM counted a
JOIN counted m ON (a.src_ip, a.dst_ip, a.protocol) = (m.src_ip, m.dst_ip, m.protocol)
  AND m.window_size = 21600 AND m.window_start = a.window_start - a.window_start % 21600
JOIN counted z ON (a.src_ip, a.dst_ip, a.protocol) = (z.src_ip, z.dst_ip, z.protocol)
  AND z.window_size = 86400 AND z.window_start = a.window_start - a.window_start % 86400
WHERE a.window_size = 3600""")
def pivot_window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour, six hours and day side by side."""
    rows = extras.pivot_window_sizes(
        feature_rows(spark, sf_dir), ["message_count", "bytes_total"],
        {3600: "1h", 21600: "6h", 86400: "24h"},
    )
    return comparable(rows)
