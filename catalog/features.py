"""Feature extraction over the message view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import (
    GROUP_SQL,
    KEY_SQL,
    SIZES,
    WINDOWED_SQL,
    comparable,
    messages,
)
from tidegauge import schemas
from tidegauge.operators import features
from tidegauge.operators.windows import WINDOW, assign_windows

GAPS_SQL = f""",
gaps AS (
  SELECT {GROUP_SQL}, ts_us,
         (ts_us - lag(ts_us) OVER (PARTITION BY {GROUP_SQL} ORDER BY ts_us)) / 1e6 AS gap
  FROM windowed),
timing AS (
  SELECT {GROUP_SQL}, coalesce(avg(gap), 0) AS iat_mean, coalesce(stddev_pop(gap), 0) AS iat_std,
         coalesce(min(gap), 0) AS iat_min, coalesce(max(gap), 0) AS iat_max,
         coalesce(quantile_cont(gap, 0.5), 0) AS iat_median
  FROM gaps GROUP BY {GROUP_SQL})
"""

VOLUME_COLUMNS_SQL = """
  count(*) AS message_count, CAST(sum(payload_size) AS BIGINT) AS bytes_total,
  round(avg(payload_size), 3) AS bytes_mean, round(stddev_pop(payload_size), 3) AS bytes_std,
  CAST(min(payload_size) AS BIGINT) AS bytes_min, CAST(max(payload_size) AS BIGINT) AS bytes_max
"""


def counts_sql(name: str, value: str, where: str, source: str = "windowed") -> str:
    """CTEs `<name>_n` (count per value) and `<name>_d` (distinct, total, entropy, mode)."""
    return f""",
{name}_n AS (
  SELECT {GROUP_SQL}, {value} AS val, count(*) AS c, min(msg_id) AS f
  FROM {source} WHERE ({where}) AND {value} IS NOT NULL GROUP BY {GROUP_SQL}, {value}),
{name}_t AS (
  SELECT *, sum(c) OVER (PARTITION BY {GROUP_SQL}) AS n FROM {name}_n),
{name}_d AS (
  SELECT {GROUP_SQL}, count(*) AS d, CAST(max(n) AS BIGINT) AS n,
         -sum((c / n) * log2(c / n + 1e-10)) AS e,
         arg_max(val, c * 1e12 - f) AS mode, max(c) AS mode_c
  FROM {name}_t GROUP BY {GROUP_SQL})
"""


def joined_sql(*names: str) -> str:
    return "\n".join(f"LEFT JOIN {n} USING ({GROUP_SQL})" for n in names)


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extract_features(messages(spark, sf_dir), SIZES)


@query(f"WITH {WINDOWED_SQL} SELECT {KEY_SQL}, {VOLUME_COLUMNS_SQL} FROM windowed GROUP BY {GROUP_SQL}")
def volume_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    windowed = assign_windows(messages(spark, sf_dir), SIZES)
    return comparable(features.volume_features(windowed))


TIMING_SQL = f"""
WITH {WINDOWED_SQL} {GAPS_SQL}
SELECT {KEY_SQL}, round(iat_mean, 3) AS iat_mean, round(iat_std, 3) AS iat_std,
       round(iat_min, 3) AS iat_min, round(iat_max, 3) AS iat_max,
       round(iat_median, 3) AS iat_median
FROM timing WHERE iat_max > 0"""


@query(TIMING_SQL)
def timing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(features.timing_features(messages(spark, sf_dir), SIZES))


@query(TIMING_SQL)
def timing_features_in_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same gaps with the sort cut into hours and the slice edges stitched."""
    return comparable(features.timing_features(messages(spark, sf_dir), SIZES, slice_seconds=3600))


MODBUS_SQL = f"""
WITH {WINDOWED_SQL} {GAPS_SQL}
{counts_sql("fc", "function_code", "protocol = 'modbus'")}
{counts_sql("un", "unit_id", "protocol = 'modbus'")}
{counts_sql("ad", "start_address", "protocol = 'modbus'")}
{counts_sql("ex", "exception_code", "protocol = 'modbus' AND is_exception")}
, base AS (
  SELECT {GROUP_SQL}, {VOLUME_COLUMNS_SQL},
    count_if(function_code IN (1, 2, 3, 4)) / count(*) AS fc_read_ratio,
    count_if(function_code IN (5, 6, 15, 16)) / count(*) AS fc_write_ratio,
    count_if(function_code IN (7, 8, 11, 12, 17)) / count(*) AS fc_diagnostic_ratio,
    avg(start_address) AS addr_mean, stddev_pop(start_address) AS addr_std,
    min(start_address) AS addr_min, max(start_address) AS addr_max,
    avg(quantity) AS qty_mean, max(quantity) AS qty_max,
    count_if(is_exception) AS exception_count,
    count_if(NOT is_exception AND dst_port = 502) AS request_count
  FROM windowed WHERE protocol = 'modbus' GROUP BY {GROUP_SQL})
SELECT {KEY_SQL}, message_count, bytes_total, bytes_mean, bytes_std, bytes_min, bytes_max,
  round(iat_mean, 3) AS iat_mean, round(iat_std, 3) AS iat_std, round(iat_min, 3) AS iat_min,
  round(iat_max, 3) AS iat_max, round(iat_median, 3) AS iat_median,
  CAST(fc_d.d AS BIGINT) AS fc_unique_count, round(fc_read_ratio, 3) AS fc_read_ratio,
  round(fc_write_ratio, 3) AS fc_write_ratio, round(fc_diagnostic_ratio, 3) AS fc_diagnostic_ratio,
  round(fc_d.e, 3) AS fc_entropy, CAST(fc_d.mode AS BIGINT) AS fc_most_common,
  round(fc_d.mode_c / fc_d.n, 3) AS fc_most_common_ratio,
  CAST(un_d.d AS BIGINT) AS unit_id_unique_count, round(un_d.e, 3) AS unit_id_entropy,
  CAST(ad_d.d AS BIGINT) AS addr_unique_count, round(addr_mean, 3) AS addr_mean,
  round(addr_std, 3) AS addr_std, CAST(addr_min AS BIGINT) AS addr_min,
  CAST(addr_max AS BIGINT) AS addr_max, CAST(addr_max - addr_min AS BIGINT) AS addr_range,
  round(qty_mean, 3) AS qty_mean, CAST(qty_max AS BIGINT) AS qty_max,
  CAST(exception_count AS BIGINT) AS exception_count,
  round(exception_count / message_count, 3) AS exception_ratio,
  CAST(coalesce(ex_d.d, 0) AS BIGINT) AS exception_codes_unique,
  CAST(request_count AS BIGINT) AS request_count,
  CAST(message_count - request_count AS BIGINT) AS response_count,
  round(request_count / message_count, 3) AS request_ratio
FROM base {joined_sql("timing", "fc_d", "un_d", "ad_d", "ex_d")}"""


def _of_protocol(spark: SparkSession, sf_dir: str, protocol: str, extras: list) -> DataFrame:
    names = [n for n, _ in schemas.VECTOR_CORE] + [n for n, _ in extras]
    rows = features.extract_features(
        messages(spark, sf_dir).filter(F.col("protocol") == protocol), SIZES
    )
    return comparable(rows.select(*WINDOW, *names))


@query(MODBUS_SQL)
def modbus_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_protocol(spark, sf_dir, "modbus", schemas.MODBUS_EXTRAS)


DNP3_SQL = f"""
WITH {WINDOWED_SQL} {GAPS_SQL}
, objects AS (SELECT *, unnest(object_groups) AS grp FROM windowed WHERE protocol = 'dnp3')
{counts_sql("fc", "dnp3_code", "protocol = 'dnp3'")}
, grouped AS (
  SELECT {GROUP_SQL}, count(DISTINCT grp) AS d, count(*) AS n,
         count_if(grp IN (1, 2)) AS bi, count_if(grp IN (10, 12)) AS bo,
         count_if(grp IN (30, 32)) AS ai, count_if(grp IN (40, 41)) AS ao
  FROM objects GROUP BY {GROUP_SQL})
, base AS (
  SELECT {GROUP_SQL}, {VOLUME_COLUMNS_SQL},
    count_if(dnp3_code = 1) / count(*) AS rd, count_if(dnp3_code IN (2, 3, 4, 5, 6)) / count(*) AS wr,
    count_if(dnp3_code IN (13, 14)) / count(*) AS ct,
    count_if(dnp3_code IN (129, 130)) / count(*) AS rs,
    count(DISTINCT dnp3_source) AS su, count(DISTINCT dnp3_destination) AS du,
    count(DISTINCT dnp3_source * 100000 + dnp3_destination) AS pu,
    count_if(is_master) / count(*) AS ms, count_if(unsolicited) AS us
  FROM windowed WHERE protocol = 'dnp3' GROUP BY {GROUP_SQL})
SELECT {KEY_SQL}, message_count, bytes_total, bytes_mean, bytes_std, bytes_min, bytes_max,
  round(iat_mean, 3) AS iat_mean, round(iat_std, 3) AS iat_std, round(iat_min, 3) AS iat_min,
  round(iat_max, 3) AS iat_max, round(iat_median, 3) AS iat_median,
  CAST(fc_d.d AS BIGINT) AS fc_unique_count, round(rd, 3) AS fc_read_ratio,
  round(wr, 3) AS fc_write_ratio, round(ct, 3) AS fc_control_ratio,
  round(rs, 3) AS fc_response_ratio, round(fc_d.e, 3) AS fc_entropy,
  CAST(su AS BIGINT) AS dnp3_src_unique, CAST(du AS BIGINT) AS dnp3_dst_unique,
  CAST(pu AS BIGINT) AS dnp3_addr_pairs, CAST(grouped.d AS BIGINT) AS obj_group_unique,
  round(bi / grouped.n, 3) AS obj_binary_input_ratio,
  round(bo / grouped.n, 3) AS obj_binary_output_ratio,
  round(ai / grouped.n, 3) AS obj_analog_input_ratio,
  round(ao / grouped.n, 3) AS obj_analog_output_ratio,
  round(ms, 3) AS master_ratio, CAST(us AS BIGINT) AS unsolicited_count,
  round(us / message_count, 3) AS unsolicited_ratio
FROM base {joined_sql("timing", "fc_d", "grouped")}"""


@query(DNP3_SQL)
def dnp3_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_protocol(spark, sf_dir, "dnp3", schemas.DNP3_EXTRAS)


OPCUA_SQL = f"""
WITH {WINDOWED_SQL} {GAPS_SQL}
{counts_sql("ty", "message_type", "protocol = 'opcua'")}
, steps AS (
  SELECT {GROUP_SQL}, sequence_number - lag(sequence_number) OVER (
           PARTITION BY {GROUP_SQL} ORDER BY sequence_number) AS step
  FROM windowed WHERE protocol = 'opcua' AND sequence_number <> 0)
, missing AS (
  SELECT {GROUP_SQL}, CAST(coalesce(sum(step - 1) FILTER (step > 1), 0) AS BIGINT) AS gaps
  FROM steps GROUP BY {GROUP_SQL})
, base AS (
  SELECT {GROUP_SQL}, {VOLUME_COLUMNS_SQL},
    count_if(message_type IN ('Hello', 'Acknowledge')) / count(*) AS hs,
    count_if(message_type = 'Message') / count(*) AS da,
    count_if(message_type = 'Error') / count(*) AS er,
    count(DISTINCT secure_channel_id) FILTER (secure_channel_id <> 0) AS cu,
    count(*) FILTER (secure_channel_id <> 0) AS cn,
    count(DISTINCT security_token_id) FILTER (security_token_id <> 0) AS tu,
    count(DISTINCT service_type) AS su,
    count(*) FILTER (service_type = 'OpenSecureChannel') AS so,
    count(*) FILTER (service_type = 'CloseSecureChannel') AS sc,
    count(*) FILTER (service_type = 'Error') AS se
  FROM windowed WHERE protocol = 'opcua' GROUP BY {GROUP_SQL})
SELECT {KEY_SQL}, message_count, bytes_total, bytes_mean, bytes_std, bytes_min, bytes_max,
  round(iat_mean, 3) AS iat_mean, round(iat_std, 3) AS iat_std, round(iat_min, 3) AS iat_min,
  round(iat_max, 3) AS iat_max, round(iat_median, 3) AS iat_median,
  CAST(ty_d.d AS BIGINT) AS msg_type_unique, round(hs, 3) AS msg_handshake_ratio,
  round(da, 3) AS msg_data_ratio, round(er, 3) AS msg_error_ratio,
  round(ty_d.e, 3) AS msg_type_entropy, CAST(cu AS BIGINT) AS channel_unique,
  CAST(tu AS BIGINT) AS token_unique,
  round(CASE WHEN cn > 0 THEN 1 - cu / cn ELSE 0 END, 3) AS channel_reuse_ratio,
  CAST(su AS BIGINT) AS service_unique, CAST(so AS BIGINT) AS service_open_channel,
  CAST(sc AS BIGINT) AS service_close_channel, CAST(se AS BIGINT) AS service_error,
  coalesce(gaps, 0) AS sequence_gaps
FROM base {joined_sql("timing", "ty_d", "missing")}"""


@query(OPCUA_SQL)
def opcua_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_protocol(spark, sf_dir, "opcua", schemas.OPCUA_EXTRAS)


@query(f"""
WITH {WINDOWED_SQL} {GAPS_SQL}
SELECT {KEY_SQL}, 'modbus' AS feature_protocol, count(*) AS message_count,
       round(max(iat_mean), 3) AS iat_mean,
       CAST(count(DISTINCT function_code) AS BIGINT) AS fc_unique_count,
       round(count_if(function_code IN (1, 2, 3, 4)) / count(*), 3) AS fc_read_ratio
FROM (SELECT * REPLACE ('s7' AS protocol) FROM windowed WHERE protocol = 'modbus')
LEFT JOIN (SELECT * REPLACE ('s7' AS protocol) FROM timing WHERE protocol = 'modbus')
  USING ({GROUP_SQL})
GROUP BY {GROUP_SQL}""")
def fallback_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A protocol without a feature set of its own is measured as Modbus and labelled so."""
    renamed = (
        messages(spark, sf_dir)
        .filter(F.col("protocol") == "modbus")
        .withColumn("protocol", F.lit("s7"))
    )
    rows = features.extract_features(renamed, SIZES)
    return comparable(
        rows.select(
            *WINDOW, "feature_protocol", "message_count", "iat_mean", "fc_unique_count",
            "fc_read_ratio",
        )
    )


@query(f"""
WITH {WINDOWED_SQL}
SELECT {KEY_SQL}, {VOLUME_COLUMNS_SQL},
       CAST(count(DISTINCT CASE protocol WHEN 'modbus' THEN function_code WHEN 'dnp3' THEN dnp3_code END) AS BIGINT)
         AS fc_unique_count,
       CASE WHEN protocol = 'modbus' THEN round(stddev_pop(start_address), 3) END AS addr_std,
       CASE WHEN protocol = 'modbus' THEN round(avg(quantity), 3) END AS qty_mean
FROM windowed WHERE protocol <> 'opcua' GROUP BY {GROUP_SQL}""")
def pane_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows merged upward from partial states of panes."""
    rows = features.extract_features(messages(spark, sf_dir), SIZES, roll_up=True)
    return comparable(
        rows.filter(F.col("protocol") != "opcua").select(
            *WINDOW, "message_count", "bytes_total", "bytes_mean", "bytes_std", "bytes_min", "bytes_max",
            "fc_unique_count", "addr_std", "qty_mean",
        )
    )


@query(f"""
WITH {WINDOWED_SQL}
SELECT {KEY_SQL}, CAST(function_code AS VARCHAR) AS value, count(*) AS count,
       min(msg_id) AS first_seen
FROM windowed WHERE protocol = 'modbus' GROUP BY {GROUP_SQL}, function_code""")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each function code occurs in a window."""
    windowed = assign_windows(messages(spark, sf_dir), SIZES)
    counted = features.value_histogram(windowed).filter(F.col("kind") == "mb_fc").drop("kind")
    return comparable(counted)
