"""Telemetry views over the `events` table, once in Spark and once in SQL.

An event stands for one protocol message: its id gives the protocol, its user the addresses,
`k` (the number in `props`) and `v` (the whole part of `value`) the protocol fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import use_utc

# the events are sparse, so the windows are longer than the library's defaults
SIZES = (3600, 21600, 86400)
GAP_S = 10800
TTL_S = 7200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(options: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        F.floor("value").cast("bigint").alias("v"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v, user, event = F.col("k"), F.col("v"), F.col("user_id"), F.col("event_id")
    groups = [1, 2, 10, 12, 30, 32, 40, 41, 60]
    return events(spark, sf_dir).select(
        F.concat(F.lit("10.0.0."), user % 4).alias("src_ip"),
        F.concat(F.lit("10.0.1."), user % 3).alias("dst_ip"),
        pick(["modbus", "dnp3", "opcua"], event % 3).alias("protocol"),
        "ts_us",
        event.alias("msg_id"),
        (v + 8).alias("payload_size"),
        (user + 49152).cast("int").alias("src_port"),
        F.when(F.col("event_type").isin("click", "view"), 502)
        .otherwise(49152 + user)
        .cast("int")
        .alias("dst_port"),
        pick([1, 2, 3, 4, 5, 6, 8, 15, 16, 43], k % 10).alias("function_code"),
        (user % 5 + 1).cast("int").alias("unit_id"),
        (k * 10).alias("start_address"),
        (v % 125 + 1).cast("int").alias("quantity"),
        (F.col("event_type") == "error").alias("is_exception"),
        (k % 4 + 1).alias("exception_code"),
        F.array(k * 10, v.cast("int"), (event % 100).cast("int")).alias("values"),
        pick([1, 2, 5, 13, 129, 130, 4, 20], k % 8).alias("dnp3_code"),
        user.cast("int").alias("dnp3_source"),
        k.alias("dnp3_destination"),
        (user % 2 == 0).alias("is_master"),
        (k % 8 == 5).alias("unsolicited"),
        F.when(k % 3 == 0, F.array(pick(groups, k % 9), pick(groups, v % 9)))
        .otherwise(F.array(pick(groups, k % 9)))
        .alias("object_groups"),
        pick(["Hello", "Acknowledge", "Message", "Error"], k % 4).alias("message_type"),
        (user % 5).alias("secure_channel_id"),
        (k % 7).cast("bigint").alias("security_token_id"),
        pick(["OpenSecureChannel", "CloseSecureChannel", "Error", None, "Read"], k % 5).alias(
            "service_type"
        ),
        (event % 1000).alias("sequence_number"),
    )


SIZES_SQL = ", ".join(f"({s})" for s in SIZES)

MESSAGES_SQL = """
numbered AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS ts_us,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CAST(floor(value) AS BIGINT) AS v
  FROM events),
messages AS (
  SELECT '10.0.0.' || (user_id % 4) AS src_ip, '10.0.1.' || (user_id % 3) AS dst_ip,
         (['modbus', 'dnp3', 'opcua'])[event_id % 3 + 1] AS protocol,
         ts_us, event_id AS msg_id, v + 8 AS payload_size, user_id + 49152 AS src_port,
         CASE WHEN event_type IN ('click', 'view') THEN 502 ELSE 49152 + user_id END AS dst_port,
         ([1, 2, 3, 4, 5, 6, 8, 15, 16, 43])[k % 10 + 1] AS function_code,
         user_id % 5 + 1 AS unit_id, k * 10 AS start_address, v % 125 + 1 AS quantity,
         event_type = 'error' AS is_exception, k % 4 + 1 AS exception_code,
         [k * 10, v, event_id % 100] AS vals,
         ([1, 2, 5, 13, 129, 130, 4, 20])[k % 8 + 1] AS dnp3_code,
         user_id AS dnp3_source, k AS dnp3_destination, user_id % 2 = 0 AS is_master,
         k % 8 = 5 AS unsolicited,
         CASE WHEN k % 3 = 0
              THEN [([1, 2, 10, 12, 30, 32, 40, 41, 60])[k % 9 + 1],
                    ([1, 2, 10, 12, 30, 32, 40, 41, 60])[v % 9 + 1]]
              ELSE [([1, 2, 10, 12, 30, 32, 40, 41, 60])[k % 9 + 1]] END AS object_groups,
         (['Hello', 'Acknowledge', 'Message', 'Error'])[k % 4 + 1] AS message_type,
         user_id % 5 AS secure_channel_id, k % 7 AS security_token_id,
         (['OpenSecureChannel', 'CloseSecureChannel', 'Error', NULL, 'Read'])[k % 5 + 1]
           AS service_type,
         event_id % 1000 AS sequence_number
  FROM numbered)
"""

WINDOWED_SQL = MESSAGES_SQL + f""",
windowed AS (
  SELECT m.*, s.window_size,
         ts_us // 1000000 - (ts_us // 1000000) % s.window_size AS window_start
  FROM messages m CROSS JOIN (VALUES {SIZES_SQL}) s(window_size))
"""

KEY_SQL = """src_ip, dst_ip, protocol, CAST(window_size AS BIGINT) AS window_size,
       CAST(window_start AS BIGINT) AS window_start"""

GROUP_SQL = "src_ip, dst_ip, protocol, window_size, window_start"


def r3(name: str, column: Column | None = None) -> Column:
    """A double as the comparison wants it."""
    return F.round((F.col(name) if column is None else column).cast("double"), 3).alias(name)


def i64(name: str, column: Column | None = None) -> Column:
    return (F.col(name) if column is None else column).cast("bigint").alias(name)


def window_key_columns() -> list[Column]:
    return [F.col("src_ip"), F.col("dst_ip"), F.col("protocol"), i64("window_size"), i64("window_start")]


def comparable(df: DataFrame) -> DataFrame:
    """Whole numbers as 64 bit, fractions rounded to three decimals."""
    columns = []
    for name, kind in df.dtypes:
        if kind in ("int", "bigint", "smallint", "tinyint"):
            columns.append(i64(name))
        elif kind in ("double", "float") or kind.startswith("decimal"):
            columns.append(r3(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored anomaly per event; most incidents and locks span hours in these sparse data."""
    from tidegauge.operators.classify import classify

    k, v, user, event = F.col("k"), F.col("v"), F.col("user_id"), F.col("event_id")
    seconds = F.floor(F.col("ts_us") / 1000000)
    shares = {
        "addr_range": (k * 7) % 100 / 100,
        "bytes_mean": v % 100 / 100,
        "fc_entropy": k / 100,
        "iat_std": event % 100 / 100,
        "message_count": user % 10 / 10,
        "qty_mean": F.lit(0.5),
    }
    return events(spark, sf_dir).select(
        event.alias("anomaly_id"),
        F.concat(F.lit("10.0.0."), user % 4).alias("src_ip"),
        F.concat(F.lit("10.0.1."), user % 3).alias("dst_ip"),
        pick(["modbus", "dnp3", "opcua"], event % 3).alias("protocol"),
        F.lit(3600).alias("window_size"),
        (seconds - seconds % 3600).alias("window_start"),
        seconds.alias("detected_s"),
        (k / 100).alias("ensemble_score"),
        classify(k / 100).alias("classification"),
        pick(["reconnaissance", "timing_anomaly", "volume_anomaly", "unknown", None], user % 5).alias(
            "anomaly_type"
        ),
        ((100 - v % 50) / 100).alias("confidence"),
        F.create_map(*[x for n, c in shares.items() for x in (F.lit(n), c)]).alias(
            "feature_contributions"
        ),
    )


ANOMALIES_SQL = """
numbered AS (
  SELECT event_id, user_id, epoch_us(ts) // 1000000 AS detected_s,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CAST(floor(value) AS BIGINT) AS v
  FROM events),
anomalies AS (
  SELECT event_id AS anomaly_id, '10.0.0.' || (user_id % 4) AS src_ip,
         '10.0.1.' || (user_id % 3) AS dst_ip,
         (['modbus', 'dnp3', 'opcua'])[event_id % 3 + 1] AS protocol,
         3600 AS window_size, detected_s - detected_s % 3600 AS window_start, detected_s,
         CAST(k AS DOUBLE) / 100 AS ensemble_score,
         CASE WHEN k >= 90 THEN 'critical' WHEN k >= 70 THEN 'anomaly'
              WHEN k >= 40 THEN 'suspicious' ELSE 'normal' END AS classification,
         (['reconnaissance', 'timing_anomaly', 'volume_anomaly', 'unknown', NULL])[user_id % 5 + 1]
           AS anomaly_type,
         CAST(100 - v % 50 AS DOUBLE) / 100 AS confidence,
         [{'o': -((k * 7) % 100) / 100.0, 'n': 'addr_range'}, {'o': -(v % 100) / 100.0, 'n': 'bytes_mean'},
          {'o': -k / 100.0, 'n': 'fc_entropy'}, {'o': -(event_id % 100) / 100.0, 'n': 'iat_std'},
          {'o': -(user_id % 10) / 10.0, 'n': 'message_count'}, {'o': -0.5, 'n': 'qty_mean'}] AS shares
  FROM numbered)
"""

# incidents by gap, numbered, over the anomalies that are not normal
CORRELATED_SQL = ANOMALIES_SQL + f""",
stepped AS (
  SELECT *, src_ip || ':' || dst_ip || ':' || protocol AS correlation_key,
         detected_s - lag(detected_s) OVER (
           PARTITION BY src_ip, dst_ip, protocol ORDER BY detected_s, anomaly_id) AS step
  FROM anomalies WHERE classification <> 'normal'),
sessions AS (
  SELECT *, sum(CASE WHEN step IS NULL OR step > {GAP_S} THEN 1 ELSE 0 END) OVER (
           PARTITION BY correlation_key ORDER BY detected_s, anomaly_id) AS session
  FROM stepped),
started AS (
  SELECT *, min(detected_s) OVER (PARTITION BY correlation_key, session) AS incident_started_s,
         row_number() OVER (PARTITION BY correlation_key, session ORDER BY detected_s, anomaly_id)
           AS incident_seq
  FROM sessions),
correlated AS (
  SELECT *, left(sha256(correlation_key || '|' || incident_started_s || '|0'), 32) AS incident_id,
         left(sha256('alert|' || anomaly_id), 32) AS alert_id,
         correlation_key || ':' || coalesce(anomaly_type, 'None') AS dedup_key,
         CASE WHEN ensemble_score >= 0.9 THEN 'critical' WHEN ensemble_score >= 0.7 THEN 'medium'
              WHEN classification = 'critical' THEN 'critical'
              WHEN classification = 'anomaly' THEN 'medium' ELSE 'low' END AS severity
  FROM started)
"""

# the alerts that pass the timed lock, found one after the other
PASSED_SQL = f"""
passed(dedup_key, hit_s) AS (
  SELECT dedup_key, min(detected_s) FROM correlated GROUP BY dedup_key
  UNION ALL
  SELECT p.dedup_key, min(c.detected_s)
  FROM passed p JOIN correlated c ON c.dedup_key = p.dedup_key AND c.detected_s >= p.hit_s + {TTL_S}
  GROUP BY p.dedup_key),
first_of AS (
  SELECT c.dedup_key, c.detected_s, min(anomaly_id) AS anomaly_id
  FROM correlated c JOIN passed p ON c.dedup_key = p.dedup_key AND c.detected_s = p.hit_s
  GROUP BY c.dedup_key, c.detected_s),
handled AS (
  SELECT c.*, f.anomaly_id IS NULL AS suppressed
  FROM correlated c LEFT JOIN first_of f USING (dedup_key, detected_s, anomaly_id))
"""

HANDLED_SQL = CORRELATED_SQL + "," + PASSED_SQL

# running priority over the alerts that pass
PRIORITY_SQL = HANDLED_SQL + """,
ranked AS (
  SELECT *, min(CASE WHEN suppressed THEN 4 ELSE least(
             CASE WHEN incident_seq >= 20 THEN 1 WHEN incident_seq >= 10 THEN 2
                  WHEN incident_seq >= 5 THEN 3 ELSE 4 END,
             CASE WHEN severity = 'critical' THEN 2 ELSE 4 END) END)
           OVER (PARTITION BY incident_id ORDER BY detected_s, anomaly_id) AS rank
  FROM handled)
"""
