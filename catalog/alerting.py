"""Correlation, suppression, escalation and the alert listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import (
    ANOMALIES_SQL,
    CORRELATED_SQL,
    GAP_S,
    HANDLED_SQL,
    PRIORITY_SQL,
    TTL_S,
    anomalies,
    comparable,
)
from tidegauge.operators import correlate as co
from tidegauge.operators import dedup, escalate, lifecycle
from tidegauge.plans import jobs
from tidegauge.session import materialise, shared_dir

AS_OF = 1706659200  # 2024-01-31


def correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.correlate(co.drop_normal(anomalies(spark, sf_dir)), GAP_S)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.to_alerts(correlated(spark, sf_dir))


def handled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.suppress_duplicates(alerts(spark, sf_dir), TTL_S)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.incident_rollup(correlated(spark, sf_dir))


@query(f"""
WITH {CORRELATED_SQL}
SELECT anomaly_id, correlation_key, incident_id, CAST(incident_started_s AS BIGINT) AS incident_started_s,
       incident_seq
FROM correlated""")
def correlate_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anomaly with its incident and its number inside it."""
    return comparable(
        correlated(spark, sf_dir).select(
            "anomaly_id", "correlation_key", "incident_id", "incident_started_s", "incident_seq"
        )
    )


CLOSED_SQL = f"""WITH {ANOMALIES_SQL},
kept AS (SELECT *, src_ip || ':' || dst_ip || ':' || protocol AS correlation_key
         FROM anomalies WHERE classification <> 'normal'),
closures AS (SELECT correlation_key, detected_s AS closed_s FROM kept WHERE classification = 'critical'
             AND anomaly_type = 'reconnaissance'),
eras AS (
  SELECT k.*, (SELECT count(*) FROM closures c WHERE c.correlation_key = k.correlation_key
               AND c.closed_s < k.detected_s) AS era FROM kept k),
steps AS (
  SELECT *, detected_s - lag(detected_s) OVER (
    PARTITION BY correlation_key, era ORDER BY detected_s, anomaly_id) AS step FROM eras),
runs AS (
  SELECT *, sum(CASE WHEN step IS NULL OR step > {GAP_S} THEN 1 ELSE 0 END) OVER (
    PARTITION BY correlation_key, era ORDER BY detected_s, anomaly_id) AS run FROM steps)
SELECT correlation_key, CAST(min(detected_s) AS BIGINT) AS created_s, count(*) AS anomaly_count
FROM runs GROUP BY correlation_key, era, run"""


@query(CLOSED_SQL)
def correlate_with_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents that operators close end early; here critical reconnaissance closes its own."""
    kept = co.drop_normal(anomalies(spark, sf_dir))
    closures = kept.filter(
        (F.col("classification") == "critical") & (F.col("anomaly_type") == "reconnaissance")
    ).select(co.correlation_key().alias("correlation_key"), F.col("detected_s").alias("closed_s"))
    rolled = co.correlate(kept, GAP_S, closures=closures)
    return comparable(
        rolled.groupBy("correlation_key", "incident_id").agg(
            F.min("detected_s").alias("created_s"), F.count(F.lit(1)).alias("anomaly_count")
        ).drop("incident_id")
    )


@query(f"""
WITH {CORRELATED_SQL}
SELECT correlation_key, CAST(min(detected_s) AS BIGINT) AS incident_started_s,
       CAST(max(detected_s) AS BIGINT) AS last_s, count(*) AS anomaly_count,
       round(max(ensemble_score), 3) AS max_ensemble_score
FROM correlated GROUP BY correlation_key, session""")
def incident_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same incidents with the built-in session window."""
    return comparable(co.incident_sessions(co.drop_normal(anomalies(spark, sf_dir)), GAP_S))


LISTED_SQL = CORRELATED_SQL + """,
seen AS (
  SELECT incident_id, kind, value, min(incident_seq) AS pos FROM (
    SELECT incident_id, incident_seq, unnest(['s', 'd', 't']) AS kind,
           unnest([src_ip, dst_ip, anomaly_type]) AS value FROM correlated)
  WHERE value IS NOT NULL GROUP BY incident_id, kind, value),
lists AS (
  SELECT incident_id,
         coalesce(list(value ORDER BY pos) FILTER (kind = 's'), []) AS src_ips,
         coalesce(list(value ORDER BY pos) FILTER (kind = 'd'), []) AS dst_ips,
         coalesce(list(value ORDER BY pos) FILTER (kind = 't'), []) AS types
  FROM seen GROUP BY incident_id),
totals AS (
  SELECT correlation_key, incident_id, count(*) AS n, max(ensemble_score) AS best,
         min(detected_s) AS created_s, max(detected_s) AS updated_s
  FROM correlated GROUP BY correlation_key, incident_id),
rolled AS (
  SELECT *, CASE WHEN len(types) = 0 THEN 'Anomaly Incident'
                 WHEN len(types) > 1 THEN 'Multi-type Anomaly Incident (' || len(types) || ' types)'
                 ELSE CASE types[1] WHEN 'reconnaissance' THEN 'Reconnaissance'
                   WHEN 'timing_anomaly' THEN 'Timing Anomaly'
                   WHEN 'volume_anomaly' THEN 'Volume Anomaly' ELSE 'Unknown' END || ' Incident'
            END AS title,
         'Correlated incident with ' || n || ' anomalies. Sources: '
           || array_to_string(src_ips[1:5], ', ') || '. Targets: '
           || array_to_string(dst_ips[1:5], ', ') || '. Max score: ' || printf('%.3f', best)
           AS description
  FROM totals JOIN lists USING (incident_id))
"""


@query(f"""
WITH {LISTED_SQL}
SELECT correlation_key, incident_id, n AS anomaly_count, round(best, 3) AS max_ensemble_score,
       CAST(created_s AS BIGINT) AS created_s, CAST(updated_s AS BIGINT) AS updated_s,
       array_to_string(src_ips, ',') AS src_ips, array_to_string(dst_ips, ',') AS dst_ips,
       array_to_string(types, ',') AS anomaly_types, len(src_ips) > 1 AS multi_source,
       len(dst_ips) > 1 AS multi_target, title, description
FROM rolled""")
def incident_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = incidents(spark, sf_dir)
    for name in ("src_ips", "dst_ips", "anomaly_types"):
        rolled = rolled.withColumn(name, F.array_join(name, ","))
    return comparable(rolled.drop("status", "src_ips_count", "dst_ips_count", "anomaly_types_count"))


@query(f"""
WITH {CORRELATED_SQL}
SELECT correlation_key, incident_id, kind, value, CAST(min(detected_s) AS BIGINT) AS first_s, count(*) AS alerts
FROM (SELECT correlation_key, incident_id, detected_s, unnest(['src_ips', 'dst_ips', 'anomaly_types']) AS kind,
             unnest([src_ip, dst_ip, anomaly_type]) AS value FROM correlated)
WHERE value IS NOT NULL GROUP BY correlation_key, incident_id, kind, value""")
def incident_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All addresses and types of incidents, a row each."""
    return comparable(co.incident_members(correlated(spark, sf_dir)).drop("at"))


@query(f"""
WITH {ANOMALIES_SQL},
steps AS (
  SELECT *, src_ip || ':' || protocol AS correlation_key, detected_s - lag(detected_s) OVER (
    PARTITION BY src_ip, protocol ORDER BY detected_s, anomaly_id) AS step
  FROM anomalies WHERE classification <> 'normal'),
runs AS (
  SELECT *, sum(CASE WHEN step IS NULL OR step > {GAP_S} THEN 1 ELSE 0 END) OVER (
    PARTITION BY correlation_key ORDER BY detected_s, anomaly_id) AS run FROM steps),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY correlation_key, run ORDER BY detected_s, anomaly_id) AS n
  FROM runs),
targets AS (
  SELECT a.correlation_key, a.run, a.n, a.ensemble_score, count(DISTINCT b.dst_ip) AS t
  FROM counted a JOIN counted b ON a.correlation_key = b.correlation_key AND a.run = b.run AND b.n <= a.n
  GROUP BY ALL)
SELECT correlation_key, count(*) AS anomaly_count, CAST(max(t) AS BIGINT) AS targets,
       'P' || min(least(CASE WHEN n >= 20 THEN 1 WHEN n >= 10 THEN 2 WHEN n >= 5 THEN 3 ELSE 4 END,
                        CASE WHEN ensemble_score >= 0.9 THEN 2 ELSE 4 END,
                        CASE WHEN t >= 3 THEN 2 ELSE 4 END)) AS priority
FROM targets GROUP BY correlation_key, run""")
def multi_target_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed by source and protocol an incident can have several targets, so that rule can fire."""
    found = co.to_alerts(
        co.correlate(co.drop_normal(anomalies(spark, sf_dir)), GAP_S, ("src_ip", "protocol"))
    ).withColumn("suppressed", F.lit(False))
    priority = escalate.incident_priority(found)
    rolled = co.incident_rollup(found)
    return comparable(
        rolled.join(priority, "incident_id").select(
            "correlation_key", "anomaly_count", F.size("dst_ips").alias("targets"), "priority"
        )
    )


CONTROLLED_SQL = f"""
WITH RECURSIVE {ANOMALIES_SQL},
kept AS (
  SELECT *, src_ip || ':' || protocol AS correlation_key,
         src_ip || ':' || dst_ip || ':' || protocol || ':' || coalesce(anomaly_type, 'None') AS dedup_key,
         CASE WHEN ensemble_score >= 0.9 THEN 'critical' WHEN ensemble_score >= 0.7 THEN 'medium'
              WHEN classification = 'critical' THEN 'critical'
              WHEN classification = 'anomaly' THEN 'medium' ELSE 'low' END AS severity
  FROM anomalies WHERE classification <> 'normal'),
closures AS (SELECT DISTINCT correlation_key, detected_s AS closed_s FROM kept WHERE severity = 'critical'
             AND anomaly_type = 'reconnaissance'),
eras AS (
  SELECT k.*, (SELECT count(*) FROM closures c WHERE c.correlation_key = k.correlation_key
               AND c.closed_s < k.detected_s) AS era FROM kept k),
steps AS (
  SELECT *, detected_s - lag(detected_s) OVER (
    PARTITION BY correlation_key, era ORDER BY detected_s, anomaly_id) AS step FROM eras),
runs AS (
  SELECT *, sum(CASE WHEN step IS NULL OR step > {GAP_S} THEN 1 ELSE 0 END) OVER (
    PARTITION BY correlation_key, era ORDER BY detected_s, anomaly_id) AS run FROM steps),
numbered_runs AS (
  SELECT *, min(detected_s) OVER (PARTITION BY correlation_key, era, run) AS started_s,
         row_number() OVER (PARTITION BY correlation_key, era, run ORDER BY detected_s, anomaly_id) AS incident_seq,
         row_number() OVER (PARTITION BY correlation_key, era, run, dst_ip ORDER BY detected_s, anomaly_id) AS of_target
  FROM runs),
released AS (SELECT dedup_key, detected_s + 900 AS released_s FROM kept WHERE severity = 'medium'),
ends AS (
  SELECT DISTINCT c.dedup_key, c.detected_s,
         least(c.detected_s + {TTL_S}, coalesce(
           (SELECT CASE WHEN count(*) > 0 THEN greatest(c.detected_s + 1, min(released_s)) END
            FROM released r WHERE r.dedup_key = c.dedup_key AND r.released_s >= c.detected_s),
           c.detected_s + {TTL_S})) AS lock_end
  FROM kept c),
passed(dedup_key, hit_s, lock_end) AS (
  SELECT dedup_key, min(detected_s), arg_min(lock_end, detected_s) FROM ends GROUP BY dedup_key
  UNION ALL
  SELECT p.dedup_key, min(e.detected_s), arg_min(e.lock_end, e.detected_s)
  FROM passed p JOIN ends e ON e.dedup_key = p.dedup_key AND e.detected_s >= p.lock_end
  GROUP BY p.dedup_key),
first_of AS (
  SELECT c.dedup_key, c.detected_s, min(anomaly_id) AS anomaly_id
  FROM kept c JOIN passed p ON c.dedup_key = p.dedup_key AND c.detected_s = p.hit_s GROUP BY c.dedup_key, c.detected_s),
marked AS (
  SELECT n.*, f.anomaly_id IS NULL AS suppressed,
         sum(CASE WHEN of_target = 1 THEN 1 ELSE 0 END) OVER (
           PARTITION BY n.correlation_key, era, run ORDER BY n.detected_s, n.anomaly_id) AS targets
  FROM numbered_runs n LEFT JOIN first_of f USING (dedup_key, detected_s, anomaly_id))"""


@query(f"""{CONTROLLED_SQL}
SELECT anomaly_id, left(sha256(correlation_key || '|' || started_s || '|0'), 32) AS incident_id,
       CAST(incident_seq AS BIGINT) AS incident_seq, suppressed,
       'P' || min(CASE WHEN suppressed THEN 4 ELSE least(
           CASE WHEN incident_seq >= 20 THEN 1 WHEN incident_seq >= 10 THEN 2 WHEN incident_seq >= 5 THEN 3 ELSE 4 END,
           CASE WHEN severity = 'critical' THEN 2 ELSE 4 END, CASE WHEN targets >= 3 THEN 2 ELSE 4 END) END)
         OVER (PARTITION BY correlation_key, era, run ORDER BY detected_s, anomaly_id) AS priority
FROM marked""")
def alerting_with_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts keyed by source and protocol, with acknowledged alerts and closed incidents.

    Medium alerts are acknowledged after 15 minutes; critical reconnaissance resolves the incident it is in. Several
    targets can fall into one incident, so the rule on them fires.
    """
    keys = ("src_ip", "protocol")
    found = anomalies(spark, sf_dir)
    store = shared_dir(spark)
    plain = co.to_alerts(co.correlate(co.drop_normal(found), GAP_S, keys))
    plain = materialise(plain.select("alert_id", "incident_id", "correlation_key", "dedup_key", "severity", "anomaly_type", "detected_s"), store, "alerts")
    acknowledged = plain.filter(F.col("severity") == "medium").select(
        F.col("alert_id").alias("id"), F.lit("acknowledged").alias("status"), (F.col("detected_s") + 900).alias("at_s")
    )
    resolved = plain.filter((F.col("severity") == "critical") & (F.col("anomaly_type") == "reconnaissance")).select(
        F.col("incident_id").alias("id"), F.lit("resolved").alias("status"), F.col("detected_s").alias("at_s")
    )
    handled_alerts, _, _ = jobs.alerting(
        found, GAP_S, TTL_S, key_columns=keys, store=store,
        releases=lifecycle.releases_of(acknowledged, plain), closures=lifecycle.closures_of(resolved, plain),
    )
    return comparable(handled_alerts.select("anomaly_id", "incident_id", "incident_seq", "suppressed", "priority"))


TITLE_SQL = """
  CASE WHEN anomaly_type IS NULL OR anomaly_type = 'unknown'
       THEN upper(left(classification, 1)) || substr(classification, 2) || ' ' || upper(protocol)
            || ' traffic from ' || src_ip
       ELSE CASE anomaly_type WHEN 'reconnaissance' THEN 'Reconnaissance'
              WHEN 'timing_anomaly' THEN 'Timing Anomaly' ELSE 'Volume Anomaly' END
            || ' detected from ' || src_ip END"""

TEXT_SQL = f"""
  'Anomaly detected in ' || upper(protocol) || ' traffic' || chr(10) || '  Source: ' || src_ip
    || chr(10) || '  Destination: ' || dst_ip || chr(10) || '  Classification: ' || classification
    || chr(10) || '  Ensemble Score: ' || printf('%.3f', ensemble_score)
    || chr(10) || '  Confidence: ' || printf('%.3f', confidence)
    || CASE WHEN anomaly_type IS NULL THEN '' ELSE chr(10) || '  Type: ' || anomaly_type END
    || chr(10) || '  Top Features:' || chr(10)
    || array_to_string(['    - ' || x.n || ': ' || printf('%.3f', abs(CAST(x.o AS DOUBLE)))
                        for x in list_sort(shares)[1:5]], chr(10))"""


@query(f"""
WITH {CORRELATED_SQL}
SELECT alert_id, incident_id, severity, 'open' AS status, {TITLE_SQL} AS title,
       {TEXT_SQL} AS description, dedup_key, anomaly_type,
       round(ensemble_score, 3) AS ensemble_score, round(confidence, 3) AS confidence
FROM correlated""")
def alert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(
        alerts(spark, sf_dir).select(
            "alert_id", "incident_id", "severity", "status", "title", "description", "dedup_key",
            "anomaly_type", "ensemble_score", "confidence",
        )
    )


@query(f"""
WITH {ANOMALIES_SQL}
SELECT anomaly_id, CAST(rank AS BIGINT) AS rank, x.n AS feature, round(-x.o, 3) AS value
FROM (SELECT anomaly_id, unnest(list_sort(shares)[1:5]) AS x, unnest(range(1, 6)) AS rank
      FROM anomalies)""")
def top_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.operators.classify import top_contributors as top

    ranked = anomalies(spark, sf_dir).select(
        "anomaly_id", F.posexplode(top(F.col("feature_contributions"), 5)).alias("rank", "x")
    )
    return comparable(
        ranked.select(
            "anomaly_id", (F.col("rank") + 1).alias("rank"), F.col("x.key").alias("feature"),
            F.col("x.value").alias("value"),
        )
    )


@query(f"WITH RECURSIVE {HANDLED_SQL} SELECT alert_id, dedup_key, suppressed FROM handled")
def suppress_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handled(spark, sf_dir).select("alert_id", "dedup_key", "suppressed")


@query(f"""
WITH RECURSIVE {CORRELATED_SQL},
released AS (SELECT dedup_key, detected_s AS released_s FROM correlated WHERE severity = 'critical'),
ends AS (
  SELECT DISTINCT c.dedup_key, c.detected_s,
         least(c.detected_s + {TTL_S}, coalesce(
           (SELECT CASE WHEN count(*) > 0 THEN greatest(c.detected_s + 1, min(released_s)) END
            FROM released r WHERE r.dedup_key = c.dedup_key AND r.released_s >= c.detected_s),
           c.detected_s + {TTL_S})) AS lock_end
  FROM correlated c),
passed(dedup_key, hit_s, lock_end) AS (
  SELECT dedup_key, min(detected_s), arg_min(lock_end, detected_s) FROM ends GROUP BY dedup_key
  UNION ALL
  SELECT p.dedup_key, min(e.detected_s), arg_min(e.lock_end, e.detected_s)
  FROM passed p JOIN ends e ON e.dedup_key = p.dedup_key AND e.detected_s >= p.lock_end
  GROUP BY p.dedup_key)
SELECT dedup_key, CAST(hit_s AS BIGINT) AS detected_s FROM passed""")
def suppress_with_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A critical alert is acknowledged at once, which frees its key again."""
    found = alerts(spark, sf_dir)
    releases = found.filter(F.col("severity") == "critical").select(
        "dedup_key", F.col("detected_s").alias("released_s")
    )
    passed = dedup.passing_seconds(found, TTL_S, releases=releases)
    return comparable(passed.select("dedup_key", "detected_s"))


@query(f"WITH RECURSIVE {PRIORITY_SQL} SELECT alert_id, incident_id, 'P' || rank AS priority FROM ranked")
def escalate_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return escalate.escalate(handled(spark, sf_dir)).select("alert_id", "incident_id", "priority")


@query(f"""
WITH RECURSIVE {PRIORITY_SQL},
moves AS (
  SELECT incident_id, detected_s, anomaly_id, rank, coalesce(lag(rank) OVER (
           PARTITION BY incident_id ORDER BY detected_s, anomaly_id), 4) AS old FROM ranked)
SELECT incident_id, CAST(detected_s AS BIGINT) AS detected_s, anomaly_id, 'P' || old AS old_priority,
       'P' || rank AS new_priority
FROM moves WHERE old <> rank""")
def escalation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(escalate.escalation_events(handled(spark, sf_dir)))


@query(f"""
WITH {CORRELATED_SQL},
updates AS (
  SELECT alert_id, arg_max(st, at_s) AS st FROM (
    SELECT alert_id, 'acknowledged' AS st, detected_s + 60 AS at_s FROM correlated WHERE severity = 'medium'
    UNION ALL
    SELECT alert_id, 'resolved', detected_s + 600 FROM correlated WHERE anomaly_id % 2 = 0)
  GROUP BY alert_id)
SELECT alert_id, coalesce(st, 'open') AS status FROM correlated LEFT JOIN updates USING (alert_id)""")
def apply_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medium alerts are acknowledged after a minute, even ones resolved after ten."""
    updated, _ = lifecycle.apply_status(alerts(spark, sf_dir), status_updates(spark, sf_dir), "alert_id")
    return updated.select("alert_id", "status")


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts(spark, sf_dir)
    row = lambda status, delay: [
        F.col("alert_id").alias("id"), F.lit(status).alias("status"),
        (F.col("detected_s") + delay).alias("at_s"),
    ]
    acknowledged = found.filter(F.col("severity") == "medium").select(*row("acknowledged", 60))
    resolved = found.filter(F.col("anomaly_id") % 2 == 0).select(*row("resolved", 600))
    return acknowledged.unionByName(resolved)


@query(f"""
WITH {ANOMALIES_SQL}
SELECT left(sha256('alert|' || anomaly_id), 32) AS id, 'resolved' AS status
FROM anomalies WHERE classification = 'normal'""")
def unknown_status_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates whose id is no alert: the ones for anomalies that never became one."""
    updates = anomalies(spark, sf_dir).select(
        co.alert_id().alias("id"), F.lit("resolved").alias("status"), F.col("detected_s").alias("at_s")
    )
    _, missing = lifecycle.apply_status(alerts(spark, sf_dir), updates, "alert_id")
    return missing.select("id", "status")


@query(f"""
WITH {CORRELATED_SQL}
SELECT alert_id, CAST(detected_s AS BIGINT) AS detected_s, severity
FROM correlated WHERE severity = 'medium' ORDER BY detected_s DESC, anomaly_id DESC LIMIT 50""")
def list_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lifecycle.list_alerts(alerts(spark, sf_dir), status="open", severity="medium")
    return comparable(listed.select("alert_id", "detected_s", "severity"))


@query(f"""
WITH {CORRELATED_SQL}
SELECT incident_id, CAST(max(detected_s) AS BIGINT) AS updated_s, count(*) AS anomaly_count
FROM correlated GROUP BY incident_id ORDER BY 2 DESC, 1 DESC LIMIT 50""")
def list_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lifecycle.list_incidents(incidents(spark, sf_dir), status="active")
    return comparable(listed.select("incident_id", "updated_s", "anomaly_count"))


@query(f"""
WITH {CORRELATED_SQL}
SELECT alert_id, incident_id, CAST(detected_s AS BIGINT) AS detected_s
FROM correlated WHERE alert_id = (SELECT min(alert_id) FROM correlated)""")
def get_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert by id; the id looked for is the smallest one."""
    found = alerts(spark, sf_dir)
    wanted = found.agg(F.min("alert_id")).first()[0]
    return comparable(
        lifecycle.get_by_id(found, "alert_id", wanted).select("alert_id", "incident_id", "detected_s")
    )


@query(f"""
WITH {CORRELATED_SQL}
SELECT alert_id, CASE WHEN age < 60 THEN age || 's ago' WHEN age < 3600 THEN age // 60 || 'm ago'
         WHEN age < 86400 THEN age // 3600 || 'h ago' ELSE age // 86400 || 'd ago' END AS age
FROM (SELECT alert_id, {AS_OF} - detected_s AS age FROM correlated)""")
def relative_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.functions.text import relative_age as age

    return alerts(spark, sf_dir).select("alert_id", age(F.col("detected_s"), AS_OF).alias("age"))


@query(f"""
WITH {CORRELATED_SQL}
SELECT alert_id, CAST(detected_s AS BIGINT) AS detected_s
FROM correlated WHERE detected_s >= {AS_OF} - 604800
ORDER BY detected_s DESC, anomaly_id DESC LIMIT 1000""")
def apply_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the last seven days, the newest thousand."""
    kept = lifecycle.apply_retention(
        alerts(spark, sf_dir), "detected_s", 604800, AS_OF, last=1000, tie="anomaly_id"
    )
    return comparable(kept.select("alert_id", "detected_s"))


@query(f"""
WITH {CORRELATED_SQL}
SELECT alert_id,
       CAST(count(*) OVER prior AS BIGINT) AS prior_alerts,
       round(max(ensemble_score) OVER prior, 3) AS prior_best
FROM correlated
WINDOW prior AS (PARTITION BY dst_ip ORDER BY detected_s RANGE BETWEEN 21600 PRECEDING AND 1 PRECEDING)""")
def prior_alert_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.prior_alert_context(alerts(spark, sf_dir), 21600)
    return comparable(found.select("alert_id", "prior_alerts", "prior_best"))
