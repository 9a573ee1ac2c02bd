"""Vector preparation, score evaluation and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.classify import CORE_SQL
from catalog.features import feature_rows
from catalog.registry import query
from catalog.views import ANOMALIES_SQL, GROUP_SQL, KEY_SQL, SIZES, anomalies, comparable, table
from tidegauge.operators import evaluate, prep
from tidegauge.operators.windows import WINDOW

NAMES = ["bytes_mean", "iat_mean", "message_count"]
VECTORS_SQL = CORE_SQL + """,
fitted AS (SELECT avg(bm) AS m1, stddev_pop(bm) AS s1, avg(iat_mean) AS m2, stddev_pop(iat_mean) AS s2,
                  avg(n) AS m3, stddev_pop(n) AS s3 FROM scored),
vectors AS (
  SELECT *, (bm - m1) / s1 AS z1, (iat_mean - m2) / s2 AS z2, (n - m3) / s3 AS z3
  FROM scored CROSS JOIN fitted)
"""
SERIES_SQL = "src_ip, dst_ip, protocol, window_size"


def core_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_rows(spark, sf_dir).select(*WINDOW, *NAMES)


def scaled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core_rows(spark, sf_dir)
    return prep.scale(rows, prep.fit_scaler(rows, NAMES))


@query(f"""
WITH {CORE_SQL}, long AS (
  SELECT unnest(['bytes_mean', 'iat_mean', 'message_count']) AS name, unnest([bm, iat_mean, n]) AS x
  FROM scored)
SELECT name, round(avg(x), 3) AS mean, round(stddev_pop(x), 3) AS std FROM long GROUP BY name""")
def scaler_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(prep.scaler_stats(core_rows(spark, sf_dir), NAMES))


@query(f"""
WITH {VECTORS_SQL}
SELECT {KEY_SQL}, round(z1, 3) AS bytes_mean, round(z2, 3) AS iat_mean, round(z3, 3) AS message_count,
       round(bm, 3) AS restored_bytes_mean
FROM vectors""")
def scale_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled values, and one of them scaled back."""
    rows = core_rows(spark, sf_dir)
    scaler = prep.fit_scaler(rows, NAMES)
    both = prep.inverse_scale(prep.scale(rows, scaler), scaler)
    return comparable(both.select(
        *WINDOW, *[F.col("scaled")[i].alias(n) for i, n in enumerate(NAMES)],
        F.col("restored")[0].alias("restored_bytes_mean"),
    ))


@query(f"""
WITH {CORE_SQL}
SELECT {KEY_SQL}, 0.0::DOUBLE AS absent, round(bm, 3) AS bytes_mean,
       CAST(window_size AS DOUBLE) AS window_size_seconds
FROM scored""")
def align_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted order of names decides; a name the rows lack is 0."""
    rows = prep.align_features(feature_rows(spark, sf_dir), ["absent", "bytes_mean", "window_size_seconds"])
    value = F.col("features")
    return comparable(rows.select(
        *WINDOW, value[0].alias("absent"), value[1].alias("bytes_mean"),
        value[2].alias("window_size_seconds"),
    ))


def _sequence_sql(length: int) -> str:
    frame = f"OVER (PARTITION BY {SERIES_SQL} ORDER BY window_start ROWS {length - 1} PRECEDING)"
    return f"""round(sum(z1) {frame}, 3) AS sum_bytes_mean, round(sum(z3) {frame}, 3) AS sum_count,
       CAST(greatest({length} - count(*) {frame}, 0) AS BIGINT) AS padding"""


def _sequence_sums(rows: DataFrame) -> DataFrame:
    part = lambda i: F.aggregate("sequence", F.lit(0.0), lambda acc, v: acc + v[i])
    empty = F.filter("sequence", lambda v: F.forall(v, lambda x: x == 0))
    return comparable(rows.select(
        *WINDOW, part(0).alias("sum_bytes_mean"), part(2).alias("sum_count"),
        F.size(empty).alias("padding"),
    ))


@query(f"WITH {VECTORS_SQL} SELECT {KEY_SQL}, {_sequence_sql(10)} FROM vectors")
def rolling_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten vectors of each series, checked by their sums and the padding."""
    return _sequence_sums(prep.rolling_sequences(scaled_rows(spark, sf_dir), 10))


@query(f"""
WITH {VECTORS_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY {SERIES_SQL} ORDER BY window_start) AS rn,
         count(*) OVER (PARTITION BY {SERIES_SQL}) AS total, {_sequence_sql(8)}
  FROM vectors)
SELECT {KEY_SQL}, sum_bytes_mean, sum_count, padding FROM placed
WHERE (rn >= 8 AND (rn - 8) % 3 = 0) OR (total < 8 AND rn = total)""")
def training_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of eight, every third one."""
    return _sequence_sums(prep.training_sequences(scaled_rows(spark, sf_dir), 8, 3))


@query(f"""
WITH {CORE_SQL}, held AS (SELECT {SERIES_SQL}, count(*) AS c FROM scored GROUP BY {SERIES_SQL})
SELECT count(*) AS total_connections, CAST(count_if(c >= 40) AS BIGINT) AS ready_sequences,
       round(avg(least(c, 40)), 3) AS avg_buffer_length, CAST(40 AS BIGINT) AS sequence_length
FROM held""")
def sequence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(prep.sequence_stats(core_rows(spark, sf_dir), 40))


@query(f"""
WITH {CORE_SQL}, held AS (SELECT {SERIES_SQL}, count(*) AS c FROM scored GROUP BY {SERIES_SQL})
SELECT {KEY_SQL} FROM scored JOIN held USING ({SERIES_SQL}) WHERE c >= 40""")
def prune_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(prep.prune_short(core_rows(spark, sf_dir), 40).select(*WINDOW))


@query(f"""
WITH {CORE_SQL}, placed AS (
  SELECT *, row_number() OVER (ORDER BY window_start, {GROUP_SQL}) AS rn, count(*) OVER () AS total
  FROM scored)
SELECT {KEY_SQL}, CASE WHEN rn <= floor(total * 0.7) THEN 'train'
         WHEN rn <= floor(total * 0.9) THEN 'validation' ELSE 'test' END AS part
FROM placed""")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70/20/10 by rank in time."""
    return comparable(prep.temporal_split(core_rows(spark, sf_dir)).select(*WINDOW, "part"))


SHARE_SQL = "CAST('0x' || left(md5({}), 8) AS BIGINT) / 4294967296.0"


@query(f"""
WITH {CORE_SQL}
SELECT {KEY_SQL}, CASE WHEN {SHARE_SQL.format("concat_ws('|', '7', src_ip, dst_ip, protocol, window_size, window_start)")} < 0.2
                       THEN 'validation' ELSE 'train' END AS part
FROM scored""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per part of a hash split."""
    train, validation = prep.random_split(core_rows(spark, sf_dir), 0.2, seed=7)
    both = train.withColumn("part", F.lit("train")).unionByName(
        validation.withColumn("part", F.lit("validation"))
    )
    return comparable(both.select(*WINDOW, "part"))


LABELLED_SQL = """
rated AS (SELECT doc_id, toxic AS y, ((doc_id * 37) % 1000 + toxic * 150) / 1000.0 AS s FROM labels)
"""


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (F.col("doc_id") * 37) % 1000 + F.col("toxic") * 150
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("toxic").alias("y"), (raw / 1000).alias("s")
    )


@query(f"""
WITH {LABELLED_SQL},
levels AS (SELECT CAST(s AS DOUBLE) AS s, sum(y) AS pos, sum(1 - y) AS neg FROM rated GROUP BY s),
curve AS (
  SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
         sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM levels),
f AS (
  SELECT *, tp / (tp + fp) AS pr, tp / p AS rc,
         2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-8) AS f1 FROM curve),
best AS (SELECT * FROM f ORDER BY f1 DESC, s LIMIT 1)
SELECT round(best.s, 3) AS optimal_threshold, round(pr, 3) AS precision, round(rc, 3) AS recall,
       round(best.f1, 3) AS f1,
       round((SELECT sum(neg * (tp - pos + pos / 2)) / max(p * n) FROM curve), 3) AS roc_auc,
       round((SELECT avg(s) FROM rated), 3) AS score_mean,
       round((SELECT stddev_pop(s) FROM rated), 3) AS score_std,
       round((SELECT quantile_cont(CAST(s AS DOUBLE), 0.95) FROM rated), 3) AS score_p95,
       round((SELECT quantile_cont(CAST(s AS DOUBLE), 0.99) FROM rated), 3) AS score_p99
FROM best""")
def labelled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best threshold and ROC-AUC of a made score against the toxic label."""
    return comparable(evaluate.labelled_metrics(_rated(spark, sf_dir), "s", "y"))


@query(f"""
WITH {ANOMALIES_SQL}
SELECT round(avg(ensemble_score), 3) AS ensemble_score_mean_score,
       round(stddev_pop(ensemble_score), 3) AS ensemble_score_std_score,
       round(avg(confidence), 3) AS confidence_mean_score,
       round(stddev_pop(confidence), 3) AS confidence_std_score
FROM anomalies""")
def evaluate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluate.evaluate_scores(anomalies(spark, sf_dir), ["ensemble_score", "confidence"]))


DRIFT_SQL = CORE_SQL + """,
long AS (
  SELECT unnest(['bytes_mean', 'iat_mean', 'message_count']) AS feature,
         unnest([bm, iat_mean, n]) AS x, window_start < 1705276800 AS base
  FROM scored WHERE window_size = 86400),
ranked AS (
  SELECT feature, x, sum(CASE WHEN base THEN 1 ELSE 0 END) OVER w AS b,
         sum(CASE WHEN base THEN 0 ELSE 1 END) OVER w AS c,
         sum(CASE WHEN base THEN 1 ELSE 0 END) OVER a AS bn, sum(CASE WHEN base THEN 0 ELSE 1 END) OVER a AS cn
  FROM long
  WINDOW w AS (PARTITION BY feature ORDER BY x), a AS (PARTITION BY feature)),
stat AS (
  SELECT feature, max(abs(b / bn - c / cn)) AS d, sqrt(max(bn * cn / (bn + cn))) AS en
  FROM ranked GROUP BY feature),
tail AS (
  SELECT feature, any_value(d) AS d, any_value(d * en) AS x,
         2 * sum((CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * d * d * en * en)) AS p
  FROM stat CROSS JOIN range(1, 101) r(j) GROUP BY feature),
tested AS (
  SELECT feature, d, CASE WHEN x < 0.04 THEN 1.0 ELSE greatest(0.0, least(1.0, p)) END AS p FROM tail)
"""


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = core_rows(spark, sf_dir).filter(F.col("window_size") == SIZES[2])
    early = F.col("window_start") < 1705276800
    return evaluate.ks_drift(days.filter(early), days.filter(~early), NAMES)


@query(f"""
WITH {DRIFT_SQL}
SELECT feature, round(d, 3) AS ks_statistic, round(p, 3) AS p_value, p < 0.05 AS drift_detected FROM tested""")
def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First against second half of the month, per feature."""
    return comparable(_drift(spark, sf_dir))


@query(f"""
WITH {DRIFT_SQL}
SELECT count(*) AS total_features, CAST(count_if(p < 0.05) AS BIGINT) AS drifted_features,
       round(count_if(p < 0.05) / count(*), 3) AS drift_ratio FROM tested""")
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluate.drift_summary(_drift(spark, sf_dir)))


@query("""
WITH rows AS (
  SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE epoch_us(ts) // 1000000 - (event_id % 13) * 60 END AS t,
         user_id % 7 AS src, CASE WHEN event_id % 40 = 0 THEN NULL ELSE value END AS reading,
         event_type = 'error' AS bad FROM events),
stepped AS (
  SELECT t < lag(t) OVER (PARTITION BY src ORDER BY event_id) AS down FROM rows WHERE t IS NOT NULL)
SELECT count(*) AS rows, CAST(count_if(t IS NULL) AS BIGINT) AS null_times,
       count(t) - count(DISTINCT t) AS duplicate_times, CAST(min(t) AS BIGINT) AS first_time,
       CAST(max(t) AS BIGINT) AS last_time, round(avg(CAST(bad AS INT)), 3) AS label_share,
       (SELECT CAST(count_if(down) AS BIGINT) FROM stepped) AS order_breaks,
       'missing_timestamps,' || CASE WHEN count(t) > count(DISTINCT t) THEN 'duplicate_timestamps,' ELSE '' END
       || 'timestamps_not_monotonic,missing_rate_reading'
       AS issues, false AS valid
FROM rows""")
def dataset_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, repeated and disordered times, missing values and label share."""
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 50 != 0,
               F.unix_seconds(F.col("ts").cast("timestamp")) - F.col("event_id") % 13 * 60).alias("t"),
        (F.col("user_id") % 7).alias("src"),
        F.when(F.col("event_id") % 40 != 0, F.col("value")).alias("reading"),
        (F.col("event_type") == "error").cast("int").alias("bad"),
    )
    found = evaluate.dataset_quality(rows, "t", ["reading"], "bad", "src", "event_id", span=5000)
    return comparable(found.withColumn("issues", F.array_join("issues", ",")))


@query(f"""
WITH {ANOMALIES_SQL}, marked AS (SELECT anomaly_id, CAST(classification = 'critical' AS INT) AS y FROM anomalies)
SELECT CAST(y AS BIGINT) AS y, anomaly_id FROM marked WHERE y = 1 OR {SHARE_SQL.format("concat_ws('|', '3', anomaly_id)")} < 0.1""")
def rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All critical anomalies and a tenth of the others, chosen by hash."""
    marked = anomalies(spark, sf_dir).withColumn("y", (F.col("classification") == "critical").cast("int"))
    kept = evaluate.rebalance(marked, "y", 0.1, ["anomaly_id"], seed=3)
    return comparable(kept.select("y", "anomaly_id"))


@query(f"""
WITH {ANOMALIES_SQL} SELECT anomaly_id FROM anomalies WHERE classification <> 'critical'""")
def normal_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = anomalies(spark, sf_dir).withColumn("y", (F.col("classification") == "critical").cast("int"))
    return evaluate.normal_only(marked, "y").select("anomaly_id")


def _f1(rated: DataFrame, half: int) -> DataFrame:
    hit = F.col("s") >= 0.5
    return rated.filter(F.col("doc_id") % 2 == half).agg(
        F.lit("ensemble").alias("model"),
        (2 * F.sum(F.when(hit, F.col("y")).otherwise(0)) / (F.count_if(hit) + F.sum("y"))).alias("f1"),
    )


@query(f"""
WITH {DRIFT_SQL.rstrip()}, {LABELLED_SQL.strip()},
halves AS (
  SELECT h, sum(y * CAST(s >= 0.5 AS INT)) AS tp, sum(CAST(s >= 0.5 AS INT)) AS pp, sum(y) AS p
  FROM (SELECT *, doc_id % 2 AS h FROM rated) GROUP BY h),
f AS (SELECT h, 2.0 * tp / (pp + p) AS f1 FROM halves)
SELECT 'ensemble' AS model, round(a.f1, 3) AS baseline_f1, round(b.f1, 3) AS current_f1,
       (SELECT max(p < 0.05) FROM tested) AS drift, (a.f1 - b.f1) / a.f1 > 0.1 AS degraded,
       (a.f1 - b.f1) / a.f1 > 0.1 OR (SELECT max(p < 0.05) FROM tested) AS retrain
FROM f a, f b WHERE a.h = 0 AND b.h = 1""")
def retrain_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 at 0.5 on even and odd documents stands for before and after."""
    rated = _rated(spark, sf_dir)
    return comparable(evaluate.retrain_triggers(_f1(rated, 0), _f1(rated, 1), _drift(spark, sf_dir)))


def _drift_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feature_rows(spark, sf_dir)
    early = F.col("window_start") < 1705276800
    return evaluate.ks_drift(rows.filter(early), rows.filter(~early), prep.feature_names(rows))


@query()
def ks_drift_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ks_drift, over the windows of all sizes and every numeric feature."""
    return comparable(_drift_all(spark, sf_dir))


@query()
def drift_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluate.drift_summary(_drift_all(spark, sf_dir)))


@query()
def retrain_triggers_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As retrain_triggers, but drift in any feature and any window size fires it."""
    rated = _rated(spark, sf_dir)
    return comparable(evaluate.retrain_triggers(_f1(rated, 0), _f1(rated, 1), _drift_all(spark, sf_dir)))
