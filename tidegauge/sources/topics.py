"""Record sources and keyed sinks: files for batch and stream, Kafka with the same records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge import schemas
from tidegauge.functions.ordered import forward_fill
from tidegauge.functions.text import joined_key
from tidegauge.operators.windows import FLOW

CORRUPT = "_corrupt"
MESSAGE_TOPICS = ("ics.parsed.modbus", "ics.parsed.dnp3", "ics.parsed.opcua")

Source = str | Mapping[str, str]


def read_text_records(spark: SparkSession, source: Source, streaming: bool = False) -> DataFrame:
    """`value`, where it came from and when it arrived, out of a path or of Kafka options.

    A path is read line by line; lines arrive when their file is written. Options are handed to the Kafka source, several topics as
    one comma-separated `subscribe` list; the connector is the cluster's to provide.
    """
    reader = spark.readStream if streaming else spark.read
    if isinstance(source, str):
        lines = reader.schema("value string").format("text").load(source)
        return lines.select(
            "value",
            F.col("_metadata.file_name").alias("topic"),
            F.lit(0).alias("partition"),
            F.col("_metadata.file_block_start").alias("offset"),
            F.col("_metadata.file_modification_time").alias("ingest_ts"),
        )
    records = reader.format("kafka").options(**source).load()
    return records.select(
        F.col("value").cast("string").alias("value"), "topic", "partition", "offset",
        F.col("timestamp").alias("ingest_ts"),
    )


def parse(records: DataFrame, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """Typed columns, the raw `value`, and `reject_reason` for records that are not usable.

    `ingest_ts`, the arrival time, stands in for the event time of messages without one.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = records.withColumn(
        "_r",
        F.from_json(
            "value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        ),
    )
    reason = F.when(F.col(f"_r.{CORRUPT}").isNotNull() | F.col("_r").isNull(), "bad_json")
    for name in required:
        reason = reason.when(F.col(f"_r.{name}").isNull(), f"missing_{name}")
    return parsed.select(
        "value", "topic", "partition", "offset", *[c for c in ("ingest_ts",) if c in records.columns],
        *[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields],
        reason.alias("reject_reason"),
    )


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and the rejected ones in raw form with source position and reason."""
    good = parsed.filter(F.col("reject_reason").isNull()).drop("value", "reject_reason")
    bad = parsed.filter(F.col("reject_reason").isNotNull()).select(
        "topic", "partition", "offset", "value", "reject_reason"
    )
    return good, bad


def read_packets(spark: SparkSession, source: Source, streaming: bool = False) -> DataFrame:
    """Raw packets; use `quarantine` to split off undecodable ones."""
    records = read_text_records(spark, source, streaming)
    return parse(records, schemas.RAW_PACKET, ("src_ip", "dst_ip", "payload_hex"))


def read_messages(spark: SparkSession, source: Source, streaming: bool = False) -> DataFrame:
    """Decoded messages of one or several topics, with topic, partition and offset attached."""
    return parse(read_text_records(spark, source, streaming), schemas.MESSAGE)


def read_features(spark: SparkSession, source: Source, streaming: bool = False) -> DataFrame:
    """Feature vectors; both spellings of the key and of the extraction time are understood."""
    plain = schemas.FEATURE_VECTOR
    aliased = T.StructType([
        *plain.fields,
        T.StructField("_window_key", schemas.WINDOW_KEY),
        T.StructField("_extracted_at", T.TimestampType()),
    ])
    parsed = parse(read_text_records(spark, source, streaming), aliased)
    merged = parsed.withColumn("window_key", F.coalesce("_window_key", "window_key")).withColumn(
        "extracted_at", F.coalesce("_extracted_at", "extracted_at")
    )
    reason = F.col("reject_reason")
    for name in ("window_key", "extracted_at", "protocol", "window_size_seconds"):
        reason = F.coalesce(reason, F.when(F.col(name).isNull(), f"missing_{name}"))
    return merged.withColumn("reject_reason", reason).drop("_window_key", "_extracted_at")


def read_anomalies(spark: SparkSession, source: Source, streaming: bool = False) -> DataFrame:
    """Anomaly results; scores outside [0, 1] are rejected."""
    parsed = parse(
        read_text_records(spark, source, streaming), schemas.ANOMALY,
        ("window_key", "detected_at", "ensemble_score", "classification", "confidence"),
    )
    reason = F.col("reject_reason")
    for name in ("ensemble_score", "confidence"):
        reason = F.coalesce(reason, F.when(~F.col(name).between(0, 1), f"range_{name}"))
    return parsed.withColumn("reject_reason", reason)


def flat_anomalies(good: DataFrame) -> DataFrame:
    """The columns correlation works on; an anomaly is identified by its content."""
    key = F.col("window_key")
    flat = good.select(
        *[key[f.name].alias(f.name) for f in schemas.WINDOW_KEY.fields],
        F.unix_seconds("detected_at").alias("detected_s"),
        "ensemble_score", "classification", "anomaly_type", "confidence", "feature_contributions",
    )
    identity = F.sha2(
        F.concat_ws("|", *FLOW, "window_size", "window_start", "detected_s", "ensemble_score"), 256
    )
    return flat.withColumn("anomaly_id", identity)


def read_training_features(
    spark: SparkSession, source: Source, max_rows: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Valid vectors from the earliest on, `max_rows` at most if asked for, and their names."""
    from tidegauge.operators.prep import feature_names

    good, _ = quarantine(read_features(spark, source))
    rows = good.drop("topic", "partition", "offset", "ingest_ts")
    if max_rows is not None:
        # no ties: rows that agree in everything are the same row
        whole = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
        rows = rows.orderBy("window_key.window_start", "window_key", whole).limit(max_rows)
    return rows, feature_names(rows)


def read_feature_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Files that each hold a JSON list of vectors, stacked; an error if there is none."""
    frame = spark.read.schema(schemas.FEATURE_VECTOR).json(
        path, multiLine=True, pathGlobFilter=glob
    )
    if not frame.inputFiles():
        raise FileNotFoundError(f"no files match {glob} in {path}")
    return frame


def load_labelled_process_csv(
    spark: SparkSession, path: str, sensors: Sequence[str], source_id: str | None = None,
    time_format: str = "d/M/yyyy h:mm:ss a", span_s: int = 86400,
) -> DataFrame:
    """Sensor rows with gaps filled forward within their source, and `label` 0 or 1."""
    columns = ["Timestamp", *sensors, "Normal/Attack", *([source_id] if source_id else [])]
    raw = spark.read.csv(path, header=True).select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in columns])
    typed = raw.select(
        F.coalesce(F.try_to_timestamp("Timestamp", F.lit(time_format)), F.try_to_timestamp("Timestamp"))
        .alias("ts"),
        *[F.col(s).try_cast("double").alias(s) for s in sensors],
        (F.col("Normal/Attack") == "Attack").cast("int").alias("label"),
        (F.col(source_id) if source_id else F.lit("all")).alias("source"),
    ).withColumn("ts_s", F.unix_seconds("ts"))
    return forward_fill(typed, list(sensors), ["source"], "ts_s", span_s)


def keyed(df: DataFrame, topic: Column, key_columns: Sequence[str] = FLOW) -> DataFrame:
    """`key, value, topic`: the record as JSON under its flow key, routed per row."""
    return df.select(
        joined_key(*key_columns).alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"),
        topic.alias("topic"),
    )


def message_topic(prefix: str = "ics.parsed.") -> Column:
    return F.concat(F.lit(prefix), F.lower("protocol"))


def message_records(envelope: DataFrame) -> DataFrame:
    """Decoded rows in the JSON form of the message topics: one `message` body per row."""
    body = F.coalesce(*[F.to_json(name) for name in ("modbus", "dnp3", "opcua")])
    union = F.from_json(body, schemas.MESSAGE_BODY)
    kept = [c for c in envelope.columns if c not in ("modbus", "dnp3", "opcua")]
    return envelope.select(*kept, union.alias("message"))


def write_keyed(df: DataFrame, target: Source, topic: Column, key_columns: Sequence[str] = FLOW) -> None:
    """Keyed JSON records to Kafka options, or to files partitioned by topic."""
    records = keyed(df, topic, key_columns)
    if isinstance(target, str):
        records.write.mode("append").partitionBy("topic").json(target)
    else:
        records.write.format("kafka").options(**target).save()


def save_training_data(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Vectors with their names as the schema; `json` gives the export of the feature topic."""
    df.write.mode("overwrite").format(form).save(path)
