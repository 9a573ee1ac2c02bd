"""Per-window feature vectors.

Three aggregates share the window key and are joined on it at the end; all of them are made of partial states that add up,
so they can also be taken per pane and merged upward (`panes`):

* volume and protocol measures - counts, sums, extremes and sums of squares;
* inter-arrival statistics - gaps inside slices, and those between neighbouring slices;
* value histograms - one row per distinct value, so that distinct counts, entropy and the most common value never need a
  window's messages in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import names
from tidegauge.functions.stats import or_zero, or_zero_double, ratio
from tidegauge.operators import panes
from tidegauge.operators.panes import Measure
from tidegauge.operators.windows import (
    DEFAULT_SIZES,
    FLOW,
    MICROS,
    WINDOW,
    assign_windows,
    inter_arrivals,
)

FALLBACK = "modbus"


@dataclass(frozen=True)
class FeatureSet:
    """What one protocol adds to the common features.

    measures: aggregates over the messages of a window; a `Measure` is merged from panes, a plain
              aggregate column is computed on the messages of each window anew
    values:   text columns whose distribution is counted
    lists:    the same for columns that hold several values per message (arrays of text)
    entropies: the value kinds whose entropy is needed
    modes:    the value kinds whose most common value is needed
    outputs:  feature columns over measures and histogram columns
    """

    measures: dict[str, Column | Measure] = field(default_factory=dict)
    values: dict[str, Column] = field(default_factory=dict)
    lists: dict[str, Column] = field(default_factory=dict)
    entropies: tuple[str, ...] = ()
    modes: tuple[str, ...] = ()
    outputs: dict[str, Column] = field(default_factory=dict)

    def kinds(self) -> list[str]:
        return [*self.values, *self.lists]


_REGISTRY: dict[str, Callable[[], FeatureSet]] = {}


def register_extractor(protocol: str, builder: Callable[[], FeatureSet]) -> None:
    """Add or replace the feature set of a protocol."""
    _REGISTRY[protocol.lower()] = builder


def registered() -> dict[str, FeatureSet]:
    return {name: build() for name, build in _REGISTRY.items()}


def feature_family(protocol: Column) -> Column:
    """Name of the feature set a protocol uses; a protocol without one gets Modbus features."""
    lowered = F.lower(protocol)
    return F.when(lowered.isin(*_REGISTRY), lowered).otherwise(FALLBACK)


_count_of = panes.counted


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _nonzero(column: str) -> Column:
    return F.when(F.col(column) != 0, _text(column))


def _stat(kind: str, name: str) -> Column:
    """What the histogram of the window says about one kind; null without values of it."""
    return F.col(f"{kind}__{name}")


def distinct(kind: str) -> Column:
    return or_zero(_stat(kind, "distinct")).cast("bigint")


def total(kind: str) -> Column:
    return or_zero(_stat(kind, "total")).cast("bigint")


def entropy(kind: str) -> Column:
    """log2(total) - sum of n*log2(n) / total over the counts n of the values."""
    many = total(kind)
    return F.when(many > 0, F.log2(many) - _stat(kind, "logs") / many).otherwise(0.0)


def most_common(kind: str) -> Column:
    """Struct of the most common value and its count; ties go to the value seen first."""
    return _stat(kind, "mode")


def _modbus() -> FeatureSet:
    code = F.col("function_code")
    exception = F.coalesce(F.col("is_exception"), F.lit(False))
    to_server = F.coalesce(F.col("dst_port") == 502, F.lit(False))
    measures = {
        "mb_codes": panes.present(code),
        "mb_reads": _count_of(code.isin(names.MODBUS_READ)),
        "mb_writes": _count_of(code.isin(names.MODBUS_WRITE)),
        "mb_diagnostics": _count_of(code.isin(names.MODBUS_DIAGNOSTIC)),
        "mb_addr_mean": panes.mean("start_address"),
        "mb_addr_std": panes.spread("start_address"),
        "mb_addr_min": panes.smallest("start_address"),
        "mb_addr_max": panes.largest("start_address"),
        "mb_qty_mean": panes.mean("quantity"),
        "mb_qty_max": panes.largest("quantity"),
        "mb_exceptions": _count_of(exception),
        "mb_requests": _count_of(~exception & to_server),
    }
    requests = F.col("mb_requests")
    outputs = {
        "fc_unique_count": distinct("mb_fc"),
        "fc_read_ratio": ratio(F.col("mb_reads"), F.col("mb_codes")),
        "fc_write_ratio": ratio(F.col("mb_writes"), F.col("mb_codes")),
        "fc_diagnostic_ratio": ratio(F.col("mb_diagnostics"), F.col("mb_codes")),
        "fc_entropy": entropy("mb_fc"),
        "fc_most_common": or_zero(most_common("mb_fc")["value"].cast("bigint")),
        "fc_most_common_ratio": ratio(or_zero(most_common("mb_fc")["count"]), F.col("mb_codes")),
        "unit_id_unique_count": distinct("mb_unit"),
        "unit_id_entropy": entropy("mb_unit"),
        "addr_unique_count": distinct("mb_addr"),
        "addr_mean": or_zero_double(F.col("mb_addr_mean")),
        "addr_std": or_zero_double(F.col("mb_addr_std")),
        "addr_min": or_zero(F.col("mb_addr_min")).cast("bigint"),
        "addr_max": or_zero(F.col("mb_addr_max")).cast("bigint"),
        "addr_range": or_zero(F.col("mb_addr_max") - F.col("mb_addr_min")).cast("bigint"),
        "qty_mean": or_zero_double(F.col("mb_qty_mean")),
        "qty_max": or_zero(F.col("mb_qty_max")).cast("bigint"),
        "exception_count": F.col("mb_exceptions"),
        "exception_ratio": ratio(F.col("mb_exceptions"), F.col("message_count")),
        "exception_codes_unique": distinct("mb_exc"),
        "request_count": requests,
        "response_count": F.col("message_count") - requests,
        "request_ratio": ratio(requests, F.col("message_count"), 0.5),
    }
    return FeatureSet(
        measures=measures,
        values={
            "mb_fc": _text("function_code"),
            "mb_unit": _text("unit_id"),
            "mb_addr": _text("start_address"),
            "mb_exc": F.when(exception, _text("exception_code")),
        },
        entropies=("mb_fc", "mb_unit"),
        modes=("mb_fc",),
        outputs=outputs,
    )


def _dnp3() -> FeatureSet:
    code = F.col("dnp3_code")
    groups = F.coalesce(F.col("object_groups"), F.array().cast("array<int>"))
    in_groups = lambda wanted: panes.summed(F.size(F.filter(groups, lambda g: g.isin(wanted))))
    measures = {
        "dn_codes": panes.present(code),
        "dn_reads": _count_of(code.isin(names.DNP3_READ)),
        "dn_writes": _count_of(code.isin(names.DNP3_WRITE)),
        "dn_restarts": _count_of(code.isin(names.DNP3_RESTART)),
        "dn_responses": _count_of(code.isin(names.DNP3_RESPONSE)),
        "dn_objects": panes.summed(F.size(F.filter(groups, lambda g: g.isNotNull()))),
        "dn_binary_in": in_groups(names.DNP3_BINARY_INPUT),
        "dn_binary_out": in_groups(names.DNP3_BINARY_OUTPUT),
        "dn_analog_in": in_groups(names.DNP3_ANALOG_INPUT),
        "dn_analog_out": in_groups(names.DNP3_ANALOG_OUTPUT),
        "dn_masters": _count_of(F.col("is_master")),
        "dn_unsolicited": _count_of(F.col("unsolicited")),
    }
    of_codes = lambda part: ratio(F.col(part), F.col("dn_codes"))
    of_objects = lambda part: ratio(F.col(part), F.col("dn_objects"))
    outputs = {
        "fc_unique_count": distinct("dn_fc"),
        "fc_read_ratio": of_codes("dn_reads"),
        "fc_write_ratio": of_codes("dn_writes"),
        "fc_control_ratio": of_codes("dn_restarts"),
        "fc_response_ratio": of_codes("dn_responses"),
        "fc_entropy": entropy("dn_fc"),
        "dnp3_src_unique": distinct("dn_src"),
        "dnp3_dst_unique": distinct("dn_dst"),
        "dnp3_addr_pairs": distinct("dn_pair"),
        "obj_group_unique": distinct("dn_group"),
        "obj_binary_input_ratio": of_objects("dn_binary_in"),
        "obj_binary_output_ratio": of_objects("dn_binary_out"),
        "obj_analog_input_ratio": of_objects("dn_analog_in"),
        "obj_analog_output_ratio": of_objects("dn_analog_out"),
        "master_ratio": ratio(F.col("dn_masters"), F.col("message_count"), 0.5),
        "unsolicited_count": F.col("dn_unsolicited"),
        "unsolicited_ratio": ratio(F.col("dn_unsolicited"), F.col("message_count")),
    }
    # concat gives NULL, hence no entry, unless both ends are known
    pair = F.concat(
        F.col("dnp3_source").cast("string"), F.lit(">"), F.col("dnp3_destination").cast("string")
    )
    return FeatureSet(
        measures=measures,
        values={
            "dn_fc": _text("dnp3_code"),
            "dn_src": _text("dnp3_source"),
            "dn_dst": _text("dnp3_destination"),
            "dn_pair": pair,
        },
        lists={"dn_group": groups.cast("array<string>")},
        entropies=("dn_fc",),
        outputs=outputs,
    )


def _opcua() -> FeatureSet:
    kind = F.nullif(F.col("message_type"), F.lit(""))
    service = F.nullif(F.col("service_type"), F.lit(""))
    sequence = F.nullif(F.col("sequence_number"), F.lit(0))
    measures = {
        "ua_types": panes.present(kind),
        "ua_handshakes": _count_of(kind.isin(names.OPCUA_HANDSHAKE)),
        "ua_data": _count_of(kind.isin(names.OPCUA_DATA)),
        "ua_errors": _count_of(kind.isin(names.OPCUA_ERROR)),
        "ua_opened": _count_of(service == "OpenSecureChannel"),
        "ua_closed": _count_of(service == "CloseSecureChannel"),
        "ua_service_errors": _count_of(service == "Error"),
        "ua_seq_min": panes.smallest(sequence),
        "ua_seq_max": panes.largest(sequence),
    }
    of_types = lambda part: ratio(F.col(part), F.col("ua_types"))
    channels = total("ua_channel")
    outputs = {
        "msg_type_unique": distinct("ua_type"),
        "msg_handshake_ratio": of_types("ua_handshakes"),
        "msg_data_ratio": of_types("ua_data"),
        "msg_error_ratio": of_types("ua_errors"),
        "msg_type_entropy": entropy("ua_type"),
        "channel_unique": distinct("ua_channel"),
        "token_unique": distinct("ua_token"),
        "channel_reuse_ratio": F.when(channels > 0, 1 - distinct("ua_channel") / channels).otherwise(
            0.0
        ),
        "service_unique": distinct("ua_service"),
        "service_open_channel": F.col("ua_opened"),
        "service_close_channel": F.col("ua_closed"),
        "service_error": F.col("ua_service_errors"),
        # the numbers missing between the distinct sorted ones, without sorting them
        "sequence_gaps": or_zero(
            F.col("ua_seq_max") - F.col("ua_seq_min") + 1 - distinct("ua_seq")
        ).cast("bigint"),
    }
    return FeatureSet(
        measures=measures,
        values={
            "ua_type": kind,
            "ua_channel": _nonzero("secure_channel_id"),
            "ua_token": _nonzero("security_token_id"),
            "ua_service": service,
            "ua_seq": sequence.cast("string"),
        },
        entropies=("ua_type",),
        outputs=outputs,
    )


register_extractor("modbus", _modbus)
register_extractor("dnp3", _dnp3)
register_extractor("opcua", _opcua)


def volume_measures() -> dict[str, Column]:
    size = or_zero(F.col("payload_size"))
    return {
        "message_count": F.count(F.lit(1)),
        "bytes_total": F.sum(size),
        "bytes_mean": F.avg(size),
        "bytes_std": F.stddev_pop(size),
        "bytes_min": F.min(size),
        "bytes_max": F.max(size),
    }


def volume_parts() -> dict[str, Measure]:
    """The same measures in parts that panes can hold."""
    size = or_zero(F.col("payload_size"))
    return {
        "message_count": panes.present(F.lit(1)),
        "bytes_total": panes.summed(size),
        "bytes_mean": panes.mean(size),
        "bytes_std": panes.spread(size),
        "bytes_min": panes.smallest(size),
        "bytes_max": panes.largest(size),
    }


def volume_features(windowed: DataFrame) -> DataFrame:
    """Message count and payload size statistics; a missing size counts as 0."""
    return windowed.groupBy(*WINDOW).agg(
        *[column.alias(name) for name, column in volume_measures().items()]
    )


def timing_features(
    messages: DataFrame,
    sizes: Sequence[int] = DEFAULT_SIZES,
    slice_seconds: int | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Inter-arrival statistics of the windows that hold at least two messages.

    Messages are sorted once, inside slices of a flow (by default of the smallest size). A slice hands on its first and last
    time, joining slices adds the gap between them, and a pair counts for a size when both ends share its window. The exact
    median is safe in memory: the gaps of a window of W microseconds add up to at most W, so it has at most sqrt(2*W)+1
    distinct ones, and the percentile buffer, which merges like the other partial aggregates, holds one counter per
    distinct value.
    """
    gap_us = F.col("ts_us") - F.col("prev_us")
    pairs = (
        assign_windows(inter_arrivals(messages, sizes, slice_seconds), sizes)
        .filter(F.col("prev_us") >= F.col("window_start") * MICROS)
        .withColumn("gap_us", gap_us)
    )
    gap = F.col("gap_us") / MICROS
    return pairs.groupBy(*WINDOW).agg(
        F.avg(gap).alias("iat_mean"),
        F.stddev_pop(gap).alias("iat_std"),
        F.min(gap).alias("iat_min"),
        F.max(gap).alias("iat_max"),
        (F.percentile("gap_us", F.lit(0.5)) / MICROS).alias("iat_median"),
        *[column.alias(name) for name, column in (extra or {}).items()],
    )


def _entries(feature_set: FeatureSet) -> Column:
    """All values of a message as (kind, value) pairs."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    parts = [F.array(*[pair(kind, value) for kind, value in feature_set.values.items()])]
    for name, listed in feature_set.lists.items():
        parts.append(F.transform(listed, lambda v: pair(name, v)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def value_counts(rows: DataFrame, span: Sequence[str], sets: dict[str, FeatureSet] | None = None) -> DataFrame:
    """One row per flow and time span, kind and distinct value: count and first arrival.

    Counts are combined before the shuffle and the value is part of the shuffle key, so a busy
    span is spread over the tasks by its values.
    """
    sets = registered() if sets is None else sets
    family = feature_family(F.col("protocol"))
    entries = None
    for name, feature_set in sets.items():
        if not feature_set.values:
            continue
        own = _entries(feature_set)
        entries = F.when(family == name, own) if entries is None else entries.when(family == name, own)
    return (
        rows.select(*span, "ts_us", "msg_id", F.explode(entries).alias("entry"))
        .select(*span, "ts_us", "msg_id", "entry.kind", "entry.value")
        .filter(F.col("value").isNotNull())
        .groupBy(*span, "kind", "value")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min(F.coalesce("msg_id", "ts_us")).alias("first_seen"),
        )
    )


def value_histogram(windowed: DataFrame, sets: dict[str, FeatureSet] | None = None) -> DataFrame:
    """One row per window, kind and distinct value."""
    return value_counts(windowed, WINDOW, sets)


def histogram_features(
    histogram: DataFrame, sets: dict[str, FeatureSet] | None = None
) -> DataFrame:
    """Per window and kind: distinct count, total, sum of n*log2(n) and most common value, as columns of one row.

    A window has a handful of kinds; every step combines before it shuffles.
    """
    sets = registered() if sets is None else sets
    kind, count = F.col("kind"), F.col("count")
    columns, modes = [], []
    for feature_set in sets.values():
        for name in feature_set.kinds():
            mine = kind == name
            columns.append(F.count_if(mine).alias(f"{name}__distinct"))
            columns.append(F.sum(F.when(mine, count)).alias(f"{name}__total"))
            if name in feature_set.entropies:
                columns.append(F.sum(F.when(mine, count * F.log2(count))).alias(f"{name}__logs"))
        modes += feature_set.modes
    rows = histogram.groupBy(*WINDOW).agg(*columns)
    if not modes:
        return rows
    seen_first = F.struct(count, (-F.col("first_seen")).alias("seen"))
    common = histogram.filter(kind.isin(modes)).groupBy(*WINDOW).agg(*[
        F.max_by(F.struct("value", "count"), F.when(kind == name, seen_first)).alias(f"{name}__mode") for name in modes
    ])
    return rows.join(common, WINDOW, "left")


def extract_features(
    messages: DataFrame,
    sizes: Sequence[int] = DEFAULT_SIZES,
    slice_seconds: int | None = None,
    roll_up: bool = False,
) -> DataFrame:
    """One row per flow, size and window with every feature; those of other protocols are NULL.

    With `roll_up` messages are aggregated once, per pane, and windows of all sizes merged upward from the panes' states:
    the same rows, for less work where panes hold many messages and for more where they hold a few.
    """
    sets = registered()
    stamped = messages.filter(F.col("ts_us").isNotNull())
    windowed = assign_windows(stamped, sizes)
    merged, direct = volume_parts(), {}
    for feature_set in sets.values():
        for name, measure in feature_set.measures.items():
            (merged if isinstance(measure, Measure) else direct)[name] = measure
    timing = timing_features(messages, sizes, slice_seconds)
    if roll_up:
        joined = panes.measured(stamped, merged, sizes)
        if direct:
            anew = windowed.groupBy(*WINDOW).agg(*[c.alias(n) for n, c in direct.items()])
            joined = joined.join(anew, WINDOW)
        counts = panes.merged_counts(value_counts(panes.in_panes(stamped, sizes), panes.PANE, sets), sizes)
    else:
        whole = {name: measure.over_messages() for name, measure in merged.items()} | direct
        joined = windowed.groupBy(*WINDOW).agg(*[c.alias(n) for n, c in whole.items()])
        counts = value_histogram(windowed, sets)
    joined = joined.join(timing, WINDOW, "left").join(histogram_features(counts, sets), WINDOW, "left")
    return joined.select(*WINDOW, *feature_columns(sets))


def feature_columns(sets: dict[str, FeatureSet] | None = None) -> list[Column]:
    """The final projection over the three joined aggregates."""
    sets = registered() if sets is None else sets
    family = feature_family(F.col("protocol"))
    outputs: dict[str, Column] = {
        "feature_protocol": family,
        "window_size_seconds": F.col("window_size"),
    }
    for name in volume_measures():
        outputs[name] = F.col(name)
    for name in ("iat_mean", "iat_std", "iat_min", "iat_max", "iat_median"):
        outputs[name] = or_zero_double(F.col(name))
    chosen: dict[str, Column] = {}
    for protocol, feature_set in sets.items():
        for name, column in feature_set.outputs.items():
            mine = family == protocol
            chosen[name] = (
                chosen[name].when(mine, column) if name in chosen else F.when(mine, column)
            )
    outputs.update(chosen)
    return [column.alias(name) for name, column in outputs.items()]


def to_vector_records(features: DataFrame, extracted_at: Column) -> DataFrame:
    """The published record: nested window key, extraction time, label, then the features."""
    head = ["window_key", "extracted_at", "protocol"]
    names_left = [c for c in features.columns if c not in (*WINDOW, "feature_protocol")]
    return features.select(
        F.struct(*WINDOW).alias(head[0]),
        extracted_at.alias(head[1]),
        F.col("feature_protocol").alias(head[2]),
        *names_left,
    )


def from_vector_records(records: DataFrame) -> DataFrame:
    """Flat window columns back out of published records."""
    key = F.col("window_key")
    rest = [c for c in records.columns if c not in ("window_key", "extracted_at", "protocol")]
    return records.select(
        *[key[c].alias(c) for c in WINDOW], F.col("protocol").alias("feature_protocol"), *rest
    )


__all__ = [
    "FLOW", "WINDOW", "FeatureSet", "extract_features", "feature_columns", "feature_family",
    "from_vector_records", "histogram_features", "register_extractor", "registered",
    "timing_features", "to_vector_records", "value_histogram", "volume_features",
    "volume_measures",
]
