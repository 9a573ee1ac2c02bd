"""Keyed stateful operators of the alerting stage, in event-time order.

Rows of a key are held until the watermark has passed them and then taken in time order, so the order of arrival inside
the allowed lateness changes nothing. Timers run on event time: one wakes a key when its earliest held row is due, one when
its state can matter no more, which is then dropped. Rows older than the watermark come out flagged `late` and change no
state; `LateSplit` writes them to a table of their own. All steps over the rows of a key are array operations; a loop runs
over the alerts that pass a lock only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidegauge.operators import correlate as co
from tidegauge.operators.dedup import TTL_S
from tidegauge.operators.escalate import Escalation
from tidegauge.operators.prep import SEQUENCE_LENGTH, SERIES
from tidegauge.operators.windows import FLOW

ALERT_COLUMNS = [
    "alert_id", "anomaly_id", "detected_s", "correlation_key", "dedup_key", "severity",
    "ensemble_score", "src_ip", "dst_ip",
]
ALERT, RELEASE, CLOSURE = "alert", "release", "closure"
_NO_TIME = -(1 << 40)  # rows without a time are late at any watermark


def _tuples(frame: pd.DataFrame) -> list[tuple]:
    """Rows as the state store takes them."""
    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
    return [tuple(map(plain, row)) for row in frame.itertuples(index=False, name=None)]


class InTimeOrder(StatefulProcessor):
    """Holds the rows of a key until the watermark has passed them.

    Subclasses take due rows in `process`, say in `idle_from` from which watermark (ms) on their state is of no use (None:
    there is none, or it is kept for ever), and drop it in `forget`.
    """

    def __init__(self, rows: StructType, out: StructType, time: str, order: list[str]) -> None:
        self.rows, self.time, self.order = rows, time, order
        self.columns, self.out = rows.fieldNames(), out.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [frame for frame in rows if len(frame)]
        if not frames:
            return
        incoming = pd.concat(frames, ignore_index=True)[self.columns]
        late = incoming[self.time].to_numpy() * 1000 < max(timerValues.getCurrentWatermarkInMs(), _NO_TIME * 1000 + 1)
        if late.any():
            yield self._shaped(incoming[late].assign(late=True))
        fresh = incoming[~late]
        if len(fresh):
            self.held.appendList(_tuples(fresh))
            self._wake(int(fresh[self.time].min()) * 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=self.columns)
        due = held[self.time].to_numpy(dtype=np.int64) * 1000 < mark
        rest = held[~due]
        if due.any():
            if len(rest):
                self.held.put(_tuples(rest))
            else:
                self.held.clear()
            for frame in self.process(key, held[due].sort_values(self.order, kind="stable", ignore_index=True)):
                yield self._shaped(frame.assign(late=False))
        if len(rest):
            self._wake(int(rest[self.time].min()) * 1000 + 1)
        idle = self.idle_from()
        if idle is not None and idle <= mark:
            self.forget()
        elif idle is not None:
            self._wake(idle)

    def _wake(self, at_ms: int) -> None:
        self.handle.registerTimer(int(at_ms))

    def _shaped(self, frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(**{c: None for c in self.out if c not in frame.columns})[self.out]

    def process(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def idle_from(self) -> int | None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _in_time_order(rows: DataFrame, keys: Sequence[str], time: str, lateness_s: int, processor: InTimeOrder, out: StructType) -> DataFrame:
    """Runs a processor over the rows of each key. The column that carries the watermark is left out behind it, as Spark
    drops late rows of a stateful operator that can see it."""
    marked = rows.withColumn("event_time__", F.timestamp_seconds(time)).withWatermark("event_time__", f"{lateness_s} seconds")
    timed = marked.withColumn(time, F.coalesce(F.col(time), F.lit(_NO_TIME)))
    return timed.drop("event_time__").groupBy(*keys).transformWithStateInPandas(processor, out, "append", "eventTime")


def passing(
    seconds: np.ndarray, releases: np.ndarray, ttl_s: int, lock: tuple[int, int] | None
) -> tuple[list[int], tuple[int, int] | None]:
    """Places of the seconds (rising) at which a key is not locked, and its last lock (set, end).

    A release frees the key from its second on, but never inside the second that set the lock.
    """
    passes: list[int] = []
    if lock is not None and len(releases):
        lock = lock[0], min(lock[1], max(int(releases[0]), lock[0] + 1))
    at = 0 if lock is None else int(np.searchsorted(seconds, lock[1]))
    while at < len(seconds):
        start = int(seconds[at])
        end, near = start + ttl_s, int(np.searchsorted(releases, start))
        if near < len(releases):
            end = min(end, max(int(releases[near]), start + 1))
        passes.append(at)
        lock = start, end
        at = int(np.searchsorted(seconds, end))
    return passes, lock


def _suppressed(alerts: pd.DataFrame, releases: np.ndarray, ttl_s: int, lock: tuple[int, int] | None):
    """Flags of the alerts of one dedup key (ordered by second and id), and its last lock."""
    seconds, first = np.unique(alerts["detected_s"].to_numpy(dtype=np.int64), return_index=True)
    passes, lock = passing(seconds, np.unique(releases), ttl_s, lock)
    flags = np.ones(len(alerts), dtype=bool)
    flags[first[passes]] = False
    return flags, lock


class _Suppress(InTimeOrder):
    """One lock per key; a passing alert sets it, a suppressed one leaves it alone, a release ends it."""

    def __init__(self, rows: StructType, out: StructType, ttl_s: int) -> None:
        super().__init__(rows, out, "detected_s", ["detected_s", "anomaly_id"])
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.lock = handle.getValueState("lock", "set_s bigint, end_s bigint")

    def process(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        lock = tuple(self.lock.get()) if self.lock.exists() else None
        alerts = rows[rows["kind"] == ALERT]
        releases = rows.loc[rows["kind"] == RELEASE, "detected_s"].to_numpy(dtype=np.int64)
        flags, lock = _suppressed(alerts, releases, self.ttl_s, lock)
        if lock is not None:
            self.lock.update(lock)
        if len(alerts):
            yield alerts.assign(suppressed=flags)

    def idle_from(self) -> int | None:
        return self.lock.get()[1] * 1000 if self.lock.exists() else None

    def forget(self) -> None:
        self.lock.clear()


def _controls(rows: DataFrame, events: DataFrame | None, kind: str, time: str) -> DataFrame:
    """The rows and, below them, control events in the same columns; what these lack gets a value that is no null."""
    if events is None:
        return rows
    empty = {"detected_s": F.col(time).cast("bigint"), "kind": F.lit(kind)}
    for field in rows.schema.fields:
        name = field.name
        if name not in empty:
            known = F.col(name) if name in events.columns else F.lit(0 if field.dataType.simpleString() != "string" else "")
            empty[name] = known.cast(field.dataType)
    return rows.unionByName(events.select(*[empty[n].alias(n) for n in rows.columns]))


def stream_suppress(
    alerts: DataFrame, ttl_s: int = TTL_S, lateness_s: int = 0, releases: DataFrame | None = None
) -> DataFrame:
    """Alerts of a stream with `suppressed`, as `suppress_duplicates` does for a table, and `late`.

    `releases(dedup_key, released_s)` is a stream too. An alert comes out once the watermark, `lateness_s` behind the newest
    event, has passed it; alerts that arrive behind the watermark come out as late, without a verdict. A key's lock is dropped
    when the watermark has passed its end.
    """
    rows = alerts.select(*ALERT_COLUMNS, F.lit(ALERT).alias("kind"))
    both = _controls(rows, releases, RELEASE, "released_s")
    schema = both.schema
    out = StructType([f for f in schema.fields if f.name != "kind"]).add("suppressed", "boolean").add("kind", "string").add("late", "boolean")
    return _in_time_order(both, ["dedup_key"], "detected_s", lateness_s, _Suppress(schema, out, ttl_s), out)


class _LastVectors(InTimeOrder):
    """The last vectors of a series, oldest first."""

    def __init__(self, rows: StructType, out: StructType, length: int, idle_s: int | None) -> None:
        super().__init__(rows, out, "window_start", ["window_start"])
        self.length, self.idle_s = length, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getListState("kept", "vector array<double>")
        self.last = handle.getValueState("last", "window_start bigint")

    def process(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        starts = rows["window_start"].to_numpy(dtype=np.int64)
        vectors = np.array([list(v) for v in rows["scaled"]], dtype=np.float64)
        before = np.zeros((0, vectors.shape[1]))
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            before = np.array([list(v[0]) for v in self.kept.get()], dtype=np.float64).reshape(-1, vectors.shape[1])
        breaks = np.zeros(len(starts), dtype=bool)
        if self.idle_s is not None:
            breaks[1:] = np.diff(starts) > self.idle_s
            breaks[0] = last is not None and starts[0] - last > self.idle_s
        sequences: list[list] = []
        for part in np.split(np.arange(len(starts)), np.flatnonzero(breaks)):
            if not len(part):
                continue
            held = np.zeros((0, vectors.shape[1])) if breaks[part[0]] else before
            series = np.concatenate([held, vectors[part]])
            padded = np.concatenate([np.zeros((max(self.length - 1 - len(held), 0), vectors.shape[1])), series])
            views = np.lib.stride_tricks.sliding_window_view(padded, self.length, axis=0)[-len(part):]
            sequences += views.transpose(0, 2, 1).tolist()
            before = series[-self.length:]
        self.kept.put([(v,) for v in before.tolist()])
        self.last.update((int(starts[-1]),))
        yield rows.assign(sequence=sequences)

    def idle_from(self) -> int | None:
        if self.idle_s is None or not self.last.exists():
            return None
        return (self.last.get()[0] + self.idle_s + 1) * 1000

    def forget(self) -> None:
        self.kept.clear()
        self.last.clear()


def stream_sequences(
    vectors: DataFrame, length: int = SEQUENCE_LENGTH, lateness_s: int = 0, idle_s: int | None = None
) -> DataFrame:
    """Left-padded sequences of a stream, as `rolling_sequences` does for a table, and `late`.

    A series that was silent for more than `idle_s` starts anew, and its vectors are dropped once the watermark is that far;
    without it a series keeps its last vectors for ever.
    """
    chosen = vectors.select(*SERIES, "window_start", "scaled")
    rows = chosen.schema
    out = StructType([
        *rows.fields, StructField("sequence", ArrayType(ArrayType(DoubleType()))),
    ]).add("late", "boolean")
    return _in_time_order(chosen, SERIES, "window_start", lateness_s, _LastVectors(rows, out, length, idle_s), out)


class _Incident(InTimeOrder):
    """The open incident of a correlation key and the locks of its alerts."""

    def __init__(self, rows: StructType, out: StructType, gap_s: int, ttl_s: int, rules: Escalation) -> None:
        super().__init__(rows, out, "detected_s", ["detected_s", "anomaly_id"])
        self.gap_s, self.ttl_s, self.rules = gap_s, ttl_s, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # targets: the first distinct ones, as many as the rule asks for; idle_s: when no lock is left
        self.incident = handle.getValueState(
            "incident", "started_s bigint, last_s bigint, count bigint, rank int, closed boolean, targets string, idle_s bigint, prune_s bigint"
        )
        self.locks = handle.getMapState("locks", "dedup_key string", "set_s bigint, end_s bigint")

    def process(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        state = self.incident.get() if self.incident.exists() else None
        at_kind = lambda kind: rows[rows["kind"] == kind].reset_index(drop=True)
        alerts, closures = at_kind(ALERT), np.unique(at_kind(CLOSURE)["detected_s"].to_numpy(dtype=np.int64))
        suppressed, locked_s = self._locked(alerts, at_kind(RELEASE))
        if not len(alerts):
            if state is not None:
                closed = state[4] or bool(len(closures))
                self.incident.update((*state[:4], closed, state[5], max(state[6], locked_s), state[7]))
            return
        at = alerts["detected_s"].to_numpy(dtype=np.int64)
        opens, session, seq, started = self._sessions(at, closures, state)
        targets, kept_targets = self._targets(alerts["dst_ip"].tolist(), session, opens, state)
        old, new = self._ranks(alerts["severity"].to_numpy(), seq, targets, suppressed, session, opens, state)
        identity = [hashlib.sha256(f"{key[0]}|{s}|0".encode()).hexdigest()[:32] for s in started]
        last = int(at[-1])
        idle, prune = max(locked_s, state[6] if state else 0, last + self.gap_s + 1), state[7] if state else last + self.ttl_s
        if last >= prune:  # ended locks of a busy key, once in a lock length
            for name in [k[0] for k, v in self.locks.iterator() if v[1] <= last]:
                self.locks.removeKey((name,))
            prune = last + self.ttl_s
        closed = bool(len(closures) and closures[-1] >= last)
        self.incident.update((int(started[-1]), last, int(seq[-1]), int(new[-1]), closed, json.dumps(kept_targets), idle, prune))
        yield alerts.assign(
            incident_id=identity, incident_seq=seq, suppressed=suppressed,
            old_priority=[f"P{r}" for r in old], priority=[f"P{r}" for r in new],
        )

    def _locked(self, alerts: pd.DataFrame, releases: pd.DataFrame) -> tuple[np.ndarray, int]:
        """Which alerts are suppressed, and the last moment at which one of their locks ends."""
        flags, latest = np.ones(len(alerts), dtype=bool), 0
        freed = {k: g["detected_s"].to_numpy(dtype=np.int64) for k, g in releases.groupby("dedup_key")}
        places = alerts.groupby("dedup_key").indices
        for name in {*places, *freed}:
            held = self.locks.getValue((name,)) if self.locks.containsKey((name,)) else None
            mine = alerts.iloc[places.get(name, np.zeros(0, dtype=np.int64))]
            flags[mine.index], lock = _suppressed(mine, freed.get(name, np.zeros(0, dtype=np.int64)), self.ttl_s, held and tuple(held))
            if lock is not None:
                self.locks.updateValue((name,), lock)
                latest = max(latest, lock[1])
        return flags, latest

    def _sessions(self, at: np.ndarray, closures: np.ndarray, state):
        """Whether an alert opens an incident, a number for the incident, its place in there and the incident's start."""
        before = np.append(state[1] if state else at[0], at[:-1])
        closed = lambda moments: np.searchsorted(closures, moments)  # noqa: E731  closures in earlier seconds
        opens = (at - before > self.gap_s) | (closed(at) > closed(before))
        opens[0] |= state is None or state[4]
        session = np.cumsum(opens)
        first = np.searchsorted(session, session)
        seq, started = np.arange(len(at)) - first + 1, at[first]
        if state:
            seq, started = np.where(session == 0, seq + state[2], seq), np.where(session == 0, state[0], started)
        return opens, session, seq, started

    def _targets(self, names: list, session: np.ndarray, opens: np.ndarray, state) -> tuple[np.ndarray, list]:
        """Distinct targets of the incident up to each alert, and those to keep for its next alerts."""
        known = json.loads(state[5]) if state and not opens[0] else []
        pairs = pd.DataFrame({"session": [0] * len(known) + session.tolist(), "name": known + names})
        pairs["new"] = ~pairs.duplicated()
        seen = pairs.groupby("session")["new"].cumsum().to_numpy()[len(known):]
        own = pairs[(pairs["session"] == session[-1]) & pairs["new"]]["name"].tolist()
        return seen, own[: self.rules.targets]

    def _ranks(self, severity, seq, targets, suppressed, session, opens, state) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the incident before and after each alert; suppressed ones trigger no rule."""
        rules = self.rules
        rank = np.select([seq >= rules.p1, seq >= rules.p2, seq >= rules.p3], [1, 2, 3], 4)
        if rules.critical_severity:
            rank = np.where(severity == "critical", np.minimum(rank, 2), rank)
        if rules.multi_target:
            rank = np.where(targets >= rules.targets, np.minimum(rank, 2), rank)
        rank = np.where(suppressed, 4, rank)
        if state and not opens[0]:
            rank[0] = min(rank[0], state[3])
        new = pd.Series(rank).groupby(session).cummin().to_numpy()
        old = np.append(state[3] if state and not opens[0] else 4, new[:-1])
        return np.where(opens, 4, old), new

    def idle_from(self) -> int | None:
        return self.incident.get()[6] * 1000 if self.incident.exists() else None

    def forget(self) -> None:
        self.incident.clear()
        self.locks.clear()


def stream_alerting(
    anomalies: DataFrame, gap_s: int = co.GAP_S, ttl_s: int = TTL_S, rules: Escalation = Escalation(),
    key_columns: Sequence[str] = FLOW, lateness_s: int = 0,
    releases: DataFrame | None = None, closures: DataFrame | None = None,
) -> DataFrame:
    """Anomalies to handled alerts: incident, suppression and priority, one state per key, as `jobs.alerting` does for tables.

    `releases(correlation_key, dedup_key, released_s)` and `closures(correlation_key, closed_s)` are streams of what operators
    did (`lifecycle.releases_of`, `closures_of`); they are merged with the anomalies to one input and applied in time order,
    after the anomalies of their own second. An escalation is a row whose `old_priority` differs from its `priority`. Alerts
    come out once the watermark has passed them; anomalies and control events behind it come out as `late` and change nothing.
    State of a key goes when its incident can take no more alerts and its last lock has ended. Locks live with the correlation
    key, so its columns must be among those of the dedup key.
    """
    unknown = set(key_columns) - {*FLOW, "anomaly_type"}
    if unknown:
        raise ValueError(f"{sorted(unknown)}: a lock would belong to several correlation keys")
    if "dst_ip" in key_columns:  # one target per incident: the rule cannot fire
        rules = Escalation(rules.p3, rules.p2, rules.p1, rules.critical_severity, False, rules.targets)
    alerts = (
        co.drop_normal(anomalies)
        .withColumn("correlation_key", co.correlation_key(key_columns))
        .withColumn("dedup_key", co.dedup_key())
        .withColumn("alert_id", co.alert_id())
        .withColumn("severity", co.alert_severity())
        .select(*ALERT_COLUMNS, F.lit(ALERT).alias("kind"))
    )
    both = _controls(_controls(alerts, releases, RELEASE, "released_s"), closures, CLOSURE, "closed_s")
    schema = both.schema
    out = StructType([f for f in schema.fields if f.name != "kind"])
    for name, kind in (("incident_id", "string"), ("incident_seq", "long"), ("suppressed", "boolean"),
                       ("old_priority", "string"), ("priority", "string"), ("kind", "string"), ("late", "boolean")):
        out = out.add(name, kind)
    return _in_time_order(both, ["correlation_key"], "detected_s", lateness_s, _Incident(schema, out, gap_s, ttl_s, rules), out)


class LateSplit:
    """Sink of a stream with a `late` column (`foreachBatch`): rows in time and late rows go to tables of their own.

    Each micro-batch writes its own partition of both, so a repeated one replaces itself.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        for name, rows in (("in_time", ~F.col("late")), ("late", F.col("late"))):
            path = f"{self.folder}/{name}/batch={batch_id}"
            batch.filter(rows).drop("late").write.mode("overwrite").parquet(path)

    def in_time(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/in_time")

    def late(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/late")


def progress_stats(progress: dict) -> dict[str, int]:
    """Open windows and rows held by the state of a running query, from its last progress."""
    operators = progress.get("stateOperators", [])
    return {
        "active_windows": sum(o.get("numRowsTotal", 0) for o in operators),
        "dropped_late": sum(o.get("numRowsDroppedByWatermark", 0) for o in operators),
    }


__all__ = [
    "LateSplit", "progress_stats", "stream_alerting", "stream_sequences", "stream_suppress",
]
