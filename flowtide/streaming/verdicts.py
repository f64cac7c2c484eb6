"""Verdict rules and alerts as keyed state on streams: exact probe windows, bursts, alerts with their current state.

All need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from flowtide.config import SECOND, PolicyConfig
from flowtide.functions.time import micros
from flowtide.operators.joins import FINGERPRINT
from flowtide.operators.policy import mark_probes, rule_of, verdict_columns

#: Rows ahead of the watermark wait in slots of this length, so that a batch reads those it passes only.
SLOT_US = 10 * SECOND
_LONG, _TEXT, _INT = T.LongType(), T.StringType(), T.IntegerType()


def _at(name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind)])


def _row(schema: T.StructType, values) -> Row:
    return Row(**dict(zip(schema.fieldNames(), values)))


def passed_on(mark_ms: int) -> datetime:
    """The event time of what a step lets out at a watermark: just ahead of it, so that the next step takes it."""
    return datetime.fromtimestamp((mark_ms + 1) / 1000, timezone.utc)


def _due(handle, micros_: list[int], mark_ms: int) -> None:
    """One timer, at the first of the times that lies ahead."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if micros_:
        handle.registerTimer(max(-(-min(micros_) // 1000), mark_ms + 1))


class ProbeProcessor(StatefulProcessor):
    """State of a source: rows ahead of the watermark, by slot, and target -> its last probe.

    Rows are taken in (time, id) order once the watermark, less ``behind_us``, has passed them. A target is forgotten
    when the window has passed its last probe. Every row comes out once, with the number of targets its source probed
    in the window up to and with the row's time; null on rows that are no probes.
    """

    def __init__(self, schema: T.StructType, window_us: int, behind_us: int):
        self.schema, self.window_us, self.behind_us = schema, window_us, behind_us

    def init(self, handle):
        self.handle = handle
        waiting = T.StructType([T.StructField("rows", T.ArrayType(self.schema))])
        self.waiting = handle.getMapState("waiting", _at("slot", _LONG), waiting)
        self.targets = handle.getMapState("targets", T.StructType([T.StructField("ip", _TEXT), T.StructField("port", _INT)]), _at("last", _LONG))

    def handleInputRows(self, key, rows, timerValues):
        fresh: dict[int, list] = {}
        for r in rows:
            fresh.setdefault(r["at_us"] // SLOT_US, []).append(tuple(r[n] for n in self.schema.fieldNames()))
        for slot, new in fresh.items():
            known = self.waiting.getValue((slot,))[0] if self.waiting.containsKey((slot,)) else []
            self.waiting.updateValue((slot,), ([tuple(x) for x in known] + new,))
        yield from self._advance(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(timerValues)

    def close(self):
        pass

    def _advance(self, timer_values) -> Iterator[Row]:
        mark_ms = timer_values.getCurrentWatermarkInMs()
        mark = mark_ms * 1000 - self.behind_us
        names = self.schema.fieldNames()
        at, number = names.index("at_us"), names.index("id")
        slots = sorted(k[0] for k in self.waiting.keys())
        ready = []
        for slot in (s for s in slots if s * SLOT_US < mark):
            rows = [tuple(x) for x in self.waiting.getValue((slot,))[0]]
            ready += [x for x in rows if x[at] < mark]
            rest = [x for x in rows if x[at] >= mark]
            if rest:
                self.waiting.updateValue((slot,), (rest,))
            else:
                self.waiting.removeKey((slot,))
        ready.sort(key=lambda x: (x[at], x[number]))
        # In the order of the last probe, so the oldest are in front.
        last = dict(sorted(((tuple(k), v[0]) for k, v in self.targets.iterator()), key=lambda kv: kv[1]))
        before = dict(last)
        target, probe = (names.index("destination_ip"), names.index("destination_port")), names.index("_probes")
        start, seen = 0, passed_on(mark_ms)
        while start < len(ready):
            now, end = ready[start][at], start
            while end < len(ready) and ready[end][at] == now:
                if ready[end][probe]:
                    where = tuple(ready[end][i] for i in target)
                    last.pop(where, None)
                    last[where] = now
                end += 1
            self._forget(last, now - self.window_us)
            for x in ready[start:end]:
                yield _row(self.out(), (*x, len(last) if x[probe] else None, seen))
            start = end
        self._forget(last, mark - self.window_us)
        for k in before.keys() - last.keys():
            self.targets.removeKey(k)
        for k, v in last.items():
            if before.get(k) != v:
                self.targets.updateValue(k, (v,))
        slots = sorted(k[0] for k in self.waiting.keys())
        due = [max(slots[0] * SLOT_US, mark) + 1 + self.behind_us] if slots else []
        due += [next(iter(last.values())) + self.window_us + 1 + self.behind_us] if last else []
        _due(self.handle, due, mark_ms)

    @staticmethod
    def _forget(last: dict, before: int) -> None:
        while last and next(iter(last.values())) < before:
            del last[next(iter(last))]

    def out(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("distinct_targets", _LONG), T.StructField("seen_at", T.TimestampType())])


class BurstProcessor(StatefulProcessor):
    """State of a fingerprint: the time of its last confirmed row, dropped when the window has passed it.

    A batch's rows are taken in (time, id) order and come out at once. A row less than the window behind the last one is
    a duplicate and extends the burst. Where the rows have a ``_rule``, only confirmed ones count.
    """

    def __init__(self, schema: T.StructType, window_us: int):
        self.schema, self.window_us = schema, window_us

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", _at("at_us", _LONG))

    def handleInputRows(self, key, rows, timerValues):
        names = self.schema.fieldNames()
        last = self.last.get()[0] if self.last.exists() else None
        seen = passed_on(timerValues.getCurrentWatermarkInMs())
        for r in sorted(rows, key=lambda x: (x["at_us"], x["id"])):
            counts = "_rule" not in names or r["_rule"] == "confirmed"
            again = counts and last is not None and r["at_us"] - last < self.window_us
            yield _row(self.out(), (*(r[n] for n in names), again, seen))
            if counts:
                last = r["at_us"] if last is None else max(last, r["at_us"])
        if last is not None:
            self.last.update((last,))
            _due(self.handle, [last + self.window_us], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        yield from ()

    def close(self):
        pass

    def out(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("is_duplicate", T.BooleanType()), T.StructField("seen_at", T.TimestampType())])


def _run(rows: DataFrame, keys: list[str], processor, time: str = "") -> DataFrame:
    """The processor's rows; with ``time``, that column is their event time for a stateful step behind."""
    return rows.groupBy(*keys).transformWithState(
        statefulProcessor=processor, outputStructType=processor.out(), outputMode="Append", timeMode="EventTime", eventTimeColumnName=time)


def stream_probe_count(verdicts: DataFrame, window_us: int, watermark: str | None = "10 seconds", behind_us: int = 0) -> DataFrame:
    """``portscan_probe_count`` on a stream: every row once the watermark has passed it, with ``distinct_targets``.

    ``verdicts``: id, source_ip, destination_ip, destination_port, timestamp, and the boolean ``_probes`` (without it,
    every row is a probe). Rows at one time see each other. A null source is a source. Late rows are dropped.
    ``watermark=None``: the input has one, and ``seen_at`` is the time by which a step before has passed its rows on.
    """
    rows = verdicts if "_probes" in verdicts.columns else verdicts.withColumn("_probes", F.lit(True))
    return _watched(rows, ["source_ip"], lambda schema: ProbeProcessor(schema, window_us, behind_us), watermark)


def stream_alert_dedup(verdicts: DataFrame, window_us: int, watermark: str | None = "10 seconds") -> DataFrame:
    """``alert_dedup`` of confirmed rows on a stream, each at once, with ``is_duplicate``.

    ``verdicts``: id, source_ip, destination_ip, prediction, timestamp. Equals the batch operator where no row comes in
    a later batch than a newer one of its fingerprint; an older row that does is a duplicate and changes nothing.
    """
    return _watched(verdicts, ["source_ip", "destination_ip", "prediction"], lambda schema: BurstProcessor(schema, window_us), watermark)


def _watched(rows: DataFrame, keys: list[str], processor, watermark: str | None) -> DataFrame:
    at = rows.withColumn("at_us", micros(rows, "timestamp"))
    if watermark:
        at = at.withWatermark("timestamp", watermark)
    # State holds no times, only their microseconds.
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in at.schema.fields if f.name not in ("timestamp", "seen_at")])
    got = _run(at, keys, processor(schema))
    return got.withColumn("timestamp", F.timestamp_micros("at_us")).drop("at_us", "seen_at")


_ALERT = T.StructType([
    T.StructField("id", _LONG), *[T.StructField(c, _TEXT) for c in FINGERPRINT], T.StructField("severity", _TEXT),
    T.StructField("confidence", T.DoubleType()), T.StructField("status", _TEXT), T.StructField("occurrences", _LONG),
    T.StructField("first_us", _LONG), T.StructField("last_us", _LONG), T.StructField("change", _LONG)])


class AlertProcessor(StatefulProcessor):
    """State of a fingerprint: its newest alert, while that is ACTIVE, and the number of changes so far.

    A batch's candidates merge into the open alert or open one; a close (a row with ``status``) ends it first. Every
    batch that touches the fingerprint appends the alerts it changed.
    """

    def init(self, handle):
        self.alert = handle.getValueState("alert", _ALERT)
        self.changes = handle.getValueState("changes", _at("n", _LONG))

    def handleInputRows(self, key, rows, timerValues):
        rows = sorted(rows, key=lambda r: (r["at_us"], r["status"] is None, r["id"]))
        number = self.changes.get()[0] if self.changes.exists() else 0
        alert = dict(zip(_ALERT.fieldNames(), self.alert.get())) if self.alert.exists() else None
        closes = [r for r in rows if r["status"] is not None]
        if closes and alert:
            number += 1
            yield _row(_ALERT, (alert | {"status": closes[-1]["status"], "change": number}).values())
            alert = None
        new = [r for r in rows if r["status"] is None]
        if new:
            number += 1
            high = max((r["confidence"] for r in new if r["confidence"] is not None), default=None)
            if alert:
                known = [c for c in (alert["confidence"], high) if c is not None]
                alert |= {"confidence": max(known, default=None), "occurrences": alert["occurrences"] + len(new),
                          "last_us": max(alert["last_us"] or new[-1]["at_us"], new[-1]["at_us"])}
            else:
                alert = dict(zip(_ALERT.fieldNames(), (
                    new[0]["id"], *key, new[0]["severity"], high, "ACTIVE", len(new), new[0]["at_us"], new[-1]["at_us"] if len(new) > 1 else None, 0)))
            alert["change"] = number
            yield _row(_ALERT, alert.values())
        if alert:
            self.alert.update(tuple(alert.values()))
        else:
            self.alert.clear()
        self.changes.update((number,))

    def close(self):
        pass

    @staticmethod
    def out() -> T.StructType:
        return _ALERT


def stream_alert_changes(candidates: DataFrame) -> DataFrame:
    """Alert candidates (and closes) on a stream -> a row for every change of an alert; the newest is its state.

    ``candidates``: id, source_ip, destination_ip, attack_type, severity, confidence, timestamp and, where alerts are
    acknowledged or resolved, ``status`` (null on candidates). A batch counts as one merge, as in ``upsert_alerts``;
    its closes come before its candidates. Append the rows to a table: nothing is rewritten, and state and table go on
    after a restart from the same checkpoint. A fingerprint's nulls are values.
    """
    rows = candidates if "status" in candidates.columns else candidates.withColumn("status", F.lit(None).cast("string"))
    rows = rows.select("id", *FINGERPRINT, "severity", "confidence", "status", micros(rows, "timestamp").alias("at_us"))
    changes = rows.groupBy(*FINGERPRINT).transformWithState(
        statefulProcessor=AlertProcessor(), outputStructType=_ALERT, outputMode="Append", timeMode="None")
    return changes.withColumns({"timestamp": F.timestamp_micros("first_us"), "last_seen": F.timestamp_micros("last_us")}).drop("first_us", "last_us")


def current_alerts(changes: DataFrame) -> DataFrame:
    """The alert table of ``stream_alert_changes`` rows: every alert as its last change left it."""
    columns = [c for c in changes.columns if c not in ("id", "change", *FINGERPRINT)]
    newest = F.max_by(F.struct(*columns), "change").alias("now")
    return changes.groupBy("id", *FINGERPRINT).agg(newest).select("id", *FINGERPRINT, "now.*")


def stream_cascade(scored: DataFrame, cfg: PolicyConfig, behind_us: int) -> DataFrame:
    """``policy_cascade`` behind a stateful step: ``scored`` rows carry the event time ``seen_at`` of that step.

    ``behind_us``: by how much a row's own time can lie behind the watermark that let it out. The first step hands the
    rows on in time order, so the second one's bursts are exact.
    """
    rows = mark_probes(scored, cfg)
    at = rows.withColumn("at_us", micros(rows, "timestamp"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in at.schema.fields if f.name not in ("timestamp", "seen_at")])
    counted = _run(at, ["source_ip"], ProbeProcessor(schema, cfg.probe_window_us, behind_us), "seen_at")
    ruled = rule_of(counted, cfg)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in ruled.schema.fields if f.name != "seen_at"])
    judged = _run(ruled, ["source_ip", "destination_ip", "prediction"], BurstProcessor(schema, cfg.dedup_window_us))
    return verdict_columns(judged.withColumn("timestamp", F.timestamp_micros("at_us")), cfg).drop("at_us", "seen_at")
