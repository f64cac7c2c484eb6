"""Packets to flows on a stream: one state per flow key, running sums only.

Packets wait until the watermark has passed them and are then taken in (time, seq) order, so the result
equals the batch operator on the same packets, except for those dropped as late.
"""

from __future__ import annotations

import math

from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from flowtide.config import FlowConfig
from flowtide.functions.network import KEY_COLUMNS, packet_defaults, with_flow_key
from flowtide.operators.features import derive_features
from flowtide.schema import TCP_FLAGS
from flowtide.streaming.verdicts import passed_on

_MOMENTS = ["fl", "bl", "al", "gap", "fg", "bg", "act", "idl"]
_SUMS = ["n_fwd", "n_bwd", "len_fwd", "len_bwd", "fg_sum", "bg_sum", "hdr_fwd", "hdr_bwd", "data_fwd",
         *[f"n_{f}" for f in TCP_FLAGS], "fwd_psh", "fwd_urg", "bwd_psh", "bwd_urg", "win_fwd", "win_bwd", "seg"]
_MARKS = ["start_us", "last_us", "island_us", "fwd_us", "bwd_us"]
_PACKET = ["ts_us", "seq", "is_lo", "pkt_len", "tcp_flags", "header_len", "win_size", "payload_len"]

_PENDING = T.StructType([T.StructField(n, T.BooleanType() if n == "is_lo" else T.LongType()) for n in _PACKET])
_OPEN = T.StructType(
    [T.StructField(n, T.LongType()) for n in [*_MARKS, *_SUMS]] + [T.StructField("lo_starts", T.BooleanType())]
    + [T.StructField(m, T.ArrayType(T.DoubleType())) for m in _MOMENTS])

_OUT = T.StructType(
    [T.StructField(k, T.IntegerType() if "port" in k else T.StringType()) for k in KEY_COLUMNS]
    + [T.StructField(n, T.LongType()) for n in ("flow_start_us", "end_us", "last_island_us", *_SUMS[:-1], "hdr_min",
                                                "hdr_after20", "act_n")]
    + [T.StructField("lo_starts", T.BooleanType())]
    + [T.StructField(f"{m}_{s}", T.DoubleType()) for m in _MOMENTS for s in ("max", "min", "mean", "std")])


def _add(m: list, x: float) -> None:
    """Adds a value to [n, mean, sum of squared deviations, min, max]."""
    m[0] += 1
    delta = x - m[1]
    m[1] += delta / m[0]
    m[2] += delta * (x - m[1])
    m[3], m[4] = (x, x) if m[0] == 1 else (min(m[3], x), max(m[4], x))


class FlowProcessor(StatefulProcessor):
    """State: packets ahead of the watermark, and the sums of the open flow."""

    def __init__(self, cfg: FlowConfig, chained: bool = False):
        self.cfg, self.chained = cfg, chained

    def init(self, handle):
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues):
        self.pending.appendList([tuple(r[n] for n in _PACKET) for r in rows])
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(key, timerValues)

    def close(self):
        pass

    def _advance(self, key, timer_values):
        mark = timer_values.getCurrentWatermarkInMs() * 1000
        waiting = sorted((dict(zip(_PACKET, r)) for r in self.pending.get()), key=lambda p: (p["ts_us"], p["seq"]))
        ready = [p for p in waiting if p["ts_us"] < mark]
        waiting = waiting[len(ready):]
        state = self.open.get() if self.open.exists() else None
        flow = None
        if state is not None:
            flow = dict(zip(_OPEN.fieldNames(), state))
            flow.update({m: list(flow[m]) for m in _MOMENTS})
        for p in ready:
            aged = flow is not None and p["ts_us"] - flow["start_us"] >= self.cfg.active_us
            if flow is not None and (p["ts_us"] - flow["last_us"] >= self.cfg.idle_us
                                     or (aged and self.cfg.active_rule == "exclusive")):
                yield self._emit(key, flow, mark)
                flow = None
            flow = self._take(flow, p)
            if p["tcp_flags"] & 5 or (self.cfg.active_rule == "inclusive"
                                      and p["ts_us"] - flow["start_us"] >= self.cfg.active_us):
                yield self._emit(key, flow, mark)
                flow = None
        if flow is not None and mark >= flow["last_us"] + self.cfg.idle_us:
            yield self._emit(key, flow, mark)
            flow = None
        if flow is None:
            self.open.clear()
        else:
            self.open.update(tuple(flow[n] for n in _OPEN.fieldNames()))
        if waiting:
            self.pending.put([tuple(p[n] for n in _PACKET) for p in waiting])
        else:
            self.pending.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = [waiting[0]["ts_us"] + 1] if waiting else []
        due += [flow["last_us"] + self.cfg.idle_us] if flow is not None else []
        if due:
            self.handle.registerTimer(max(-(-min(due) // 1000), mark // 1000 + 1))

    def _take(self, flow, p):
        if flow is None:
            flow = {n: 0 for n in _SUMS} | {m: [0.0] * 5 for m in _MOMENTS}
            flow.update(start_us=p["ts_us"], last_us=p["ts_us"], island_us=p["ts_us"], fwd_us=-1, bwd_us=-1,
                        lo_starts=p["is_lo"], seg=20)
        d = "fwd" if p["is_lo"] == flow["lo_starts"] else "bwd"
        gap = p["ts_us"] - flow["last_us"]
        _add(flow["gap"], float(gap))
        if gap > self.cfg.activity_us:
            if flow["last_us"] > flow["island_us"]:
                _add(flow["act"], float(flow["last_us"] - flow["island_us"]))
            _add(flow["idl"], float(gap))
            flow["island_us"] = p["ts_us"]
        if flow[f"{d}_us"] >= 0:
            between = p["ts_us"] - flow[f"{d}_us"]
            _add(flow[f"{d[0]}g"], float(between))
            flow[f"{d[0]}g_sum"] += between
        flow[f"{d}_us"] = flow["last_us"] = p["ts_us"]
        for m in ("al", f"{d[0]}l"):
            _add(flow[m], float(p["pkt_len"]))
        flow[f"n_{d}"] += 1
        flow[f"len_{d}"] += p["pkt_len"]
        flow[f"hdr_{d}"] += p["header_len"]
        flow[f"win_{d}"] = flow[f"win_{d}"] or p["win_size"]
        for name, bit in TCP_FLAGS.items():
            if p["tcp_flags"] & bit:
                flow[f"n_{name}"] += 1
                if name in ("psh", "urg"):
                    flow[f"{d}_{name}"] += 1
        if d == "fwd":
            flow["data_fwd"] += p["payload_len"] > 0
            if 0 < p["header_len"] and (flow["seg"] == 20 or p["header_len"] < flow["seg"]):
                flow["seg"] = p["header_len"]
        return flow

    def out(self) -> T.StructType:
        return T.StructType([*_OUT.fields, T.StructField("seen_at", T.TimestampType())]) if self.chained else _OUT

    def _emit(self, key, flow, mark):
        seg = flow["seg"]
        out = dict(zip(KEY_COLUMNS, key))
        out.update(flow_start_us=flow["start_us"], end_us=flow["last_us"], last_island_us=flow["island_us"],
                   lo_starts=flow["lo_starts"], act_n=int(flow["act"][0]), hdr_min=min(seg, 20),
                   hdr_after20=(1 << 31) - seg if seg > 20 else None)
        out.update({n: int(flow[n]) for n in _SUMS[:-1]})
        for m in _MOMENTS:
            n, mean, m2, low, high = flow[m]
            stats = (high, low, mean, math.sqrt(max(m2, 0.0) / n)) if n else (None,) * 4
            out.update(zip((f"{m}_max", f"{m}_min", f"{m}_mean", f"{m}_std"), stats))
        if self.chained:
            out["seen_at"] = passed_on(mark // 1000)
        return Row(**{f: out[f] for f in self.out().fieldNames()})


def stream_flows(packets: DataFrame, watermark: str = "10 seconds", cfg: FlowConfig = FlowConfig(), chained: bool = False) -> DataFrame:
    """Streaming packets -> finished flows with all features (as ``flow_features``, without ``flow_seq``).

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). ``chained`` adds ``seen_at``, the
    event time of the flows for a stateful step behind this one: a flow comes out when the watermark is at most the idle
    timeout past its last packet, so its own time can't be that.
    """
    keyed = with_flow_key(packet_defaults(packets.where("ts IS NOT NULL"))).withWatermark("ts", watermark)
    ints = [F.col(n).cast("bigint").alias(n) for n in _PACKET if n not in ("ts_us", "is_lo")]
    narrow = keyed.select(*KEY_COLUMNS, "ts", F.unix_micros("ts").alias("ts_us"), "is_lo", *ints)
    processor = FlowProcessor(cfg, chained)
    sums = narrow.groupBy(*KEY_COLUMNS).transformWithState(
        statefulProcessor=processor, outputStructType=processor.out(), outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="seen_at" if chained else "")
    return derive_features(sums, [*KEY_COLUMNS, "flow_start_us", *(["seen_at"] if chained else [])])


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop behind their watermark, over their whole life.

    Register it with ``spark.streams.addListener`` before the query starts.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def of(self, query) -> int:
        return self.dropped.get(str(query.id), 0)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        key = str(event.progress.id)
        self.dropped[key] = self.dropped.get(key, 0) + late

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def stream_late_rows(rows: DataFrame, time_column: str, delay_us: int, path: str, checkpoint: str, trigger: dict | None = None):
    """Counts, batch by batch, the rows that a watermark of ``delay_us`` on ``time_column`` drops as late.

    Writes one row a batch into ``path``: batch_id, rows, late, and ``high_us``, the newest time so far. A batch's mark is
    the newest time of the batches before, less the delay, in whole milliseconds; rows not behind it are in time. A
    repeated batch writes the same row again, and the count goes on after a restart from the same checkpoint. Rows
    without a time are not late. ``late_rows`` adds the batches up.
    """
    at = F.unix_micros(time_column)

    def count(batch: DataFrame, batch_id: int) -> None:
        before = batch.sparkSession.read.parquet(f"{path}/batch_id={batch_id - 1}").first() if batch_id else None
        high = before["high_us"] if before else None
        mark = -1 if high is None else max(high // 1000 * 1000 - delay_us, 0)
        batch.agg(F.count("*").alias("rows"), F.count_if(at <= mark).alias("late"), F.greatest(
            F.max(at), F.lit(high).cast("bigint")).alias("high_us")).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (rows.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(count).start())


def late_rows(spark, path: str) -> DataFrame:
    """The batches that ``stream_late_rows`` has counted."""
    return spark.read.schema("rows bigint, late bigint, high_us bigint, batch_id bigint").parquet(path)


def late_packets(query) -> int:
    """Rows a streaming query has dropped behind the watermark in its last batches.

    A query keeps its newest 100 progress reports; ``LateRows`` counts from the start.
    """
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in _operators(p))


def _operators(progress):
    ops = progress["stateOperators"] if isinstance(progress, dict) else progress.stateOperators
    return [o if isinstance(o, dict) else o.jsonValue() if hasattr(o, "jsonValue") else vars(o) for o in ops]


def flush_marker(last_us: int, cfg: FlowConfig = FlowConfig(), delay_us: int = 10_000_000) -> Row:
    """A packet of no real flow, late enough that the watermark closes every flow seen up to ``last_us``."""
    from datetime import datetime, timezone

    at = (last_us + cfg.idle_us + delay_us + 2_000_000) / 1e6
    return Row(src_ip="0.0.0.0", dst_ip="0.0.0.0", src_port=0, dst_port=0, protocol="FLUSH", pkt_len=0,
               ts=datetime.fromtimestamp(at, timezone.utc), tcp_flags=0, header_len=0, win_size=0, payload_len=0, seq=-1)
