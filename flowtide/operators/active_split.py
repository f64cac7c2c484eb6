"""The active-timeout rule on segments that outlive it.

Where a flow ends depends on where it began, so the rule is sequential along a segment. It runs on
the packets past their segment's first ``active`` only, in chunks of at most ``chunk_rows`` packets:

1. each chunk of a key longer than one chunk is reduced, in parallel, to the map from the flow open
   at its entry to the flow open at its exit (constant when a segment begins inside the chunk;
   otherwise it depends only on which packet closes the entering flow);
2. those maps are chained along each key, streaming, which gives every chunk its entry flow;
3. every chunk marks its packets, in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.config import FlowConfig
from flowtide.functions.network import KEY_COLUMNS

_CHUNK = "_chunk"
_CLOSED = -1


def split_long_segments(rows: DataFrame, cfg: FlowConfig) -> DataFrame:
    """Adds ``flow_seq``, ``flow_start_us`` and ``flow_lo``; drops the ``seg_*`` columns.

    A key of at most one chunk has no rows in steps 1 and 2.
    """
    flow = {"flow_seq": F.col("seg_idx"), "flow_start_us": F.col("seg_us"), "flow_lo": F.col("seg_lo")}
    is_tail = F.col("ts_us") - F.col("seg_us") >= cfg.active_us
    young = rows.where(~is_tail).withColumns(flow).drop("seg_us", "seg_idx", "seg_lo")
    tail = rows.where(is_tail).withColumns({
        _CHUNK: F.floor(F.col("idx") / cfg.chunk_rows).cast("bigint"),
        # The first packet past the timeout closes the segment's first flow.
        "_closer": F.col("_p_us") - F.col("seg_us") < cfg.active_us,
    })
    entries = _chunk_entries(tail.where(F.col("key_n") > cfg.chunk_rows), cfg)
    tail = tail.join(entries, [*KEY_COLUMNS, _CHUNK], "left")
    marked = (
        tail.repartition(*KEY_COLUMNS, _CHUNK).sortWithinPartitions(*KEY_COLUMNS, "idx")
        .mapInArrow(_marker(cfg, young.columns), young.schema)
    )
    return young.unionByName(marked)


class _Chunk:
    """Flow starts inside one chunk of tail packets, ordered by packet ordinal."""

    def __init__(self, ts: np.ndarray, closer: np.ndarray, cfg: FlowConfig):
        self.ts, self.closer, self.n, self.active = ts, closer, len(ts), cfg.active_us
        self.inclusive = cfg.active_rule == "inclusive"
        at = np.arange(self.n + 1)
        first = np.append(np.where(closer, at[:-1], self.n), self.n)
        self.next_closer = np.minimum.accumulate(first[::-1])[::-1]
        free = np.append(np.where(closer, self.n, at[:-1]), self.n)
        self.next_free = np.minimum.accumulate(free[::-1])[::-1]

    def after_close(self, p: int) -> int:
        """Where the next flow starts when packet ``p`` closes one."""
        return int(self.next_free[p + 1]) if self.inclusive else p

    def closing_packet(self, start_ts: int, position: int) -> int:
        """The packet that ends a flow begun at ``start_ts``: by age, or the next segment's first."""
        by_age = int(np.searchsorted(self.ts, start_ts + self.active))
        return min(max(by_age, position), int(self.next_closer[position]))

    def walk(self, start: int):
        """Flow starts reachable from ``start``, in order."""
        while start < self.n:
            yield start
            if not self.inclusive:
                start = self.closing_packet(int(self.ts[start]), start + 1)
                continue
            p = self.closing_packet(int(self.ts[start]), start + 1)
            start = self.n if p >= self.n else self.after_close(p)

    def exits(self, upto: int) -> np.ndarray:
        """For every start position 0..upto the last flow start of its chain (n = none open)."""
        pos = np.arange(self.n)
        by_age = np.searchsorted(self.ts, self.ts + self.active)
        nxt = np.minimum(np.maximum(by_age, pos + 1), self.next_closer[np.minimum(pos + 1, self.n)])
        if self.inclusive:
            jump = np.where(nxt >= self.n, pos, self.next_free[np.minimum(nxt + 1, self.n)])
        else:
            jump = np.where(nxt >= self.n, pos, nxt)
        jump = np.append(jump, self.n)
        while True:
            twice = jump[jump]
            if np.array_equal(twice, jump):
                return jump[:upto + 1]
            jump = twice


def _columns(table: pa.Table, *names):
    return [table.column(n).to_numpy(zero_copy_only=False) for n in names]


_TRANSFER = ", ".join([
    "k_proto string, k_ip_lo string, k_port_lo int, k_ip_hi string, k_port_hi int", f"{_CHUNK} bigint",
    "fixed boolean", "threshold array<bigint>", "exit_us array<bigint>", "exit_idx array<bigint>",
    "exit_lo array<boolean>",
])
_ENTRY = ", ".join([
    "k_proto string, k_ip_lo string, k_port_lo int, k_ip_hi string, k_port_hi int", f"{_CHUNK} bigint",
    "entry_us bigint", "entry_idx bigint", "entry_lo boolean",
])


def _chunk_entries(tail: DataFrame, cfg: FlowConfig) -> DataFrame:
    maps = tail.select(*KEY_COLUMNS, _CHUNK, "idx", "ts_us", "is_lo", "_closer").groupBy(
        *KEY_COLUMNS, _CHUNK).applyInArrow(_transfer(cfg), _TRANSFER)
    return (
        maps.repartition(*KEY_COLUMNS).sortWithinPartitions(*KEY_COLUMNS, _CHUNK)
        .mapInArrow(_chain(cfg), _ENTRY)
    )


def _transfer(cfg: FlowConfig):
    """Chunk rows -> one row with the chunk's entry-to-exit map."""

    def reduce_chunk(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        idx, ts, lo, closer = _columns(table, "idx", "ts_us", "is_lo", "_closer")
        chunk = _Chunk(ts, closer, cfg)
        if closer.any():
            # Whatever enters, the chain after the last segment begin decides the exit.
            q = int(np.flatnonzero(closer)[-1])
            start = chunk.after_close(q)
            positions, thresholds, fixed = chunk.exits(chunk.n)[[start]], np.array([0]), True
        else:
            # Entry 0 is "no flow open"; entry p + 1 is "packet p closes the entering flow".
            reach = int(np.searchsorted(ts, ts[0] + cfg.active_us))
            reach = min(reach, chunk.n - 1)
            starts = np.array([0] + [chunk.after_close(p) for p in range(reach + 1)])
            positions, fixed = chunk.exits(chunk.n)[starts], False
            thresholds = np.append([np.iinfo(np.int64).min], ts[:reach + 1])
            last_of_run = np.append(positions[1:-1] != positions[2:], True)
            keep = np.append([True], last_of_run)
            positions, thresholds = positions[keep], thresholds[keep]
        none = positions >= chunk.n
        at = np.minimum(positions, chunk.n - 1)
        out = table.slice(0, 1).select([*KEY_COLUMNS, _CHUNK])
        one = lambda v, t: pa.array([v.tolist()], pa.list_(t))
        for name, col in [
            ("fixed", pa.array([fixed])),
            ("threshold", one(thresholds.astype(np.int64), pa.int64())),
            ("exit_us", one(np.where(none, 0, ts[at]), pa.int64())),
            ("exit_idx", one(np.where(none, _CLOSED, idx[at]), pa.int64())),
            ("exit_lo", one(np.where(none, False, lo[at]).astype(bool), pa.bool_())),
        ]:
            out = out.append_column(name, col)
        return out

    return reduce_chunk


def _chain(cfg: FlowConfig):
    """Chunk maps in key order -> the flow open at each chunk's entry, in constant memory."""

    def run(batches):
        key, state, last_chunk = None, (0, _CLOSED, False), None
        for batch in batches:
            heads = batch.select([*KEY_COLUMNS, _CHUNK]).to_pylist()
            entries = []
            for i, head in enumerate(heads):
                this = tuple(head[k] for k in KEY_COLUMNS)
                if this != key:
                    key, state, last_chunk = this, (0, _CLOSED, False), None
                entries.append(state)
                fixed = batch.column("fixed")[i].as_py()
                thresholds = batch.column("threshold")[i].values.to_numpy(zero_copy_only=False)
                if fixed or state[1] == _CLOSED:
                    pick = 0
                else:
                    pick = 1 + int(np.searchsorted(thresholds[1:], state[0] + cfg.active_us))
                if pick < len(thresholds):
                    state = tuple(batch.column(c)[i].values[pick].as_py() for c in ("exit_us", "exit_idx", "exit_lo"))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in [*KEY_COLUMNS, _CHUNK]],
                 pa.array([s[0] for s in entries], pa.int64()), pa.array([s[1] for s in entries], pa.int64()),
                 pa.array([s[2] for s in entries], pa.bool_())],
                names=[*KEY_COLUMNS, _CHUNK, "entry_us", "entry_idx", "entry_lo"])

    return run


def _runs(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Borders of the runs of equal ``names`` values, first and last included."""
    n = batch.num_rows
    change = np.zeros(max(n - 1, 0), bool)
    for name in names:
        col = batch.column(name)
        change |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(change) + 1, [n]))


def _marker(cfg: FlowConfig, columns: list[str]):
    """Chunk rows in order, with the entry flow -> rows with their flow. Holds one Arrow batch."""
    group = [*KEY_COLUMNS, _CHUNK]

    def mark(batches):
        last_key, state = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n = batch.num_rows
            idx, ts, lo, closer, seg_us, seg_idx, seg_lo = _columns(
                batch, "idx", "ts_us", "is_lo", "_closer", "seg_us", "seg_idx", "seg_lo")
            start_us, start_idx, start_lo = np.zeros(n, np.int64), np.full(n, _CLOSED), np.zeros(n, bool)
            if cfg.active_rule == "inclusive":
                start_us[closer], start_idx[closer], start_lo[closer] = seg_us[closer], seg_idx[closer], seg_lo[closer]
            borders = _runs(batch, group)
            for a, b in zip(borders[:-1], borders[1:]):
                key = tuple(batch.column(c)[int(a)].as_py() for c in group) if a == 0 else None
                if key is None or key != last_key:
                    entry = batch.column("entry_idx")[int(a)].as_py()
                    state = (batch.column("entry_us")[int(a)].as_py(), entry, batch.column("entry_lo")[int(a)].as_py())
                    if entry is None or entry == _CLOSED:
                        state = None
                chunk = _Chunk(ts[a:b], closer[a:b], cfg)
                if closer[a]:
                    first, open_end = chunk.after_close(0), False
                elif state is None:
                    first, open_end = 0, False
                else:
                    start_us[a], start_idx[a], start_lo[a] = state
                    p = chunk.closing_packet(state[0], 0)
                    first, open_end = (chunk.n, True) if p >= chunk.n else (chunk.after_close(p), False)
                begins = np.fromiter(chunk.walk(first), np.int64)
                if len(begins):
                    at = a + begins
                    start_us[at], start_idx[at], start_lo[at] = ts[at], idx[at], lo[at]
                    last = int(begins[-1])
                    open_end = chunk.closing_packet(int(ts[a + last]), last + 1) >= chunk.n
                    if open_end:
                        state = (int(ts[a + last]), int(idx[a + last]), bool(lo[a + last]))
                if not open_end:
                    state = None
            last_key = tuple(batch.column(c)[n - 1].as_py() for c in group)
            # Every packet takes the latest opening at or before it.
            opened = np.maximum.accumulate(np.where(start_idx != _CLOSED, np.arange(n), 0))
            out = pa.Table.from_batches([batch])
            out = (out.append_column("flow_seq", pa.array(start_idx[opened], pa.int64()))
                   .append_column("flow_start_us", pa.array(start_us[opened], pa.int64()))
                   .append_column("flow_lo", pa.array(start_lo[opened], pa.bool_()))
                   .select(columns))
            yield from out.to_batches()

    return mark
