"""Packets to flows: direction-free keys, timeouts, TCP close.

A packet opens a new flow when its key is new, the gap to the previous packet reaches the idle
timeout, the previous packet carried FIN or RST, or the flow's age has reached the active timeout
(``inclusive``: the packet that reaches it is still part of the flow and closes it).

The first three rules are local and give *segments*. Packets younger than the active timeout,
counted from their segment's start, belong to the segment's first flow. Only older packets need
the sequential rule (see ``active_split``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.config import FlowConfig
from flowtide.functions.network import KEY_COLUMNS, flag, packet_defaults, with_flow_key
from flowtide.functions.time import micros
from flowtide.operators.active_split import split_long_segments
from flowtide.operators.scan import SLICE, gap_sessions, ordered_scan, sliced

FLOW_ID = [*KEY_COLUMNS, "flow_seq"]


_NEIGHBOURS = ["_gap_us", "_isl", "_isl_p", "_dir", "_dir20"]


def annotate_packets(packets: DataFrame, cfg: FlowConfig = FlowConfig(), carry: list[str] | None = None,
                     neighbours: bool = True) -> DataFrame:
    """Every packet with its flow (``flow_seq`` = ordinal of the flow's first packet in its key),
    its direction ``fwd``, and with ``neighbours`` the columns about earlier packets the feature sums need.

    ``carry`` names the packet columns to keep (default all); whatever is not needed should not be shuffled.

    The packets are read once and stored in slices of (key, time, order); what one slice needs from earlier
    slices of its key comes from one summary row per slice. Packets of one time and sequence number are ordered
    by a hash of all their fields, so that every branch of the plan sees the same order.
    """
    base = with_flow_key(
        packet_defaults(packets.where(F.col("ts").isNotNull())).withColumn("ts_us", micros(packets, "ts"))
    ).withColumns({
        "_term": flag(F.col("tcp_flags"), "fin") | flag(F.col("tcp_flags"), "rst"),
        "_is20": F.col("header_len") == 20,
    })
    base = sliced(base.withColumn("_tie", F.xxhash64(*base.columns)), KEY_COLUMNS, ["ts_us", "seq", "_tie"])
    slice_key = [*KEY_COLUMNS, SLICE]
    w = Window.partitionBy(*slice_key).orderBy("ts_us", "seq", "_tie")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)

    def last(value: Column, frame) -> Column:
        return F.last(value, ignorenulls=True).over(frame)

    lo, hi = F.col("is_lo"), ~F.col("is_lo")
    first = F.struct("ts_us", F.lit(1).cast("bigint").alias("rn"), "is_lo")
    local = base.withColumns({
        "_rn": F.row_number().over(w).cast("bigint"),
        "_p_us": F.lag("ts_us").over(w),
        "_p_term": F.lag("_term").over(w),
    })
    at = F.struct("ts_us", F.col("_rn").alias("rn"))
    local = local.withColumns({
        "_lo_before": last(F.when(lo, at), before),
        "_hi_before": last(F.when(hi, at), before),
    })
    gap = F.col("ts_us") - F.col("_p_us")
    local = local.withColumns({
        "_cut": (gap >= cfg.idle_us) | F.col("_p_term"),
        "_gap": gap > cfg.activity_us,
    }).withColumns({
        "_seg": last(F.when(F.col("_cut"), F.struct("ts_us", F.col("_rn").alias("rn"), "is_lo")), upto),
        "_isl": last(F.when(F.col("_gap"), F.col("ts_us")), upto),
        "_isl_before": last(F.when(F.col("_gap"), F.col("ts_us")), before),
        "_lo20": last(F.when(lo & F.col("_is20"), F.col("_rn")), upto),
        "_hi20": last(F.when(hi & F.col("_is20"), F.col("_rn")), upto),
        "_first": F.first(first).over(upto),
        "_next": F.lead("ts_us").over(w),
    })

    # One row per (key, slice): the state after its last packet.
    ends = local.where(F.col("_next").isNull()).select(
        *slice_key, F.col("_rn").alias("n"), F.col("_first").alias("head"),
        F.col("ts_us").alias("end_us"), F.col("_term").alias("end_term"),
        F.when(lo, at).otherwise(F.col("_lo_before")).alias("lo_at"),
        F.when(hi, at).otherwise(F.col("_hi_before")).alias("hi_at"),
        F.col("_seg").alias("seg"), F.col("_isl").alias("isl"),
        F.col("_lo20").alias("lo20"), F.col("_hi20").alias("hi20"),
    )
    ks = Window.partitionBy(*KEY_COLUMNS).orderBy(SLICE)
    past = ks.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({
        "base": F.coalesce(F.sum("n").over(past), F.lit(0)),
        "key_n": F.sum("n").over(Window.partitionBy(*KEY_COLUMNS)),
        "p_us": F.lag("end_us").over(ks),
        "p_term": F.lag("end_term").over(ks),
    })
    head_gap = F.col("head.ts_us") - F.col("p_us")
    placed = lambda s, *more: F.when(F.col(s).isNotNull(), F.struct(
        F.col(f"{s}.ts_us").alias("ts_us"), (F.col("base") + F.col(f"{s}.rn") - 1).alias("idx"), *more))
    numbered = lambda s: placed(s, F.col(f"{s}.is_lo").alias("is_lo"))
    ends = ends.withColumns({
        "head_cut": F.when(F.col("p_us").isNull() | (head_gap >= cfg.idle_us) | F.col("p_term"), numbered("head")),
        "head_isl": F.when(head_gap > cfg.activity_us, F.col("head.ts_us")),
        "seg_abs": numbered("seg"),
        "lo_abs": placed("lo_at"),
        "hi_abs": placed("hi_at"),
        "lo20_abs": F.col("base") + F.col("lo20") - 1,
        "hi20_abs": F.col("base") + F.col("hi20") - 1,
    })
    carried = ends.select(
        *slice_key, "base", "key_n", "p_us", "p_term",
        last(F.col("lo_abs"), past).alias("c_lo"), last(F.col("hi_abs"), past).alias("c_hi"),
        F.coalesce("head_cut", last(F.coalesce("seg_abs", "head_cut"), past)).alias("c_seg"),
        F.col("head_isl"), last(F.coalesce("isl", "head_isl"), past).alias("c_isl"),
        last(F.col("lo20_abs"), past).alias("c_lo20"), last(F.col("hi20_abs"), past).alias("c_hi20"),
    )

    rows = local.join(carried, slice_key).withColumns({
        "idx": F.col("base") + F.col("_rn") - 1,
        "_p_us": F.coalesce("_p_us", "p_us"),
        "_seg": F.coalesce(numbered("_seg"), "c_seg"),
        "_gap_us": F.col("ts_us") - F.coalesce("_p_us", "p_us"),
        # Start of the activity island at this packet and at the one before it.
        "_isl": F.coalesce("_isl", "head_isl", "c_isl"),
        "_isl_p": F.coalesce(
            "_isl_before", F.when(F.col("_rn") > 1, F.coalesce("head_isl", "c_isl")).otherwise(F.col("c_isl"))),
        "_dir": F.when(lo, F.coalesce(placed("_lo_before"), "c_lo")).otherwise(F.coalesce(placed("_hi_before"), "c_hi")),
        "_dir20": F.when(lo, F.coalesce(F.col("base") + F.col("_lo20") - 1, F.col("c_lo20")))
                   .otherwise(F.coalesce(F.col("base") + F.col("_hi20") - 1, F.col("c_hi20"))),
    })
    keep = [*KEY_COLUMNS, "ts_us", "is_lo", *[c for c in (packets.columns if carry is None else carry) if c != "ts_us"],
            "idx", "_p_us", "key_n", *(_NEIGHBOURS if neighbours else [])]
    rows = rows.select(*keep, F.col("_seg.ts_us").alias("seg_us"), F.col("_seg.idx").alias("seg_idx"),
                       F.col("_seg.is_lo").alias("seg_lo"))
    return _with_flow_columns(split_long_segments(rows, cfg), neighbours).drop("key_n")


def _with_flow_columns(rows: DataFrame, neighbours: bool) -> DataFrame:
    """Cuts the neighbour columns at flow borders."""
    start = F.col("idx") == F.col("flow_seq")
    rows = rows.withColumn("fwd", F.col("is_lo") == F.col("flow_lo")).drop("flow_lo")
    if not neighbours:
        return rows.drop("_p_us")
    return rows.withColumns({
        "prev_us": F.when(~start, F.col("_p_us")),
        "dir_prev_us": F.when(~start & (F.col("_dir.idx") >= F.col("flow_seq")), F.col("_dir.ts_us")),
        "gap_us": F.when(~start, F.col("_gap_us")),
        "island_us": F.greatest("_isl", "flow_start_us"),
        "prev_island_us": F.greatest("_isl_p", "flow_start_us"),
        "dir20_idx": F.when(F.col("_dir20") >= F.col("flow_seq"), F.col("_dir20")),
    }).drop("_p_us", *_NEIGHBOURS)


def flow_sessionize(packets: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """Packets plus ``flow_seq``, ``flow_start_us`` and ``fwd``. Rows without a time are left out."""
    return annotate_packets(packets, cfg, neighbours=False).drop("idx", "is_lo")


def flow_summary(packets: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """One row per flow with its key, start, end and packet counts per direction."""
    rows = annotate_packets(packets, cfg, carry=["pkt_len"], neighbours=False)
    return rows.groupBy(*FLOW_ID, "flow_start_us").agg(
        F.max("ts_us").alias("flow_end_us"), F.count("*").alias("total_pkts"),
        F.count_if("fwd").alias("fwd_pkts"), F.sum("pkt_len").alias("total_bytes"))


def _closes_by_packet() -> Column:
    """True where a FIN or RST ends the flow; only its last packet can carry one."""
    return F.max(F.coalesce(flag(F.col("tcp_flags"), "fin") | flag(F.col("tcp_flags"), "rst"), F.lit(False)))


def flow_idle_sessions(packets: DataFrame, idle_us: int) -> DataFrame:
    """Sessions by the idle rule only (gap >= idle splits): key, start_us, end_us, total_pkts, total_bytes."""
    rows = packet_defaults(packets.where(F.col("ts").isNotNull()))
    keyed = with_flow_key(rows.withColumn("ts_us", micros(packets, "ts")))
    return gap_sessions(keyed, KEY_COLUMNS, "ts_us", idle_us,
                        sums={"total_pkts": F.lit(1), "total_bytes": F.col("pkt_len")})


def interarrival(packets: DataFrame, by: list[str]) -> DataFrame:
    """Microseconds since the previous row with the same ``by`` columns (null for the first)."""
    rows = packets.withColumn("ts_us", micros(packets, "ts"))
    scanned = ordered_scan(rows, by, ["ts_us", "seq"],
                           maxes={"prev_us": F.col("ts_us")}, inclusive=False)
    return scanned.withColumn("gap_us", F.col("ts_us") - F.col("prev_us")).drop("prev_us")


def active_idle_periods(packets: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """Active and idle periods of every flow, one row each (``kind``, ``start_us``, ``dur_us``)."""
    rows = annotate_packets(packets, cfg, carry=[])
    paused = rows.where(F.col("gap_us") > cfg.activity_us)
    closed = paused.select(*FLOW_ID, F.explode(F.array(
        F.struct(F.lit("active").alias("kind"), F.col("prev_island_us").alias("start_us"),
                 (F.col("prev_us") - F.col("prev_island_us")).alias("dur_us")),
        F.struct(F.lit("idle").alias("kind"), F.col("prev_us").alias("start_us"), F.col("gap_us").alias("dur_us")),
    )).alias("p")).select(*FLOW_ID, "p.*")
    final = rows.groupBy(*FLOW_ID).agg(F.max("island_us").alias("start_us"), F.max("ts_us").alias("end_us")).select(
        *FLOW_ID, F.lit("active").alias("kind"), "start_us", (F.col("end_us") - F.col("start_us")).alias("dur_us"))
    return closed.unionByName(final).where(F.col("dur_us") > 0)


def active_flow_count(packets: DataFrame, at_us: int, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """Number of flows open at a time: started and not ended.

    FIN, RST and (in the inclusive rule) the packet that reaches the active age end a flow at their own time; any
    other flow stays open for the idle timeout after its last packet.
    """
    rows = annotate_packets(packets, cfg, carry=["tcp_flags"], neighbours=False)
    flows = rows.groupBy(*FLOW_ID, "flow_start_us").agg(
        F.max("ts_us").alias("flow_end_us"), _closes_by_packet().alias("closed"))
    end = F.col("flow_end_us")
    aged = (end - F.col("flow_start_us") >= cfg.active_us) & F.lit(cfg.active_rule == "inclusive")
    is_open = (F.col("flow_start_us") <= at_us) & F.when(F.col("closed") | aged, F.lit(at_us) < end).otherwise(
        F.lit(at_us) < end + cfg.idle_us)
    return flows.agg(F.count_if(is_open).alias("active_flows"))
