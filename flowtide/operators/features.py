"""The 76 features of a flow as one aggregation over annotated packets.

Every feature is a sum, count, extreme or moment of row values, so the packets are combined
before the shuffle and a flow of any size reduces to one small row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.config import FlowConfig
from flowtide.functions.network import flag, safe_ratio
from flowtide.operators.flows import FLOW_ID, annotate_packets
from flowtide.schema import FEATURE_COLUMNS, FEATURE_NAMES, TCP_FLAGS

_NO_HEADER = 1 << 30


def flow_features(packets: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """One row per flow: key, 5-tuple of the initiator, start/end, ``syn_count`` and 76 features."""
    carry = ["pkt_len", "tcp_flags", "header_len", "win_size", "payload_len"]
    return features_of(annotate_packets(packets, cfg, carry), cfg)


def features_of(rows: DataFrame, cfg: FlowConfig = FlowConfig()) -> DataFrame:
    """``flow_features`` on packets that ``annotate_packets`` has already assigned to flows."""
    fwd, bwd = F.col("fwd"), ~F.col("fwd")
    length = F.col("pkt_len").cast("double")
    on = lambda cond, value: F.when(cond, value)
    dir_gap = (F.col("ts_us") - F.col("dir_prev_us")).cast("double")
    flow_gap = F.coalesce(F.col("gap_us"), F.lit(0)).cast("double")
    paused = F.col("gap_us") > cfg.activity_us
    active = on(paused & (F.col("prev_us") > F.col("prev_island_us")),
                (F.col("prev_us") - F.col("prev_island_us")).cast("double"))
    idle = on(paused, F.col("gap_us").cast("double"))
    # Ordinal in the flow above, window size below: the smallest is the first non-zero window.
    window_at = (F.col("idx") - F.col("flow_seq")) * F.lit(1 << 31) + F.col("win_size")
    # Header size after the latest 20-byte header of the direction; see ``_min_segment``.
    header = F.col("header_len")
    last20 = F.coalesce(F.col("dir20_idx") - F.col("flow_seq") + 1, F.lit(0))
    after20 = last20 * F.lit(1 << 31) - F.when(header > 20, header).otherwise(F.lit(_NO_HEADER))

    def moments(prefix: str, value: Column) -> list[Column]:
        return [F.max(value).alias(f"{prefix}_max"), F.min(value).alias(f"{prefix}_min"),
                F.avg(value).alias(f"{prefix}_mean"), F.stddev_pop(value).alias(f"{prefix}_std")]

    aggs = [
        F.max("ts_us").alias("end_us"), F.max("island_us").alias("last_island_us"),
        F.count_if(fwd).alias("n_fwd"), F.count_if(bwd).alias("n_bwd"),
        F.sum(on(fwd, length)).alias("len_fwd"), F.sum(on(bwd, length)).alias("len_bwd"),
        *moments("fl", on(fwd, length)), *moments("bl", on(bwd, length)), *moments("al", length),
        *moments("gap", flow_gap),
        *moments("fg", on(fwd, dir_gap)), F.sum(on(fwd, dir_gap)).alias("fg_sum"),
        *moments("bg", on(bwd, dir_gap)), F.sum(on(bwd, dir_gap)).alias("bg_sum"),
        *[F.count_if(flag(F.col("tcp_flags"), f)).alias(f"n_{f}") for f in TCP_FLAGS],
        *[F.count_if(side & flag(F.col("tcp_flags"), f)).alias(f"{d}_{f}")
          for d, side in (("fwd", fwd), ("bwd", bwd)) for f in ("psh", "urg")],
        F.sum(on(fwd, header)).alias("hdr_fwd"), F.sum(on(bwd, header)).alias("hdr_bwd"),
        F.min(on(fwd & (F.col("win_size") > 0), window_at)).alias("win_fwd"),
        F.min(on(bwd & (F.col("win_size") > 0), window_at)).alias("win_bwd"),
        F.count_if(fwd & (F.col("payload_len") > 0)).alias("data_fwd"),
        F.min(on(fwd & (header > 0), header)).alias("hdr_min"),
        F.max(on(fwd & (header >= 20), after20)).alias("hdr_after20"),
        *moments("act", active), F.count(active).alias("act_n"),
        *moments("idl", idle),
        F.bool_or(F.col("fwd") == F.col("is_lo")).alias("lo_starts"),
    ]
    grouped = rows.groupBy(*FLOW_ID, "flow_start_us").agg(*aggs)
    return derive_features(grouped, [*FLOW_ID, "flow_start_us"])


def _min_segment() -> Column:
    """A header of 20 is replaced by whatever follows it; otherwise the smaller one stays.

    So a header below 20 makes it the plain minimum; else it is the minimum since the last 20.
    """
    tail = F.lit(1 << 31) - F.pmod(F.col("hdr_after20"), F.lit(1 << 31))
    return (F.when(F.col("hdr_min") < 20, F.col("hdr_min"))
            .when(F.col("hdr_after20").isNull() | (tail >= _NO_HEADER), F.lit(20)).otherwise(tail))


def derive_features(g: DataFrame, ids: list[str]) -> DataFrame:
    """The flow row from the sums of ``features_of`` (batch or stream)."""
    c, zero = F.col, F.lit(0.0)
    dbl = lambda name: F.coalesce(c(name).cast("double"), zero)
    dur = F.greatest(c("end_us") - c("flow_start_us"), F.lit(0)).cast("double")
    # Rates use the duration in seconds, at least one microsecond.
    secs = F.greatest(dur / 1e6, F.lit(1e-6))
    n_fwd, n_bwd = dbl("n_fwd"), dbl("n_bwd")
    four = lambda p: [dbl(f"{p}_{s}") for s in ("max", "min", "mean", "std")]
    iat = lambda p: [dbl(f"{p}_mean"), dbl(f"{p}_std"), dbl(f"{p}_max"), dbl(f"{p}_min")]
    window = lambda name: F.coalesce(F.pmod(c(name), F.lit(1 << 31)).cast("double"), zero)
    # The island still open at the flow's end joins the closed ones.
    last = (c("end_us") - c("last_island_us")).cast("double")
    has_last, k = last > 0, c("act_n").cast("double")
    m2 = F.coalesce(c("act_std") * c("act_std") * k, zero)
    shift = last - F.coalesce(c("act_mean"), zero)
    n_act = k + F.when(has_last, 1.0).otherwise(0.0)
    act_mean = F.when(n_act == 0, dur).otherwise(
        F.coalesce(c("act_mean"), zero) + F.when(has_last, shift / F.greatest(n_act, F.lit(1.0))).otherwise(0.0))
    act_m2 = m2 + F.when(has_last, shift * shift * k / F.greatest(n_act, F.lit(1.0))).otherwise(0.0)
    act_std = F.when(n_act == 0, 0.0).otherwise(F.sqrt(act_m2 / F.greatest(n_act, F.lit(1.0))))
    edge = lambda f, name: F.when(n_act == 0, dur).otherwise(
        f(c(name), F.when(has_last, last)))
    values = [
        dur, n_fwd, n_bwd, dbl("len_fwd"), dbl("len_bwd"),
        *four("fl"), *four("bl"),
        (dbl("len_fwd") + dbl("len_bwd")) / secs, (n_fwd + n_bwd) / secs,
        *iat("gap"),
        dbl("fg_sum"), *iat("fg"), dbl("bg_sum"), *iat("bg"),
        dbl("fwd_psh"), dbl("bwd_psh"), dbl("fwd_urg"), dbl("bwd_urg"),
        dbl("hdr_fwd"), dbl("hdr_bwd"), n_fwd / secs, n_bwd / secs,
        dbl("al_min"), dbl("al_max"), dbl("al_mean"), dbl("al_std"), dbl("al_std") * dbl("al_std"),
        *[dbl(f"n_{f}") for f in ("fin", "syn", "rst", "psh", "ack", "urg", "cwe", "ece")],
        safe_ratio(n_bwd, n_fwd), dbl("al_mean"), dbl("fl_mean"), dbl("bl_mean"),
        *[zero] * 6,
        n_fwd, dbl("len_fwd"), n_bwd, dbl("len_bwd"),
        window("win_fwd"), window("win_bwd"), dbl("data_fwd"), _min_segment().cast("double"),
        act_mean, act_std, edge(F.greatest, "act_max"), edge(F.least, "act_min"),
        dbl("idl_mean"), dbl("idl_std"), dbl("idl_max"), dbl("idl_min"),
    ]
    side = lambda a, b: F.when(c("lo_starts"), c(a)).otherwise(c(b))
    return g.select(
        *ids, c("end_us").alias("flow_end_us"),
        side("k_ip_lo", "k_ip_hi").alias("src_ip"), side("k_ip_hi", "k_ip_lo").alias("dst_ip"),
        side("k_port_lo", "k_port_hi").alias("src_port"), side("k_port_hi", "k_port_lo").alias("dst_port"),
        c("k_proto").alias("protocol"), (c("n_fwd") + c("n_bwd")).alias("total_pkts"),
        c("n_syn").alias("syn_count"),
        *[v.alias(n) for n, v in zip(FEATURE_COLUMNS, values, strict=True)],
    )


def with_canonical_names(features: DataFrame) -> DataFrame:
    """Feature columns under their canonical names (for export next to flow CSV files)."""
    return features.withColumnsRenamed(dict(zip(FEATURE_COLUMNS, FEATURE_NAMES)))


def project_feature_sample(df: DataFrame, n: int = 12, digits: int | None = 4) -> DataFrame:
    """Adds ``features``: a map of the first n features that ``df`` has, in model order."""
    have = [(name, col) for name, col in zip(FEATURE_NAMES, FEATURE_COLUMNS) if col in df.columns][:n]
    value = lambda col: F.round(F.col(col), digits) if digits is not None else F.col(col)
    return df.withColumn("features", F.map_from_arrays(
        F.array(*[F.lit(name) for name, _ in have]), F.array(*[value(col).cast("double") for _, col in have])))
