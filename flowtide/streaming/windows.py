"""Native windows on streams of packets, detections and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.labels import is_intrusion
from flowtide.functions.network import KEY_COLUMNS, packet_defaults, with_flow_key


def stream_flow_sessions(packets: DataFrame, watermark: str = "10 seconds", idle_us: int = 5_000_000) -> DataFrame:
    """Flows by the idle rule only: one row per session once the watermark has passed it."""
    keyed = with_flow_key(packet_defaults(packets)).withWatermark("ts", watermark)
    return (
        keyed.groupBy(*KEY_COLUMNS, F.session_window("ts", f"{idle_us - 1} microseconds").alias("w"))
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("total_pkts"),
             F.sum("pkt_len").alias("total_bytes")).drop("w")
    )


def stream_trend(detections: DataFrame, watermark: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Totals and intrusions per tumbling window."""
    return (
        detections.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", width).alias("w"))
        .agg(F.count("*").alias("total"), F.count_if(is_intrusion(F.col("prediction"))).alias("intrusions"))
        .select(F.col("w.start").alias("bucket"), "total", "intrusions")
    )


def stream_portscan(verdicts: DataFrame, watermark: str = "10 seconds", window: str = "30 seconds",
                    slide: str = "5 seconds", min_probes: int = 5) -> DataFrame:
    """Sources that probed at least ``min_probes`` different targets within a sliding window.

    The targets of a window are counted once each by a first aggregation, whose state spreads by target;
    the second one counts them per source.
    """
    probes = verdicts.where("prediction = 'PortScan'").withWatermark("timestamp", watermark)
    targets = probes.groupBy(F.window("timestamp", window, slide), "source_ip", "destination_ip", "destination_port").count()
    return (
        targets.groupBy("window", "source_ip").agg(F.count("*").alias("distinct_targets"), F.sum("count").alias("probes"))
        .where(F.col("distinct_targets") >= min_probes)
        .select("source_ip", F.col("window.start").alias("window_start"), "distinct_targets", "probes")
    )


def stream_dedup(verdicts: DataFrame, watermark: str = "10 seconds", window_us: int = 60_000_000) -> DataFrame:
    """One alert per burst: confirmed rows of a fingerprint less than ``window_us`` apart."""
    rows = verdicts.where("is_intrusion").withWatermark("timestamp", watermark)
    burst = F.session_window("timestamp", f"{window_us - 1} microseconds").alias("w")
    return rows.groupBy("source_ip", "destination_ip", F.col("prediction").alias("attack_type"), burst).agg(
        F.min_by("id", F.struct("timestamp", "id")).alias("id"), F.min_by("severity", F.struct("timestamp", "id")).alias("severity"),
        F.max("confidence").alias("confidence"), F.min("timestamp").alias("timestamp"),
        F.max("timestamp").alias("last_seen"), F.count("*").alias("occurrences")).drop("w")
