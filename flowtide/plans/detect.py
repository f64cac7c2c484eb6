"""From packets to alerts in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.config import FlowConfig, PolicyConfig
from flowtide.operators.features import flow_features, project_feature_sample
from flowtide.operators.policy import policy_cascade
from flowtide.plans.scoring import score_flows
from flowtide.plans.training import TrainedModel
from flowtide.session import materialize

_FLOW = ("id", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "timestamp", "total_pkts",
         "duration_s", "syn_count", "features")


def as_scored_input(features: DataFrame) -> DataFrame:
    """``flow_features`` rows under the column names of detections; the time of a flow is its end."""
    sample = project_feature_sample(features, 12)
    return sample.withColumns({
        "id": F.xxhash64("k_proto", "k_ip_lo", "k_port_lo", "k_ip_hi", "k_port_hi", "flow_start_us", "flow_seq"),
        "source_ip": F.col("src_ip"), "destination_ip": F.col("dst_ip"),
        "source_port": F.col("src_port"), "destination_port": F.col("dst_port"),
        "timestamp": F.timestamp_micros("flow_end_us"), "duration_s": F.col("flow_duration") / 1e6})


def detect(packets: DataFrame, model: TrainedModel, flow_cfg: FlowConfig = FlowConfig(),
           policy_cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Packets -> flows -> features -> predictions -> verdicts (detection rows).

    The cascade reads its input several times, so the scored flows (one row per flow) are written once.
    """
    return verdicts(as_scored_input(flow_features(packets, flow_cfg)), model, policy_cfg)


def score_stream(packets: DataFrame, model: TrainedModel, flow_cfg: FlowConfig = FlowConfig(), policy_cfg: PolicyConfig = PolicyConfig(),
                 watermark: str = "10 seconds") -> DataFrame:
    """``detect`` on a stream, in one plan: packets -> flows -> scores -> cascade, three keyed states in a row.

    A verdict comes out when the watermark is the idle timeout past the flow's end, because until then a flow that ended
    earlier may still be open; from there on it equals the batch. ``id`` is of the key and the start, without the batch's
    ``flow_seq``; flows of one key that start at the same microsecond share it. Late packets are dropped.
    """
    from flowtide.streaming.flows import stream_flows
    from flowtide.streaming.verdicts import stream_cascade

    flows = as_scored_input(stream_flows(packets, watermark, flow_cfg, chained=True).withColumn("flow_seq", F.lit(0)))
    scored = score_flows(flows, model, (*(c for c in _FLOW if c != "features"), "seen_at")).drop("raw_prediction", "status")
    return stream_cascade(scored, policy_cfg, flow_cfg.idle_us).withColumns({"mode": F.lit("LIVE"), "batch": F.lit(False)})


def verdicts(flows: DataFrame, model: TrainedModel, policy_cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """``detect`` from ``as_scored_input`` rows on."""
    scored = materialize(score_flows(flows, model, _FLOW).drop("raw_prediction", "status"))
    return policy_cascade(scored, policy_cfg).withColumns({"mode": F.lit("LIVE"), "batch": F.lit(False)})


def alert_candidates(detections: DataFrame) -> DataFrame:
    """Confirmed, non-duplicate verdicts as input of ``upsert_alerts``."""
    return detections.where("is_intrusion AND should_alert").select(
        "id", "source_ip", "destination_ip", F.col("prediction").alias("attack_type"), "severity", "confidence", "timestamp")
