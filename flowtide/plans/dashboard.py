"""The dashboard's frames, each from one scan of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from flowtide.operators import aggregates as agg
from flowtide.operators import paging


def summary(detections: DataFrame, alerts: DataFrame, models: DataFrame) -> dict[str, DataFrame]:
    return {
        "overview": agg.traffic_overview(detections),
        "attack_distribution": agg.attack_distribution(detections),
        "severity_counts": agg.severity_counts(alerts),
        "active_alerts": agg.active_alerts(alerts),
        "recent_detections": paging.recent_detections(detections, 10),
        "active_model": models.where("status = 'ACTIVE'"),
    }


def trends(detections: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    return {
        "hourly": agg.trend_hourly(detections, as_of),
        "daily_attacks": agg.trend_daily_attacks(detections, as_of),
        "protocols": agg.count_by_protocol(detections),
        "top_source_ips": agg.top_source_ips(detections),
        "top_destination_ips": agg.top_destination_ips(detections),
    }
