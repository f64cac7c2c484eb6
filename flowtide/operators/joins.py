"""Key lookups between detections, alerts, models and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.labels import is_intrusion, normalize_label
from flowtide.functions.time import micros
from flowtide.operators.scan import ordered_scan

FINGERPRINT = ["source_ip", "destination_ip", "attack_type"]


def alerts_with_detection(alerts: DataFrame, detections: DataFrame, cols: list[str]) -> DataFrame:
    """Alerts with ``cols`` of the detection that raised them; alerts without one stay."""
    right = detections.select(F.col("id").alias("detection_id"), *[F.col(c).alias(f"detection_{c}") for c in cols])
    return alerts.join(right, "detection_id", "left")


def detections_with_model(detections: DataFrame, models: DataFrame) -> DataFrame:
    """Detections with the registry columns of their model version."""
    return detections.join(models.withColumnRenamed("version", "model_version"), "model_version", "left")


def alerted_detections(detections: DataFrame, alerts: DataFrame) -> DataFrame:
    return detections.join(alerts.select(F.col("detection_id").alias("id")), "id", "left_semi")


def unalerted_intrusions(detections: DataFrame, alerts: DataFrame) -> DataFrame:
    """Intrusions no alert refers to."""
    return detections.where(is_intrusion(F.col("prediction"))).join(
        alerts.select(F.col("detection_id").alias("id")), "id", "left_anti")


def active_alert_match(detections: DataFrame, alerts: DataFrame) -> DataFrame:
    """For each detection the newest alert of its fingerprint opened at or before it and not closed by then.

    ``alerts``: fingerprint, ``alert_id`` BIGINT, ``opened_us``, ``closed_us`` (null while open); ids grow with
    the opening time and one fingerprint has at most one open alert at a time. Both sides are merged into
    one timeline per fingerprint, so no pairs are formed.
    """
    line = ["source_ip", "destination_ip", "attack_type", "at_us", "rank", "detection_id", "alert_id", "closed_us"]
    none = F.lit(None).cast("bigint")
    events = detections.select(
        *FINGERPRINT, micros(detections, "timestamp").alias("at_us"), F.lit(1).alias("rank"),
        F.col("id").alias("detection_id"), none.alias("alert_id"), none.alias("closed_us")).unionByName(
        alerts.select(*FINGERPRINT, F.col("opened_us").alias("at_us"), F.lit(0).alias("rank"),
                      none.alias("detection_id"), "alert_id", F.col("closed_us"))).select(line)
    # Alert ids and closing times both grow along a fingerprint, so the running maximum is the newest alert.
    scanned = ordered_scan(
        events, FINGERPRINT, ["at_us", "rank"],
        maxes={"match_id": F.col("alert_id"), "match_closed": F.when(F.col("rank") == 0, F.coalesce(
            "closed_us", F.lit(2**62)))})
    live = F.col("at_us") < F.col("match_closed")
    return scanned.where("rank = 1").select(
        "detection_id", *FINGERPRINT, "at_us", F.when(live, F.col("match_id")).alias("alert_id"))


def label_lookup(df: DataFrame, col: str, out: str = "category") -> DataFrame:
    """Adds the category of a raw label column, computed once per distinct label."""
    distinct = df.where(F.col(col).isNotNull()).select(col).distinct()
    known = distinct.withColumn(out, normalize_label(F.col(col)))
    return df.join(known, col, "left").withColumn(out, F.coalesce(out, F.lit("Unknown")))
