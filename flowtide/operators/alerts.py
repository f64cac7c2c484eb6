"""Alerts: merging detections, lifecycle events, the active model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.time import micros
from flowtide.operators.joins import FINGERPRINT
from flowtide.operators.scan import ordered_scan

STATUS_OF_EVENT = {"CREATE": "ACTIVE", "ACK": "ACKNOWLEDGED", "RESOLVE": "RESOLVED"}


def alert_aggregate(detections: DataFrame, closes: DataFrame) -> DataFrame:
    """Detections merged into alerts: one alert per fingerprint for as long as it stays ACTIVE.

    ``detections``: id, fingerprint, severity, confidence, timestamp. ``closes``: fingerprint and timestamp of
    acknowledge/resolve events, which take effect at their own time. ``epoch`` counts the closes before.
    """
    none = F.lit(None)
    line = detections.select(
        *FINGERPRINT, micros(detections, "timestamp").alias("at_us"), F.lit(1).alias("rank"), "id", "severity",
        "confidence").unionByName(closes.select(
            *FINGERPRINT, micros(closes, "timestamp").alias("at_us"), F.lit(0).alias("rank"),
            none.cast("bigint").alias("id"), none.cast("string").alias("severity"), none.cast("double").alias("confidence")))
    scanned = ordered_scan(line, FINGERPRINT, ["at_us", "rank", "id"],
                           sums={"epoch": F.when(F.col("rank") == 0, 1).otherwise(0)})
    first = F.struct("at_us", "id")
    return scanned.where("rank = 1").groupBy(*FINGERPRINT, "epoch").agg(
        F.min_by("id", first).alias("detection_id"), F.min_by("severity", first).alias("severity"),
        F.max("confidence").alias("confidence"), F.count("*").alias("occurrences"),
        F.min("at_us").alias("timestamp_us"), F.max("at_us").alias("last_seen_us"))


def upsert_alerts(alerts: DataFrame, new: DataFrame) -> DataFrame:
    """The alert table after a batch of new alert candidates.

    Candidates of one fingerprint merge into its newest ACTIVE alert, or open one. ``alerts``: id,
    fingerprint, severity, confidence, status, occurrences, timestamp, last_seen; ``new``: id, fingerprint,
    severity, confidence, timestamp.
    """
    order = F.struct("timestamp", "id")
    batch = new.groupBy(*FINGERPRINT).agg(
        F.count("*").alias("_n"), F.max("confidence").alias("_conf"), F.max("timestamp").alias("_seen"),
        F.min("timestamp").alias("_first"), F.min_by("id", order).alias("_new_id"), F.min_by("severity", order).alias("_sev"))
    open_ids = alerts.where("status = 'ACTIVE'").groupBy(*FINGERPRINT).agg(F.max_by("id", order).alias("id"))
    # A missing address or attack is a value like any other here.
    same = reduce(lambda a, b: a & b, [batch[c].eqNullSafe(open_ids[c]) for c in FINGERPRINT])
    matched = batch.join(open_ids, same, "left").select(*[batch[c] for c in batch.columns], open_ids["id"])
    merged = alerts.join(matched.where("id IS NOT NULL").select("id", "_n", "_conf", "_seen"), "id", "left").withColumns({
        "occurrences": F.col("occurrences") + F.coalesce("_n", F.lit(0)),
        "confidence": F.greatest("confidence", "_conf"),
        "last_seen": F.greatest("_seen", "last_seen"),
    }).select(alerts.columns)
    opened = matched.where("id IS NULL").select(
        F.col("_new_id").alias("id"), *FINGERPRINT, F.col("_sev").alias("severity"), F.col("_conf").alias("confidence"),
        F.lit("ACTIVE").alias("status"), F.col("_n").alias("occurrences"), F.col("_first").alias("timestamp"),
        F.when(F.col("_n") > 1, F.col("_seen")).alias("last_seen"))
    return merged.unionByName(opened, allowMissingColumns=True)


def alert_current_state(lifecycle: DataFrame) -> DataFrame:
    """State of every alert after its lifecycle events: the last status wins, any transition is allowed.

    ``lifecycle``: alert_id, ts, event_id (tie-break), kind CREATE / ACK / RESOLVE / NOTE, actor, text.
    The notes themselves are rows of ``alert_notes``.
    """
    order = F.struct("ts", "event_id")
    kind = F.col("kind")
    status = F.create_map(*[F.lit(v) for pair in STATUS_OF_EVENT.items() for v in pair])

    def latest(what, when):
        return F.max_by(what, F.when(when, order))

    return lifecycle.groupBy("alert_id").agg(
        F.coalesce(latest(status[kind], kind != "NOTE"), F.lit("ACTIVE")).alias("status"),
        latest("actor", kind == "ACK").alias("acknowledged_by"),
        F.max(F.when(kind == "ACK", F.col("ts"))).alias("acknowledged_at"),
        latest("actor", kind == "RESOLVE").alias("resolved_by"),
        F.max(F.when(kind == "RESOLVE", F.col("ts"))).alias("resolved_at"),
        F.max("ts").alias("updated_at"),
        F.count_if(_is_note()).alias("note_count"))


def _is_note():
    """Notes, and resolve events that carry a text."""
    return F.col("kind").isin("NOTE", "RESOLVE") & (F.coalesce(F.trim("text"), F.lit("")) != "")


def alert_notes(lifecycle: DataFrame) -> DataFrame:
    """The notes of every alert in order: alert_id, note_no from 1, text, author, ts."""
    notes = lifecycle.where(_is_note())
    notes = notes.withColumn("_at", micros(notes, "ts"))
    return ordered_scan(notes, ["alert_id"], ["_at", "event_id"],
                        sums={"note_no": F.lit(1)}).select(
        "alert_id", "note_no", "text", F.col("actor").alias("author"), "ts")


def active_model(registry: DataFrame) -> DataFrame:
    """Registry with the status that activations give: the last one is ACTIVE, earlier ones ARCHIVED.

    ``registry``: model_id, status, activated_at (null when never activated). FAILED models cannot be activated.
    """
    can = F.col("activated_at").isNotNull() & (F.col("status") != "FAILED")
    winner = registry.where(can).agg(F.max_by("model_id", F.struct("activated_at", "model_id")).alias("model_id"))
    marked = registry.join(winner.withColumn("_won", F.lit(True)), "model_id", "left")
    return marked.withColumn("status", F.when(F.col("_won"), "ACTIVE").when(can, "ARCHIVED").otherwise(F.col("status"))
                             ).drop("_won")
