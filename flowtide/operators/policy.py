"""Verdicts: the rule cascade over scored flows.

Input columns: id, source_ip, destination_ip, source_port, destination_port, protocol, prediction,
confidence, severity, total_pkts, duration_s, syn_count, timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.config import PolicyConfig
from flowtide.functions.labels import BENIGN
from flowtide.functions.network import is_infrastructure
from flowtide.functions.time import micros
from flowtide.operators.scan import gap_sessions, ordered_scan

_SCORED_KEY = ["source_ip", "destination_ip", "prediction"]


def infrastructure_rule(cfg: PolicyConfig = PolicyConfig()) -> Column:
    """Infrastructure traffic below the flood volume."""
    return is_infrastructure(F.col("destination_ip"), F.col("source_port"), F.col("destination_port")) & (
        F.col("total_pkts") < cfg.infrastructure_max_packets)


def normalize_infrastructure_verdict(df: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Infrastructure rows become BENIGN, 0.95, LOW."""
    hit = infrastructure_rule(cfg)
    return df.withColumns({
        "prediction": F.when(hit, BENIGN).otherwise(F.col("prediction")),
        "confidence": F.when(hit, 0.95).otherwise(F.col("confidence")),
        "severity": F.when(hit, "LOW").otherwise(F.col("severity")),
    })


def low_volume(cfg: PolicyConfig = PolicyConfig()) -> Column:
    """Too few packets, too slow and too few SYNs for a flood."""
    packets = F.col("total_pkts")
    rate = packets / F.greatest(F.col("duration_s"), F.lit(1e-4))
    syn_ratio = F.col("syn_count") / F.greatest(packets, F.lit(1))
    return (packets < cfg.dos_min_packets) & (rate < cfg.dos_min_rate) & (syn_ratio < cfg.dos_min_syn_ratio)


def dos_volumetric(df: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Adds ``volume_ok``: the flow is big, fast or SYN-heavy enough for DoS."""
    return df.withColumn("volume_ok", ~low_volume(cfg))


def confidence_gate(df: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Below the threshold a verdict becomes BENIGN, LOW and keeps its confidence."""
    low = F.col("confidence") < cfg.confidence_threshold
    return df.withColumns({"prediction": F.when(low, BENIGN).otherwise(F.col("prediction")),
                           "severity": F.when(low, "LOW").otherwise(F.col("severity"))})


def portscan_probe_count(df: DataFrame, window_us: int, probe: Column | None = None) -> DataFrame:
    """Adds ``distinct_targets``: different (destination, port) pairs the source probed in the last
    ``window_us``, both ends included; null on rows that are no probes.

    A probe counts from its own time until the window has passed or the same target is probed again,
    so the count is a running sum of +1 and -1 and no window content is collected.
    """
    probe = F.lit(True) if probe is None else probe
    rows = df.withColumns({"_at": micros(df, "timestamp"), "_probe": probe})
    probes = rows.where("_probe").select("source_ip", "destination_ip", "destination_port", "_at").distinct()
    target = ["source_ip", "destination_ip", "destination_port"]
    again = ordered_scan(probes, target, ["_at"], mins={"_next": F.col("_at")}, inclusive=False, descending=True)
    steps = again.select("source_ip", F.explode(F.array(
        F.struct(F.col("_at").alias("_at"), F.lit(1).alias("step")),
        F.struct(F.least(F.col("_next"), F.col("_at") + window_us + 1).alias("_at"), F.lit(-1).alias("step")),
    )).alias("s")).select("source_ip", "s.*").groupBy("source_ip", "_at").agg(F.sum("step").alias("step"))
    counted = ordered_scan(steps, ["source_ip"], ["_at"], sums={"distinct_targets": F.col("step")})
    counted = counted.select(F.col("source_ip").alias("_src"), F.col("_at").alias("_then"), "distinct_targets")
    same = F.col("source_ip").eqNullSafe(F.col("_src")) & (F.col("_at") == F.col("_then"))
    return (
        rows.join(counted, same, "left")
        .withColumn("distinct_targets", F.when(F.col("_probe"), F.col("distinct_targets")))
        .drop("_src", "_then", "_at", "_probe")
    )


def alert_dedup(df: DataFrame, window_us: int, confirmed: Column | None = None) -> DataFrame:
    """Adds ``is_duplicate``: a confirmed row less than ``window_us`` after the previous confirmed row of
    its (source, destination, attack). Duplicates extend the burst."""
    confirmed = F.lit(True) if confirmed is None else confirmed
    rows = df.withColumns({"_at": micros(df, "timestamp"), "_ok": F.coalesce(confirmed, F.lit(False))})
    scanned = ordered_scan(rows, _SCORED_KEY, ["_at", "id"],
                           maxes={"_last": F.when(F.col("_ok"), F.col("_at"))}, inclusive=False)
    dup = F.col("_ok") & F.coalesce(F.col("_at") - F.col("_last") < window_us, F.lit(False))
    return scanned.withColumn("is_duplicate", dup).drop("_at", "_ok", "_last")


def alert_sessions(df: DataFrame, window_us: int) -> DataFrame:
    """One row per burst of equal alerts: start, end, count, highest confidence."""
    rows = df.withColumn("_at", micros(df, "timestamp"))
    return gap_sessions(rows, _SCORED_KEY, "_at", window_us, sums={"occurrences": F.lit(1)},
                        maxes={"confidence": F.col("confidence")})


def policy_cascade(df: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Adds the verdict columns; the raw prediction, confidence and severity move to ``raw_*``.

    Order: benign, infrastructure, port-scan evidence, flood volume, confidence, duplicate. Probe history
    holds every PortScan row past the infrastructure rule; burst history only confirmed rows.
    """
    rows = mark_probes(df, cfg)
    rows = rule_of(portscan_probe_count(rows, cfg.probe_window_us, F.col("_probes")), cfg)
    return verdict_columns(alert_dedup(rows, cfg.dedup_window_us, F.col("_rule") == "confirmed"), cfg)


def mark_probes(df: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """First step of the cascade, row by row: adds ``_benign``, ``_infra`` and ``_probes`` (counts as a probe)."""
    benign = F.col("prediction").eqNullSafe(BENIGN)
    rows = df.withColumns({"_benign": benign, "_infra": ~benign & infrastructure_rule(cfg)})
    return rows.withColumn("_probes", ~F.col("_infra") & F.col("prediction").eqNullSafe("PortScan"))


def rule_of(rows: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Second step, row by row, after ``distinct_targets`` is known: adds ``_rule``, the rule that decides."""
    c = F.col
    few = F.coalesce(c("distinct_targets") < cfg.min_probes, F.lit(False))
    thin = ~c("_infra") & F.coalesce(c("prediction").isin("DoS", "DDoS"), F.lit(False)) & low_volume(cfg)
    return rows.withColumn("_rule", F.when(c("_benign"), "benign").when(c("_infra"), "infrastructure")
                           .when(few, "probes").when(thin, "volume")
                           .when(c("confidence") < cfg.confidence_threshold, "confidence").otherwise("confirmed"))


def verdict_columns(rows: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Last step, row by row, after ``is_duplicate`` is known."""
    c = F.col
    rule, ok = c("_rule"), c("_rule") == "confirmed"
    port = c("destination_port").cast("string")
    # Rounds the double itself, so 0.605, which lies below the middle, becomes 0.60.
    rounded = lambda x, digits: F.coalesce(F.format_number(x, digits), F.lit("null"))
    # The texts of a verdict.
    note = (
        F.when(rule == "benign", "Classified as normal benign traffic by ML model.")
        .when(rule == "infrastructure", F.concat(
            F.lit("Normal infrastructure network traffic ("), c("destination_ip"), F.lit(":"), port, F.lit(" "),
            c("protocol"), F.lit(").")))
        .when(rule == "probes", F.concat(
            F.lit("Single/isolated connection to port "), port,
            F.lit(f" (PortScan requires >={cfg.min_probes} probes).")))
        .when(rule == "volume", "Normal traffic volume (insufficient volumetric evidence for DoS).")
        .when(rule == "confidence", F.concat(F.lit("ML confidence ("), rounded(c("confidence"), 2), F.lit(
            f") below detection threshold ({cfg.confidence_threshold:.2f}).")))
        .otherwise(F.concat(F.lit("Confirmed "), F.coalesce("prediction", F.lit("null")), F.lit(" intrusion with "),
                            rounded(c("confidence") * 100, 1), F.lit("% confidence.")))
    )
    return rows.withColumnsRenamed({
        "prediction": "raw_prediction", "confidence": "raw_confidence", "severity": "raw_severity",
    }).withColumns({
        "prediction": F.when(ok, c("raw_prediction")).otherwise(BENIGN),
        "is_intrusion": ok,
        "confidence": F.when(rule == "infrastructure", 0.95).when(rule.isin("probes", "volume"), 0.85)
                       .otherwise(c("raw_confidence")),
        "severity": F.when(ok, c("raw_severity")).otherwise("LOW"),
        "should_alert": ok & ~c("is_duplicate"),
        "validation_note": note,
        "dedup_key": F.when(ok, F.struct(c("source_ip").alias("src"), c("destination_ip").alias("dst"),
                                         c("raw_prediction").alias("attack"))),
    }).drop("_benign", "_infra", "_probes", "_rule")
