"""Verdict rules, alerts, lifecycle, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.checks.flow_queries import _ASSIGNED, _FLOW
from flowtide.checks.mapping import FLOW
from flowtide.checks.registry import query
from flowtide.config import DAY, HOUR, PolicyConfig
from flowtide.functions.labels import is_intrusion
from flowtide.functions.time import micros
from flowtide.operators import alerts as al
from flowtide.operators import policy as pol
from flowtide.operators.aggregates import session_counters
from flowtide.operators.flows import flow_summary

CFG = PolicyConfig(probe_window_us=DAY, dedup_window_us=12 * HOUR, min_probes=3)

_INFRA = "(source_port IN (53,67,68,123) OR destination_port IN (53,67,68,123))"
_THIN = "(total_pkts < 20 AND total_pkts / greatest(duration_s, 1e-4) < 50 AND syn_count / greatest(total_pkts, 1) < 0.70)"


def _dup_sql(window: int) -> str:
    return f"""last_value(CASE WHEN ok THEN us END IGNORE NULLS) OVER (PARTITION BY source_ip, destination_ip, prediction
      ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > us - {window}"""


@query("normalize_infrastructure_verdict", "detections", sql=f"""SELECT id,
  CASE WHEN {_INFRA} AND total_pkts < 100 THEN 'BENIGN' ELSE prediction END AS prediction,
  CASE WHEN {_INFRA} AND total_pkts < 100 THEN 0.95 ELSE confidence END AS confidence,
  CASE WHEN {_INFRA} AND total_pkts < 100 THEN 'LOW' ELSE severity END AS severity FROM $detections""")
def q_normalize_infrastructure(spark, d):
    return pol.normalize_infrastructure_verdict(d).select("id", "prediction", "confidence", "severity")


@query("dos_volumetric", "detections", sql=f"SELECT id, NOT {_THIN} AS volume_ok FROM $detections")
def q_dos_volumetric(spark, d):
    return pol.dos_volumetric(d).select("id", "volume_ok")


@query("confidence_gate", "detections", sql="""SELECT id, CASE WHEN confidence < 0.75 THEN 'BENIGN' ELSE prediction END AS prediction,
  CASE WHEN confidence < 0.75 THEN 'LOW' ELSE severity END AS severity, confidence FROM $detections""")
def q_confidence_gate(spark, d):
    return pol.confidence_gate(d).select("id", "prediction", "severity", "confidence")


@query("portscan_probe_count", "detections", sql=f"""WITH p AS (SELECT id, source_ip, epoch_us(timestamp) AS us,
    concat(destination_ip, ':', destination_port) AS target FROM $detections WHERE prediction = 'PortScan')
  SELECT id, count(DISTINCT target) OVER (PARTITION BY source_ip ORDER BY us RANGE BETWEEN {CFG.probe_window_us} PRECEDING AND CURRENT ROW)
    AS distinct_targets FROM p""")
def q_portscan_probe_count(spark, d):
    rows = d.where("prediction = 'PortScan'")
    return pol.portscan_probe_count(rows, CFG.probe_window_us).select("id", "distinct_targets")


@query("alert_dedup", "detections", sql=f"""WITH p AS (SELECT *, epoch_us(timestamp) AS us,
    (prediction IS NULL OR prediction <> 'BENIGN') AND confidence >= 0.75 AS ok FROM $detections)
  SELECT id, ok AND coalesce({_dup_sql(CFG.dedup_window_us)}, false) AS is_duplicate FROM p""")
def q_alert_dedup(spark, d):
    ok = is_intrusion(F.col("prediction")) & (F.col("confidence") >= 0.75)
    return pol.alert_dedup(d, CFG.dedup_window_us, ok).select("id", "is_duplicate")


@query("alert_sessions", "detections", sql=f"""WITH p AS (SELECT *, epoch_us(timestamp) AS us FROM $detections
    WHERE prediction IS NULL OR prediction <> 'BENIGN'), m AS (
    SELECT *, CASE WHEN us - lag(us) OVER f < {CFG.dedup_window_us} THEN 0 ELSE 1 END AS fresh FROM p
    WINDOW f AS (PARTITION BY source_ip, destination_ip, prediction ORDER BY us, id)
  ), s AS (SELECT *, sum(fresh) OVER (PARTITION BY source_ip, destination_ip, prediction ORDER BY us, id) AS burst FROM m)
  SELECT coalesce(source_ip, '?') AS source_ip, destination_ip, coalesce(prediction, '?') AS prediction, min(us) AS start_us, max(us) AS end_us,
         count(*) AS occurrences, max(confidence) AS confidence
  FROM s GROUP BY s.source_ip, destination_ip, s.prediction, burst""")
def q_alert_sessions(spark, d):
    got = pol.alert_sessions(d.where(is_intrusion(F.col("prediction"))), CFG.dedup_window_us)
    return got.withColumns({c: F.coalesce(c, F.lit("?")) for c in ("source_ip", "prediction")})


_CASCADE = f"""r AS (
  SELECT *, epoch_us(timestamp) AS us, coalesce(prediction = 'BENIGN', false) AS benign,
         NOT coalesce(prediction = 'BENIGN', false) AND {_INFRA} AND total_pkts < 100 AS infra FROM $detections
), probes AS (
  SELECT id AS pid, count(DISTINCT concat(destination_ip, ':', destination_port)) OVER (PARTITION BY source_ip ORDER BY us
         RANGE BETWEEN {CFG.probe_window_us} PRECEDING AND CURRENT ROW) AS targets
  FROM r WHERE prediction = 'PortScan' AND NOT infra
), ruled AS (
  SELECT r.*, CASE WHEN benign THEN 'benign' WHEN infra THEN 'infrastructure' WHEN targets < {CFG.min_probes} THEN 'probes'
         WHEN prediction IN ('DoS', 'DDoS') AND {_THIN} THEN 'volume' WHEN confidence < {CFG.confidence_threshold} THEN 'confidence'
         ELSE 'confirmed' END AS rule
  FROM r LEFT JOIN probes ON pid = id
), v AS (SELECT *, rule = 'confirmed' AS ok FROM ruled
), verdict AS (SELECT *, ok AND coalesce({_dup_sql(CFG.dedup_window_us)}, false) AS dup FROM v)"""


@query("policy_cascade", "detections", sql=f"""WITH {_CASCADE}
  SELECT id, CASE WHEN ok THEN prediction ELSE 'BENIGN' END AS prediction, ok AS is_intrusion,
    CASE rule WHEN 'infrastructure' THEN 0.95 WHEN 'probes' THEN 0.85 WHEN 'volume' THEN 0.85 ELSE confidence END AS confidence,
    CASE WHEN ok THEN severity ELSE 'LOW' END AS severity, ok AND NOT dup AS should_alert, dup AS is_duplicate,
    CASE rule WHEN 'benign' THEN 'Classified as normal benign traffic by ML model.'
      WHEN 'infrastructure' THEN concat('Normal infrastructure network traffic (', destination_ip, ':', destination_port, ' ', protocol, ').')
      WHEN 'probes' THEN concat('Single/isolated connection to port ', destination_port, ' (PortScan requires >={CFG.min_probes} probes).')
      WHEN 'volume' THEN 'Normal traffic volume (insufficient volumetric evidence for DoS).'
      WHEN 'confidence' THEN printf('ML confidence (%.2f) below detection threshold ({CFG.confidence_threshold:.2f}).', confidence)
      ELSE printf('Confirmed %s intrusion with %.1f%% confidence.', coalesce(prediction, 'null'), confidence * 100) END AS note,
    CASE WHEN ok THEN concat(coalesce(source_ip, '?'), '|', destination_ip, '|', coalesce(prediction, '?')) END AS dedup_key
  FROM verdict""")
def q_policy_cascade(spark, d):
    k = F.col("dedup_key")
    got = pol.policy_cascade(d, CFG)
    return got.select(
        "id", "prediction", "is_intrusion", "confidence", "severity", "should_alert", "is_duplicate", F.col("validation_note").alias("note"),
        F.when(k.isNotNull(), F.concat_ws("|", F.coalesce(k["src"], F.lit("?")), k["dst"], F.coalesce(k["attack"], F.lit("?")))
               ).alias("dedup_key"))


@query("session_counters", "packets", "detections", sql=f"""WITH RECURSIVE {_ASSIGNED}, {_CASCADE}
  SELECT (SELECT count(*) FROM $packets) AS packets_captured, (SELECT count(DISTINCT ({_FLOW})) FROM ini) AS flows_generated, count(*) AS flows_analyzed, count(*) FILTER (NOT ok) AS normal_traffic,
         count(*) FILTER (ok) AS intrusions, count(*) FILTER (ok AND NOT dup) AS alerts FROM verdict""")
def q_session_counters(spark, packets, d):
    verdicts = pol.policy_cascade(d, CFG)
    return session_counters(flow_summary(packets, FLOW), verdicts)


_INTRUSION = "prediction IS DISTINCT FROM 'BENIGN'"
_CLOSES = f"SELECT source_ip, destination_ip, prediction AS attack_type, timestamp FROM $detections WHERE id % 11 = 0 AND {_INTRUSION}"


def _closes(d):
    return d.where((F.col("id") % 11 == 0) & is_intrusion(F.col("prediction"))).select(
        "source_ip", "destination_ip", F.col("prediction").alias("attack_type"), "timestamp")


@query("alert_aggregate", "detections", sql=f"""WITH c AS ({_CLOSES}), d AS (
    SELECT *, prediction AS attack_type FROM $detections WHERE {_INTRUSION}
  ), e AS (
    SELECT source_ip, destination_ip, attack_type, timestamp, 1 AS rank, id, severity, confidence FROM d
    UNION ALL SELECT *, 0, NULL, NULL, NULL FROM c
  ), n AS (SELECT *, sum(1 - rank) OVER (PARTITION BY source_ip, destination_ip, attack_type ORDER BY timestamp, rank, id
    ROWS UNBOUNDED PRECEDING) AS epoch FROM e)
  SELECT source_ip, destination_ip, attack_type, cast(epoch AS bigint) AS epoch, arg_min(id, (timestamp, id)) AS detection_id,
         arg_min(severity, (timestamp, id)) AS severity, max(confidence) AS confidence, count(*) AS occurrences,
         epoch_us(min(timestamp)) AS timestamp_us, epoch_us(max(timestamp)) AS last_seen_us
  FROM n WHERE rank = 1 GROUP BY 1, 2, 3, 4""")
def q_alert_aggregate(spark, d):
    rows = d.where(is_intrusion(F.col("prediction"))).withColumnRenamed("prediction", "attack_type")
    return al.alert_aggregate(rows, _closes(d))


@query("upsert_alerts", "detections", sql=f"""WITH d AS (
    SELECT *, prediction AS attack_type FROM $detections WHERE {_INTRUSION}
  ), a AS (
    SELECT id, source_ip, destination_ip, attack_type, severity, confidence, CASE WHEN id % 10 = 5 THEN 'RESOLVED' ELSE 'ACTIVE' END AS status,
           1 AS occurrences, timestamp FROM d WHERE id % 2 = 0
  ), b AS (SELECT source_ip, destination_ip, attack_type, count(*) AS n, max(confidence) AS conf, arg_min(id, (timestamp, id)) AS nid,
      max(timestamp) AS seen FROM d WHERE id % 2 = 1 GROUP BY 1, 2, 3
  ), o AS (SELECT source_ip, destination_ip, attack_type, arg_max(id, (timestamp, id)) AS oid FROM a WHERE status = 'ACTIVE' GROUP BY 1, 2, 3
  ), m AS (SELECT b.*, oid FROM b LEFT JOIN o ON b.source_ip IS NOT DISTINCT FROM o.source_ip
      AND b.destination_ip IS NOT DISTINCT FROM o.destination_ip AND b.attack_type IS NOT DISTINCT FROM o.attack_type)
  SELECT a.id, a.status, a.occurrences + coalesce(m.n, 0) AS occurrences, greatest(a.confidence, m.conf) AS confidence,
         coalesce(epoch_us(greatest(m.seen, a.timestamp)), -1) AS seen_us
  FROM a LEFT JOIN m ON m.oid = a.id
  UNION ALL SELECT nid, 'ACTIVE', n, conf, CASE WHEN n > 1 THEN epoch_us(seen) ELSE -1 END FROM m WHERE oid IS NULL""")
def q_upsert_alerts(spark, d):
    rows = d.where(is_intrusion(F.col("prediction"))).withColumnRenamed("prediction", "attack_type")
    cols = ["id", "source_ip", "destination_ip", "attack_type", "severity", "confidence", "timestamp"]
    table = rows.where("id % 2 = 0").select(*cols, F.when(F.col("id") % 10 == 5, "RESOLVED").otherwise("ACTIVE").alias("status"),
                                            F.lit(1).cast("bigint").alias("occurrences"),
                                            F.col("timestamp").alias("last_seen"))
    got = al.upsert_alerts(table, rows.where("id % 2 = 1").select(*cols))
    return got.select("id", "status", "occurrences", "confidence", F.coalesce(micros(got, "last_seen"), F.lit(-1)).alias("seen_us"))


@query("alert_current_state", "lifecycle", sql="""SELECT alert_id,
    coalesce(CASE arg_max(kind, (ts, event_id)) FILTER (kind <> 'NOTE') WHEN 'ACK' THEN 'ACKNOWLEDGED' WHEN 'RESOLVE' THEN 'RESOLVED' ELSE 'ACTIVE' END, 'ACTIVE') AS status,
    coalesce(arg_max(actor, (ts, event_id)) FILTER (kind = 'ACK'), '-') AS acknowledged_by,
    coalesce(arg_max(actor, (ts, event_id)) FILTER (kind = 'RESOLVE'), '-') AS resolved_by,
    epoch_us(max(ts)) AS updated_us, count(*) FILTER (kind IN ('NOTE', 'RESOLVE')) AS note_count
  FROM $lifecycle GROUP BY 1""")
def q_alert_current_state(spark, e):
    got = al.alert_current_state(e)
    return got.select("alert_id", "status", F.coalesce("acknowledged_by", F.lit("-")).alias("acknowledged_by"),
                      F.coalesce("resolved_by", F.lit("-")).alias("resolved_by"),
                      micros(got, "updated_at").alias("updated_us"), "note_count")


@query("alert_notes", "lifecycle", sql="""SELECT alert_id, row_number() OVER (PARTITION BY alert_id ORDER BY ts, event_id) AS note_no,
  text, actor AS author FROM $lifecycle WHERE kind IN ('NOTE', 'RESOLVE')""")
def q_alert_notes(spark, e):
    return al.alert_notes(e).drop("ts")


@query("active_model", "registry", sql="""WITH w AS (SELECT arg_max(model_id, (activated_at, model_id)) AS won FROM $registry
    WHERE activated_at IS NOT NULL AND status <> 'FAILED')
  SELECT model_id, CASE WHEN model_id = won THEN 'ACTIVE' WHEN activated_at IS NOT NULL AND status <> 'FAILED' THEN 'ARCHIVED'
    ELSE status END AS status FROM $registry, w""")
def q_active_model(spark, r):
    return al.active_model(r).select("model_id", "status")
