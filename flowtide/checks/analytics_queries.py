"""Filters, joins, counts, trends, sorts, pages and sets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from flowtide.checks.registry import query
from flowtide.functions import labels as lab
from flowtide.functions import network as net
from flowtide.functions.time import date_parts, parse_flow_timestamp
from flowtide.operators import aggregates as agg
from flowtide.operators import filters as fil
from flowtide.operators import joins, paging, sets
from flowtide.schema import FEATURE_NAMES

_IS = "(prediction IS NULL OR prediction <> 'BENIGN')"


# -- filters ---------------------------------------------------------------------------------------

@query("filter_eq", "detections", sql="SELECT id FROM $detections WHERE prediction = 'DoS' AND severity = 'HIGH' AND status = 'NEW'")
def q_filter_eq(spark, d):
    return fil.filter_eq(d, prediction="DoS", severity="HIGH", status="NEW", protocol=None).select("id")


@query("filter_ne", "detections", sql=f"SELECT id FROM $detections WHERE {_IS}")
def q_filter_ne(spark, d):
    return fil.filter_ne(d, "prediction", "BENIGN").select("id")


@query("filter_range", "detections", sql="""SELECT id FROM $detections
  WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-09 12:00:00' AND confidence >= 0.8""")
def q_filter_range(spark, d):
    days = fil.filter_range(d, "timestamp", datetime(2024, 1, 5), datetime(2024, 1, 9, 12))
    return fil.filter_range(days, "confidence", ge=0.8).select("id")


@query("filter_in", "detections", sql="SELECT id FROM $detections WHERE severity IN ('HIGH', 'CRITICAL')")
def q_filter_in(spark, d):
    return fil.filter_in(d, "severity", ["HIGH", "CRITICAL"]).select("id")


@query("filter_exists", "detections", sql="SELECT id FROM $detections WHERE source_ip IS NOT NULL")
def q_filter_exists(spark, d):
    return fil.filter_exists(d, "source_ip").select("id")


@query("search_regex", "detections", sql="""SELECT id FROM $detections
  WHERE coalesce(regexp_matches(source_ip, '(?i)1\\.4|dos$'), false) OR coalesce(regexp_matches(destination_ip, '(?i)1\\.4|dos$'), false)
     OR coalesce(regexp_matches(prediction, '(?i)1\\.4|dos$'), false)""")
def q_search_regex(spark, d):
    return fil.search_regex(d, r"1\.4|dos$").select("id")


@query("lookup_by_id", "registry", sql="SELECT model_id, version FROM $registry WHERE model_id = 'm7' OR version = 'm7'")
def q_lookup_by_id(spark, r):
    return fil.lookup_by_id(r, "m7", ("model_id", "version")).select("model_id", "version")


@query("filter_or_and", "detections", sql="""SELECT id FROM $detections
  WHERE (prediction = 'DoS' AND protocol = 'TCP') OR (prediction IS NULL AND severity = 'MEDIUM')""")
def q_filter_or_and(spark, d):
    return fil.filter_or_and(d, [{"prediction": "DoS", "protocol": "TCP"}, {"prediction": None, "severity": "MEDIUM"}]).select("id")


@query("drop_metadata", "flow_rows", sql="""SELECT row_id, " Flow Duration" AS d, "totlen fwd packets" AS l, 7 AS n_columns FROM $flow_rows""")
def q_drop_metadata(spark, r):
    left = fil.drop_metadata(r)
    return left.select("row_id", F.col("` Flow Duration`").alias("d"), F.col("`totlen fwd packets`").alias("l"),
                       F.lit(len(left.columns)).alias("n_columns"))


@query("normalize_columns", "flow_rows", sql="""SELECT row_id, " Flow Duration" AS flow_duration,
  "totlen fwd packets" AS len_fwd, "FLOW BYTES/S" AS rate, "Idle Mean" AS idle, " Label" AS label FROM $flow_rows""")
def q_normalize_columns(spark, r):
    return fil.normalize_columns(r, keep=("row_id",)).toDF("row_id", "flow_duration", "len_fwd", "rate", "idle", "label")


@query("to_numeric_clean", "flow_rows", sql="""SELECT row_id,
  CASE WHEN isinf(try_cast(" Flow Duration" AS double)) THEN NULL ELSE try_cast(" Flow Duration" AS double) END AS d,
  CASE WHEN isinf(try_cast("FLOW BYTES/S" AS double)) THEN NULL ELSE try_cast("FLOW BYTES/S" AS double) END AS b FROM $flow_rows""")
def q_to_numeric_clean(spark, r):
    return fil.to_numeric_clean(r, [" Flow Duration", "FLOW BYTES/S"]).select(
        "row_id", F.col("` Flow Duration`").alias("d"), F.col("`FLOW BYTES/S`").alias("b"))


@query("align_features", "flow_rows", sql="""SELECT row_id, cast("Idle Mean" AS double) AS idle_mean, cast(0 AS double) AS idle_std,
  cast("totlen fwd packets" AS double) AS len_fwd FROM $flow_rows""")
def q_align_features(spark, r):
    names = ["Idle Mean", "Idle Std", "Total Length of Fwd Packets"]
    rows = fil.to_numeric_clean(fil.normalize_columns(r, keep=("row_id",)), [names[0], names[2]])
    return fil.align_features(rows, names, keep=("row_id",)).toDF("row_id", "idle_mean", "idle_std", "len_fwd")


# -- joins -----------------------------------------------------------------------------------------

@query("alerts_with_detection", "alerts", "detections", sql="""SELECT a.id, a.attack_type, d.source_ip, d.prediction
  FROM $alerts a LEFT JOIN $detections d ON d.id = a.detection_id""")
def q_alerts_with_detection(spark, a, d):
    got = joins.alerts_with_detection(a, d, ["source_ip", "prediction"])
    return got.select("id", "attack_type", F.col("detection_source_ip").alias("source_ip"),
                      F.col("detection_prediction").alias("prediction"))


@query("detections_with_model", "detections", "registry", sql="""SELECT d.id, d.model_version, r.model_type
  FROM $detections d LEFT JOIN $registry r ON r.version = d.model_version""")
def q_detections_with_model(spark, d, r):
    return joins.detections_with_model(d, r.select("version", "model_type")).select("id", "model_version", "model_type")


@query("alerted_detections", "detections", "alerts", sql="""SELECT id FROM $detections
  WHERE id IN (SELECT detection_id FROM $alerts)""")
def q_alerted_detections(spark, d, a):
    return joins.alerted_detections(d, a).select("id")


@query("unalerted_intrusions", "detections", "alerts", sql=f"""SELECT id FROM $detections
  WHERE {_IS} AND id NOT IN (SELECT detection_id FROM $alerts)""")
def q_unalerted_intrusions(spark, d, a):
    return joins.unalerted_intrusions(d, a).select("id")


_DAY = 86_400_000_000


@query("active_alert_match", "detections", sql=f"""WITH a AS (
    SELECT id AS alert_id, source_ip, destination_ip, prediction AS attack_type, epoch_us(timestamp) AS opened_us,
           least(lead(epoch_us(timestamp)) OVER (PARTITION BY source_ip, destination_ip, prediction ORDER BY timestamp, id),
                 epoch_us(timestamp) + (id % 3) * {_DAY}) AS closed_us
    FROM $detections WHERE {_IS})
  SELECT d.id AS detection_id, coalesce(max(a.alert_id), -1) AS alert_id
  FROM $detections d LEFT JOIN a ON a.source_ip IS NOT DISTINCT FROM d.source_ip AND a.destination_ip IS NOT DISTINCT FROM d.destination_ip
   AND a.attack_type IS NOT DISTINCT FROM d.prediction AND a.opened_us <= epoch_us(d.timestamp) AND epoch_us(d.timestamp) < a.closed_us
  WHERE {_IS.replace("prediction", "d.prediction")} GROUP BY d.id""")
def q_active_alert_match(spark, d):
    from flowtide.functions.time import micros
    from flowtide.operators.scan import ordered_scan
    intr = d.where(lab.is_intrusion(F.col("prediction"))).withColumnRenamed("prediction", "attack_type")
    intr = intr.withColumn("opened_us", micros(intr, "timestamp"))
    following = ordered_scan(intr, joins.FINGERPRINT, ["opened_us", "id"], mins={"_next": F.col("opened_us")},
                             inclusive=False, descending=True)
    opened = following.select(*joins.FINGERPRINT, F.col("id").alias("alert_id"), "opened_us",
                              F.least("_next", F.col("opened_us") + (F.col("id") % 3) * _DAY).alias("closed_us"))
    return joins.active_alert_match(intr, opened).select(
        "detection_id", F.coalesce("alert_id", F.lit(-1)).alias("alert_id"))


_LABEL_SQL = "CASE trim(\" Label\") WHEN 'BENIGN' THEN 'BENIGN' WHEN 'DoS Hulk' THEN 'DoS' WHEN 'PortScan' THEN 'PortScan' " \
    "WHEN 'DDoS attacks-LOIC-HTTP' THEN 'DoS' WHEN 'Botnet' THEN 'Bot' ELSE 'Unknown' END"


@query("label_lookup", "flow_rows", sql=f"SELECT row_id, {_LABEL_SQL} AS category FROM $flow_rows")
def q_label_lookup(spark, r):
    rows = r.select("row_id", F.col("` Label`").alias("raw"))
    return joins.label_lookup(rows, "raw").select("row_id", "category")


@query("normalize_label", "flow_rows", sql=f"SELECT row_id, {_LABEL_SQL} AS category FROM $flow_rows")
def q_normalize_label(spark, r):
    return r.select("row_id", lab.normalize_label(F.col("` Label`")).alias("category"))


# -- counts ----------------------------------------------------------------------------------------

for _name, _col in (("prediction", "prediction"), ("severity", "severity"), ("protocol", "protocol")):
    query(f"count_by_{_name}", "detections",
          sql=f"SELECT coalesce({_col}, 'Unknown') AS label, count(*) AS count FROM $detections GROUP BY 1")(
        lambda spark, d, fn=getattr(agg, f"count_by_{_name}"): fn(d))


@query("attack_distribution", "detections",
       sql=f"SELECT coalesce(prediction, 'Unknown') AS label, count(*) AS count FROM $detections WHERE {_IS} GROUP BY 1")
def q_attack_distribution(spark, d):
    return agg.attack_distribution(d)


@query("group_aggregate", "detections", sql="""SELECT protocol, severity, count(*) AS n, cast(coalesce(sum(total_pkts), 0) AS bigint) AS pkts,
  count(*) FILTER (prediction IS NULL OR prediction <> 'BENIGN') AS hits
  FROM $detections WHERE confidence >= 0.6 GROUP BY 1, 2 ORDER BY n DESC, protocol, severity LIMIT 5""")
def q_group_aggregate(spark, d):
    return agg.group_aggregate(
        d, ["protocol", "severity"],
        {"n": F.count("*"), "pkts": agg.sum_of("total_pkts"), "hits": agg.count_if_ne("prediction", "BENIGN")},
        where=F.col("confidence") >= 0.6, sort=[F.desc("n"), F.asc("protocol"), F.asc("severity")], limit=5)


@query("count_where", "detections", sql=f"SELECT count(*) AS count FROM $detections WHERE {_IS}")
def q_count_where(spark, d):
    return agg.count_where(d, lab.is_intrusion(F.col("prediction")))


@query("traffic_overview", "detections", sql=f"""SELECT count(*) AS total, count(*) FILTER (prediction = 'BENIGN') AS normal,
  count(*) FILTER {"(" + _IS[1:-1] + ")"} AS intrusions, round(count(*) FILTER {"(" + _IS[1:-1] + ")"} * 100.0 / count(*), 2) AS detection_rate
  FROM $detections""".replace("FILTER (", "FILTER (WHERE "))
def q_traffic_overview(spark, d):
    return agg.traffic_overview(d)


@query("severity_counts", "detections", sql="""SELECT count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'LOW') AS low FROM $detections""")
def q_severity_counts(spark, d):
    return agg.severity_counts(d)


@query("alert_status_counts", "alerts", sql="SELECT status, count(*) AS count FROM $alerts GROUP BY 1")
def q_alert_status_counts(spark, a):
    return agg.alert_status_counts(a)


@query("active_alerts", "alerts", sql="SELECT count(*) AS count FROM $alerts WHERE status = 'ACTIVE'")
def q_active_alerts(spark, a):
    return agg.active_alerts(a)


for _side in ("source", "destination"):
    query(f"top_{_side}_ips", "detections", sql=f"""SELECT {_side}_ip AS ip, count(*) AS count FROM $detections
      WHERE {_side}_ip IS NOT NULL GROUP BY 1 ORDER BY count DESC, ip LIMIT 10""")(
        lambda spark, d, fn=getattr(agg, f"top_{_side}_ips"): fn(d))


@query("top_ips_share", "detections", sql="""WITH t AS (SELECT source_ip AS ip, count(*) AS count FROM $detections
    WHERE source_ip IS NOT NULL GROUP BY 1 ORDER BY count DESC, ip LIMIT 10)
  SELECT ip, count, round(count * 100.0 / max(count) OVER (), 0) AS share FROM t""")
def q_top_ips_share(spark, d):
    return agg.top_ips_share(d)


# -- trends and reports ----------------------------------------------------------------------------

_NOW = datetime(2024, 1, 25, 12)
_NOW_SQL = "TIMESTAMP '2024-01-25 12:00:00'"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


@query("trend_hourly", "detections", sql=f"""SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H') AS bucket,
  day(timestamp) AS day, hour(timestamp) AS hour, count(*) AS total, count(*) FILTER (WHERE {_IS[1:-1]}) AS intrusions
  FROM $detections WHERE timestamp >= {_NOW_SQL} - INTERVAL 24 HOURS GROUP BY 1, 2, 3""")
def q_trend_hourly(spark, d):
    got = agg.trend_hourly(d, _now())
    return got.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))


@query("trend_daily_attacks", "detections", sql=f"""SELECT year(timestamp) AS year, month(timestamp) AS month, day(timestamp) AS day,
  prediction AS attack, count(*) AS count FROM $detections
  WHERE timestamp >= {_NOW_SQL} - INTERVAL 7 DAYS AND {_IS} GROUP BY 1, 2, 3, 4""")
def q_trend_daily_attacks(spark, d):
    return agg.trend_daily_attacks(d, _now())


@query("trend_daily_pivot", "detections", sql=f"""SELECT strftime(timestamp, '%Y-%m-%d') AS day,
  count(*) FILTER (prediction = 'PortScan') AS "PortScan", count(*) FILTER (prediction = 'DoS') AS "DoS",
  count(*) FILTER (prediction = 'DDoS') AS "DDoS", count(*) FILTER (prediction IS NULL) AS "Unknown"
  FROM $detections WHERE timestamp >= {_NOW_SQL} - INTERVAL 7 DAYS AND {_IS} GROUP BY 1""")
def q_trend_daily_pivot(spark, d):
    return agg.trend_daily_pivot(d, _now(), ["PortScan", "DoS", "DDoS", "Unknown"])


@query("report_distributions", "detections", sql=f"""
  SELECT 'attack' AS section, prediction AS label, count(*) AS count, count(*) FILTER (WHERE {_IS[1:-1]}) AS intrusions
  FROM $detections WHERE prediction IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'severity', severity, count(*), count(*) FILTER (WHERE {_IS[1:-1]}) FROM $detections GROUP BY 2
  UNION ALL SELECT 'total', 'all', count(*), count(*) FILTER (WHERE {_IS[1:-1]}) FROM $detections""")
def q_report_distributions(spark, d):
    return agg.report_distributions(d)


@query("report_summary", "detections", sql=f"""SELECT count(*) AS total_traffic, count(*) FILTER (WHERE {_IS[1:-1]}) AS total_intrusions,
  count(*) FILTER (prediction = 'BENIGN') AS normal_traffic,
  round(count(*) FILTER (WHERE {_IS[1:-1]}) * 100.0 / count(*), 2) AS detection_rate FROM $detections""")
def q_report_summary(spark, d):
    return agg.report_summary(d)


@query("batch_summary", "detections", sql="""
  SELECT 'records' AS section, 'total' AS label, count(*) AS count FROM $detections
  UNION ALL SELECT 'records', CASE WHEN is_intrusion THEN 'intrusion' ELSE 'normal' END, count(*) FROM $detections GROUP BY 2
  UNION ALL SELECT 'attack', coalesce(prediction, 'Unknown'), count(*) FROM $detections WHERE is_intrusion GROUP BY 2
  UNION ALL SELECT 'severity', severity, count(*) FROM $detections GROUP BY 2""")
def q_batch_summary(spark, d):
    return agg.batch_summary(d)


@query("system_stats", "detections", "alerts", "registry", "audit", sql="""
  SELECT 'detections' AS name, count(*) AS count FROM $detections UNION ALL
  SELECT 'alerts', count(*) FROM $alerts WHERE status = 'ACTIVE' UNION ALL
  SELECT 'models', count(*) FROM $registry UNION ALL SELECT 'audit', count(*) FROM $audit""")
def q_system_stats(spark, d, a, r, u):
    return agg.system_stats({"detections": d, "alerts": a, "models": r, "audit": u})


# -- sorts, limits, pages --------------------------------------------------------------------------

@query("paginate_detections", "detections", sql="""SELECT id, epoch_us(timestamp) AS at_us FROM $detections
  WHERE prediction = 'DoS' ORDER BY timestamp DESC, id DESC LIMIT 20 OFFSET 40""")
def q_paginate_detections(spark, d):
    from flowtide.functions.time import micros
    rows, _ = paging.paginate_detections(d, page=3, per_page=20, prediction="DoS")
    return rows.select("id", micros(rows, "timestamp").alias("at_us"))


@query("paginate_totals", "detections", sql="""SELECT count(*) AS total, 3 AS page, 20 AS per_page,
  greatest(1, cast(ceil(count(*) / 20.0) AS bigint)) AS pages FROM $detections WHERE prediction = 'DoS'""")
def q_paginate_totals(spark, d):
    return paging.paginate_detections(d, page=3, per_page=20, prediction="DoS")[1]


@query("paginate_alerts", "alerts", sql="""SELECT id FROM $alerts WHERE status = 'ACTIVE' AND severity = 'HIGH'
  ORDER BY timestamp DESC, id DESC LIMIT 100 OFFSET 100""")
def q_paginate_alerts(spark, a):
    return paging.paginate_alerts(a, page=2, per_page=500, status="ACTIVE", severity="HIGH")[0].select("id")


@query("paginate_audit", "audit", sql="""SELECT id, username FROM $audit WHERE event = 'LOGIN'
  ORDER BY timestamp DESC, id DESC LIMIT 15 OFFSET 15""")
def q_paginate_audit(spark, a):
    return paging.paginate_audit(a, page=2, per_page=15, event="LOGIN")[0].select("id", "username")


@query("next_page", "audit", sql="""SELECT id FROM $audit WHERE timestamp < 500 OR (timestamp = 500 AND id < 40)
  ORDER BY timestamp DESC, id DESC LIMIT 25""")
def q_next_page(spark, a):
    return paging.next_page(a, 25, (500, 40)).select("id")


@query("recent_detections", "detections", sql="SELECT id, prediction FROM $detections ORDER BY timestamp DESC, id DESC LIMIT 50")
def q_recent_detections(spark, d):
    return paging.recent_detections(d, 50).select("id", "prediction")


@query("list_models", "registry", sql="SELECT model_id, version, created_at FROM $registry")
def q_list_models(spark, r):
    return paging.list_models(r).select("model_id", "version", "created_at")


@query("sort_multi", "detections", sql="""SELECT id, row_number() OVER (ORDER BY coalesce(prediction, '') DESC, confidence, id) AS place
  FROM $detections""")
def q_sort_multi(spark, d):
    """Every row with its place in the sorted result."""
    from pyspark.sql import Window
    from flowtide.session import materialize
    ordered = paging.sort_multi(d, [("prediction", -1), ("confidence", 1), ("id", 1)])
    rows = materialize(ordered.select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.withColumn("before", before), "part").select("id", (F.col("before") + F.col("at") - F.col("low") + 1).alias("place"))


@query("limit_n", "detections", sql="SELECT id FROM $detections")
def q_limit_n(spark, d):
    return paging.limit_n(d, 0).select("id")


@query("read_head", "detections", sql="SELECT id FROM $detections ORDER BY id LIMIT 1000")
def q_read_head(spark, d):
    from flowtide.sources.flow_csv import read_head
    return read_head(d, 1000, ["id"]).select("id")


@query("last_events", "detections", sql="SELECT id FROM $detections ORDER BY id DESC LIMIT 500")
def q_last_events(spark, d):
    return paging.last_events(d).select("id")


@query("poll_events", "detections", sql="SELECT id FROM $detections WHERE id > 300 ORDER BY id DESC LIMIT 200")
def q_poll_events(spark, d):
    return paging.poll_events(d, 300, 200).select("id")


@query("row_index_preview", "detections", sql="""SELECT id, row_number() OVER (ORDER BY id) AS row_index
  FROM $detections ORDER BY id LIMIT 50""")
def q_row_index_preview(spark, d):
    return paging.row_index_preview(d, ["id"]).select("id", "row_index")


@query("alert_cap", "detections", sql="SELECT id FROM $detections WHERE is_intrusion ORDER BY id LIMIT 100")
def q_alert_cap(spark, d):
    return paging.alert_cap(d, ["id"]).select("id")


# -- sets ------------------------------------------------------------------------------------------

@query("label_union", "predictions", sql="SELECT label FROM $predictions UNION SELECT prediction FROM $predictions")
def q_label_union(spark, p):
    return sets.label_union(p, "label", "prediction")


@query("distinct_classes", "predictions", sql="SELECT DISTINCT prediction AS label FROM $predictions")
def q_distinct_classes(spark, p):
    return sets.distinct_classes(p, "prediction")


@query("unknown_labels", "flow_rows", sql="""SELECT DISTINCT " Label" AS label FROM $flow_rows WHERE " Label" = 'Mystery'""")
def q_unknown_labels(spark, r):
    return sets.unknown_labels(r.select(F.col("` Label`").alias("label")), "label")


@query("recognized_features", "flow_rows", sql="""
  SELECT 'Flow Duration' AS feature, count(" Flow Duration") AS filled FROM $flow_rows UNION ALL
  SELECT 'Total Length of Fwd Packets', count("totlen fwd packets") FROM $flow_rows UNION ALL
  SELECT 'Flow Bytes/s', count("FLOW BYTES/S") FROM $flow_rows UNION ALL SELECT 'Idle Mean', count("Idle Mean") FROM $flow_rows""")
def q_recognized_features(spark, r):
    return sets.recognized_features(r)


_MISSING = [n for n in FEATURE_NAMES if n not in ("Flow Duration", "Total Length of Fwd Packets", "Flow Bytes/s", "Idle Mean")]


@query("missing_features", "flow_rows", sql=f"""SELECT unnest({_MISSING}) AS feature, n AS rows FROM (SELECT count(*) AS n FROM $flow_rows)""")
def q_missing_features(spark, r):
    return sets.missing_features(r)


# -- scalar functions ------------------------------------------------------------------------------

@query("is_infrastructure", "detections", sql="""SELECT id,
  (source_port IN (53,67,68,123,137,138,1900,3702,5353,5355) OR destination_port IN (53,67,68,123,137,138,1900,3702,5353,5355)
   OR regexp_matches(ip, '^2(2[4-9]|3[0-9])\\.') OR ip LIKE '%.255') AS infra
  FROM (SELECT *, CASE WHEN id % 7 = 0 THEN concat(cast(200 + id % 50 AS varchar), '.1.2.', cast(id % 256 AS varchar)) ELSE destination_ip END AS ip FROM $detections)""")
def q_is_infrastructure(spark, d):
    ip = F.when(F.col("id") % 7 == 0, F.concat((200 + F.col("id") % 50).cast("string"), F.lit(".1.2."), (F.col("id") % 256).cast("string"))
                ).otherwise(F.col("destination_ip"))
    return d.select("id", net.is_infrastructure(ip, F.col("source_port"), F.col("destination_port")).alias("infra"))


@query("assign_severity", "detections", sql="SELECT id, severity FROM $detections")
def q_assign_severity(spark, d):
    return d.select("id", lab.assign_severity(F.col("prediction"), F.col("confidence")).alias("severity"))


@query("prediction_status", "detections", sql=f"""SELECT id, CASE WHEN {_IS} THEN 'Intrusion Detected' ELSE 'Normal Traffic' END AS status,
  round(greatest(confidence, 1 - confidence), 4) AS confidence FROM $detections""")
def q_prediction_status(spark, d):
    probs = F.array(F.col("confidence"), 1 - F.col("confidence"))
    return d.select("id", lab.prediction_status(F.col("prediction")).alias("status"),
                    lab.max_probability(probs).alias("confidence"))


@query("probability_map", "detections", sql="""SELECT id, round(confidence, 4) AS dos, round(1 - confidence, 4) AS benign FROM $detections""")
def q_probability_map(spark, d):
    m = lab.probability_map(["DoS", "BENIGN"], F.array(F.col("confidence"), 1 - F.col("confidence")))
    return d.select("id", m["DoS"].alias("dos"), m["BENIGN"].alias("benign"))


@query("date_parts", "detections", sql="""SELECT id, year(timestamp) AS year, month(timestamp) AS month, day(timestamp) AS day,
  hour(timestamp) AS hour FROM $detections""")
def q_date_parts(spark, d):
    return d.select("id", *date_parts(F.col("timestamp")))


@query("parse_flow_timestamp", "detections", sql="""SELECT id, CASE WHEN id % 5 <> 0 THEN strftime(timestamp, '%Y-%m-%d %H:%M:%S') END AS at
  FROM $detections""")
def q_parse_flow_timestamp(spark, d):
    text = F.when(F.col("id") % 5 == 0, "not a time").otherwise(F.date_format("timestamp", "dd/MM/yyyy hh:mm:ss a"))
    return d.select("id", F.date_format(parse_flow_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("normalize_protocol", "detections", sql="""SELECT id, CASE protocol WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' ELSE protocol END AS protocol
  FROM $detections""")
def q_normalize_protocol(spark, d):
    return d.select("id", net.normalize_protocol(F.col("protocol")).alias("protocol"))


@query("default_metadata", "detections", sql="""SELECT id, coalesce(source_ip, 'batch') AS source_ip, destination_port, protocol FROM $detections""")
def q_default_metadata(spark, d):
    return net.default_metadata(d, "batch").select("id", "source_ip", "destination_port", "protocol")
