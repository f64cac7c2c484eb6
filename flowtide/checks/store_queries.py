"""Sinks and sources: written to the checkpoint folder, read back, compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowtide.checks.registry import query
from flowtide.operators import paging
from flowtide.session import ensure_checkpoint_dir
from flowtide.sources import tables
from flowtide.sources.flow_csv import read_flow_csv


def _place(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("write_detections", "detections", sql="""SELECT id, prediction, status, strftime(timestamp, '%Y-%m-%d') AS day FROM $detections""")
def q_write_detections(spark, d):
    path = _place(spark, "detections")
    tables.write_detections(d, path)
    return spark.read.parquet(path).select("id", "prediction", "status", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("append_audit", "audit", sql="SELECT id, event, username, 0 AS n_details FROM $audit")
def q_append_audit(spark, a):
    """In two batches, as a log is appended to."""
    path = _place(spark, "audit")
    rows = a.withColumn("timestamp", F.timestamp_seconds("timestamp"))
    for part in (rows.where("id % 2 = 0"), rows.where("id % 2 <> 0")):
        tables.append_audit(part, path)
    return spark.read.parquet(path).select("id", "event", "username", F.size("details").alias("n_details"))


@query("export_batch_results", "detections", sql="""SELECT row_number() OVER (ORDER BY id) AS row_index, coalesce(prediction, '-') AS prediction,
  CASE WHEN is_intrusion THEN 'true' ELSE 'false' END AS is_intrusion, confidence, severity FROM $detections""")
def q_export_batch_results(spark, d):
    path = _place(spark, "export")
    tables.export_batch_results(d, path, "id")
    back = spark.read.schema("row_index bigint, prediction string, is_intrusion string, confidence double, severity string").option(
        "header", True).csv(path)
    return back.select("row_index", F.coalesce("prediction", F.lit("-")).alias("prediction"), "is_intrusion", "confidence", "severity")


@query("read_flow_csv", "flow_rows", sql="""SELECT cast(row_id AS varchar) AS row_id, " Flow Duration" AS duration, " Label" AS label FROM $flow_rows""")
def q_read_flow_csv(spark, r):
    """Two folders' worth of files with their columns in different orders."""
    path = _place(spark, "csv")
    for k, part in enumerate((r.where("row_id % 2 = 0"), r.where("row_id % 2 <> 0").select(*[f"`{c}`" for c in reversed(r.columns)]))):
        part.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(f"{path}/part={k}")
    got = read_flow_csv(spark, f"{path}/*")
    return got.select("row_id", F.col("Flow Duration").alias("duration"), F.col("Label").alias("label"))


_HIT = "prediction IS NULL OR prediction <> 'BENIGN'"
_REPORT = f"""WITH totals AS (SELECT count(*) AS n, count(*) FILTER ({_HIT}) AS hits FROM $detections),
  newest AS (SELECT * FROM $detections ORDER BY timestamp DESC, id DESC LIMIT 50)
  SELECT 'summary' AS section, 'total_traffic' AS key, cast(n AS varchar) AS value FROM totals
  UNION ALL SELECT 'summary', 'total_intrusions', cast(hits AS varchar) FROM totals
  UNION ALL SELECT 'summary', 'normal_traffic', cast(n - hits AS varchar) FROM totals
  UNION ALL SELECT 'summary', 'detection_rate', cast(round(hits * 100.0 / n, 2) AS varchar) FROM totals
  UNION ALL SELECT 'summary', 'active_model', version FROM $registry WHERE model_id = 'm7'
  UNION ALL SELECT 'attack', prediction, cast(count(*) AS varchar) FROM $detections WHERE prediction IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'severity', severity, cast(count(*) AS varchar) FROM $detections WHERE severity IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'alerts', coalesce(severity, 'Unknown'), cast(count(*) AS varchar) FROM $alerts GROUP BY 2
  UNION ALL SELECT 'incident', strftime(timestamp, '%Y-%m-%d %H:%M:%S'), concat_ws(',', coalesce(source_ip, ''), coalesce(destination_ip, ''),
    coalesce(prediction, ''), coalesce(severity, ''), cast(confidence AS varchar)) FROM newest"""


def _with_active_model(m):
    return m.withColumn("status", F.when(F.col("model_id") == "m7", "ACTIVE").otherwise(F.col("status")))


def _whole_seconds(lines):
    """Incident times without their fraction, which the engines spell differently."""
    time = F.when(F.col("section") == "incident", F.substring("key", 1, 19)).otherwise(F.col("key"))
    return lines.select("section", time.alias("key"), "value")


@query("report_json", "detections", "alerts", "registry", sql=_REPORT)
def q_report_json(spark, d, a, m):
    path = _place(spark, "report")
    tables.report_json(d, a, _with_active_model(m), path)
    document = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<struct<key:string,value:string>>>").alias("doc"))
    return _whole_seconds(document.select(F.explode("doc").alias("section", "lines")).select("section", F.inline("lines")))


@query("report_csv", "detections", "alerts", "registry", sql=_REPORT)
def q_report_csv(spark, d, a, m):
    path = _place(spark, "report")
    tables.report_csv(d, a, _with_active_model(m), path)
    return _whole_seconds(spark.read.option("header", True).csv(path))


@query("list_datasets", "@supplier", sql="SELECT s_name AS name, s_suppkey * 3 % 101 AS uploaded_at FROM supplier")
def q_list_datasets(spark, supplier):
    frame = supplier.select(F.col("s_name").alias("name"), (F.col("s_suppkey") * 3 % 101).alias("uploaded_at"))
    return paging.list_datasets(frame)
