"""Append-only tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flowtide.operators import aggregates as agg
from flowtide.operators import paging
from flowtide.operators.scan import ordered_scan


def write_detections(df: DataFrame, path: str) -> int:
    """Appends detections, partitioned by date; fills ``timestamp`` and ``status``. Returns the rows written."""
    now = F.current_timestamp()
    filled = df.withColumns({
        "timestamp": F.coalesce(F.col("timestamp"), now) if "timestamp" in df.columns else now,
        "status": F.coalesce(F.col("status"), F.lit("NEW")) if "status" in df.columns else F.lit("NEW"),
    })
    seen = Observation()
    dated = filled.withColumn("date", F.to_date("timestamp")).observe(seen, F.count("*").alias("n"))
    dated.write.mode("append").partitionBy("date").parquet(path)
    return seen.get["n"]


def append_audit(events: DataFrame, path: str) -> None:
    """Appends audit entries; missing details become an empty map."""
    empty = F.create_map().cast("map<string,string>")
    filled = events.withColumns({
        "timestamp": F.coalesce("timestamp", F.current_timestamp()),
        "details": F.coalesce("details", empty) if "details" in events.columns else empty,
    })
    filled.write.mode("append").parquet(path)


def export_batch_results(scored: DataFrame, path: str, order: str) -> None:
    """All scored rows as CSV: row_index (from 1, by ``order``), prediction, is_intrusion, confidence, severity."""
    numbered = ordered_scan(scored.withColumn("_all", F.lit(0)), ["_all"], [order], sums={"row_index": F.lit(1)})
    numbered.select("row_index", "prediction", "is_intrusion", "confidence", "severity").write.mode(
        "overwrite").option("header", True).csv(path)


def report_rows(detections: DataFrame, alerts: DataFrame, models: DataFrame, incidents: int = 50) -> DataFrame:
    """The report as (section_no, section, line, key, value): summary, attacks, severities, alerts, latest incidents."""
    def lines(no, section, df, key, value):
        return df.select(F.lit(no).alias("section_no"), F.lit(section).alias("section"),
                         F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))

    totals = agg.report_summary(detections)
    summary = totals.select(F.explode(F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(c).cast("string"))])
                                      ).alias("key", "value"))
    model = models.where("status = 'ACTIVE'").limit(1).select(F.lit("active_model").alias("key"), F.col("version").alias("value"))
    dist = agg.report_distributions(detections)
    recent = paging.recent_detections(detections, incidents).select(
        F.col("timestamp").cast("string").alias("key"),
        F.concat_ws(",", F.coalesce("source_ip", F.lit("")), F.coalesce("destination_ip", F.lit("")),
                    F.coalesce("prediction", F.lit("")), F.coalesce("severity", F.lit("")),
                    F.col("confidence").cast("string")).alias("value"))
    parts = [
        lines(1, "summary", summary, "key", "value"), lines(1, "summary", model, "key", "value"),
        lines(2, "attack", dist.where("section = 'attack'"), "label", "count"),
        lines(3, "severity", dist.where("section = 'severity'"), "label", "count"),
        lines(4, "alerts", agg.count_by(alerts, "severity"), "label", "count"),
        lines(5, "incident", recent, "key", "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_csv(detections: DataFrame, alerts: DataFrame, models: DataFrame, path: str) -> None:
    """The report as one CSV file (a few hundred lines at most)."""
    rows = report_rows(detections, alerts, models)
    rows.orderBy("section_no", "key").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report_json(detections: DataFrame, alerts: DataFrame, models: DataFrame, path: str) -> None:
    """The report as one JSON document: section -> list of (key, value). It has a few hundred lines at most."""
    line = F.struct("section_no", "key", "value")
    sections = report_rows(detections, alerts, models).groupBy("section").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    pairs = F.transform("lines", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    document = sections.select(F.struct(F.col("section").alias("key"), pairs.alias("value")).alias("e")).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list("e"), lambda a, b: F.when(a["key"] < b["key"], -1).when(
            a["key"] > b["key"], 1).otherwise(0)))).alias("value"))
    document.coalesce(1).write.mode("overwrite").text(path)
