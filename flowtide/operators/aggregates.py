"""Counts, distributions, trends and reports over detections, alerts and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.functions.labels import BENIGN, is_intrusion
from flowtide.schema import SEVERITIES


def count_by(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, largest first; null is "Unknown"."""
    label = F.coalesce(F.col(col).cast("string"), F.lit("Unknown"))
    return (df.groupBy(label.alias("label")).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "label"))


def count_by_prediction(detections: DataFrame) -> DataFrame:
    return count_by(detections, "prediction")


def count_by_severity(detections: DataFrame) -> DataFrame:
    return count_by(detections, "severity")


def count_by_protocol(detections: DataFrame) -> DataFrame:
    return count_by(detections, "protocol")


def attack_distribution(detections: DataFrame) -> DataFrame:
    """``count_by_prediction`` of the intrusions."""
    return count_by(detections.where(is_intrusion(F.col("prediction"))), "prediction")


def count_if_ne(col: str, value) -> Column:
    """Conditional count: rows whose column is not ``value`` (null counts)."""
    return F.count_if(~F.col(col).eqNullSafe(F.lit(value)))


def sum_of(col: str) -> Column:
    """Sum with null as 0."""
    return F.coalesce(F.sum(col), F.lit(0))


def group_aggregate(df: DataFrame, by: list[str], aggs: dict[str, Column], where: Column | None = None,
                    sort: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Match, group by 0..n columns, aggregate, sort, limit."""
    if where is not None:
        df = df.where(where)
    out = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    if sort:
        out = out.orderBy(*sort)
    return out if limit is None else out.limit(limit)


def count_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("count"))


def _rate(part: Column, total: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100, total), 2), F.lit(0.0))


def traffic_overview(detections: DataFrame) -> DataFrame:
    """Total, normal and intrusion counts and the detection rate in percent, in one pass."""
    return detections.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("prediction") == BENIGN).alias("normal"),
        F.count_if(is_intrusion(F.col("prediction"))).alias("intrusions"),
    ).withColumn("detection_rate", _rate(F.col("intrusions"), F.col("total")))


def severity_counts(df: DataFrame) -> DataFrame:
    """One row with the four severity buckets."""
    return df.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])


def alert_status_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("status").agg(F.count("*").alias("count"))


def active_alerts(alerts: DataFrame) -> DataFrame:
    return count_where(alerts, F.col("status") == "ACTIVE")


def top_ips(detections: DataFrame, col: str, k: int = 10) -> DataFrame:
    return (detections.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("ip"))
            .agg(F.count("*").alias("count")).orderBy(F.desc("count"), "ip").limit(k))


def top_source_ips(detections: DataFrame, k: int = 10) -> DataFrame:
    return top_ips(detections, "source_ip", k)


def top_destination_ips(detections: DataFrame, k: int = 10) -> DataFrame:
    return top_ips(detections, "destination_ip", k)


def top_ips_share(detections: DataFrame, col: str = "source_ip", k: int = 10) -> DataFrame:
    """The top k with each count in percent of the largest (whole percent)."""
    top = top_ips(detections, col, k)
    # At most k rows reach this window.
    share = F.round(F.col("count") * 100 / F.max("count").over(Window.partitionBy()), 0)
    return top.withColumn("share", share)


def _since(detections: DataFrame, start: Column) -> DataFrame:
    """Rows from ``start`` on. A table of ``write_detections`` has a directory per ``date``, which prunes earlier days.

    A day more is read, as the table may have been written in another time zone.
    """
    recent = F.col("timestamp") >= start
    if "date" in detections.columns:
        recent = recent & (F.col("date") >= F.date_sub(F.to_date(start), 1))
    return detections.where(recent)


def trend_hourly(detections: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Total and intrusion counts per hour since ``as_of`` minus ``hours``."""
    recent = _since(detections, as_of - F.expr(f"INTERVAL {hours} HOURS"))
    hour = F.date_trunc("hour", "timestamp")
    return (recent.groupBy(hour.alias("bucket"))
            .agg(F.count("*").alias("total"), F.count_if(is_intrusion(F.col("prediction"))).alias("intrusions"))
            .select("bucket", F.dayofmonth("bucket").alias("day"), F.hour("bucket").alias("hour"), "total", "intrusions")
            .orderBy("bucket"))


def trend_daily_attacks(detections: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Intrusions per day and attack since ``as_of`` minus ``days``."""
    recent = _since(detections, as_of - F.expr(f"INTERVAL {days} DAYS")).where(is_intrusion(F.col("prediction")))
    return (recent.groupBy(F.to_date("timestamp").alias("date"), F.col("prediction").alias("attack"))
            .agg(F.count("*").alias("count"))
            .select(F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"),
                    "attack", "count")
            .orderBy("year", "month", "day", "attack"))


def trend_daily_pivot(detections: DataFrame, as_of: Column, attacks: list[str], days: int = 7) -> DataFrame:
    """Day by attack matrix; a missing attack is "Unknown", an empty cell 0."""
    recent = _since(detections, as_of - F.expr(f"INTERVAL {days} DAYS")).where(is_intrusion(F.col("prediction")))
    name = F.coalesce("prediction", F.lit("Unknown"))
    return (recent.select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), name.alias("attack"))
            .groupBy("day").pivot("attack", attacks).count().fillna(0).orderBy("day"))


def report_distributions(detections: DataFrame) -> DataFrame:
    """Attack and severity distributions and the grand totals from one scan.

    ``section`` is attack, severity or total; the sections without a label leave null values out.
    """
    flagged = detections.withColumn("_hit", is_intrusion(F.col("prediction")).cast("bigint"))
    sets = flagged.groupingSets(
        [[F.col("prediction")], [F.col("severity")], []], F.col("prediction"), F.col("severity"),
    ).agg(F.grouping_id().alias("_g"), F.count("*").alias("count"), F.sum("_hit").alias("intrusions"))
    section = F.when(F.col("_g") == 1, "attack").when(F.col("_g") == 2, "severity").otherwise("total")
    label = F.when(F.col("_g") == 1, F.col("prediction")).when(F.col("_g") == 2, F.col("severity")).otherwise("all")
    return sets.select(section.alias("section"), label.alias("label"), "count",
                       F.coalesce("intrusions", F.lit(0)).alias("intrusions")).where("label IS NOT NULL")


def report_summary(detections: DataFrame) -> DataFrame:
    """Report totals: normal traffic is the rest after intrusions."""
    return detections.agg(
        F.count("*").alias("total_traffic"),
        F.count_if(is_intrusion(F.col("prediction"))).alias("total_intrusions"),
    ).select("total_traffic", "total_intrusions",
             (F.col("total_traffic") - F.col("total_intrusions")).alias("normal_traffic"),
             _rate(F.col("total_intrusions"), F.col("total_traffic")).alias("detection_rate"))


def batch_summary(scored: DataFrame) -> DataFrame:
    """Totals, attack counts of intrusions and severity counts of a scored batch, as (section, label, count)."""
    attack = F.when(F.col("is_intrusion"), F.coalesce("prediction", F.lit("Unknown")))
    counted = scored.groupBy(attack.alias("attack"), "severity", "is_intrusion").agg(F.count("*").alias("n"))
    parts = counted.select("n", F.explode(F.array(
        F.struct(F.lit("records").alias("section"), F.lit("total").alias("label")),
        F.struct(F.lit("records").alias("section"),
                 F.when(F.col("is_intrusion"), "intrusion").otherwise("normal").alias("label")),
        F.struct(F.lit("attack").alias("section"), F.col("attack").alias("label")),
        F.struct(F.lit("severity").alias("section"), F.col("severity").alias("label")),
    )).alias("p")).select("p.*", "n")
    return parts.where("label IS NOT NULL").groupBy("section", "label").agg(F.sum("n").alias("count"))


def session_counters(flows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Packets, flows, verdict and alert counts of a capture, one row; each input is read once."""
    none = F.lit(None)
    rows = flows.select(F.col("total_pkts").cast("bigint").alias("packets"), none.cast("boolean").alias("hit"),
                        none.cast("boolean").alias("alert")).unionByName(
        verdicts.select(none.cast("bigint").alias("packets"), F.col("is_intrusion").alias("hit"), F.col("should_alert").alias("alert")))
    return rows.agg(
        F.sum("packets").alias("packets_captured"), F.count("packets").alias("flows_generated"),
        F.count("hit").alias("flows_analyzed"), F.count_if(~F.col("hit")).alias("normal_traffic"),
        F.count_if("hit").alias("intrusions"), F.count_if("alert").alias("alerts"))


def system_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table; of alerts only the active ones."""
    counts = [
        (df.where("status = 'ACTIVE'") if name == "alerts" else df)
        .agg(F.count("*").alias("count")).select(F.lit(name).alias("name"), "count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
