"""Alert table maintained from a stream of alert candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.streaming.verdicts import stream_alert_changes


def stream_alert_upsert(candidates: DataFrame, table_path: str, checkpoint: str, trigger: dict | None = None):
    """Appends the changes of alerts to a Parquet table; ``current_alerts`` over it is the alert table.

    The open alerts are the stream's state, so nothing is read back or rewritten, and the file sink commits a batch once.
    """
    return (stream_alert_changes(candidates).writeStream.format("parquet").option("path", table_path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).outputMode("append").start())


def stream_detections(verdicts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Appends verdict rows to the detection table, one directory per date."""
    dated = verdicts.withColumns({"status": F.lit("NEW"), "date": F.to_date("timestamp")})
    return (dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("date").trigger(**(trigger or {"availableNow": True})).outputMode("append").start())
