"""Streams over the driver's tables, run to the end of the input into a parquet sink.

One batch reads the whole table, the closing batch moves the watermark to the newest row minus the
delay; groups that end by then are in the result.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from flowtide.checks import flow_queries as fq
from flowtide.checks.mapping import FLOW, MAPPINGS, frame
from flowtide.checks.policy_queries import CFG
from flowtide.checks.registry import QUERIES, ORACLES
from flowtide.checks.mapping import with_ctes
from flowtide.config import DAY, HOUR
from flowtide.session import ensure_checkpoint_dir
from flowtide.streaming import flows as sf
from flowtide.streaming import verdicts as sv
from flowtide.streaming import windows as sw
from flowtide.sources.packets import packet_source

_DELAY = HOUR
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark, sf_dir, name, time_column):
    text = MAPPINGS[name].replace("varchar(40)", "string").replace("varchar(20)", "string").replace("varchar(9)", "string")
    tables = {}
    for t in re.findall(r"\{(\w+)\}", text):
        path = f"{sf_dir}/{t}.parquet"
        # A glob, because a stream takes a table of one file only that way.
        tables[t] = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    df = spark.sql(text, **tables)
    us = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {time_column})")
    return df.withColumn(time_column, F.timestamp_micros(us))


def _drain(spark, df):
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    q = (df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _stream_query(name, frame, time_column, sql):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, _stream(spark, sf_dir, frame, time_column))
        ORACLES[name] = with_ctes(sql)
        return fn
    return register


def _mark(table: str, column: str) -> str:
    return f"(SELECT epoch_us(max({column})) // 1000 * 1000 - {_DELAY} FROM ${table})"


@_stream_query("stream_flow_sessions", "packets", "ts", f"""WITH {fq._KEYED}, m AS (
    SELECT *, CASE WHEN us - lag(us) OVER k < {FLOW.idle_us} THEN 0 ELSE 1 END AS fresh FROM pk
    WINDOW k AS (PARTITION BY k_proto, k_ip_lo, k_port_lo, k_ip_hi, k_port_hi ORDER BY us, seq)
  ), s AS (SELECT *, sum(fresh) OVER (PARTITION BY k_proto, k_ip_lo, k_port_lo, k_ip_hi, k_port_hi ORDER BY us, seq) AS sid FROM m)
  SELECT k_proto, k_ip_lo, k_ip_hi, min(us) AS start_us, max(us) AS end_us, count(*) AS total_pkts
  FROM s GROUP BY k_proto, k_ip_lo, k_port_lo, k_ip_hi, k_port_hi, sid
  HAVING max(us) + {FLOW.idle_us - 1} <= {_mark("packets", "ts")}""")
def q_stream_flow_sessions(spark, packets):
    got = _drain(spark, sw.stream_flow_sessions(packets, "1 hour", FLOW.idle_us))
    return got.select("k_proto", "k_ip_lo", "k_ip_hi", F.unix_micros("start_ts").alias("start_us"),
                      F.unix_micros("end_ts").alias("end_us"), "total_pkts")


@_stream_query("stream_flows", "packets", "ts", f"""WITH RECURSIVE {fq._ASSIGNED}, ready AS (
    SELECT *, {_mark("packets", "ts")} AS mark FROM ini
  ), f AS (
    SELECT k_proto, k_ip_lo, k_ip_hi, min(us) AS flow_start_us, max(us) FILTER (us < mark) AS flow_end_us, count(*) FILTER (us < mark) AS total_pkts,
           cast(sum(pkt_len) FILTER (fwd AND us < mark) AS double) AS total_length_of_fwd_packets,
           arg_max(tcp_flags, idx) & 5 AS closing, max(mark) AS mark, max(us) AS last_us
    FROM ready GROUP BY {fq._FLOW})
  SELECT k_proto, k_ip_lo, k_ip_hi, flow_start_us, flow_end_us, total_pkts, coalesce(total_length_of_fwd_packets, 0) AS total_length_of_fwd_packets
  FROM f WHERE (last_us < mark AND (closing <> 0 OR last_us - flow_start_us >= {FLOW.active_us})) OR last_us + {FLOW.idle_us} <= mark""")
def q_stream_flows(spark, packets):
    got = _drain(spark, sf.stream_flows(packets, "1 hour", FLOW))
    return got.select("k_proto", "k_ip_lo", "k_ip_hi", "flow_start_us", "flow_end_us", "total_pkts", "total_length_of_fwd_packets")


@_stream_query("stream_trend", "detections", "timestamp", f"""SELECT epoch_us(date_trunc('hour', timestamp)) AS bucket_us, count(*) AS total,
    count(*) FILTER (prediction IS NULL OR prediction <> 'BENIGN') AS intrusions
  FROM $detections GROUP BY 1 HAVING bucket_us + {HOUR} <= {_mark("detections", "timestamp")}""")
def q_stream_trend(spark, d):
    return _drain(spark, sw.stream_trend(d)).select(F.unix_micros("bucket").alias("bucket_us"), "total", "intrusions")


@_stream_query("stream_portscan", "detections", "timestamp", f"""WITH w AS (
    SELECT source_ip, destination_ip, destination_port, epoch_us(timestamp) // {6 * HOUR} * {6 * HOUR} - i * {6 * HOUR} AS start_us
    FROM $detections, unnest([0, 1, 2, 3]) AS t(i) WHERE prediction = 'PortScan')
  SELECT coalesce(source_ip, '?') AS source_ip, start_us, count(DISTINCT (destination_ip, destination_port)) AS distinct_targets, count(*) AS probes
  FROM w WHERE start_us + {DAY} <= (SELECT epoch_us(max(timestamp)) // 1000 * 1000 - {_DELAY} FROM $detections WHERE prediction = 'PortScan')
  GROUP BY w.source_ip, start_us HAVING distinct_targets >= 2""")
def q_stream_portscan(spark, d):
    got = _drain(spark, sw.stream_portscan(d, "1 hour", "1 day", "6 hours", 2))
    return got.select(F.coalesce("source_ip", F.lit("?")).alias("source_ip"), F.unix_micros("window_start").alias("start_us"),
                      "distinct_targets", "probes")


@_stream_query("stream_dedup", "detections", "timestamp", f"""WITH p AS (SELECT *, epoch_us(timestamp) AS us FROM $detections WHERE is_intrusion), m AS (
    SELECT *, CASE WHEN us - lag(us) OVER f < {12 * HOUR} THEN 0 ELSE 1 END AS fresh FROM p
    WINDOW f AS (PARTITION BY source_ip, destination_ip, prediction ORDER BY us, id)
  ), s AS (SELECT *, sum(fresh) OVER (PARTITION BY source_ip, destination_ip, prediction ORDER BY us, id) AS burst FROM m)
  SELECT coalesce(source_ip, '?') AS source_ip, destination_ip, coalesce(prediction, '?') AS attack_type, min(us) AS start_us, max(us) AS end_us,
         count(*) AS occurrences, max(confidence) AS confidence
  FROM s GROUP BY s.source_ip, destination_ip, s.prediction, burst
  HAVING max(us) + {12 * HOUR - 1} <= (SELECT epoch_us(max(timestamp)) // 1000 * 1000 - {_DELAY} FROM $detections WHERE is_intrusion)""")
def q_stream_dedup(spark, d):
    got = _drain(spark, sw.stream_dedup(d, "1 hour", 12 * HOUR))
    return got.select(F.coalesce("source_ip", F.lit("?")).alias("source_ip"), "destination_ip",
                      F.coalesce("attack_type", F.lit("?")).alias("attack_type"), F.unix_micros("timestamp").alias("start_us"),
                      F.unix_micros("last_seen").alias("end_us"), "occurrences", "confidence")


# Keyed state: rows come out one by one. --------------------------------------------------------------------------

_PROBE_MARK = f"(SELECT epoch_us(max(timestamp)) // 1000 * 1000 - {_DELAY} FROM $detections WHERE prediction = 'PortScan')"


@_stream_query("stream_portscan_exact", "detections", "timestamp", f"""WITH p AS (SELECT id, source_ip, epoch_us(timestamp) AS us,
    concat(destination_ip, ':', destination_port) AS target FROM $detections WHERE prediction = 'PortScan'), n AS (
  SELECT id, us, count(DISTINCT target) OVER (PARTITION BY source_ip ORDER BY us RANGE BETWEEN {CFG.probe_window_us} PRECEDING AND CURRENT ROW)
    AS distinct_targets FROM p)
  SELECT id, distinct_targets FROM n WHERE us < {_PROBE_MARK}""")
def q_stream_portscan_exact(spark, d):
    rows = d.where("prediction = 'PortScan'").select("id", "source_ip", "destination_ip", "destination_port", "timestamp")
    return _drain(spark, sv.stream_probe_count(rows, CFG.probe_window_us, "1 hour")).select("id", "distinct_targets")


@_stream_query("stream_dedup_immediate", "detections", "timestamp", f"""WITH p AS (SELECT *, epoch_us(timestamp) AS us FROM $detections WHERE is_intrusion)
  SELECT id, NOT coalesce(us - lag(us) OVER (PARTITION BY source_ip, destination_ip, prediction ORDER BY us, id) < {CFG.dedup_window_us}, false)
    AS should_alert FROM p""")
def q_stream_dedup_immediate(spark, d):
    rows = d.where("is_intrusion").select("id", "source_ip", "destination_ip", "prediction", "timestamp")
    return _drain(spark, sv.stream_alert_dedup(rows, CFG.dedup_window_us, "1 hour")).select("id", (~F.col("is_duplicate")).alias("should_alert"))


#: Batches of the queries below: quarters of the events by id, in this order.
_ORDER = (0, 2, 1, 3)


def _in_parts(spark, df, part, order):
    """``df`` written as one file a part, in this order, and read as a stream of one file a batch."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    for k in order:
        df.where(part == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return folder, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _timed(df, time_column):
    us = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {time_column})")
    return df.withColumn(time_column, F.timestamp_micros(us))


_PART = "CAST(floor({id} * 4 / (SELECT max({id}) + 1 FROM {table})) AS INT)"


def _quarter(df, column):
    top = df.agg(F.max(column)).first()[0] + 1
    return F.floor(F.col(column) * 4 / top)


_FP = "source_ip, destination_ip, attack_type"


def _stream_alert_upsert(spark, sf_dir):
    d = _timed(frame(spark, sf_dir, "detections"), "timestamp").where("is_intrusion").withColumnRenamed("prediction", "attack_type")
    rows = d.select("id", "source_ip", "destination_ip", "attack_type", "severity", "confidence", "timestamp",
                    F.when(F.col("id") % 11 == 0, "RESOLVED").alias("status"))
    folder, stream = _in_parts(spark, rows, _quarter(d, "id"), range(4))
    got = sv.current_alerts(_drain(spark, sv.stream_alert_changes(stream)))
    return got.select("id", "severity", "confidence", "status", "occurrences", F.unix_micros("timestamp").alias("first_us"),
                      F.coalesce(F.unix_micros("last_seen"), F.lit(-1)).alias("last_us"))


QUERIES["stream_alert_upsert"] = _stream_alert_upsert
ORACLES["stream_alert_upsert"] = with_ctes(f"""WITH r AS (SELECT id, source_ip, destination_ip, prediction AS attack_type, severity, confidence,
    epoch_us(timestamp) AS us, id % 11 = 0 AS closes FROM $detections WHERE is_intrusion), p AS (
  SELECT *, {_PART.format(id="id", table="r")} AS part FROM r), k AS (SELECT DISTINCT {_FP}, part FROM p WHERE closes), e AS (
  SELECT p.*, (SELECT count(*) FROM k WHERE k.source_ip IS NOT DISTINCT FROM p.source_ip AND k.destination_ip IS NOT DISTINCT FROM p.destination_ip
      AND k.attack_type IS NOT DISTINCT FROM p.attack_type AND k.part <= p.part) AS epoch,
    (SELECT count(*) FROM k WHERE k.source_ip IS NOT DISTINCT FROM p.source_ip AND k.destination_ip IS NOT DISTINCT FROM p.destination_ip
      AND k.attack_type IS NOT DISTINCT FROM p.attack_type) AS epochs FROM p WHERE NOT closes), f AS (
  SELECT *, min(part) OVER g AS first_part, count(*) OVER (PARTITION BY {_FP}, epoch, part) AS n FROM e WINDOW g AS (PARTITION BY {_FP}, epoch))
  SELECT arg_min(id, (part, us, id)) AS id, arg_min(severity, (part, us, id)) AS severity, max(confidence) AS confidence,
         CASE WHEN epoch < max(epochs) THEN 'RESOLVED' ELSE 'ACTIVE' END AS status, count(*) AS occurrences, arg_min(us, (part, us, id)) AS first_us,
         coalesce(max(us) FILTER (n > 1 OR part > first_part), -1) AS last_us
  FROM f GROUP BY {_FP}, epoch""")


def _late_packets(spark, sf_dir):
    packets = _timed(frame(spark, sf_dir, "packets"), "ts")
    folder, stream = _in_parts(spark, packets, _quarter(packets, "seq"), _ORDER)
    sf.stream_late_rows(stream, "ts", _DELAY, f"{folder}/counts", f"{folder}/state").awaitTermination()
    return sf.late_rows(spark, f"{folder}/counts").select("batch_id", "rows", "late")


QUERIES["late_packets"] = _late_packets
ORACLES["late_packets"] = with_ctes(f"""WITH p AS (SELECT epoch_us(ts) AS us, {_PART.format(id="seq", table="$packets")} AS part FROM $packets), b AS (
  SELECT us, CASE part {" ".join(f"WHEN {k} THEN {i}" for i, k in enumerate(_ORDER))} END AS batch_id FROM p), h AS (
  SELECT batch_id, count(*) AS rows, max(us) AS high FROM b GROUP BY 1), m AS (
  SELECT batch_id, rows, greatest(max(high) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - {_DELAY}, 0) AS mark FROM h)
  SELECT m.batch_id, m.rows, count(*) FILTER (us <= mark) AS late FROM m JOIN b USING (batch_id) GROUP BY 1, 2""")


def _packet_source(spark, sf_dir):
    """All packets through an intake of two files a batch; the batch of a packet is checked in the tests."""
    packets = _timed(frame(spark, sf_dir, "packets"), "ts")
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    packets.repartition(7, "seq").write.parquet(f"{folder}/in")
    got = _drain(spark, packet_source(spark, f"{folder}/in", files_per_trigger=2))
    return got.select("seq", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "pkt_len", F.unix_micros("ts").alias("us"), "tcp_flags",
                      "header_len", "win_size", "payload_len")


QUERIES["packet_source"] = _packet_source
ORACLES["packet_source"] = with_ctes("""SELECT seq, src_ip, dst_ip, src_port, dst_port, protocol, pkt_len, epoch_us(ts) AS us, tcp_flags, header_len,
  win_size, payload_len FROM $packets""")


def _score_stream(spark, sf_dir):
    """Packets to verdicts in one stream, by a model trained on the flows of the table."""
    from flowtide.checks.model_queries import flow_model
    from flowtide.plans.detect import score_stream

    model = flow_model(spark, frame(spark, sf_dir, "packets"))
    packets = _stream(spark, sf_dir, "packets", "ts")
    got = _drain(spark, score_stream(packets, model, FLOW, CFG, "1 hour"))
    return got.select("source_ip", "destination_ip", "source_port", F.unix_micros("timestamp").alias("end_us"), "total_pkts",
                      F.col("is_intrusion").isNotNull().alias("judged"))


QUERIES["score_stream"] = _score_stream
ORACLES["score_stream"] = with_ctes(f"""WITH RECURSIVE {fq._ASSIGNED}, f AS (
    SELECT arg_min(src_ip, idx) AS source_ip, arg_min(dst_ip, idx) AS destination_ip, arg_min(src_port, idx) AS source_port, max(us) AS end_us,
           count(*) AS total_pkts FROM ini GROUP BY {fq._FLOW})
  SELECT *, true AS judged FROM f WHERE end_us < {_mark("packets", "ts")} - {FLOW.idle_us}""")
