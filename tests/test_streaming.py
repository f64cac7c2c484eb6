"""Streams against the batch operators on the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from flowtide.config import SECOND, FlowConfig
from flowtide.operators.features import flow_features
from flowtide.operators.flows import flow_idle_sessions
from flowtide.schema import FEATURE_COLUMNS, PACKET_SCHEMA
from flowtide.sources.packets import packet_source
from flowtide.streaming.alerts import stream_alert_upsert
from flowtide.streaming.verdicts import current_alerts
from flowtide.streaming.flows import flush_marker, late_packets, stream_flows
from flowtide.streaming.windows import stream_dedup, stream_flow_sessions, stream_portscan, stream_trend

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


@pytest.fixture(scope="module")
def packet_files(spark, tmp_path_factory):
    rng = random.Random(5)
    rows, now = [], 1_700_000_000 * SECOND
    for i in range(400):
        now += rng.choice([1000, 300_000, 900_000, 1_500_000, 2_000_000, 6_000_000 if i % 7 == 0 else 10])
        c, s = ("10.0.0.9", 5000 + rng.randrange(3)), ("10.0.0.2", 80)
        a, b = (c, s) if rng.random() < 0.6 else (s, c)
        rows.append((a[0], b[0], a[1], b[1], "tcp", rng.randrange(40, 1500), now, rng.choice([0] * 20 + [1, 2, 24]),
                     rng.choice([0, 20, 32]), rng.choice([0, 512]), rng.choice([0, 9]), i))
    names = [f.name for f in PACKET_SCHEMA]
    types = ", ".join(f"{n} {'bigint' if n in ('ts', 'seq') else 'string' if 'ip' in n or n == 'protocol' else 'int'}" for n in names)
    folder = str(tmp_path_factory.mktemp("packets"))
    for part in range(4):
        df = spark.createDataFrame(rows[part * 100:(part + 1) * 100], types).withColumn("ts", F.timestamp_micros("ts"))
        df.coalesce(1).write.mode("append").parquet(folder)
    real = spark.createDataFrame(rows, types).withColumn("ts", F.timestamp_micros("ts"))
    marker = flush_marker(now)
    spark.createDataFrame([tuple(marker[n] for n in names)], PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder, real


def drain(spark, df, name, tmp_path):
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    q.awaitTermination(240)
    assert q.exception() is None
    return q, spark.table(name)


def test_stream_flows_equal_batch(spark, packet_files, tmp_path):
    folder, real = packet_files
    q, got = drain(spark, stream_flows(packet_source(spark, folder, files_per_trigger=1), "10 seconds"), "s_flows", tmp_path)
    assert late_packets(q) == 0
    key = lambda r: (r.k_ip_lo, r.k_port_lo, r.k_port_hi, r.flow_start_us)
    want = {key(r): r for r in flow_features(real).collect()}
    have = {key(r): r for r in got.where("protocol <> 'FLUSH'").collect()}
    assert set(want) == set(have)
    for k, w in want.items():
        for c in [*FEATURE_COLUMNS, "total_pkts", "src_ip", "src_port", "flow_end_us"]:
            assert have[k][c] == (w[c] if isinstance(w[c], str) else pytest.approx(w[c], rel=1e-9, abs=1e-3)), (k, c)


def test_stream_sessions_equal_batch(spark, packet_files, tmp_path):
    folder, real = packet_files
    _, got = drain(spark, stream_flow_sessions(packet_source(spark, folder, files_per_trigger=1)), "s_sessions", tmp_path)
    cols = ["k_port_lo", "k_port_hi", "start_us", "end_us", "total_pkts", "total_bytes"]
    want = sorted(map(tuple, flow_idle_sessions(real, 5 * SECOND).select(cols).collect()))
    got = got.where("k_proto <> 'FLUSH'").withColumns({"start_us": F.unix_micros("start_ts"), "end_us": F.unix_micros("end_ts")})
    assert sorted(map(tuple, got.select(cols).collect())) == want


DETECTION = ("id bigint, source_ip string, destination_ip string, destination_port int, prediction string, severity string, "
             "confidence double, is_intrusion boolean, timestamp timestamp")


def detections(spark, folder, rows):
    """Each inner list is one file, in order."""
    for part in rows:
        spark.createDataFrame(part, DETECTION.replace("timestamp timestamp", "at double")).withColumn(
            "timestamp", F.timestamp_micros((F.col("at") * 1e6).cast("bigint"))).drop("at").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(DETECTION).option("maxFilesPerTrigger", 1).parquet(folder)


def row(i, at, port=80, attack="PortScan", src="10.0.0.99", conf=0.9):
    return (i, src, "192.168.31.1", port, attack, "HIGH", conf, attack != "BENIGN", float(at))


END = [row(999, 900_000, src="end", attack="BENIGN"), row(998, 900_000, src="end"), row(997, 900_000, src="end")]


def test_portscan_dedup_trend_and_late_rows(spark, tmp_path):
    rows = [[row(i, 100 + i, port=p) for i, p in enumerate([22, 21, 23, 80, 80])],
            [row(9, 106, port=8080), row(10, 190, port=443)], [row(11, 4000, attack="BENIGN", src="x")],
            [row(13, 4001, attack="BENIGN", src="x")], [row(12, 5, src="late")], END]
    source = detections(spark, str(tmp_path / "d"), rows)
    q, scans = drain(spark, stream_portscan(source), "s_scan", tmp_path)
    assert {r.source_ip for r in scans.collect()} == {"10.0.0.99"}
    assert max(r.distinct_targets for r in scans.collect()) == 5
    assert late_packets(q) >= 1
    _, bursts = drain(spark, stream_dedup(source), "s_dedup", tmp_path)
    got = sorted((r.source_ip, r.occurrences) for r in bursts.where("source_ip = '10.0.0.99'").collect())
    assert got == [("10.0.0.99", 1), ("10.0.0.99", 6)]
    _, trend = drain(spark, stream_trend(source, watermark="10 seconds"), "s_trend", tmp_path)
    assert sorted((r.total, r.intrusions) for r in trend.collect()) == [(2, 0), (7, 7)]


def test_upsert_is_idempotent(spark, tmp_path):
    rows = [[row(1, 10, conf=0.8), row(2, 20, conf=0.9)], [row(3, 500_000, conf=0.7), row(4, 30, src="b")]]
    source = detections(spark, str(tmp_path / "d"), rows).withColumnRenamed("prediction", "attack_type")
    q = stream_alert_upsert(source, str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(240)
    changes = spark.read.parquet(str(tmp_path / "t"))
    got = {r.source_ip: r for r in current_alerts(changes).collect()}
    assert (got["10.0.0.99"].occurrences, got["10.0.0.99"].confidence, got["10.0.0.99"].status) == (3, 0.9, "ACTIVE")
    assert got["b"].occurrences == 1 and len(got) == 2
    assert sorted(r.change for r in changes.collect()) == [1, 1, 2] and current_alerts(changes.where("change = 1")).count() == 2
    # A second run from the same checkpoint finds nothing new and appends nothing.
    stream_alert_upsert(source, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
