"""Keyed state on streams against the batch operators: probes, bursts, alerts, late rows, the whole detection."""

import random

import pytest
from pyspark.sql import functions as F

from flowtide.config import SECOND, FlowConfig, PolicyConfig
from flowtide.operators.alerts import upsert_alerts
from flowtide.operators.policy import alert_dedup, portscan_probe_count
from flowtide.streaming.verdicts import current_alerts, stream_alert_changes, stream_alert_dedup, stream_probe_count

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERDICT = "id bigint, source_ip string, destination_ip string, destination_port int, prediction string, severity string, confidence double, at bigint"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def frame(spark, rows):
    return spark.createDataFrame(rows, VERDICT).withColumn("timestamp", F.timestamp_micros("at")).drop("at")


def files(spark, folder, parts):
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, df, name, tmp_path):
    q = (df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def random_rows(seed, n, step, mixed=0):
    rng, now, out = random.Random(seed), 1_700_000_000 * SECOND, []
    for i in range(n):
        now += rng.choice([0, step // 10, step, 3 * step])
        out.append((i, rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.randrange(6), rng.choice(["DoS", "PortScan", None]),
                    rng.choice(["LOW", "HIGH"]), round(rng.random(), 3), now + (rng.randrange(-mixed, mixed) if mixed else 0)))
    return out


END = [(10**6, "end", "x", 1, "end", "LOW", 0.5, 1_800_000_000 * SECOND)]


def test_probe_count_equals_batch_row_by_row(spark, tmp_path):
    rows = random_rows(1, 120, 8 * SECOND, mixed=4 * SECOND)
    parts = [rows[i:i + 40] for i in range(0, 120, 40)]
    got = drain(spark, stream_probe_count(files(spark, str(tmp_path / "in"), [*parts, END]), 30 * SECOND), "probes", tmp_path)
    want = portscan_probe_count(frame(spark, rows), 30 * SECOND)
    pairs = lambda df: sorted((r.id, r.distinct_targets) for r in df.where("id < 1000000").collect())
    assert pairs(got) == pairs(want) and max(n for _, n in pairs(want)) > 4


def test_probe_window_is_inclusive_and_waits(spark, tmp_path):
    t = 1_700_000_000 * SECOND
    rows = [(i, "a", "x", port, "PortScan", "LOW", 0.9, t + at) for i, (port, at) in enumerate(
        [(1, 0), (2, 30 * SECOND), (3, 60 * SECOND + 1), (3, 60 * SECOND + 1)])]
    got = drain(spark, stream_probe_count(files(spark, str(tmp_path / "in"), [rows[2:], rows[:2], END]), 30 * SECOND, "2 minutes"), "w", tmp_path)
    # The second file is older than the first and inside the delay: counted as if it had come first.
    assert sorted((r.id, r.distinct_targets) for r in got.where("id < 10").collect()) == [(0, 1), (1, 2), (2, 1), (3, 1)]


def test_bursts_are_flagged_at_once(spark, tmp_path):
    rows = random_rows(2, 120, 25 * SECOND)
    parts = [rows[i:i + 40] for i in range(0, 120, 40)]
    got = drain(spark, stream_alert_dedup(files(spark, str(tmp_path / "in"), parts), 60 * SECOND), "bursts", tmp_path)
    want = alert_dedup(frame(spark, rows), 60 * SECOND)
    pairs = lambda df: sorted((r.id, r.is_duplicate) for r in df.collect())
    # No closing row: nothing waits for a watermark.
    assert pairs(got) == pairs(want) and {d for _, d in pairs(want)} == {True, False}


ALERT = ["id", "source_ip", "destination_ip", "attack_type", "severity", "confidence", "status", "occurrences", "timestamp", "last_seen"]


def test_alert_changes_equal_upserts_batch_by_batch_and_after_a_restart(spark, tmp_path):
    rows, folder = random_rows(3, 60, 20 * SECOND), str(tmp_path / "in")
    parts, table = [rows[i:i + 20] for i in range(0, 60, 20)], None
    for part in parts:
        source = files(spark, folder, [part]).withColumnRenamed("prediction", "attack_type")
        # Every part is a query of its own, started from the checkpoint of the one before.
        changes = drain(spark, stream_alert_changes(source), "alerts", tmp_path)
        new = frame(spark, part).withColumnRenamed("prediction", "attack_type").select("id", "source_ip", "destination_ip", "attack_type", "severity", "confidence", "timestamp")
        if table is None:
            table = new.limit(0).withColumns({"status": F.lit("ACTIVE"), "occurrences": F.lit(1).cast("bigint"), "last_seen": F.col("timestamp")})
        table = spark.createDataFrame(upsert_alerts(table, new).select(ALERT).collect(), table.select(ALERT).schema)
        have = sorted((tuple(r) for r in current_alerts(changes).select(ALERT).collect()), key=repr)
        want = sorted((tuple(r) for r in table.collect()), key=repr)
        assert [r[:8] for r in have] == [r[:8] for r in want]
        assert [r[8:] for r in have] == [r[8:] for r in want]
    assert changes.count() > len(want) and changes.groupBy("id", "change").count().where("count > 1").isEmpty()


def test_a_close_ends_an_alert(spark, tmp_path):
    t = 1_700_000_000 * SECOND
    one = lambda i, at, status=None: (i, "a", "x", "DoS", "HIGH", 0.9, status, t + at)
    schema, folder = "id bigint, source_ip string, destination_ip string, attack_type string, severity string, confidence double, status string, at bigint", str(tmp_path / "in")
    for part in ([one(1, 0), one(2, 5)], [one(0, 9, "RESOLVED")], [one(3, 20)]):
        spark.createDataFrame(part, schema).withColumn("timestamp", F.timestamp_micros("at")).drop("at").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = current_alerts(drain(spark, stream_alert_changes(source), "closed", tmp_path))
    assert sorted((r.id, r.status, r.occurrences) for r in got.collect()) == [(1, "RESOLVED", 2), (3, "ACTIVE", 1)]


def test_late_rows_are_counted_over_a_restart(spark, tmp_path):
    from flowtide.streaming.flows import late_rows, stream_late_rows

    t, folder = 1_700_000_000, str(tmp_path / "in")

    def add(*seconds):
        spark.createDataFrame([((t + s) * SECOND if s is not None else None,) for s in seconds], "us bigint").select(
            F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(folder)

    def run():
        source = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
        stream_late_rows(source, "ts", 10 * SECOND, str(tmp_path / "counts"), str(tmp_path / "state")).awaitTermination(120)
        q = (source.withWatermark("ts", "10 seconds").groupBy(F.window("ts", "1 second")).count().writeStream.format("noop").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start())
        q.awaitTermination(120)

    add(0, 5, None)
    add(100, 60, -50)
    add(90, 89, 91, 300, None)
    run()
    add(95, 289, 290, 291)
    run()
    got = sorted((r.batch_id, r.rows, r.late) for r in late_rows(spark, str(tmp_path / "counts")).collect())
    # The mark of a batch comes from the batches before: -10, 90, 290.
    assert got == [(0, 3, 0), (1, 3, 1), (2, 5, 2), (3, 4, 3)]


def test_intake_is_bounded_and_loses_nothing(spark, tmp_path):
    from flowtide.schema import PACKET_SCHEMA
    from flowtide.sources.packets import packet_source

    cast = [f"CAST(id AS {f.dataType.simpleString()}) AS {f.name}" if f.name != "ts" else "timestamp_micros(id) AS ts" for f in PACKET_SCHEMA]
    for k in range(7):
        spark.range(10 * k, 10 * k + 10).selectExpr(*cast).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sizes = {}
    q = (packet_source(spark, str(tmp_path / "in"), files_per_trigger=2).writeStream.option("checkpointLocation", str(tmp_path / "state"))
         .trigger(availableNow=True).foreachBatch(lambda b, i: sizes.update({i: sorted(r.seq for r in b.collect())})).start())
    q.awaitTermination(120)
    assert [len(sizes[i]) for i in sorted(sizes)] == [20, 20, 20, 10]
    assert sorted(x for v in sizes.values() for x in v) == list(range(70))


def test_detection_on_a_stream_equals_the_batch(spark, tmp_path):
    from flowtide.checks.mapping import frame as table
    from flowtide.checks.model_queries import flow_model
    from flowtide.checks.stream_queries import _timed
    from flowtide.config import HOUR
    from flowtide.plans.detect import detect, score_stream

    flow = FlowConfig(idle_us=6 * HOUR, active_us=24 * HOUR, activity_us=2 * HOUR)
    policy = PolicyConfig(probe_window_us=72 * HOUR, dedup_window_us=48 * HOUR, min_probes=2, confidence_threshold=0.5, dos_min_packets=1)
    packets = _timed(table(spark, "/root/testdata/sf0.001", "packets"), "ts")
    model = flow_model(spark, packets)
    folder = str(tmp_path / "in")
    for k in range(3):
        packets.where(F.floor(F.unix_micros("ts") / 1e6 / 86400 / 10) % 3 == k).coalesce(1).write.mode("append").parquet(folder)
    # One file a batch; the delay is as long as the table, so that nothing is late and a closing packet lets all out.
    span = packets.agg(F.max("ts").alias("high"), F.min("ts").alias("low")).first()
    days = (span.high - span.low).days + 2
    last = packets.orderBy(F.desc("ts")).limit(1).selectExpr(
        "* except (ts, seq, protocol)", f"ts + make_interval(0, 0, 0, {2 * days}) AS ts", "-1L AS seq", "'END' AS protocol").select(packets.columns)
    last.coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drain(spark, score_stream(source, model, flow, policy, f"{days} days"), "detect", tmp_path).where("protocol <> 'END'")
    want = detect(packets, model, flow, policy)
    columns = ["source_ip", "source_port", "destination_ip", "destination_port", "protocol", "timestamp", "total_pkts", "raw_prediction", "prediction",
               "is_intrusion", "confidence", "severity", "should_alert", "is_duplicate", "distinct_targets", "validation_note"]
    both = [sorted((tuple(r) for r in df.select(columns).collect()), key=repr) for df in (got, want)]
    assert both[0] == both[1] and len(both[1]) > 50
    assert {r[11] for r in both[1]} and {r[12] for r in both[1]} == {True, False}
