"""Files in, files out, frames, models."""

import struct
from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from flowtide.operators import prep
from flowtide.plans import training
from flowtide.plans.scoring import evaluate_saved_model, score_batch
from flowtide.sources import tables
from flowtide.sources.flow_csv import detect_encoding, read_flow_csv, read_head
from flowtide.sources.models import load_model, save_model
from flowtide.sources.packets import decode_frames


def test_flow_csv(spark, tmp_path):
    path = tmp_path / "flows.csv"
    path.write_text(" Flow Duration,Fwd Header Length,Fwd Header Length, Label\n1,2,3,BENIGN\ninf,NA,,DoS Hulk\n")
    df = read_flow_csv(spark, str(path))
    assert df.columns == ["Flow Duration", "Fwd Header Length", "Fwd Header Length.1", "Label"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3", "BENIGN"), ("inf", None, None, "DoS Hulk")]
    assert [r[0] for r in read_head(df, 1).collect()] == ["1"]
    latin = tmp_path / "latin.csv"
    latin.write_bytes("Label\nWeb Attack é XSS\n".encode("latin-1"))
    assert detect_encoding(spark, str(path)) == "utf-8" and detect_encoding(spark, str(latin)) == "latin-1"
    assert read_flow_csv(spark, str(latin), "latin-1").first()[0] == "Web Attack é XSS"


def frame(ip, payload=b"", kind=0x0800):
    return b"\0" * 12 + struct.pack(">H", kind) + ip + payload


def v4(proto, body, src=(10, 0, 0, 1), dst=(10, 0, 0, 2), frag=0):
    return struct.pack(">BBHHHBBH4B4B", 0x45, 0, 20 + len(body), 1, frag, 64, proto, 0, *src, *dst) + body


def test_decode_frames(spark):
    tcp = struct.pack(">HHIIBBHHH", 49152, 443, 0, 0, 0x60, 0x12, 65535, 0, 0) + b"\0" * 4 + b"hello"
    udp = struct.pack(">HHHH", 5353, 53, 12, 0) + b"abcd"
    v6 = struct.pack(">IHBB", 0x60000000, 12, 17, 64) + bytes.fromhex("20010db8000000000000000000000001") + bytes.fromhex(
        "ff0200000000000000000000000000fb") + udp
    frames = [frame(v4(6, tcp)), frame(v4(17, udp)), frame(v4(1, b"\0" * 8)), frame(v6, kind=0x86DD), frame(b"\0" * 28, kind=0x0806),
              frame(v4(17, udp, frag=5))]
    df = spark.createDataFrame([(bytearray(f), i) for i, f in enumerate(frames)], "frame binary, ts int")
    got = {r.ts: r for r in decode_frames(df).collect()}
    assert set(got) == {0, 1, 2, 3, 5}
    t = got[0]
    assert (t.src_ip, t.dst_ip, t.src_port, t.dst_port, t.protocol, t.tcp_flags, t.header_len, t.win_size, t.payload_len) == (
        "10.0.0.1", "10.0.0.2", 49152, 443, "TCP", 0x12, 44, 65535, 5)
    assert (got[1].protocol, got[1].header_len, got[1].payload_len, got[1].dst_port) == ("UDP", 28, 4, 53)
    assert (got[2].protocol, got[2].src_port, got[2].header_len) == ("ICMP", 0, 28)
    assert (got[3].src_ip, got[3].dst_ip, got[3].protocol, got[3].payload_len) == ("2001:db8::1", "ff02::fb", "UDP", 4)
    assert (got[5].protocol, got[5].src_port) == ("IP", 0)


def test_decode_tags_and_extension_headers(spark):
    udp = struct.pack(">HHHH", 5353, 53, 12, 0) + b"abcd"
    tag = lambda kind, *rest: frame(b"".join(struct.pack(">HH", 5, k) for k in rest) + v4(17, udp), kind=kind)

    def six(first, chain, body, src="0" * 31 + "1", dst="fe80" + "0" * 24 + "00ab"):
        payload = chain + body
        return frame(struct.pack(">IHBB", 0x60000000, len(payload), first, 64) + bytes.fromhex(src) + bytes.fromhex(dst) + payload, kind=0x86DD)

    hop, auth = bytes([51, 1]) + b"\0" * 14, bytes([17, 4]) + b"\0" * 22
    fragment = lambda nxt, offset: bytes([nxt, 0]) + struct.pack(">HI", offset << 3 | 1, 7)
    frames = [tag(0x8100, 0x0800), tag(0x88A8, 0x8100, 0x9100, 0x0800), tag(0x8100, 0x0806), six(0, hop + auth, udp), six(44, fragment(17, 0), udp),
              six(44, fragment(17, 3), udp), six(60, b"", b"\x11"), six(58, b"", b"\0" * 8, src="0" * 32), frame(b"", kind=0x8100), b"\0" * 9]
    df = spark.createDataFrame([(bytearray(f), i) for i, f in enumerate(frames)], "frame binary, ts int")
    got = {r.ts: r for r in decode_frames(df).collect()}
    assert set(got) == {0, 1, 3, 4, 5, 6, 7}
    for i in (0, 1):
        assert (got[i].src_ip, got[i].protocol, got[i].src_port, got[i].header_len, got[i].payload_len) == ("10.0.0.1", "UDP", 5353, 28, 4)
    assert (got[3].src_ip, got[3].dst_ip, got[3].protocol, got[3].dst_port, got[3].header_len, got[3].payload_len) == ("::1", "fe80::ab", "UDP", 53, 88, 4)
    assert (got[4].protocol, got[4].header_len, got[4].payload_len) == ("UDP", 56, 4)
    assert (got[5].protocol, got[5].src_port) == ("IP", 0) and got[6].protocol == "IP"
    assert (got[7].protocol, got[7].src_ip) == ("IP", "::")


def test_tables_and_reports(spark, tmp_path):
    det = spark.createDataFrame(
        [(1, "a", "b", "BENIGN", "LOW", 0.9, datetime(2024, 1, 1)), (2, "a", "c", "DoS", "HIGH", 0.8, datetime(2024, 1, 2))],
        "id bigint, source_ip string, destination_ip string, prediction string, severity string, confidence double, timestamp timestamp")
    path = str(tmp_path / "det")
    assert tables.write_detections(det, path) == 2
    assert tables.write_detections(det.drop("timestamp"), path) == 2
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.where("status = 'NEW'").count() == 4
    audit = spark.createDataFrame([(None, "LOGIN", "u1")], "timestamp timestamp, event string, username string")
    tables.append_audit(audit, str(tmp_path / "audit"))
    tables.append_audit(audit, str(tmp_path / "audit"))
    rows = spark.read.parquet(str(tmp_path / "audit")).collect()
    assert len(rows) == 2 and rows[0].details == {} and rows[0].timestamp is not None
    alerts = det.where("id = 2").withColumn("status", F.lit("ACTIVE"))
    models = spark.createDataFrame([("v1", "ACTIVE")], "version string, status string")
    tables.report_csv(det, alerts, models, str(tmp_path / "csv"))
    got = {(r.section, r.key): r.value for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    assert got[("summary", "total_traffic")] == "2" and got[("summary", "active_model")] == "v1"
    assert got[("attack", "DoS")] == "1" and got[("alerts", "HIGH")] == "1"
    tables.report_json(det, alerts, models, str(tmp_path / "json"))
    document = spark.read.json(str(tmp_path / "json")).collect()
    assert len(document) == 1 and {r.key: r.value for r in document[0].attack} == {"BENIGN": "1", "DoS": "1"}
    tables.export_batch_results(det.withColumn("is_intrusion", F.col("prediction") != "BENIGN"), str(tmp_path / "exp"), "id")
    assert spark.read.option("header", True).csv(str(tmp_path / "exp")).columns == [
        "row_index", "prediction", "is_intrusion", "confidence", "severity"]


@pytest.fixture(scope="module")
def raw(spark):
    """Three classes that two of the twelve features separate."""
    from flowtide.schema import FEATURE_NAMES
    i, cls = F.col("id"), F.col("id") % 3
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100)) / 100
    return spark.range(240).select(
        "id", *[(noise(k) + (cls * 2 if k < 2 else F.lit(0))).cast("string").alias(n) for k, n in enumerate(FEATURE_NAMES[:12])],
        F.when(cls == 0, "BENIGN").when(cls == 1, "DoS Hulk").otherwise("PortScan").alias(" Label")).where(i >= 0)


SMALL = {"random_forest": dict(numTrees=5, maxDepth=4), "decision_tree": dict(maxDepth=4),
         "logistic_regression": dict(maxIter=8), "svm": dict(maxIter=4, dimensions=32)}


def test_train_save_load_score(spark, raw, tmp_path):
    model, record = training.train_model(raw, "random_forest", row_id="id", params=SMALL["random_forest"])
    r = record.first()
    assert r.metrics["accuracy"] > 0.9 and r.metrics["roc_auc"] > 0.9
    assert (r.training_samples, r.test_samples, r.feature_count, r.classes) == (192, 48, 12, ["BENIGN", "DoS", "PortScan"])
    assert r.feature_importance[0].importance >= r.feature_importance[-1].importance
    save_model(model, str(tmp_path / "m"), record)
    again = load_model(spark, str(tmp_path / "m"))
    a = score_batch(raw, model, ("id",)).orderBy("id").collect()
    b = score_batch(raw, again, ("id",)).orderBy("id").collect()
    assert a == b and len(a) == 240
    assert a[0].status in ("Intrusion Detected", "Normal Traffic")
    assert a[0].confidence == pytest.approx(max(a[0].probabilities.values()))
    assert evaluate_saved_model(spark, str(tmp_path / "m"), raw).first().accuracy > 0.9
    assert score_batch(raw.drop("Flow Duration").limit(3), again).count() == 3


def test_compare_models(spark, raw):
    got = {r.model_type: r for r in training.compare_models(raw, row_id="id", params=SMALL).collect()}
    assert set(got) == set(training.MODEL_TYPES)
    for r in got.values():
        assert r.status == "success", (r.model_type, [x[:300] for x in (r.error or "").splitlines() if "Caused" in x or "Exception" in x])
        assert r.accuracy > 0.6, r
    bad = training.compare_models(raw, row_id="id", params={"decision_tree": dict(maxDepth=-1)}, types=["decision_tree"]).first()
    assert bad.status == "failed" and bad.error
    with pytest.raises(ValueError, match="Unknown model type"):
        training.train_model(raw, "magic")
    with pytest.raises(ValueError, match="too small"):
        training.train_model(raw.limit(60), row_id="id")


@pytest.mark.parametrize("classes", [2, 3])
def test_models_train_in_a_session_that_observed(spark, raw, classes):
    """Once a DataFrame was observed, Spark cannot serialize the session, which summaries of fitted models hold."""
    seen = Observation()
    assert spark.range(7).observe(seen, F.count("*").alias("n")).count() == 7 and seen.get["n"] == 7
    rows = raw if classes == 3 else raw.where("trim(` Label`) <> 'PortScan'")
    got = training.compare_models(rows, row_id="id", params=SMALL).collect()
    assert {r.model_type: (r.status, r.accuracy > 0.6 if r.accuracy else r.error[:200]) for r in got} == {
        t: ("success", True) for t in training.MODEL_TYPES}


def test_svm_projection_is_deterministic(raw):
    rows, features = prep.prepare_raw(raw, ("id",))
    stats = prep.fit_stats(rows, features)
    assert stats == prep.fit_stats(rows.repartition(3), features) or stats.names == tuple(features)


def test_flow_csv_matches_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,Label\n1,2,BENIGN\n")
    (tmp_path / "b.csv").write_text("Label,y,z\nDoS,4,5\n")
    rows = read_flow_csv(spark, str(tmp_path)).orderBy("Label").select("x", "y", "z", "Label").collect()
    assert [tuple(r) for r in rows] == [("1", "2", None, "BENIGN"), (None, "4", "5", "DoS")]


def test_flow_csv_finds_the_encoding(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("Lab\u00e9l\nWeb Attack \u00e9\n".encode("latin-1"))
    assert read_flow_csv(spark, str(tmp_path)).first().asDict() == {"Lab\u00e9l": "Web Attack \u00e9"}


def test_trends_read_the_days_they_need(spark, tmp_path):
    """The scan of a table of ``write_detections`` is cut by its date directories; the rows are those without it."""
    from flowtide.operators import aggregates as agg

    rows = [(datetime(2024, 1, d, h), "DoS" if h % 2 else "BENIGN") for d in range(1, 26) for h in (0, 5, 13, 23)]
    det = spark.createDataFrame(rows, "timestamp timestamp, prediction string")
    path = str(tmp_path / "d")
    tables.write_detections(det, path)
    stored, now = spark.read.parquet(path), F.lit(datetime(2024, 1, 25, 12))
    for trend in (agg.trend_hourly, agg.trend_daily_attacks, lambda d, t: agg.trend_daily_pivot(d, t, ["DoS"])):
        got = trend(stored, now)
        assert got.collect() == trend(det, now).collect() and got.count()
        scan = next(line for line in got._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line)
        assert "date" in scan.split("PartitionFilters: [")[1].split("]")[0]
