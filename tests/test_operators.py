"""Fixed cases of labels, severities, policy, alerts, metrics, preprocessing and paging."""

import random

import pytest
from pyspark.sql import functions as F

from flowtide.config import SECOND, PolicyConfig
from flowtide.functions import labels as lab
from flowtide.functions import network as net
from flowtide.operators import alerts as al
from flowtide.operators import dataset as ds
from flowtide.operators import filters as fil
from flowtide.operators import metrics as met
from flowtide.operators import paging, prep
from flowtide.operators import policy as pol
from flowtide.operators.joins import active_alert_match, label_lookup
from flowtide.operators.scan import ordered_scan
from flowtide.schema import FEATURE_NAMES


def test_labels(spark):
    cases = {"DoS Hulk": "DoS", " ddos ": "DDoS", "DDoS attacks-LOIC-HTTP": "DoS", "Botnet": "Bot",
             "SSH-Patator": "Brute Force", "Web Attack – XSS": "Web Attack", "abnormal": "BENIGN", "": "BENIGN",
             "Infilteration": "Unknown", None: "Unknown", "Heartbleed": "DoS", "PORT SCAN": "PortScan"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    for r in df.withColumn("got", lab.normalize_label(F.col("raw"))).collect():
        assert r.got == r.want, r.raw
    assert {(r.raw, r.category) for r in label_lookup(df, "raw").collect()} == set(cases.items())


def test_severity(spark):
    cases = [("DDoS", 0.9, "CRITICAL"), ("DDoS", 0.5, "MEDIUM"), ("DoS", 0.55, "HIGH"), ("PortScan", 0.54, "LOW"),
             ("BENIGN", 0.1, "LOW"), ("Unknown", 0.9, "MEDIUM"), ("Other", 0.9, "MEDIUM"), (None, 0.9, "MEDIUM")]
    df = spark.createDataFrame(cases, "a string, c double, want string")
    assert df.where(lab.assign_severity(F.col("a"), F.col("c")) != F.col("want")).count() == 0


def test_infrastructure(spark):
    cases = [("8.8.8.8", 53100, 53, True), ("224.0.0.251", 1, 2, True), ("239.255.255.250", 1, 1900, True),
             ("192.168.1.255", 1, 2, True), ("ff02::fb", 1, 2, True), ("FF05::1:3", 1, 2, True), ("ff::1", 1, 2, False),
             ("239.bad", 1, 2, True), ("bad.255", 1, 2, False), ("1.2.3.4", 123, 2, True), ("1.2.3.4", 1, 2, False),
             ("300.1.1.255", 1, 2, False), ("240.0.0.1", 1, 2, False), ("2001:db8::1", 1, 2, False), (None, 1, 2, False)]
    df = spark.createDataFrame(cases, "ip string, sp int, dp int, want boolean")
    got = df.withColumn("got", net.is_infrastructure(F.col("ip"), F.col("sp"), F.col("dp"))).collect()
    assert [r.ip for r in got if r.got != r.want] == []


FLOW = ("id bigint, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, "
        "prediction string, confidence double, severity string, total_pkts bigint, duration_s double, syn_count bigint, at double")


def flows(spark, rows):
    base = dict(source_ip="10.0.0.99", destination_ip="192.168.31.1", source_port=40001, destination_port=22, protocol="TCP",
                prediction="PortScan", confidence=0.88, severity="HIGH", total_pkts=1, duration_s=0.0, syn_count=1, at=0.0)
    names = [c.split()[0] for c in FLOW.split(", ")]
    data = [tuple({**base, "id": i, **r}[n] for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, FLOW).withColumn("timestamp", F.timestamp_micros((F.col("at") * 1e6).cast("bigint")))


@pytest.mark.parametrize("n_slices", [1, 6])
def test_policy_port_scan(spark, slices, n_slices):
    slices(n_slices)
    rows = [dict(destination_port=p, at=float(i)) for i, p in enumerate([22, 21, 23, 80, 8080, 3389])]
    got = pol.policy_cascade(flows(spark, rows), PolicyConfig()).orderBy("id").collect()
    assert [r.prediction for r in got] == ["BENIGN"] * 4 + ["PortScan"] * 2
    assert [r.should_alert for r in got] == [False] * 4 + [True, False]
    assert [r.is_duplicate for r in got] == [False] * 5 + [True]
    assert got[0].validation_note == "Single/isolated connection to port 22 (PortScan requires >=5 probes)."
    assert got[4].validation_note == "Confirmed PortScan intrusion with 88.0% confidence."
    assert got[4].dedup_key.attack == "PortScan" and got[0].dedup_key is None


def test_policy_rules(spark):
    dos = dict(prediction="DoS", confidence=0.9)
    rows = [
        dict(prediction="BENIGN", confidence=0.6),
        dict(destination_ip="224.0.0.251", destination_port=5353, prediction="Bot"),
        dict(destination_ip="224.0.0.251", destination_port=5353, prediction="Bot", total_pkts=100),
        dict(**dos, total_pkts=10, duration_s=1.0, syn_count=1), dict(**dos, total_pkts=20, duration_s=10.0, syn_count=0, at=200.0),
        dict(**dos, total_pkts=10, duration_s=0.1, syn_count=0, at=400.0), dict(**dos, total_pkts=10, duration_s=10.0, syn_count=7, at=600.0),
        dict(prediction="DoS", confidence=0.7499, total_pkts=50, at=800.0), dict(prediction="DoS", confidence=0.75, total_pkts=50, at=1000.0),
    ]
    got = pol.policy_cascade(flows(spark, rows)).orderBy("id").collect()
    assert [r.prediction for r in got] == ["BENIGN", "BENIGN", "Bot", "BENIGN", "DoS", "DoS", "DoS", "BENIGN", "DoS"]
    assert [r.confidence for r in got] == [0.6, 0.95, 0.88, 0.85, 0.9, 0.9, 0.9, 0.7499, 0.75]
    assert got[1].validation_note == "Normal infrastructure network traffic (224.0.0.251:5353 TCP)."
    assert got[7].validation_note == "ML confidence (0.75) below detection threshold (0.75)."


def test_dedup_refreshes(spark):
    rows = [dict(prediction="DoS", at=float(t)) for t in [0, 50, 100, 170, 230]]
    got = pol.alert_dedup(flows(spark, rows), 60 * SECOND).orderBy("id").collect()
    assert [r.is_duplicate for r in got] == [False, True, True, False, False]
    bursts = pol.alert_sessions(flows(spark, rows), 60 * SECOND).orderBy("start_us").collect()
    assert [r.occurrences for r in bursts] == [3, 1, 1]


@pytest.mark.parametrize("n_slices", [9, 2, 1])
def test_probe_count_against_window_sets(spark, slices, n_slices):
    slices(n_slices)
    rng = random.Random(3)
    rows, at = [], 0.0
    for _ in range(400):
        at += rng.choice([0, 0.5, 1, 3, 10])
        rows.append(dict(source_ip=rng.choice(["hot"] * 8 + ["a", "b"]), destination_ip=f"d{rng.randrange(3)}",
                         destination_port=rng.randrange(4), at=at))
    got = {r.id: r.distinct_targets for r in pol.portscan_probe_count(
        flows(spark, rows), 30 * SECOND).collect()}
    for i, r in enumerate(rows):
        want = {(o["destination_ip"], o["destination_port"]) for o in rows
                if o["source_ip"] == r["source_ip"] and r["at"] - 30 <= o["at"] <= r["at"]}
        assert got[i] == len(want)


def test_probe_window_is_inclusive(spark):
    rows = [dict(destination_port=1, at=0.0), dict(destination_port=2, at=30.0), dict(destination_port=3, at=30.000001)]
    got = pol.portscan_probe_count(flows(spark, rows), 30 * SECOND).orderBy("id").collect()
    assert [r.distinct_targets for r in got] == [1, 2, 2]


def test_ordered_scan_equals_plain_window(spark):
    from pyspark.sql import Window
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise("k").alias("k"),
        (F.col("id") * 37 % 101).alias("o"), "id", (F.col("id") % 5).alias("v"))
    for inclusive in (True, False):
        for descending in (True, False):
            order = [F.col(c).desc() if descending else F.col(c) for c in ("o", "id")]
            w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            want = df.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w).alias("m"))
            got = ordered_scan(df, ["k"], ["o", "id"], sums={"s": F.col("v")},
                               maxes={"m": F.col("v")}, inclusive=inclusive, descending=descending).select("id", "s", "m")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_alert_merge(spark):
    cols = "id bigint, source_ip string, destination_ip string, attack_type string, severity string, confidence double, timestamp timestamp"
    new = spark.sql("SELECT 1L id, 'a' source_ip, 'b' destination_ip, 'DoS' attack_type, 'HIGH' severity, 0.8D confidence, TIMESTAMP'2024-01-01' timestamp "
                    "UNION ALL SELECT 2L, 'a', 'b', 'DoS', 'HIGH', 0.9D, TIMESTAMP'2024-02-01'")
    closes = new.where("id = 1").select("source_ip", "destination_ip", "attack_type", F.lit("2024-01-15").cast("timestamp").alias("timestamp"))
    one = al.alert_aggregate(new, closes.limit(0)).collect()
    assert [(r.occurrences, r.confidence, r.detection_id) for r in one] == [(2, 0.9, 1)]
    two = al.alert_aggregate(new, closes).collect()
    assert sorted((r.occurrences, r.detection_id) for r in two) == [(1, 1), (1, 2)]
    empty = spark.createDataFrame([], cols + ", status string, occurrences bigint, last_seen timestamp")
    first = al.upsert_alerts(empty, new.where("id = 1"))
    again = al.upsert_alerts(first, new.where("id = 2")).collect()
    assert [(r.id, r.occurrences, r.confidence, r.status) for r in again] == [(1, 2, 0.9, "ACTIVE")]
    closed = first.withColumn("status", F.lit("RESOLVED"))
    assert al.upsert_alerts(closed, new.where("id = 2")).count() == 2
    opened = spark.sql("SELECT 'a' source_ip, 'b' destination_ip, 'DoS' attack_type, 7L alert_id, 0L opened_us, 1706000000000000L closed_us")
    match = active_alert_match(new, opened).orderBy("detection_id").collect()
    assert [r.alert_id for r in match] == [7, None]


def test_stored_confusion_matrices(spark):
    """Per-class counts of two published models, with their published scores."""
    names = ["BENIGN", "Bot", "Brute Force", "DDoS", "DoS", "PortScan"]
    forest = [[998, 0, 0, 0, 0, 0], [0, 0, 21, 0, 0, 0], [0, 0, 171, 0, 0, 0], [0, 0, 0, 0, 161, 0], [0, 0, 0, 1, 438, 0],
              [0, 0, 0, 0, 0, 210]]
    cells = [(y, p, forest[i][j]) for i, y in enumerate(names) for j, p in enumerate(names)]
    conf = spark.createDataFrame(cells, "label string, predicted string, count bigint")
    m = met.classification_metrics(met.classification_report(conf)).first()
    want = dict(accuracy=0.9085, precision_macro=0.6036406163049527, recall_macro=0.6662870159453304, f1_macro=0.6310132326947882,
                f1_weighted=0.8697964935747384, precision_weighted=0.8406509416736226, recall_weighted=0.9085)
    for k, v in want.items():
        assert m[k] == pytest.approx(v, abs=1e-12), k


def test_roc_auc_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(8) / 8) for _ in range(80)]
    pos, neg = [s for y, s in rows if y == "b"], [s for y, s in rows if y == "a"]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "y string, s double")
    assert met.roc_auc(df, "y", {"b": F.col("s")}).first()[0] == pytest.approx(want)
    assert met.roc_auc(df.where("y = 'b'"), "y", {"b": F.col("s")}).first()[0] is None


def test_medians_and_cleaning(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1.0, 2.0, 3.0]), rng.gauss(0, 1e6) if i % 50 else 1e300, 7.0, None) for i in range(301)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    direct = df.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in "abc"]).first().asDict() | {"d": 0.0}
    assert prep.exact_medians(df, list("abcd")) == pytest.approx(direct)
    raw = spark.createDataFrame([("1", "x", "5", "Infinity"), ("2", " 3 ", "nan", None)], "` Flow Duration` string, b string, `TotLen Fwd Packets` string, `Idle Mean` string")
    named = fil.normalize_columns(raw)
    assert named.columns == ["Flow Duration", "Total Length of Fwd Packets", "Idle Mean"]
    clean = fil.to_numeric_clean(named, named.columns).collect()
    assert [tuple(r) for r in clean] == [(1.0, 5.0, None), (2.0, None, None)]
    with pytest.raises(ValueError, match="Too few"):
        prep.preprocess_fit_transform(raw.withColumn("Label", F.lit("BENIGN")))
    with pytest.raises(ValueError, match="No label"):
        prep.preprocess_fit_transform(raw)
    stats = prep.FeatureStats(("Flow Duration", "Idle Std"), (9.0, 9.0), (1.0, 2.0), (2.0, 4.0))
    got = prep.preprocess_transform(spark.createDataFrame([("abc",), ("5",)], "`Flow Duration` string"), stats).collect()
    assert [tuple(r) for r in got] == [(4.0, -0.5), (2.0, -0.5)]


def test_split_is_stratified_disjoint_and_repeatable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("y"))
    a = prep.stratified_split(df, "y", "id")
    sizes = {(r.y, r.is_test): r["count"] for r in a.groupBy("y", "is_test").count().collect()}
    assert sizes == {("rare", True): 20, ("rare", False): 80, ("hot", True): 180, ("hot", False): 720}
    again = prep.stratified_split(df.repartition(7), "y", "id")
    assert a.where("is_test").select("id").exceptAll(again.where("is_test").select("id")).count() == 0
    with pytest.raises(ValueError):
        prep.stratified_split(df.where("id <= 1"), "y", "id")


def test_profile_and_verdict(spark):
    small = spark.createDataFrame([("1", "inf", "x")] * 99, "`Flow Duration` string, `Idle Mean` string, other string")
    p = ds.dataset_profile(small).first()
    assert (p.total_rows, p.missing_values, p.numeric_columns, p.recognized_features) == (99, 99, 2, 2)
    v = ds.dataset_verdict(small).first()
    assert not v.valid and len(v.errors) == 3
    assert any(w.startswith("High missing") for w in v.warnings) and any("98/99 rows" in w for w in v.warnings)
    wide = spark.range(150).select(*[F.col("id").cast("string").alias(n) for n in FEATURE_NAMES[:12]],
                                   F.lit("BENIGN").alias(" Label"))
    ok = ds.dataset_verdict(wide).first()
    assert ok.valid and ok.warnings == []
    odd = wide.withColumn(" Label", F.when(F.col(FEATURE_NAMES[0]).cast("int") % 3 == 0, "Riddle").otherwise("Mystery"))
    assert ds.dataset_verdict(odd).first().warnings == ["Unknown labels (will be mapped to 'Unknown'): ['Mystery', 'Riddle']"]


def test_paging(spark):
    df = spark.range(41).select("id", F.timestamp_seconds("id").alias("timestamp"), F.lit("NEW").alias("status"))
    rows, totals = paging.paginate_detections(df, page=3)
    assert [r.id for r in rows.collect()] == [0] and totals.first().pages == 3
    assert paging.paginate_detections(df.limit(0))[1].first().pages == 1
    assert paging.paginate_detections(df, per_page=500)[1].first().per_page == 100
    first = paging.next_page(df, 20).collect()
    second = paging.next_page(df, 20, (first[-1].timestamp, first[-1].id)).collect()
    assert [r.id for r in second] == list(range(20, 0, -1))
    assert [r.id for r in paging.poll_events(df, 10, 5).collect()] == [36, 37, 38, 39, 40]


def test_flow_key_is_direction_free(spark):
    df = spark.createDataFrame([("10.0.0.9", "10.0.0.10", 5, 6, "tcp"), ("10.0.0.10", "10.0.0.9", 6, 5, "TCP")],
                               "src_ip string, dst_ip string, src_port int, dst_port int, protocol string")
    assert net.flow_key(df).select("flow_key").distinct().count() == 1


def test_hot_key_is_cut_by_rows(spark, slices):
    """All rows at one time and key order: slices follow the rows, not the clock."""
    from flowtide.operators.scan import SLICE, ordered_scan, sliced
    slices(5)
    df = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    sizes = [r["count"] for r in sliced(df, ["k"], ["at"]).groupBy(SLICE).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 1000
    got = ordered_scan(df, ["k"], ["at"], sums={"n": F.lit(1)}, maxes={"before": F.col("at")}, inclusive=True)
    assert got.where("n <> at + 1 OR before <> at").count() == 0
    nulls = ordered_scan(df.withColumn("k", F.when(F.col("at") % 2 == 0, F.lit("\u0000"))), ["k"], ["at"], sums={"n": F.lit(1)})
    assert nulls.groupBy("k").agg(F.max("n").alias("m")).agg(F.max("m")).first()[0] == 1000


def test_upsert_matches_null_fingerprints_and_keeps_last_seen(spark):
    from datetime import datetime
    cols = "id int, source_ip string, destination_ip string, attack_type string, severity string, confidence double, timestamp timestamp"
    batch = lambda i, month: spark.createDataFrame([(i, None, "d", "DoS", "HIGH", 0.9, datetime(2024, month, 1))], cols)
    table = batch(1, 3).selectExpr("*", "'ACTIVE' AS status", "1L AS occurrences", "timestamp AS last_seen")
    rows = al.upsert_alerts(table, batch(2, 2)).collect()
    assert [(r.id, r.occurrences, r.last_seen.month) for r in rows] == [(1, 2, 3)]


def test_duplicate_rows_compare_text_columns_as_text(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "a string, b string")
    count = lambda df: ds.duplicate_rows(df).first()[0]
    assert count(rows(("1", "x"), ("1.0", "x"))) == 1
    assert count(rows(("1", "x"), ("1.0", "x"), ("word", "y"))) == 0
    assert count(rows(("inf", "x"), (None, "x"))) == 1 and count(rows(("inf", "x"), (None, "x"), ("w", "z"))) == 0
    assert count(rows((None, "x"), ("x", None))) == 0


def test_auc_of_missing_scores_is_null(spark):
    df = spark.createDataFrame([("b", 0.9), ("a", 0.1), ("b", float("nan")), ("a", None)], "y string, s double")
    assert met.roc_auc(df, "y", {"b": F.col("s")}).first()[0] is None


def test_model_queries_train_with_the_default_parameters(monkeypatch):
    from flowtide.checks import model_queries, registry
    from flowtide.plans import training

    calls = []

    class Stop(Exception):
        pass

    def fit(*args, **kw):
        calls.append((args[4] if len(args) > 4 else None) or kw.get("params"))
        raise Stop

    for name in ("fit_pipeline", "train_model", "compare_models"):
        monkeypatch.setattr(training, name, fit)
    monkeypatch.setattr(registry, "frame", lambda *a: None)
    monkeypatch.setattr(model_queries, "_labelled", lambda r: (None, []))
    monkeypatch.setattr(model_queries.prep, "fit_stats", lambda *a: None)
    names = ["train_random_forest", "train_decision_tree", "train_logistic_regression", "train_svm", "train_model", "compare_models",
             "evaluate_saved_model", "score_batch", "feature_importance", "rank_importance"]
    for name in names:
        with pytest.raises(Stop):
            registry.QUERIES[name](None, "")
    assert calls == [None] * len(names)


def test_sketched_medians_keep_their_rank(spark):
    values = [float((i * 7919) % 5003) ** 2 for i in range(5003)]
    df = spark.createDataFrame([(v, None) for v in values], "a double, b double").repartition(7)
    got = prep.sketched_medians(df, ["a", "b"], 200)
    assert got["b"] == 0.0 and abs(sorted(values).index(got["a"]) - 2501) <= 5003 / 200 + 1
