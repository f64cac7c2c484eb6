"""Sessionization and features against fixed cases and a sequential model of the flow rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowtide.config import SECOND, FlowConfig
from flowtide.operators.features import flow_features
from flowtide.operators.flows import active_idle_periods, flow_sessionize, flow_summary

A, B = ("10.0.0.1", 1000), ("10.0.0.2", 80)
COLUMNS = ("src_ip string, src_port int, dst_ip string, dst_port int, protocol string, ts_us bigint, pkt_len int, "
           "tcp_flags int, header_len int, win_size int, payload_len int, seq bigint")


def packets(spark, rows):
    """rows: (seconds, 'f' | 'b', overrides)"""
    out = []
    for i, (t, side, extra) in enumerate(rows):
        (s, d) = (A, B) if side == "f" else (B, A)
        p = dict(src=s, dst=d, proto="tcp", len=100, flags=0, hdr=20, win=0, pay=0)
        p.update(extra)
        out.append((*p["src"], *p["dst"], p["proto"], round(t * SECOND), p["len"], p["flags"], p["hdr"], p["win"],
                    p["pay"], i))
    return spark.createDataFrame(out, COLUMNS).withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")


def flow_times(spark, rows, cfg=FlowConfig()):
    df = flow_sessionize(packets(spark, rows), cfg).orderBy("ts", "seq").collect()
    flows = {}
    for r in df:
        flows.setdefault(r.flow_seq, []).append(r.ts_us / SECOND)
    return [v for _, v in sorted(flows.items())]


@pytest.mark.parametrize("times, want", [
    ([0, 4, 8, 12, 16, 17], [[0, 4, 8, 12, 16], [17]]),
    ([0, 5], [[0], [5]]),
    ([0, 4.999999], [[0, 4.999999]]),
])
def test_timeouts(spark, slices, times, want):
    for n in (1, 4):
        slices(n)
        assert flow_times(spark, [(t, "f", {}) for t in times]) == want


def test_exclusive_active_rule(spark):
    cfg = FlowConfig(active_rule="exclusive")
    assert flow_times(spark, [(t, "f", {}) for t in [0, 4, 8, 12, 16, 17]], cfg) == [[0, 4, 8, 12], [16, 17]]


def test_fin_ends_flow_and_next_sender_is_forward(spark):
    rows = [(0, "f", {}), (1, "b", {}), (2, "b", {"flags": 1}), (3, "b", {})]
    got = flow_sessionize(packets(spark, rows)).orderBy("seq").collect()
    assert [r.flow_seq for r in got] == [0, 0, 0, 3]
    assert [r.fwd for r in got] == [True, False, False, True]


def one(spark, rows, cfg=FlowConfig()):
    got = flow_features(packets(spark, rows), cfg).collect()
    assert len(got) == 1
    return got[0].asDict()


def test_two_packet_flow(spark):
    f = one(spark, [(1000.0, "f", {"len": 68, "proto": "UDP"}), (1000.02, "b", {"len": 128, "proto": "udp"})])
    assert (f["total_fwd_packets"], f["total_backward_packets"]) == (1, 1)
    assert (f["flow_duration"], f["flow_iat_mean"], f["flow_iat_std"], f["flow_iat_max"], f["flow_iat_min"]) == (
        20000, 10000, 10000, 20000, 0)
    assert f["fwd_iat_total"] == f["bwd_iat_max"] == 0
    assert f["flow_bytes_per_s"] == pytest.approx(9800) and f["down_up_ratio"] == 1.0


def test_feature_vector(spark):
    f = one(spark, [
        (100.00, "f", {"len": 64, "flags": 2, "win": 65535}), (100.01, "b", {"len": 64, "flags": 18, "win": 65535}),
        (100.02, "f", {"len": 1500, "flags": 24, "pay": 1460}), (100.03, "b", {"len": 64, "flags": 16})])
    want = {
        "total_fwd_packets": 2, "total_backward_packets": 2, "total_length_of_fwd_packets": 1564,
        "total_length_of_bwd_packets": 128, "syn_flag_count": 2, "ack_flag_count": 3, "psh_flag_count": 1,
        "flow_duration": 30000, "fwd_packet_length_max": 1500, "fwd_packet_length_min": 64,
        "fwd_packet_length_mean": 782, "fwd_packet_length_std": 718, "bwd_packet_length_mean": 64,
        "bwd_packet_length_std": 0, "packet_length_mean": 423, "packet_length_variance": 386643,
        "packet_length_std": 621.806240, "flow_bytes_per_s": 56400, "flow_packets_per_s": 133.333333,
        "flow_iat_mean": 7500, "flow_iat_std": 4330.127019, "flow_iat_max": 10000, "flow_iat_min": 0,
        "fwd_iat_total": 20000, "fwd_iat_mean": 20000, "fwd_iat_std": 0, "fwd_header_length": 40,
        "bwd_header_length": 40, "init_win_bytes_forward": 65535, "init_win_bytes_backward": 65535,
        "act_data_pkt_fwd": 1, "min_seg_size_forward": 20, "active_mean": 30000, "active_max": 30000,
        "active_min": 30000, "active_std": 0, "idle_mean": 0, "idle_max": 0, "fwd_psh_flags": 1, "bwd_psh_flags": 0,
    }
    for name, value in want.items():
        assert f[name] == pytest.approx(value, abs=1e-3), name


@pytest.mark.parametrize("times, want", [
    ([0, 0.5, 2.0, 2.2, 5.0], dict(active_mean=350000, active_std=150000, active_max=500000, active_min=200000,
                                   idle_mean=2150000, idle_std=650000)),
    ([0, 2], dict(active_mean=2000000, active_max=2000000, active_min=2000000, active_std=0, idle_mean=2000000)),
    ([0, 1], dict(active_mean=1000000, idle_mean=0)),
    ([0], dict(active_mean=0, active_max=0, active_std=0, idle_mean=0, idle_std=0)),
])
def test_active_idle(spark, slices, times, want):
    for n in (6, 1):
        slices(n)
        f = one(spark, [(t, "f", {}) for t in times], FlowConfig())
        for name, value in want.items():
            assert f[name] == pytest.approx(value), (name, n)


@pytest.mark.parametrize("headers, want", [
    ([20], 20), ([40, 60], 40), ([40, 60, 20, 32], 32), ([8, 20], 8), ([], 20), ([40, 20], 20), ([20, 60, 0, 44], 44)])
def test_min_segment(spark, headers, want):
    rows = [(0, "f", {"hdr": headers[0]})] if headers else [(0, "f", {"hdr": 0})]
    rows += [(0.1 * (i + 1), "f", {"hdr": h}) for i, h in enumerate(headers[1:])] + [(0.9, "b", {"hdr": 20})]
    assert one(spark, rows)["min_seg_size_forward"] == want


class Model:
    """Sequential flow rules, packet by packet."""

    def __init__(self, cfg):
        self.cfg = cfg

    def run(self, rows):
        flows, current = {}, {}
        counts = {}
        for r in sorted(rows, key=lambda r: (r["ts"], r["seq"])):
            key = (r["proto"].upper(), *sorted([r["src"], r["dst"]]))
            n = counts.get(key, 0)
            counts[key] = n + 1
            f = current.get(key)
            if f and (r["ts"] - f["last"] >= self.cfg.idle_us or (
                    self.cfg.active_rule == "exclusive" and r["ts"] - f["start"] >= self.cfg.active_us)):
                f = None
            if f is None:
                f = current[key] = dict(start=r["ts"], src=r["src"], packets=[], seq=n)
                flows[(key, n)] = f
            f["last"] = r["ts"]
            f["packets"].append(r)
            if r["flags"] & 5 or (self.cfg.active_rule == "inclusive" and r["ts"] - f["start"] >= self.cfg.active_us):
                current[key] = None
        return flows


def feature_model(f, cfg):
    ps = f["packets"]
    fwd = [p for p in ps if p["src"] == f["src"]]
    bwd = [p for p in ps if p["src"] != f["src"]]
    mean = lambda v: sum(v) / len(v) if v else 0.0
    std = lambda v: math.sqrt(mean([(x - mean(v)) ** 2 for x in v])) if v else 0.0
    gaps = lambda ts: [b - a for a, b in zip(ts, ts[1:])]
    ts = [p["ts"] for p in ps]
    flow_gaps, fg, bg = [0] + gaps(ts), gaps([p["ts"] for p in fwd]), gaps([p["ts"] for p in bwd])
    dur = ts[-1] - ts[0]
    islands, idles, start = [], [], ts[0]
    for a, b in zip(ts, ts[1:]):
        if b - a > cfg.activity_us:
            islands.append(a - start)
            idles.append(b - a)
            start = b
    islands = [i for i in [*islands, ts[-1] - start] if i > 0]
    seg = 20
    for p in fwd:
        if p["hdr"] > 0 and (seg == 20 or p["hdr"] < seg):
            seg = p["hdr"]
    return dict(
        flow_duration=dur, total_fwd_packets=len(fwd), total_backward_packets=len(bwd),
        fwd_packet_length_std=std([p["len"] for p in fwd]), packet_length_mean=mean([p["len"] for p in ps]),
        flow_iat_mean=mean(flow_gaps), flow_iat_std=std(flow_gaps), flow_iat_max=max(flow_gaps),
        fwd_iat_total=sum(fg), fwd_iat_std=std(fg), bwd_iat_mean=mean(bg), bwd_iat_max=max(bg, default=0),
        bwd_iat_min=min(bg, default=0), fwd_header_length=sum(p["hdr"] for p in fwd),
        init_win_bytes_forward=next((p["win"] for p in fwd if p["win"]), 0),
        init_win_bytes_backward=next((p["win"] for p in bwd if p["win"]), 0), min_seg_size_forward=seg,
        active_mean=mean(islands) if islands else dur, active_std=std(islands), active_max=max(islands, default=dur),
        active_min=min(islands, default=dur), idle_mean=mean(idles), idle_std=std(idles), idle_max=max(idles, default=0),
        idle_min=min(idles, default=0),
    )


@pytest.mark.parametrize("rule", ["inclusive", "exclusive"])
@pytest.mark.parametrize("chunk_rows, n_slices", [(1_000_000, 1), (9, 7), (40, 12)])
def test_against_sequential_model(spark, slices, rule, chunk_rows, n_slices):
    slices(n_slices)
    cfg = FlowConfig(active_rule=rule, chunk_rows=chunk_rows)
    rng = random.Random(11)
    rows, now = [], 0
    for i in range(1500):
        now += rng.choice([0, 1, 200_000, 900_000, 1_100_000, 2_500_000, 2_500_000] + ([6_000_000] if i % 9 == 0 else []))
        hot = rng.random() < 0.6
        c = ("10.0.0.9", 5000 + (0 if hot else rng.randrange(6)))
        s, d = (c, B) if rng.random() < 0.6 else (B, c)
        rows.append(dict(src=s, dst=d, proto="tcp", ts=now, seq=i, len=rng.randrange(40, 1500),
                         flags=rng.choice([0] * 60 + [1, 4]), hdr=rng.choice([0, 20, 24, 32, 60]),
                         win=rng.choice([0, 0, 512, 9000])))
    df = spark.createDataFrame(
        [(*r["src"], *r["dst"], r["proto"], r["ts"], r["len"], r["flags"], r["hdr"], r["win"], 0, r["seq"]) for r in rows],
        COLUMNS).withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")
    want = Model(cfg).run(rows)
    got = {}
    for r in flow_features(df, cfg).collect():
        key = (r.k_proto, (r.k_ip_lo, r.k_port_lo), (r.k_ip_hi, r.k_port_hi))
        got[(key, r.flow_seq)] = r
    assert set(got) == set(want)
    for k, f in want.items():
        r = got[k].asDict()
        assert (r["src_ip"], r["src_port"]) == f["src"]
        assert r["total_pkts"] == len(f["packets"])
        for name, value in feature_model(f, cfg).items():
            assert r[name] == pytest.approx(value, abs=1e-3, rel=1e-9), (k, name)


def test_order_of_rows_does_not_matter_and_every_packet_has_one_flow(spark):
    rows = [(t * 0.7, "f" if t % 3 else "b", {}) for t in range(60)]
    df = packets(spark, rows)
    a = flow_summary(df).drop("flow_seq").collect()
    b = flow_summary(df.orderBy(F.rand(3))).drop("flow_seq").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert sum(r.total_pkts for r in a) == 60


def test_periods(spark):
    got = active_idle_periods(packets(spark, [(t, "f", {}) for t in [0, 0.5, 2.0, 2.2, 5.0]])).orderBy("start_us", "kind")
    assert [(r.kind, r.dur_us) for r in got.collect()] == [
        ("active", 500000), ("idle", 1500000), ("active", 200000), ("idle", 2800000)]


def test_finished_flows_are_not_active(spark):
    from flowtide.operators.flows import active_flow_count
    count = lambda rows, at: active_flow_count(packets(spark, rows), int(at * 1e6)).first()[0]
    assert count([(0, "f", {}), (1, "f", dict(flags=1))], 2) == 0
    assert count([(0, "f", {}), (1, "f", dict(flags=1))], 0.5) == 1
    assert count([(0, "f", {}), (1, "f", {})], 2) == 1 and count([(0, "f", {}), (1, "f", {})], 6) == 0
