"""Flow queries: keys, sessions, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.checks.mapping import FLOW
from flowtide.checks.registry import query
from flowtide.config import HOUR
from flowtide.functions import network as net
from flowtide.operators import features, flows
from flowtide.schema import FEATURE_COLUMNS, FEATURE_NAMES

_KEYED = """
keyed AS (
  SELECT *, epoch_us(ts) AS us, upper(protocol) AS k_proto,
         (src_ip > dst_ip OR (src_ip = dst_ip AND src_port > dst_port)) AS swap
  FROM $packets
), pk AS (
  SELECT *, CASE WHEN swap THEN dst_ip ELSE src_ip END AS k_ip_lo, CASE WHEN swap THEN dst_port ELSE src_port END AS k_port_lo,
         CASE WHEN swap THEN src_ip ELSE dst_ip END AS k_ip_hi, CASE WHEN swap THEN src_port ELSE dst_port END AS k_port_hi
  FROM keyed
)"""

# A packet opens a flow when idle, after FIN/RST, or when the previous one reached the active age.
_ASSIGNED = _KEYED + f""", num AS (
  SELECT *, row_number() OVER (PARTITION BY k_proto, k_ip_lo, k_port_lo, k_ip_hi, k_port_hi ORDER BY us, seq) - 1 AS idx
  FROM pk
), walk AS (
  SELECT k_proto, k_ip_lo, k_port_lo, k_ip_hi, k_port_hi, idx, us, tcp_flags, idx AS flow_seq, us AS start_us
  FROM num WHERE idx = 0
  UNION ALL
  SELECT n.k_proto, n.k_ip_lo, n.k_port_lo, n.k_ip_hi, n.k_port_hi, n.idx, n.us, n.tcp_flags,
         CASE WHEN n.us - w.us >= {FLOW.idle_us} OR (w.tcp_flags & 5) <> 0 OR w.us - w.start_us >= {FLOW.active_us}
              THEN n.idx ELSE w.flow_seq END,
         CASE WHEN n.us - w.us >= {FLOW.idle_us} OR (w.tcp_flags & 5) <> 0 OR w.us - w.start_us >= {FLOW.active_us}
              THEN n.us ELSE w.start_us END
  FROM walk w JOIN num n ON n.idx = w.idx + 1 AND n.k_proto = w.k_proto AND n.k_ip_lo = w.k_ip_lo
   AND n.k_port_lo = w.k_port_lo AND n.k_ip_hi = w.k_ip_hi AND n.k_port_hi = w.k_port_hi
), fl AS (
  SELECT n.*, w.flow_seq, w.start_us FROM num n JOIN walk w
    ON n.idx = w.idx AND n.k_proto = w.k_proto AND n.k_ip_lo = w.k_ip_lo
   AND n.k_port_lo = w.k_port_lo AND n.k_ip_hi = w.k_ip_hi AND n.k_port_hi = w.k_port_hi
), ini AS (
  SELECT *, (NOT swap) = first_value(NOT swap) OVER (PARTITION BY k_proto, k_ip_lo, k_port_lo, k_ip_hi, k_port_hi, flow_seq ORDER BY idx) AS fwd
  FROM fl
)"""

_FLOW = "k_proto, k_ip_lo, k_port_lo, k_ip_hi, k_port_hi, flow_seq"

_GAPS = _ASSIGNED + f""", gaps AS (
  SELECT *, us - lag(us) OVER (PARTITION BY {_FLOW} ORDER BY idx) AS gap,
         us - lag(us) OVER (PARTITION BY {_FLOW}, fwd ORDER BY idx) AS dgap
  FROM ini
), isl AS (
  SELECT *, sum(CASE WHEN gap > {FLOW.activity_us} THEN 1 ELSE 0 END) OVER (PARTITION BY {_FLOW} ORDER BY idx) AS island
  FROM gaps
)"""


@query("flow_key", "packets", sql=f"""WITH {_KEYED}
  SELECT seq, k_proto AS proto, k_ip_lo AS lo_ip, cast(k_port_lo AS bigint) AS lo_port, k_ip_hi AS hi_ip,
         cast(k_port_hi AS bigint) AS hi_port FROM pk""")
def q_flow_key(spark, packets):
    k = F.col("flow_key")
    return net.flow_key(packets).select(
        "seq", k["protocol"].alias("proto"), k["lo"]["ip"].alias("lo_ip"), k["lo"]["port"].cast("bigint").alias("lo_port"),
        k["hi"]["ip"].alias("hi_ip"), k["hi"]["port"].cast("bigint").alias("hi_port"))


@query("flow_sessionize", "packets", sql=f"""WITH RECURSIVE {_ASSIGNED}
  SELECT seq, flow_seq, start_us AS flow_start_us, fwd FROM ini""")
def q_flow_sessionize(spark, packets):
    return flows.flow_sessionize(packets, FLOW).select("seq", "flow_seq", "flow_start_us", "fwd")


@query("flush_flows", "packets", sql=f"""WITH RECURSIVE {_ASSIGNED}
  SELECT k_proto, k_ip_lo, k_ip_hi, flow_seq, min(us) AS flow_start_us, max(us) AS flow_end_us, count(*) AS total_pkts,
         count(*) FILTER (fwd) AS fwd_pkts, cast(sum(pkt_len) AS bigint) AS total_bytes
  FROM ini GROUP BY {_FLOW}, k_ip_lo, k_ip_hi""")
def q_flush_flows(spark, packets):
    return flows.flow_summary(packets, FLOW).drop("k_port_lo", "k_port_hi")


@query("flow_idle_sessions", "packets", sql=f"""WITH {_KEYED}, m AS (
    SELECT *, CASE WHEN us - lag(us) OVER k < {FLOW.idle_us} THEN 0 ELSE 1 END AS fresh FROM pk
    WINDOW k AS (PARTITION BY k_proto, k_ip_lo, k_port_lo, k_ip_hi, k_port_hi ORDER BY us, seq)
  ), s AS (SELECT *, sum(fresh) OVER (PARTITION BY k_proto, k_ip_lo, k_port_lo, k_ip_hi, k_port_hi ORDER BY us, seq) AS sid FROM m)
  SELECT k_proto, k_ip_lo, k_ip_hi, min(us) AS start_us, max(us) AS end_us, count(*) AS total_pkts
  FROM s GROUP BY k_proto, k_ip_lo, k_port_lo, k_ip_hi, k_port_hi, sid""")
def q_flow_idle_sessions(spark, packets):
    got = flows.flow_idle_sessions(packets, FLOW.idle_us)
    return got.select("k_proto", "k_ip_lo", "k_ip_hi", "start_us", "end_us", "total_pkts")


@query("interarrival", "packets", sql="""
  SELECT seq, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts, seq), -1) AS gap_us FROM $packets""")
def q_interarrival(spark, packets):
    return flows.interarrival(packets, ["src_ip", "dst_ip"]).select("seq", F.coalesce("gap_us", F.lit(-1)).alias("gap_us"))


@query("active_idle_periods", "packets", sql=f"""WITH RECURSIVE {_GAPS}
  SELECT k_proto, k_ip_lo, flow_seq, 'active' AS kind, min(us) AS start_us, max(us) - min(us) AS dur_us
  FROM isl GROUP BY {_FLOW}, island HAVING max(us) > min(us)
  UNION ALL
  SELECT k_proto, k_ip_lo, flow_seq, 'idle', us - gap, gap FROM gaps WHERE gap > {FLOW.activity_us}""")
def q_active_idle_periods(spark, packets):
    return flows.active_idle_periods(packets, FLOW).select("k_proto", "k_ip_lo", "flow_seq", "kind", "start_us", "dur_us")


_AT_US = 1_705_000_000_000_000


@query("active_flow_count", "packets", sql=f"""WITH RECURSIVE {_ASSIGNED}, f AS (
    SELECT min(us) AS a, max(us) AS b, bool_or((tcp_flags & 5) <> 0) AS closed FROM ini GROUP BY {_FLOW})
  SELECT count(*) AS active_flows FROM f WHERE a <= {_AT_US}
    AND {_AT_US} < CASE WHEN closed OR b - a >= {FLOW.active_us} THEN b ELSE b + {FLOW.idle_us} END""")
def q_active_flow_count(spark, packets):
    return flows.active_flow_count(packets, _AT_US, FLOW)


def _digits(name: str) -> int:
    """Decimals to compare: whole microseconds for durations, four for the rest."""
    return 0 if any(part in name for part in ("iat", "active", "idle", "duration")) else 4


def _features_sql() -> str:
    f, b = "FILTER (fwd)", "FILTER (NOT fwd)"
    z = lambda e: f"coalesce({e}, 0)"
    four = lambda x, flt: [z(f"{g}({x}) {flt}") for g in ("max", "min", "avg", "stddev_pop")]
    iat = lambda x, flt: [z(f"{g}({x}) {flt}") for g in ("avg", "stddev_pop", "max", "min")]
    dur = "(max(us) - min(us))"
    sec = f"greatest({dur} / 1e6, 1e-6)"
    nf, nb = f"count(*) {f}", f"count(*) {b}"
    bit = lambda m, flt="TRUE": f"count(*) FILTER ((tcp_flags & {m}) <> 0 AND {flt})"
    lf, lb = z(f"sum(pkt_len) {f}"), z(f"sum(pkt_len) {b}")
    vals = [
        dur, nf, nb, lf, lb, *four("pkt_len", f), *four("pkt_len", b), f"({lf} + {lb}) / {sec}", f"count(*) / {sec}",
        *iat("coalesce(gap, 0)", ""), z(f"sum(dgap) {f}"), *iat("dgap", f), z(f"sum(dgap) {b}"), *iat("dgap", b),
        bit(8, "fwd"), bit(8, "NOT fwd"), bit(32, "fwd"), bit(32, "NOT fwd"),
        z(f"sum(header_len) {f}"), z(f"sum(header_len) {b}"), f"{nf} / {sec}", f"{nb} / {sec}",
        "min(pkt_len)", "max(pkt_len)", "avg(pkt_len)", "stddev_pop(pkt_len)", "var_pop(pkt_len)",
        *[bit(m) for m in (1, 2, 4, 8, 16, 32, 128, 64)],
        f"coalesce({nb} / nullif({nf}, 0), 0)", "avg(pkt_len)", z(f"avg(pkt_len) {f}"), z(f"avg(pkt_len) {b}"),
        *["0"] * 6, nf, lf, nb, lb,
        z("arg_min(win_size, idx) FILTER (fwd AND win_size > 0)"), z("arg_min(win_size, idx) FILTER (NOT fwd AND win_size > 0)"),
        "count(*) FILTER (fwd AND payload_len > 0)",
        "list_reduce(list_prepend(20, coalesce(list(header_len ORDER BY idx) FILTER (fwd AND header_len > 0), [])), "
        "lambda a, h: CASE WHEN a = 20 OR h < a THEN h ELSE a END)",
    ]
    names = FEATURE_COLUMNS[:68]
    picked = ", ".join(f"round(cast({v} AS double), {_digits(n)}) AS {n}" for v, n in zip(vals, names, strict=True))
    tail = ", ".join(
        f"round(cast(coalesce(p.{k}_{s}, {alt}) AS double), 0) AS {'active' if k == 'a' else 'idle'}_{s}"
        for k in "ai" for s, alt in (("mean", "g.flow_duration" if k == "a" else "0"), ("std", "0"),
                                     ("max", "g.flow_duration" if k == "a" else "0"), ("min", "g.flow_duration" if k == "a" else "0")))
    return f"""WITH RECURSIVE {_GAPS}, g AS (
      SELECT {_FLOW}, {picked} FROM isl GROUP BY {_FLOW}
    ), periods AS (
      SELECT {_FLOW}, 1 AS act, max(us) - min(us) AS d FROM isl GROUP BY {_FLOW}, island HAVING max(us) > min(us)
      UNION ALL SELECT {_FLOW}, 0, gap FROM gaps WHERE gap > {FLOW.activity_us}
    ), p AS (
      SELECT {_FLOW}, avg(d) FILTER (act = 1) AS a_mean, stddev_pop(d) FILTER (act = 1) AS a_std, max(d) FILTER (act = 1) AS a_max,
             min(d) FILTER (act = 1) AS a_min, avg(d) FILTER (act = 0) AS i_mean, stddev_pop(d) FILTER (act = 0) AS i_std,
             max(d) FILTER (act = 0) AS i_max, min(d) FILTER (act = 0) AS i_min
      FROM periods GROUP BY {_FLOW})
    SELECT g.k_proto, g.k_ip_lo, g.flow_seq, {", ".join("g." + n for n in names)}, {tail}
    FROM g LEFT JOIN p USING ({_FLOW})"""


@query("flow_features", "packets", sql=_features_sql())
def q_flow_features(spark, packets):
    got = features.flow_features(packets, FLOW)
    return got.select("k_proto", "k_ip_lo", "flow_seq", *[F.round(c, _digits(c)).alias(c) for c in FEATURE_COLUMNS])


_SAMPLE = list(zip(FEATURE_NAMES, FEATURE_COLUMNS))[:12]


@query("project_feature_sample", "packets", sql=f"""SELECT * FROM (
    SELECT k_proto, k_ip_lo, flow_seq, {", ".join(c for _, c in _SAMPLE)} FROM ({_features_sql()}) AS every_feature)""")
def q_project_feature_sample(spark, packets):
    """All values of the sample map, which must hold these names only."""
    got = features.project_feature_sample(features.flow_features(packets, FLOW), 12, digits=None)
    m = F.col("features")
    names = F.array(*[F.lit(n) for n, _ in _SAMPLE])
    return got.where(F.map_keys(m) == names).select(
        "k_proto", "k_ip_lo", "flow_seq", *[F.round(m[n], _digits(c)).alias(c) for n, c in _SAMPLE])


@query("tcp_flags_decode", "packets", sql="""
  SELECT seq, tcp_flags & 1 AS fin, (tcp_flags >> 1) & 1 AS syn, (tcp_flags >> 2) & 1 AS rst, (tcp_flags >> 3) & 1 AS psh,
         (tcp_flags >> 4) & 1 AS ack, (tcp_flags >> 5) & 1 AS urg, (tcp_flags >> 6) & 1 AS ece, (tcp_flags >> 7) & 1 AS cwe
  FROM $packets""")
def q_tcp_flags_decode(spark, packets):
    return packets.select("seq", *net.tcp_flags_decode(F.col("tcp_flags")))


@query("safe_rates", "packets", sql="""
  SELECT seq, round(pkt_len / greatest(payload_len / 1e3, 1e-6), 4) AS rate,
         round(coalesce(cast(payload_len AS double) / nullif(win_size, 0), 0), 6) AS ratio FROM $packets""")
def q_safe_rates(spark, packets):
    return packets.select("seq", F.round(net.safe_rate(F.col("pkt_len"), F.col("payload_len") / 1e3), 4).alias("rate"),
                          F.round(net.safe_ratio(F.col("payload_len"), F.col("win_size")), 6).alias("ratio"))


@query("merge_directions", "packets", sql="""
  SELECT src_ip, dst_ip, pkt_len, count(*) AS n FROM $packets GROUP BY ALL""")
def q_merge_directions(spark, packets):
    from flowtide.operators.sets import merge_directions
    lengths = packets.select("src_ip", "dst_ip", "pkt_len", (F.col("seq") % 3 != 0).alias("fwd"))
    both = merge_directions(lengths.where("fwd").drop("fwd"), lengths.where("not fwd").drop("fwd"))
    return both.groupBy("src_ip", "dst_ip", "pkt_len").agg(F.count("*").alias("n"))


# Frames made of the packets: by ``seq``, up to two VLAN tags, every fifth IPv6, every other of these with two extension headers.
_SIX, _EXTENDED = "seq % 5 = 0", "seq % 10 = 0"


def frames_of(packets):
    """``seq``, ``ts`` and the Ethernet frame of every packet."""
    h = lambda c, n: F.lpad(F.hex(c if not isinstance(c, (str, int)) else F.expr(str(c))), 2 * n, "0")
    octets = lambda c: F.concat(*[h(F.split(c, r"\.")[i].cast("bigint"), 1) for i in range(4)])
    six = lambda c: F.concat(F.lit("20010db8" + "00" * 8), octets(c))
    proto = h("CASE protocol WHEN 'tcp' THEN 6 ELSE 17 END", 1)
    ports = F.concat(h("src_port", 2), h("dst_port", 2))
    tcp = F.concat(ports, F.lit("00" * 8 + "50"), h("tcp_flags", 1), h("win_size", 2), F.lit("0000" * 2))
    udp = F.concat(ports, h("8 + payload_len", 2), F.lit("0000"))
    body = F.concat(F.when(F.col("protocol") == "tcp", tcp).otherwise(udp), F.repeat(F.lit("ab"), F.col("payload_len")))
    size = "CASE protocol WHEN 'tcp' THEN 20 ELSE 8 END + payload_len"
    four = F.concat(F.lit("08004500"), h(f"20 + {size}", 2), F.lit("0001000040"), proto, F.lit("0000"), octets("src_ip"), octets("dst_ip"))
    more = F.concat(F.lit("3c00" + "00" * 6), proto, F.lit("01" + "00" * 14))
    long = F.expr(_EXTENDED)
    six_head = F.concat(F.lit("86dd60000000"), h(f"CASE WHEN {_EXTENDED} THEN 24 ELSE 0 END + {size}", 2), F.when(long, F.lit("00")).otherwise(proto),
                        F.lit("40"), six("src_ip"), six("dst_ip"), F.when(long, more).otherwise(F.lit("")))
    tags = F.repeat(F.lit("81000005"), F.expr("CAST(seq % 3 AS int)"))
    return packets.select("seq", "ts", F.unhex(F.concat(F.lit("00" * 12), tags, F.when(F.expr(_SIX), six_head).otherwise(four), body)).alias("frame"))


_V6 = """concat('2001:db8::', lower(to_hex(cast(split_part({0}, '.', 1) AS int) * 256 + cast(split_part({0}, '.', 2) AS int))), ':',
    lower(to_hex(cast(split_part({0}, '.', 3) AS int) * 256 + cast(split_part({0}, '.', 4) AS int))))"""


@query("decode_frames", "packets", sql=f"""WITH p AS (SELECT *, CASE WHEN {_EXTENDED} THEN 64 WHEN {_SIX} THEN 40 ELSE 20 END AS ip_header,
    CASE protocol WHEN 'tcp' THEN 20 ELSE 8 END AS l4 FROM $packets)
  SELECT epoch_us(ts) AS us, CASE WHEN {_SIX} THEN {_V6.format("src_ip")} ELSE src_ip END AS src_ip,
         CASE WHEN {_SIX} THEN {_V6.format("dst_ip")} ELSE dst_ip END AS dst_ip, src_port, dst_port, upper(protocol) AS protocol,
         14 + 4 * (seq % 3) + ip_header + l4 + payload_len AS pkt_len, CASE protocol WHEN 'tcp' THEN tcp_flags ELSE 0 END AS tcp_flags,
         ip_header + l4 AS header_len, CASE protocol WHEN 'tcp' THEN win_size ELSE 0 END AS win_size, payload_len FROM p""")
def q_decode_frames(spark, packets):
    from flowtide.functions.time import micros
    from flowtide.sources.packets import decode_frames

    got = decode_frames(frames_of(packets))
    return got.withColumn("us", micros(got, "ts")).drop("ts")
