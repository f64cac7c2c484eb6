"""Packet streams and raw frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.functions.network import packet_defaults
from flowtide.schema import PACKET_SCHEMA


def packet_source(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = PACKET_SCHEMA,
                  files_per_trigger: int = 100) -> DataFrame:
    """Streaming packets with defaults filled. ``files_per_trigger`` bounds the intake; nothing is dropped."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)
    return packet_defaults(raw).withColumn("ts", F.col("ts").cast("timestamp"))


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = PACKET_SCHEMA) -> DataFrame:
    return packet_defaults(spark.read.schema(schema).format(fmt).load(path))


def _uint(data: Column, pos: Column, n: int) -> Column:
    """Big-endian unsigned integer of n bytes at a 1-based position."""
    return F.conv(F.hex(F.substring(data, pos, F.lit(n))), 16, 10).cast("bigint")


def _ipv4(data: Column, pos: Column) -> Column:
    return F.concat_ws(".", *[_uint(data, pos + i, 1).cast("string") for i in range(4)])


def _ipv6(data: Column, pos: Column) -> Column:
    """Eight groups without leading zeros; the leftmost longest run of two or more zero groups becomes ``::``."""
    groups = [F.lower(F.conv(F.hex(F.substring(data, pos + 2 * i, F.lit(2))), 16, 16)) for i in range(8)]
    text = F.concat(F.lit(":"), *[F.concat(g, F.lit(":")) for g in groups])

    def short(t: Column) -> Column:
        found = [F.when(t.contains(":" + "0:" * run), F.regexp_replace(t, f"^(.*?):{'0:' * run}(.*)$", "$1::$2")) for run in range(8, 1, -1)]
        return F.coalesce(*found, t)

    # The outer colons were separators only. An array of one holds a value that is used several times.
    inner = F.transform(F.transform(F.array(text), short), lambda t: F.regexp_replace(F.regexp_replace(t, "^:(?!:)", ""), "(?<!:):$", ""))
    return F.transform(inner, lambda t: F.when(t == "", "::").otherwise(t))[0]


#: EtherTypes of VLAN tags; IPv6 headers that stand between the address header and the transport.
VLAN_TYPES = (0x8100, 0x88A8, 0x9100)
FRAGMENT, AUTHENTICATION, NO_NEXT_HEADER = 44, 51, 59
EXTENSION_HEADERS = (0, 43, FRAGMENT, AUTHENTICATION, 60, 135, 139, 140)


def decode_frames(df: DataFrame) -> DataFrame:
    """Ethernet frames (``frame`` BINARY, ``ts``) -> packet columns. Only IPv4 and IPv6 frames stay.

    VLAN tags are skipped, as many as there are, and so are IPv6 extension headers. TCP, UDP and ICMP fields are read;
    anything else (ICMPv6 and fragments behind the first too) is protocol "IP" without ports.
    """
    frame = F.col("frame")
    at = lambda pos, n=1: _uint(frame, F.lit(pos) if isinstance(pos, int) else pos.cast("int"), n)
    # Tags are four bytes each, so they are the longest run of such groups behind the addresses.
    tags = F.regexp_extract(F.hex(frame), "^.{24}((?:(?:" + "|".join(f"{t:04X}" for t in VLAN_TYPES) + ").{4})*)", 1)
    # Generators, so that what is found is computed once a frame and not once a use.
    rows = df.select("*", F.inline(F.array(F.struct((F.length(tags) / 2 + 13).cast("int")))).alias("_type_at"))
    rows = rows.withColumn("_type", at(F.col("_type_at"), 2)).where(F.col("_type").isin(0x0800, 0x86DD))
    v4, ip = F.col("_type") == 0x0800, F.col("_type_at") + 2

    # Behind an IPv6 address header: where the next header begins, what it is, and whether a first fragment goes on.
    chain = lambda pos, nxt, first: F.struct(pos.cast("int").alias("pos"), nxt.alias("next"), first.alias("first"))

    def skip(h, _):
        size = F.when(h["next"] == FRAGMENT, 8).when(h["next"] == AUTHENTICATION, (at(h["pos"] + 1) + 2) * 4).otherwise((at(h["pos"] + 1) + 1) * 8)
        first = F.coalesce((h["next"] != FRAGMENT) | (F.shiftright(at(h["pos"] + 2, 2), 3) == 0), F.lit(False))
        # A header that is cut off ends the chain.
        nxt = F.when(size.isNull(), F.lit(NO_NEXT_HEADER).cast("bigint")).otherwise(at(h["pos"]))
        go_on = h["first"] & h["next"].isin(*EXTENSION_HEADERS)
        return F.when(go_on, chain(h["pos"] + F.coalesce(size, F.lit(0)), nxt, first)).otherwise(h)

    start = chain(ip + 40, at(ip + 6), F.lit(True))
    # A chain has no more headers than eight bytes fit into the frame.
    turns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(frame) / 8).cast("int")))
    six = F.when(~v4 & at(ip + 6).isin(*EXTENSION_HEADERS), F.aggregate(turns, start, skip)).otherwise(start)
    rows = rows.select("*", F.inline(F.array(six)).alias("_l4_at", "_l4_type", "_l4_first")).withColumns({
        "_iphdr": F.when(v4, at(ip).bitwiseAND(F.lit(15)) * 4).otherwise(F.col("_l4_at") - ip),
        "_next": F.when(v4, at(ip + 9)).otherwise(F.col("_l4_type")),
        "_iplen": F.when(v4, at(ip + 2, 2)).otherwise(at(ip + 4, 2) + 40),
        # Only the first fragment of a packet has the transport header.
        "_first": F.when(v4, at(ip + 6, 2).bitwiseAND(F.lit(0x1FFF)) == 0).otherwise(F.col("_l4_first")),
    })
    l4 = (F.col("_iphdr") + ip).cast("int")
    proto = (F.when(~F.col("_first"), "IP").when(F.col("_next") == 6, "TCP").when(F.col("_next") == 17, "UDP")
             .when(v4 & (F.col("_next") == 1), "ICMP").otherwise("IP"))
    rows = rows.withColumn("protocol", proto)
    tcp, ports = F.col("protocol") == "TCP", F.col("protocol").isin("TCP", "UDP")
    tcp_header = F.shiftright(at(l4 + 12), 4) * 4
    l4_header = F.when(tcp, tcp_header).when(F.col("protocol").isin("UDP", "ICMP"), 8).otherwise(0)
    header = F.col("_iphdr") + l4_header
    return rows.select(
        F.when(v4, _ipv4(frame, ip + 12)).otherwise(_ipv6(frame, ip + 8)).alias("src_ip"),
        F.when(v4, _ipv4(frame, ip + 16)).otherwise(_ipv6(frame, ip + 24)).alias("dst_ip"),
        F.when(ports, at(l4, 2)).otherwise(0).cast("int").alias("src_port"),
        F.when(ports, at(l4 + 2, 2)).otherwise(0).cast("int").alias("dst_port"),
        "protocol", F.length(frame).alias("pkt_len"), "ts",
        F.when(tcp, at(l4 + 13)).otherwise(0).cast("int").alias("tcp_flags"),
        F.greatest(F.lit(20), header).cast("int").alias("header_len"),
        F.when(tcp, at(l4 + 14, 2)).otherwise(0).cast("int").alias("win_size"),
        F.when(ports, F.greatest(F.lit(0), F.col("_iplen") - header)).otherwise(0).cast("int").alias("payload_len"))
