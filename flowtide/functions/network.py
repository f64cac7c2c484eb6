"""Packet and address expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.schema import TCP_FLAGS

# Ports of name, address and time services.
INFRASTRUCTURE_PORTS = [53, 67, 68, 123, 137, 138, 1900, 3702, 5353, 5355]

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4_MULTICAST = rf"^(22[4-9]|23[0-9])(\.{_OCTET}){{3}}$"
_V4_BROADCAST = rf"^([0-9a-fA-F:]*:)?({_OCTET}\.){{3}}255$"
_V6_MULTICAST = r"^(?i)ff[0-9a-f]{2}(:[0-9a-f]{0,4}){2,7}(%.+)?$"

KEY_COLUMNS = ["k_proto", "k_ip_lo", "k_port_lo", "k_ip_hi", "k_port_hi"]


# What a packet field is when it is missing.
PACKET_DEFAULTS = {
    "src_ip": "0.0.0.0", "dst_ip": "0.0.0.0", "src_port": 0, "dst_port": 0, "protocol": "IP",
    "pkt_len": 60, "tcp_flags": 0, "header_len": 20, "win_size": 0, "payload_len": 0, "seq": 0,
}


def packet_defaults(df: DataFrame) -> DataFrame:
    """Adds missing packet columns and fills null fields."""
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        for name, value in PACKET_DEFAULTS.items()
    })


def flag(flags: Column, name: str) -> Column:
    """True when the named TCP flag bit is set."""
    return flags.bitwiseAND(F.lit(TCP_FLAGS[name])) != 0


def tcp_flags_decode(flags: Column) -> list[Column]:
    """One 0/1 column per TCP flag."""
    return [flag(flags, n).cast("int").alias(n) for n in TCP_FLAGS]


def is_infrastructure(dst_ip: Column, src_port: Column, dst_port: Column) -> Column:
    """Multicast, broadcast or a service port on either side."""
    address = (
        dst_ip.rlike(_V4_MULTICAST) | dst_ip.rlike(_V6_MULTICAST) | dst_ip.rlike(_V4_BROADCAST)
        | dst_ip.startswith("224.") | dst_ip.startswith("239.")
    )
    ports = dst_port.isin(INFRASTRUCTURE_PORTS) | src_port.isin(INFRASTRUCTURE_PORTS)
    return F.coalesce(address, F.lit(False)) | F.coalesce(ports, F.lit(False))


def normalize_protocol(protocol: Column) -> Column:
    """Protocol numbers to names; other text is upper-cased."""
    text = F.upper(F.trim(protocol.cast("string")))
    return (F.when(text.isin("6", "6.0"), "TCP").when(text.isin("17", "17.0"), "UDP")
            .when(text.isin("0", "1", "0.0", "1.0"), "ICMP").otherwise(text))


def with_flow_key(df: DataFrame) -> DataFrame:
    """Adds the direction-free key as flat columns, and ``is_lo``: sent by the lower endpoint."""
    swap = (F.col("src_ip") > F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") > F.col("dst_port")))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return df.withColumns({
        "k_proto": F.upper("protocol"),
        "k_ip_lo": pick("src_ip", "dst_ip"),
        "k_port_lo": pick("src_port", "dst_port"),
        "k_ip_hi": pick("dst_ip", "src_ip"),
        "k_port_hi": pick("dst_port", "src_port"),
        "is_lo": ~swap,
    })


def flow_key(df: DataFrame) -> DataFrame:
    """Adds ``flow_key``: STRUCT<protocol, lo STRUCT<ip, port>, hi STRUCT<ip, port>>."""
    src, dst = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(
        F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    return df.withColumn("flow_key", F.struct(
        F.upper("protocol").alias("protocol"), F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi")))


def safe_rate(amount: Column, seconds: Column) -> Column:
    """Amount per second with the duration floored at one microsecond."""
    return amount / F.greatest(seconds, F.lit(1e-6))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 when the denominator is zero."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def default_metadata(df: DataFrame, ip: str = "unknown") -> DataFrame:
    """Fills the missing address, port and protocol fields of scored rows."""
    return df.withColumns({
        "source_ip": F.coalesce("source_ip", F.lit(ip)),
        "destination_ip": F.coalesce("destination_ip", F.lit(ip)),
        "source_port": F.coalesce(F.col("source_port").cast("int"), F.lit(0)),
        "destination_port": F.coalesce(F.col("destination_port").cast("int"), F.lit(0)),
        "protocol": F.coalesce("protocol", F.lit("unknown")),
    })
