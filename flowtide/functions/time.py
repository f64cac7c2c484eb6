"""Exact microsecond time columns for TIMESTAMP and TIMESTAMP_NTZ inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(df: DataFrame, name: str) -> Column:
    """``name`` as BIGINT microseconds; NTZ values are read as UTC wall clock."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.LongType):
        return F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))


def date_parts(ts: Column) -> list[Column]:
    """Year, month, day and hour of a timestamp."""
    return [F.year(ts).alias("year"), F.month(ts).alias("month"),
            F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour")]


def parse_flow_timestamp(text: Column) -> Column:
    """``dd/MM/yyyy hh:mm:ss a`` text to a timestamp, null when it does not parse."""
    return F.try_to_timestamp(text, F.lit("dd/MM/yyyy hh:mm:ss a"))
