"""Running sums and maxima along a key, safe for keys that hold a large share of all rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here the rows are range-partitioned by
(key, order) and the partition number is the slice: a hot key is cut by its number of rows, wherever they lie. The
sliced rows are written once to the checkpoint folder, so every later step sees the same slices and the input is not
computed again. Rows are windowed inside (key, slice); each slice is also reduced to one summary row (map-side
combined before its shuffle), the summaries are scanned per key, and the carried-in value is joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.session import materialize

SLICE = "_slice"


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` stored with ``_slice``, the number of its range partition by (keys, order).

    Slices grow with ``order`` along a key; rows equal in keys and order share a slice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *keys, *order).withColumn(SLICE, F.spark_partition_id()))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    inclusive: bool = True,
    descending: bool = False,
) -> DataFrame:
    """Adds running sums, maxima and minima of ``order``-ed rows per key.

    With ``inclusive=False`` a row's own value is left out; ``descending=True`` scans from the last row to the
    first. Sums start at 0, maxima and minima at null. Null keys form their own group.
    """
    sums, maxes, mins = sums or {}, maxes or {}, mins or {}
    specs = ([(n, c, F.sum) for n, c in sums.items()] + [(n, c, F.max) for n, c in maxes.items()]
             + [(n, c, F.min) for n, c in mins.items()])
    base = sliced(df.withColumns({f"_v_{n}": c for n, c, _ in specs}), keys, order)
    if descending:
        base = base.withColumn(SLICE, -F.col(SLICE))
    by_order = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    inside = Window.partitionBy(*keys, SLICE).orderBy(*by_order)
    local = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = base.withColumns({f"_l_{n}": agg(f"_v_{n}").over(local) for n, _, agg in specs})

    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        base.groupBy(*keys, SLICE).agg(*[agg(f"_v_{n}").alias(f"_s_{n}") for n, _, agg in specs])
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(SLICE).alias("_at_slice"),
                *[agg(f"_s_{n}").over(before).alias(f"_c_{n}") for n, _, agg in specs])
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
                  F.col(SLICE) == F.col("_at_slice"))
    merged = rows.join(carried, same, "left")
    out = {}
    for n, _, agg in specs:
        mine, carry = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if agg is F.sum:
            out[n] = F.coalesce(mine, F.lit(0)) + F.coalesce(carry, F.lit(0))
        else:
            out[n] = (F.greatest if agg is F.max else F.least)(mine, carry)
    scratch = [*[f"_k{i}" for i in range(len(keys))], SLICE, "_at_slice"] + [f"_{p}_{n}" for p in "vlc" for n, _, _ in specs]
    return merged.withColumns(out).drop(*scratch)


def gap_sessions(
    df: DataFrame,
    keys: list[str],
    at: str,
    gap_us: int,
    sums: dict[str, Column],
    maxes: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per run of rows of a key with gaps below ``gap_us``: ``start_us``, ``end_us``, sums and maxima.

    Rows are first merged inside (key, slice). What crosses to the second step, per key, is at most one
    row per slice and per gap, so its size is bounded by the time span and not by the number of rows.
    """
    maxes = maxes or {}
    values = {**{f"_v_{n}": c for n, c in sums.items()}, **{f"_v_{n}": c for n, c in maxes.items()}}
    inside = Window.partitionBy(*keys, SLICE).orderBy(at)
    rows = sliced(df.select(*keys, F.col(at).alias(at), *[c.alias(n) for n, c in values.items()]), keys, [at])
    fresh = F.coalesce((F.col(at) - F.lag(at).over(inside) >= gap_us).cast("int"), F.lit(0))
    runs = rows.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(inside)).groupBy(
        *keys, SLICE, "_run").agg(
        F.min(at).alias("start_us"), F.max(at).alias("end_us"),
        *[F.sum(f"_v_{n}").alias(n) for n in sums], *[F.max(f"_v_{n}").alias(n) for n in maxes])
    along = Window.partitionBy(*keys).orderBy("start_us")
    apart = F.coalesce((F.col("start_us") - F.lag("end_us").over(along) >= gap_us).cast("int"), F.lit(0))
    return runs.withColumn("_fresh", apart).withColumn("_run", F.sum("_fresh").over(along)).groupBy(*keys, "_run").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxes]).drop("_run")
