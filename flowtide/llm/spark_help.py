"""Helpers the corpus operators share: cuts in the lineage, prefix sums over hash buckets, components of a link graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtide.session import ensure_checkpoint_dir

#: Where a null doc_id sorts: behind every other document.
LAST_ID = 2**63 - 1


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the cluster's checkpoint folder; later plans start from those files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Shelf:
    """Parquet tables of one run in a folder of its own below the cluster's checkpoint folder.

    Every table is removed when it is no longer needed, or by ``close``. What an operator returns must not read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}", compression=compression)
        return self.read(df.schema, name)

    def read(self, schema, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names])

    def remove(self, *names: str) -> None:
        for n in names:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}" if n else self.folder)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        self.remove("")


def ident(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(LAST_ID))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it (Spark compares names without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def buckets_for(rows: int, each: int = 20_000) -> int:
    return max(1, -(-rows // each))


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``keys`` before this one, ordered by (bucket, order).

    Rows are summed inside (keys, bucket); one row per bucket is scanned per key and carried back, so a key with a
    large share of all rows is still spread over its buckets.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum")).select(
        *keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    rows = df.withColumn("_within", F.sum(value).over(inside) - F.col(value))
    return rows.join(carried, [*keys, bucket]).withColumn(out, F.col("_within") + F.col("_carry")).drop("_within", "_carry")


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected link table; root is the smallest node reachable.

    Large-star and small-star steps alternate until the links no longer change. Every step reduces a node's
    neighbours to their minimum before it is joined back, so a node with very many links needs no list of them.
    """
    links = cut(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        links = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == state:
            break
        state = (row.n, row.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
