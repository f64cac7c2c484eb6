"""Collects the queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

from flowtide.checks.mapping import frame, with_ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, *frames: str, sql: str | None = None):
    """Registers a function of (spark, *frames) as a query; ``$frame`` in ``sql`` names a mapping."""

    def register(fn):
        def run(spark, sf_dir):
            return fn(spark, *[
                spark.read.parquet(f"{sf_dir}/{f[1:]}.parquet") if f.startswith("@") else frame(spark, sf_dir, f)
                for f in frames])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register
