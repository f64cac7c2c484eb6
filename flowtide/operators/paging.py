"""Sorts, limits and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.operators.filters import filter_eq

MAX_PER_PAGE = 100


def _paginate(df: DataFrame, page: int, per_page: int, by: str, equals: dict) -> tuple[DataFrame, DataFrame]:
    rows = filter_eq(df, **equals)
    shown = rows.orderBy(F.desc(by), F.desc("id")).offset((page - 1) * per_page).limit(per_page)
    totals = rows.agg(F.count("*").alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(per_page).alias("per_page"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("bigint").alias("pages"))
    return shown, totals


def paginate_detections(df: DataFrame, page: int = 1, per_page: int = 20, **equals):
    """(page rows, totals row), newest first. At most 100 rows per page."""
    return _paginate(df, page, min(per_page, MAX_PER_PAGE), "timestamp", equals)


def paginate_alerts(df: DataFrame, page: int = 1, per_page: int = 20, **equals):
    return _paginate(df, page, min(per_page, MAX_PER_PAGE), "timestamp", equals)


def paginate_audit(df: DataFrame, page: int = 1, per_page: int = 20, **equals):
    return _paginate(df, page, per_page, "timestamp", equals)


def next_page(df: DataFrame, per_page: int, before: tuple | None = None) -> DataFrame:
    """Keyset paging: the rows after ``before`` = (timestamp, id) of the last row shown; no offset is read."""
    if before is not None:
        at, last_id = F.lit(before[0]), F.lit(before[1])
        df = df.where((F.col("timestamp") < at) | ((F.col("timestamp") == at) & (F.col("id") < last_id)))
    return df.orderBy(F.desc("timestamp"), F.desc("id")).limit(per_page)


def recent_detections(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def newest_first(df: DataFrame, by: str, tie: str) -> DataFrame:
    """Registry and dataset lists: latest first."""
    return df.orderBy(F.desc(by), tie)


def list_models(df: DataFrame) -> DataFrame:
    return newest_first(df, "created_at", "model_id")


def list_datasets(df: DataFrame) -> DataFrame:
    return newest_first(df, "uploaded_at", "name")


def sort_multi(df: DataFrame, keys: list[tuple[str, int]]) -> DataFrame:
    """Several keys, 1 ascending or -1 descending; null sorts as 0 in number columns, as '' in text."""
    kinds = dict(df.dtypes)

    def key(name: str, direction: int) -> Column:
        value = F.coalesce(F.col(name), F.lit("" if kinds[name] == "string" else 0))
        return value.asc() if direction > 0 else value.desc()

    return df.orderBy(*[key(n, d) for n, d in keys])


def limit_n(df: DataFrame, n: int) -> DataFrame:
    """The first n rows; no limit when n <= 0."""
    return df.limit(n) if n > 0 else df


def last_events(df: DataFrame, n: int = 500) -> DataFrame:
    """The newest n events by id."""
    return df.orderBy(F.desc("id")).limit(n)


def poll_events(df: DataFrame, since_id: int = 0, limit: int = 50) -> DataFrame:
    """The last ``limit`` events after ``since_id``, ascending; 0 means all."""
    after = df.where(F.col("id") > since_id)
    if limit > 0:
        after = after.orderBy(F.desc("id")).limit(limit)
    return after.orderBy("id")


def row_index_preview(df: DataFrame, order: list[str], n: int = 50) -> DataFrame:
    """The first n rows with a 1-based ``row_index``. Only the n rows reach the numbering window."""
    from pyspark.sql import Window

    top = df.orderBy(*order).limit(n)
    return top.withColumn("row_index", F.row_number().over(Window.orderBy(*order)))


def alert_cap(df: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The first n intrusions in row order."""
    return df.where("is_intrusion").orderBy(*order).limit(n)
