"""Row filters and column projections over detections, alerts and flow rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.schema import CANONICAL_BY_KEY, LABEL_COLUMNS, METADATA_COLUMNS


def filter_eq(df: DataFrame, **equals) -> DataFrame:
    """All given equalities; a None value means no filter on that column."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])),
                  [kv for kv in equals.items() if kv[1] is not None], df)


def filter_ne(df: DataFrame, col: str, value) -> DataFrame:
    """Not equal; null rows stay."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


def filter_range(df: DataFrame, col: str, ge=None, le=None) -> DataFrame:
    """Inclusive bounds; null rows go."""
    if ge is not None:
        df = df.where(F.col(col) >= F.lit(ge))
    return df if le is None else df.where(F.col(col) <= F.lit(le))


def filter_in(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.where(F.col(col).isin(values))


def filter_exists(df: DataFrame, col: str, exists: bool = True) -> DataFrame:
    return df.where(F.col(col).isNotNull() if exists else F.col(col).isNull())


def search_regex(df: DataFrame, pattern: str,
                 cols: tuple[str, ...] = ("source_ip", "destination_ip", "prediction")) -> DataFrame:
    """Case-insensitive find in any of the columns."""
    hits = [F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False)) for c in cols]
    return df.where(reduce(lambda a, b: a | b, hits))


def lookup_by_id(df: DataFrame, value, cols: tuple[str, ...] = ("id",)) -> DataFrame:
    """The row whose id equals ``value`` (in any of ``cols``), or none."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c) == F.lit(value) for c in cols])).limit(1)


def filter_or_and(df: DataFrame, any_of: list[dict]) -> DataFrame:
    """Rows that meet all equalities of at least one dict."""
    groups = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in g.items()]) for g in any_of]
    return df.where(reduce(lambda a, b: a | b, groups))


def find_label_column(columns: list[str]) -> str | None:
    """First header that, stripped, is a label header."""
    return next((c for c in columns if c.strip() in LABEL_COLUMNS), None)


def _by_name(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def normalize_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical feature columns (the first header wins per feature) plus ``label`` and ``keep``."""
    picked: dict[str, str] = {}
    for column in df.columns:
        name = CANONICAL_BY_KEY.get(column.strip().lower())
        if name and column not in keep:
            picked.setdefault(name, column)
    label = find_label_column(df.columns)
    return df.select(
        *[_by_name(c) for c in keep], *[_by_name(raw).alias(name) for name, raw in picked.items()],
        *([_by_name(label).alias("label")] if label else []))


def drop_metadata(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.strip() in METADATA_COLUMNS])


def clean_number(value: Column) -> Column:
    """Text or number to a finite DOUBLE, anything else to null."""
    number = value.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def to_numeric_clean(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: clean_number(_by_name(c)) for c in cols})


def align_features(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly ``names`` in order; an absent column is 0.0."""
    have = set(df.columns)
    return df.select(*keep, *[(_by_name(n) if n in have else F.lit(0.0)).alias(n) for n in names])
