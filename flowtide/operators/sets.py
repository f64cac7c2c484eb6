"""Set operators over labels and feature names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.labels import LABEL_CATEGORIES, label_key
from flowtide.schema import CANONICAL_BY_KEY, FEATURE_NAMES


def merge_directions(fwd: DataFrame, bwd: DataFrame) -> DataFrame:
    """Bag union of the rows of both directions."""
    return fwd.unionByName(bwd)


def label_union(df: DataFrame, y: str, p: str) -> DataFrame:
    """Sorted distinct labels among true and predicted ones."""
    both = df.select(F.explode(F.array(y, p)).alias("label"))
    return both.distinct().orderBy("label")


def distinct_classes(df: DataFrame, y: str) -> DataFrame:
    return df.select(F.col(y).alias("label")).distinct().orderBy("label")


def is_known_label(label: Column) -> Column:
    """True when a label maps to a category, exactly or by containment."""
    key = label_key(label)
    return reduce(lambda a, raw: a | key.contains(raw) | F.lit(raw).contains(key), LABEL_CATEGORIES, F.lit(False))


def unknown_labels(df: DataFrame, label: str) -> DataFrame:
    """Distinct non-null labels that map to no category."""
    distinct = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    return distinct.where(~is_known_label(F.col("label")))


def recognized_feature_names(columns: list[str]) -> list[str]:
    """Canonical names the headers map to, in header order, repeats kept."""
    keys = [c.strip().lower() for c in columns]
    return [CANONICAL_BY_KEY[k] for k in keys if k in CANONICAL_BY_KEY]


def recognized_features(df: DataFrame) -> DataFrame:
    """Canonical features some column maps to, each with its number of filled cells (first header wins)."""
    picked: dict[str, str] = {}
    for column, name in ((c, CANONICAL_BY_KEY.get(c.strip().lower())) for c in df.columns):
        if name:
            picked.setdefault(name, column)
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(picked.values())])
    return filled.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"n{i}").alias("filled")) for i, n in enumerate(picked)
    ])).alias("r")).select("r.*")


def missing_features(df: DataFrame) -> DataFrame:
    """Canonical features that no column maps to, with the number of rows that take 0.0 for them."""
    have = set(recognized_feature_names(df.columns))
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES if n not in have])
    return df.agg(F.count("*").alias("rows")).select(F.explode(names).alias("feature"), "rows")
