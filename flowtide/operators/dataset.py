"""Profile and verdict of a raw flow dataset (all columns text, as ``read_flow_csv`` gives them)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.operators.filters import _by_name, find_label_column
from flowtide.operators.sets import is_known_label, recognized_feature_names
from flowtide.schema import MIN_FEATURES

# Limits of a usable data set; the texts of dataset_verdict must match too.
MIN_ROWS = 100
HIGH_MISSING_PERCENT = 30
HIGH_DUPLICATE_SHARE = 0.5
#: Names a warning lists at most.
NAMED_LABELS = 100


def _total(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values, F.lit(0).cast("bigint"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: sizes, recognised features, missing cells (infinite numbers count), column kinds. One pass."""
    aggs = [F.count("*").alias("rows")]
    for i, name in enumerate(df.columns):
        text = _by_name(name).cast("string")
        number = text.try_cast("double")
        aggs += [F.count_if(text.isNull()).alias(f"null_{i}"),
                 F.count_if(text.isNotNull() & number.isNull()).alias(f"text_{i}"),
                 F.count_if(F.isnan(number) | (F.abs(number) == float("inf"))).alias(f"inf_{i}")]
    n = len(df.columns)
    numeric = [F.col(f"text_{i}") == 0 for i in range(n)]
    missing = _total([F.col(f"null_{i}") + F.when(numeric[i], F.col(f"inf_{i}")).otherwise(0) for i in range(n)])
    numeric_columns = _total([k.cast("bigint") for k in numeric])
    label = find_label_column(df.columns)
    return df.agg(*aggs).select(
        F.col("rows").alias("total_rows"), F.lit(n).cast("bigint").alias("total_columns"),
        F.lit(label.strip() if label else None).cast("string").alias("label_column"),
        F.lit(len(recognized_feature_names(df.columns))).cast("bigint").alias("recognized_features"),
        F.lit(n - (1 if label else 0)).cast("bigint").alias("total_features"),
        missing.alias("missing_values"), numeric_columns.alias("numeric_columns"),
        (F.lit(n) - numeric_columns).cast("bigint").alias("non_numeric_columns"),
    ).withColumn("missing_rate", F.coalesce(F.round(F.try_divide(
        F.col("missing_values"), F.col("total_rows") * F.col("total_columns")) * 100, 2), F.lit(0.0)))


def dataset_preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows as text, null as ''."""
    return df.limit(n).select(*[F.coalesce(_by_name(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def label_distribution(df: DataFrame) -> DataFrame:
    """Rows per raw label, nulls left out."""
    label = _by_name(find_label_column(df.columns))
    return df.where(label.isNotNull()).groupBy(label.alias("label")).agg(F.count("*").alias("count"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows.

    In a column of numbers, numbers compare by value and infinities as missing; a column with any other text
    compares as text. Rows are grouped by a 128-bit hash of their cells, so the shuffle does not carry them.
    """
    texts = [_by_name(name).cast("string") for name in df.columns]
    # One pass tells the kinds of the columns; they are fitted values of the data set.
    odd = df.agg(*[F.count_if(t.isNotNull() & t.try_cast("double").isNull()).alias(f"t{i}") for i, t in enumerate(texts)]).first()
    cells = []
    for i, text in enumerate(texts):
        number = text.try_cast("double")
        lost = F.isnan(number) | (F.abs(number) == float("inf"))
        cells.append(text if odd[i] else F.when(lost, None).otherwise(number.cast("string")))
    # A null is hashed as a cell of its own, so that (null, 'a') and ('a', null) differ.
    marked = [F.struct(c.isNull(), F.coalesce(c, F.lit(""))) for c in cells]
    return df.select(F.xxhash64(*marked).alias("h1"), F.xxhash64(F.lit(1), *marked).alias("h2")).groupBy("h1", "h2").count().agg(
        F.coalesce(F.sum("count") - F.count("*"), F.lit(0)).alias("duplicate_rows"))


def _unknown_names(labels: DataFrame) -> DataFrame:
    """One row with the most frequent unknown labels of (label, count), in order."""
    top = labels.where(~is_known_label(F.col("label"))).orderBy(F.desc("count"), "label").limit(NAMED_LABELS)
    order = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "label")))
    return top.agg(F.transform(order, lambda x: x["label"]).alias("unknown"))


def dataset_verdict(df: DataFrame) -> DataFrame:
    """One row: ``valid``, ``errors`` and ``warnings`` of a dataset.

    The warning names the ``NAMED_LABELS`` most frequent unknown labels; ``unknown_labels`` gives all.
    """
    label = find_label_column(df.columns)
    row = dataset_profile(df).withColumn("_one", F.lit(1)).join(
        duplicate_rows(df).withColumn("_one", F.lit(1)), "_one")
    unknown = _unknown_names(label_distribution(df)) if label else df.sparkSession.createDataFrame([([],)], "unknown array<string>")
    row = row.join(unknown.withColumn("_one", F.lit(1)), "_one")
    c = F.col
    error = F.array_compact(F.array(
        F.when(c("total_rows") < MIN_ROWS, F.format_string(
            f"Dataset has only %d rows. Minimum {MIN_ROWS} required.", c("total_rows"))),
        F.when(c("label_column").isNull(), "No label column found. Expected one of: Label, Class, Attack, Category."),
        F.when(c("recognized_features") < MIN_FEATURES, F.format_string(
            f"Only %d recognized feature columns found. Minimum {MIN_FEATURES} required. "
            "Dataset may be incompatible.", c("recognized_features"))),
    ))
    warning = F.array_compact(F.array(
        F.when(F.size("unknown") > 0, F.concat(
            F.lit("Unknown labels (will be mapped to 'Unknown'): ['"), F.array_join("unknown", "', '"), F.lit("']"))),
        F.when(c("missing_rate") > HIGH_MISSING_PERCENT, F.concat(
            F.lit("High missing value rate: "), c("missing_rate").cast("string"), F.lit("%"))),
        F.when(c("duplicate_rows") > c("total_rows") * HIGH_DUPLICATE_SHARE, F.format_string(
            "High duplicate rate: %d/%d rows are duplicates.", c("duplicate_rows"), c("total_rows"))),
    ))
    return row.select((F.size(error) == 0).alias("valid"), error.alias("errors"), warning.alias("warnings"))
