"""Preprocessing: exact medians, scaling, splits, class weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtide.functions.labels import with_category
from flowtide.operators.filters import align_features, drop_metadata, find_label_column, normalize_columns, to_numeric_clean
from flowtide.operators.scan import ordered_scan
from flowtide.schema import FEATURE_NAMES, MIN_FEATURES

_BINS = 4096


@dataclass(frozen=True)
class FeatureStats:
    """Fitted values per feature, in feature order."""

    names: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.names, self.medians, self.means, self.stds)),
                                     "feature string, median double, mean double, std double")

    @staticmethod
    def from_df(df: DataFrame, order: list[str]) -> "FeatureStats":
        rows = {r.feature: r for r in df.collect()}
        picked = [rows[n] for n in order]
        return FeatureStats(tuple(order), tuple(r["median"] for r in picked), tuple(r["mean"] for r in picked),
                            tuple(r["std"] for r in picked))


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact median per column over its non-null values; 0.0 for a column without values.

    Every pass counts the values between two bounds in equal-width bins and keeps the bin that holds the
    middle rank, until the bin has a single value; a pass moves at most bins x columns counters.
    """
    first = df.agg(*[f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(cols)
                     for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    counts = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    # Target t = (column, rank); bounds are narrowed until they meet.
    targets = {}
    for i, c in enumerate(cols):
        if counts[c]:
            for rank in {(counts[c] - 1) // 2, counts[c] // 2}:
                targets[(c, rank)] = [first[f"lo{i}"], first[f"hi{i}"], rank]
    while True:
        todo = {t: b for t, b in targets.items() if b[0] < b[1]}
        if not todo:
            break
        names = list(todo)
        cells = []
        for t, key in enumerate(names):
            lo, hi, _ = todo[key]
            v = F.col(f"`{key[0]}`")
            inside = (v >= lo) & (v <= hi)
            # Halved bounds keep the width finite.
            place = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
            cells.append(F.struct(F.lit(t).alias("t"), F.when(inside, F.least(
                F.floor(place * _BINS).cast("int"), F.lit(_BINS - 1))).alias("bin"), v.alias("v")))
        binned = (df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("bin IS NOT NULL")
                  .groupBy("t", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
        # At most _BINS rows per target reach this window.
        upto = F.sum("n").over(Window.partitionBy("t").orderBy("bin"))
        ranks = F.create_map(*[F.lit(x) for t, key in enumerate(names) for x in (t, todo[key][2])])
        hit = binned.withColumn("upto", upto).where(
            (F.col("upto") > ranks[F.col("t")]) & (F.col("upto") - F.col("n") <= ranks[F.col("t")]))
        for r in hit.collect():
            bounds = targets[names[r.t]]
            targets[names[r.t]] = [r.lo, r.hi, bounds[2] - (r.upto - r.n)]
    out = {}
    for c in cols:
        found = [targets[(c, rank)][0] for rank in ((counts[c] - 1) // 2, counts[c] // 2)] if counts[c] else [0.0]
        out[c] = float(sum(found) / len(found))
    return out


def fit_median_impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the median of every column."""
    medians = exact_medians(df, cols)
    return df.sparkSession.createDataFrame([tuple(medians[c] for c in cols)], ", ".join(f"`{c}` double" for c in cols))


def sketched_medians(df: DataFrame, cols: list[str], accuracy: int = 10_000) -> dict[str, float]:
    """A median per column from one pass with mergeable quantile sketches; 0.0 for a column without values.

    The value is one of the column's; its rank is off by at most n / ``accuracy``. Use it where ``exact_medians``'s
    further passes cost too much.
    """
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`"), 0.5, accuracy).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: float(row[i]) if row[i] is not None else 0.0 for i, c in enumerate(cols)}


def fit_standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column mean and population standard deviation, 1.0 where that is 0 (feature, mean, std)."""
    wide = df.agg(*[f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(cols)
                    for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    fix = lambda s: F.when(F.coalesce(s, F.lit(0.0)) == 0, 1.0).otherwise(s)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"m{i}"), F.lit(0.0)).alias("mean"),
                 fix(F.col(f"s{i}")).alias("std")) for i, c in enumerate(cols)])).alias("r")).select("r.*")


def fit_stats(df: DataFrame, cols: list[str]) -> FeatureStats:
    """Medians, then mean and deviation of the imputed columns."""
    medians = exact_medians(df, cols)
    filled = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(medians[c])).alias(c) for c in cols])
    scale = {r.feature: r for r in fit_standard_scale(filled, cols).collect()}
    return FeatureStats(tuple(cols), tuple(medians[c] for c in cols), tuple(scale[c]["mean"] for c in cols),
                        tuple(scale[c]["std"] for c in cols))


def prepare_raw(df: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Raw flow rows -> numeric canonical features in order plus ``label`` (category) and ``keep``."""
    if not find_label_column(df.columns):
        raise ValueError("No label column found. Expected one of: Label, Class, Attack.")
    named = normalize_columns(drop_metadata(df), keep)
    features = [n for n in FEATURE_NAMES if n in named.columns]
    clean = with_category(to_numeric_clean(named, features), "label", "label")
    return clean.select(*keep, *features, "label"), features


def _require_features(features: list[str], minimum: int) -> None:
    if len(features) < minimum:
        raise ValueError(f"Too few recognizable feature columns: {len(features)}. Dataset may be incompatible.")


def preprocess_transform(df: DataFrame, stats: FeatureStats, keep: tuple[str, ...] = ()) -> DataFrame:
    """Aligned, imputed, scaled features. A missing column is 0.0 before scaling, a missing value the median."""
    have = [c for c in stats.names if c in df.columns]
    aligned = align_features(to_numeric_clean(df, have), list(stats.names), keep)
    return aligned.select(*keep, *[
        ((F.coalesce(F.col(f"`{n}`"), F.lit(m)) - F.lit(mean)) / F.lit(std)).alias(n)
        for n, m, mean, std in zip(stats.names, stats.medians, stats.means, stats.stds)])


def preprocess_fit_transform(df: DataFrame, fit_rows: DataFrame | None = None, keep: tuple[str, ...] = (),
                             min_features: int = MIN_FEATURES) -> tuple[DataFrame, FeatureStats]:
    """Scaled features with ``label`` and ``keep``, and the fitted values.

    The values are fitted on ``fit_rows`` (raw training rows), by default on all of ``df``.
    """
    rows, features = prepare_raw(df, keep)
    _require_features(features, min_features)
    stats = fit_stats(rows if fit_rows is None else prepare_raw(fit_rows, keep)[0], features)
    return preprocess_transform(rows, stats, (*keep, "label")), stats


def stratified_split(df: DataFrame, y: str, row_id: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: round(test_size x n) rows of every class, picked by a seeded hash of ``row_id``.

    Classes are ranked in slices of the hash, so a class with most of the rows is spread over tasks.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed)))))
    ranked = ordered_scan(hashed, [y], ["_h", row_id], sums={"_rank": F.lit(1)})
    sizes = df.groupBy(F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    if sizes.where("_n < 2").limit(1).count():
        raise ValueError("The least populated class has only 1 member, which is too few.")
    joined = ranked.join(sizes, ranked[y] == F.col("_y"), "left")
    in_test = F.col("_rank") <= F.round(F.col("_n") * test_size)
    return joined.withColumn("is_test", F.coalesce(in_test, F.lit(False))).drop("_h", "_rank", "_y", "_n")


def class_weights_balanced(df: DataFrame, y: str) -> DataFrame:
    """Per class: rows and weight n / (classes x rows). The window sees one row per class."""
    sizes = df.groupBy(F.col(y).alias("label")).agg(F.count("*").alias("count"))
    every = Window.partitionBy()
    return sizes.withColumn("weight", F.sum("count").over(every) / (F.count("*").over(every) * F.col("count")))


def with_class_weights(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    weights = class_weights_balanced(df, y).select(F.col("label").alias("_label"), F.col("weight").alias(out))
    return df.join(weights, df[y] == F.col("_label"), "left").drop("_label")
