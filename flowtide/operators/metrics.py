"""Classifier metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.operators.scan import ordered_scan


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, predicted, count) over the sorted union of labels, zeros kept."""
    counts = df.groupBy(F.col(y).alias("label"), F.col(p).alias("predicted")).agg(F.count("*").alias("count"))
    # One array of class names; the grid is unfolded from it.
    names = counts.agg(F.array_sort(F.array_distinct(F.concat(
        F.collect_set("label"), F.collect_set("predicted")))).alias("names"))
    grid = names.select(F.explode("names").alias("label"), "names").select("label", F.explode("names").alias("predicted"))
    return grid.join(counts, ["label", "predicted"], "left").select(
        "label", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_report(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    hit = F.when(F.col("label") == F.col("predicted"), F.col("count")).otherwise(0)
    parts = confusion.select(F.explode(F.array(
        F.struct(F.col("label").alias("label"), hit.alias("tp"), F.col("count").alias("support"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("count").alias("said")),
    )).alias("r")).select("r.*")
    sums = parts.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    scored = sums.withColumns({"precision": _ratio(F.col("tp"), F.col("said")), "recall": _ratio(F.col("tp"), F.col("support"))})
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select("label", "precision", "recall", f1.alias("f1"), "support", "tp")


def classification_metrics(report: DataFrame) -> DataFrame:
    """Accuracy and macro / support-weighted precision, recall, F1."""
    total = F.sum("support")
    weighted = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), total)
    return report.agg(
        _ratio(F.sum("tp"), total).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
        total.alias("test_samples"))


def roc_auc(df: DataFrame, y: str, scores: dict[str, Column]) -> DataFrame:
    """Macro average over the classes of the area under the ROC curve; null when a class is absent or alone, or
    a score is missing or not a number.

    ``scores`` maps class -> score column (one entry for the binary case). Ties count half. Equal scores are
    counted first; the ranks run over slices of the ordered scores.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("cls"), s.cast("double").alias("score"), (F.col(y) == c).alias("pos"))
        for c, s in scores.items()])).alias("r")).select("r.*")
    levels = long.groupBy("cls", "score").agg(F.count_if("pos").alias("pos"), F.count_if(~F.col("pos")).alias("neg"))
    ranked = ordered_scan(levels, ["cls"], ["score"], sums={"below": F.col("neg")}, inclusive=False)
    per_class = ranked.groupBy("cls").agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad"))
    auc = F.when(F.col("bad") == 0, F.try_divide(F.col("u"), (F.col("p") * F.col("n")).cast("double")))
    return per_class.agg(F.when(F.count(auc) == F.count("*"), F.avg(auc)).alias("roc_auc"))


def feature_importance(model, names: list[str], spark, k: int | None = None) -> DataFrame:
    """Feature weights of a fitted MLlib model, largest first: tree importances, or the mean absolute
    coefficient over the classes."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    else:
        values = []
    pairs = [(n, round(float(v), 6)) for n, v in zip(names, values)]
    ranked = spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return ranked if k is None else ranked.limit(k)


def rank_importance(importance: DataFrame) -> DataFrame:
    """Adds the 1-based rank; one row per feature."""
    from pyspark.sql import Window

    return importance.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
