"""Scoring flow rows in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.labels import assign_severity, is_intrusion, max_probability, normalize_label, prediction_status
from flowtide.operators.filters import normalize_columns, to_numeric_clean
from flowtide.plans.training import TrainedModel, apply_model, evaluate
from flowtide.operators.prep import prepare_raw
from flowtide.schema import FEATURE_COLUMNS, FEATURE_NAMES


def score_batch(df: DataFrame, model: TrainedModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw flow rows (any header spelling) -> ``keep`` plus the prediction columns. One lazy plan, also for streams."""
    named = normalize_columns(df, keep).drop("label")
    features = [c for c in named.columns if c in FEATURE_NAMES]
    return _predictions(apply_model(to_numeric_clean(named, features), model, keep), model)


def score_flows(features: DataFrame, model: TrainedModel, keep: tuple[str, ...]) -> DataFrame:
    """``flow_features`` rows, of a batch or a stream -> ``keep`` plus the prediction columns."""
    renamed = features.select(*keep, *[F.col(c).alias(n) for c, n in zip(FEATURE_COLUMNS, FEATURE_NAMES)])
    return _predictions(apply_model(renamed, model, keep), model)


def _predictions(scored: DataFrame, model: TrainedModel) -> DataFrame:
    done = scored.withColumns({"prediction": normalize_label(F.col("raw_prediction")),
                               "confidence": max_probability(F.col("_p"))}).drop("_p")
    return done.withColumns({
        "status": prediction_status(F.col("prediction")),
        "is_intrusion": is_intrusion(F.col("prediction")),
        "severity": assign_severity(F.col("prediction"), F.col("confidence")),
        "model_version": F.lit(model.version),
    })


def evaluate_saved_model(spark, path: str, df: DataFrame) -> DataFrame:
    """Metrics of a stored model on a raw labelled dataset."""
    from flowtide.sources.models import load_model

    return evaluate(load_model(spark, path), prepare_raw(df)[0])
