"""Training, comparison and evaluation of flow classifiers on MLlib."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest, OneVsRestModel,
    RandomForestClassifier)
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.labels import probability_map
from flowtide.operators import metrics as met
from flowtide.operators.calibration import fit_sigmoids, normalised
from flowtide.operators.filters import align_features
from flowtide.operators.prep import (
    FeatureStats, _require_features, class_weights_balanced, fit_stats, prepare_raw, stratified_split)
from flowtide.schema import MIN_FEATURES
from flowtide.session import ensure_checkpoint_dir, materialize
from flowtide.sources.flow_csv import read_head

MIN_TRAINING_ROWS = 100


@dataclass(frozen=True)
class ModelType:
    """A registered estimator: ``build(params, rows)`` gives the MLlib estimator.

    A parameter ``folds`` of margin models is the number of parts whose margins, from models fitted on the other parts,
    calibrate the probabilities; 0 for none. ``task_rows``: an input with fewer partitions than one per so many rows is dealt over more of them, up to the cores.
    """

    label: str
    build: Callable
    params: dict = field(default_factory=dict)
    fourier: bool = False
    task_rows: int | None = None


def _random_forest(p, rows):
    return RandomForestClassifier(labelCol="y", featuresCol="x", weightCol="weight", **p)


def _decision_tree(p, rows):
    return DecisionTreeClassifier(labelCol="y", featuresCol="x", weightCol="weight", **p)


def _logistic_regression(p, rows):
    return LogisticRegression(labelCol="y", featuresCol="x", weightCol="weight", standardization=False,
                              regParam=1.0 / max(rows, 1), **p)


def _svm(p, rows):
    svc = LinearSVC(regParam=1.0 / max(rows, 1), standardization=False, **{k: v for k, v in p.items() if k not in ("dimensions", "folds", "parallelism")})
    # The classes' fits are many short jobs; side by side they fill the cores.
    return OneVsRest(classifier=svc, labelCol="y", featuresCol="x", weightCol="weight", parallelism=p["parallelism"])


MODEL_TYPES: dict[str, ModelType] = {
    # The node of every row and tree is kept with the rows; without that each pass ships the trees grown so far.
    "random_forest": ModelType("Random Forest", _random_forest, dict(
        numTrees=100, maxDepth=20, minInstancesPerNode=2, seed=42, maxMemoryInMB=512, cacheNodeIds=True, checkpointInterval=10),
        task_rows=15_000),
    "logistic_regression": ModelType("Logistic Regression", _logistic_regression, dict(maxIter=1000)),
    "decision_tree": ModelType("Decision Tree", _decision_tree, dict(maxDepth=20, seed=42, maxMemoryInMB=512)),
    "svm": ModelType("Support Vector Machine", _svm, dict(maxIter=100, dimensions=64, folds=3, parallelism=8), fourier=True),
}


def register_model_type(name: str, model_type: ModelType) -> None:
    """Adds an estimator to the registry."""
    MODEL_TYPES[name] = model_type


@dataclass(frozen=True)
class TrainedModel:
    """Scaling, classifier and label decoding as one pipeline over aligned numeric features."""

    pipeline: PipelineModel
    stats: FeatureStats
    classes: tuple[str, ...]
    version: str
    model_type: str


def _scaler(stats: FeatureStats) -> SQLTransformer:
    cols = ", ".join(f"(coalesce(`{n}`, {m!r}D) - {mean!r}D) / {std!r}D AS s_{i}" for i, (n, m, mean, std) in enumerate(
        zip(stats.names, stats.medians, stats.means, stats.stds)))
    return SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__")


def _fourier(d: int, dimensions: int, seed: int = 42) -> SQLTransformer:
    """Random Fourier features of the scaled columns: a linear model on them approximates an RBF kernel
    (Rahimi and Recht, 2007)."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, np.sqrt(2.0 / d), (dimensions, d))
    shifts = rng.uniform(0.0, 2 * np.pi, dimensions)
    term = lambda w: " + ".join(f"{float(v)!r}D * s_{i}" for i, v in enumerate(w))
    scale = float(np.sqrt(2.0 / dimensions))
    cols = ", ".join(f"{scale!r}D * cos({term(w)} + {float(b)!r}D) AS r_{j}" for j, (w, b) in enumerate(zip(weights, shifts)))
    return SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__")


def _margins(models, inputs: list[str], labels: list[str], sigmoids: list[tuple[float, float]]) -> SQLTransformer:
    """The margins of one linear model per class and the class with the largest, as plain expressions; with
    ``sigmoids`` also the classes' probabilities, each on its own."""
    line = lambda m: " + ".join([f"{float(m.intercept)!r}D", *(
        f"{float(w)!r}D * {c}" for w, c in zip(m.coefficients.toArray(), inputs))])
    margins = ", ".join(line(m) for m in models)
    names = ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in labels)
    own = ", ".join(f"1.0D / (1.0D + exp(least({a!r}D * margins[{c}] + {b!r}D, 700.0D)))" for c, (a, b) in enumerate(sigmoids))
    calibrated = f", array({own}) AS sigmoids" if sigmoids else ""
    return SQLTransformer(statement=(
        f"SELECT *, element_at(array({names}), cast(array_position(margins, array_max(margins)) AS int)) AS raw_prediction"
        f"{calibrated} FROM (SELECT *, array({margins}) AS margins FROM __THIS__)"))


def _unseen_margins(instances: DataFrame, fit: Callable, folds: int) -> DataFrame:
    """``y`` and the ``margins`` of every row, from models fitted on the parts of ``instances`` it does not belong to.

    Parts are cut by a hash of the row, so equal rows share a part and a task that runs again gives the same parts.
    """
    from pyspark.ml.functions import vector_to_array

    parted = instances.withColumn("part", F.pmod(F.xxhash64(vector_to_array("x"), "y"), F.lit(folds)))
    out = []
    for part in range(folds):
        models = fit(parted.where(F.col("part") != part)).models
        # As expressions: a fitted model holds the session in its summary and cannot be sent to tasks in every session.
        line = lambda m: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(w)) for w in m.coefficients.toArray()]), lambda a, b: a * b),
                                     F.lit(float(m.intercept)), lambda a, b: a + b)
        rows = parted.where(F.col("part") == part).select("y", vector_to_array("x").alias("v"))
        out.append(rows.select("y", F.array(*map(line, models)).alias("margins")))
    return reduce(DataFrame.unionByName, out)


def _without_summary(model, spark: SparkSession):
    """``model`` saved and read again: the summary of a fit on two classes holds the session, which Spark cannot send to
    tasks once any DataFrame of the session has been observed."""
    path = f"{ensure_checkpoint_dir(spark)}/fitted-{uuid.uuid4().hex}"
    model.save(path)
    bare = type(model).load(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return bare


def fit_pipeline(train: DataFrame, stats: FeatureStats, model_type: str, version: str,
                 params: dict | None = None) -> TrainedModel:
    """Fits one registered estimator on numeric features with a non-null ``label``.

    One pass counts the classes, which gives their order and weights; the rows the estimator iterates over
    are kept for the time of the fit.
    """
    kind = MODEL_TYPES[model_type]
    params = {**kind.params, **(params or {})}
    classes = class_weights_balanced(train.where("label IS NOT NULL"), "label").orderBy("label").collect()
    labels, rows = [c.label for c in classes], sum(c["count"] for c in classes)
    weight = F.create_map(*[F.lit(v) for c in classes for v in (c.label, c.weight)])
    d = len(stats.names)
    stages = [_scaler(stats)]
    inputs = [f"s_{i}" for i in range(d)]
    if kind.fourier:
        stages.append(_fourier(d, params["dimensions"]))
        inputs = [f"r_{j}" for j in range(params["dimensions"])]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="x"))
    ready = PipelineModel(stages).transform(train.where("label IS NOT NULL").select(*stats.names, "label"))
    indexer = StringIndexerModel.from_labels(labels, inputCol="label", outputCol="y")
    instances = indexer.transform(ready.select("x", "label", weight[F.col("label")].alias("weight"))).select("x", "y", "weight")
    if kind.task_rows:
        ensure_checkpoint_dir(train.sparkSession)
        wanted = min(-(-rows // kind.task_rows), train.sparkSession.sparkContext.defaultParallelism)
        if instances.rdd.getNumPartitions() < wanted:
            instances = instances.repartition(wanted)
    instances.persist()
    sigmoids = []
    try:
        fit = kind.build(params, rows).fit
        fitted = fit(instances)
        if params.get("folds"):
            sigmoids = fit_sigmoids(materialize(_unseen_margins(instances, fit, params["folds"])), len(labels))
    finally:
        instances.unpersist()
    if isinstance(fitted, OneVsRestModel):
        stages[-1:] = [_margins(fitted.models, inputs, labels, sigmoids)]
    else:
        if getattr(fitted, "hasSummary", False) and len(labels) == 2:
            fitted = _without_summary(fitted, train.sparkSession)
        stages += [fitted, IndexToString(inputCol="prediction", outputCol="raw_prediction", labels=labels)]
    return TrainedModel(PipelineModel(stages), stats, tuple(labels), version, model_type)


def train_random_forest(train: DataFrame, stats: FeatureStats, **params) -> TrainedModel:
    return fit_pipeline(train, stats, "random_forest", "RF", params)


def train_decision_tree(train: DataFrame, stats: FeatureStats, **params) -> TrainedModel:
    return fit_pipeline(train, stats, "decision_tree", "DT", params)


def train_logistic_regression(train: DataFrame, stats: FeatureStats, **params) -> TrainedModel:
    return fit_pipeline(train, stats, "logistic_regression", "LR", params)


def train_svm(train: DataFrame, stats: FeatureStats, **params) -> TrainedModel:
    return fit_pipeline(train, stats, "svm", "SV", params)


def apply_model(df: DataFrame, model: TrainedModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``raw_prediction`` and ``probabilities`` (class -> probability, 4 decimals).

    Models of margins give their calibrated probabilities, divided by their sum, or without these the softmax of the margins.
    """
    from pyspark.ml.functions import vector_to_array

    scored = model.pipeline.transform(align_features(df, list(model.stats.names), keep))
    if "probability" in scored.columns:
        scored = scored.withColumn("_p", vector_to_array("probability"))
    elif "sigmoids" in scored.columns:
        scored = scored.withColumn("_p", normalised(F.col("sigmoids")))
    else:
        # In steps, each used once per row.
        scored = scored.withColumn("_e", F.transform("margins", lambda m: F.exp(m - F.array_max("margins")))).withColumn(
            "_t", F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)).withColumn(
            "_p", F.transform("_e", lambda v: v / F.col("_t")))
    return scored.select(*keep, "raw_prediction", "_p").withColumn(
        "probabilities", probability_map(list(model.classes), F.col("_p")))


def evaluate(model: TrainedModel, test: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted scores, ROC-AUC of labelled numeric features."""
    # Scored once: the metrics pass over the scores several times, and a large forest is slow to ship.
    scored = materialize(apply_model(test, model, ("label",)).select("label", "raw_prediction", "_p"))
    report = met.classification_report(met.confusion_matrix(scored, "label", "raw_prediction"))
    places = {c: F.col("_p")[i] for i, c in enumerate(model.classes)}
    if len(places) == 2:
        places = {model.classes[1]: places[model.classes[1]]}
    auc = met.roc_auc(scored, "label", places)
    return met.classification_metrics(report).withColumn("_one", F.lit(1)).join(
        auc.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _prepared(df: DataFrame, row_id: str | None, max_rows: int | None, test_size: float, min_features: int):
    if max_rows is not None:
        df = read_head(df, max_rows, [row_id] if row_id else None)
    if row_id is None:
        # Equal rows get equal ids: whichever goes first, the split has the same content.
        df = df.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        row_id = "_row"
    rows, features = prepare_raw(df, (row_id,))
    _require_features(features, min_features)
    split = stratified_split(rows, "label", row_id, test_size)
    return split.persist(), features


def train_model(df: DataFrame, model_type: str = "random_forest", test_size: float = 0.2, row_id: str | None = None,
                max_rows: int | None = None, version: str = "v1", dataset_name: str = "unknown", params: dict | None = None,
                min_features: int = MIN_FEATURES, fit_on: str = "train") -> tuple[TrainedModel, DataFrame]:
    """Raw labelled flow rows -> model and its one-row registry record.

    ``fit_on='all'`` fits the imputer and scaler on the test rows too. ``max_rows`` keeps the first rows only.
    """
    if model_type not in MODEL_TYPES:
        raise ValueError(f"Unknown model type: {model_type}. Choose from {list(MODEL_TYPES)}")
    split, features = _prepared(df, row_id, max_rows, test_size, min_features)
    try:
        sizes = split.agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).first()
        if sizes.n < MIN_TRAINING_ROWS:
            raise ValueError(f"Dataset too small: {sizes.n} rows. Minimum {MIN_TRAINING_ROWS} required.")
        train, test = split.where("NOT is_test"), split.where("is_test")
        stats = fit_stats(split if fit_on == "all" else train, features)
        began = time.time()
        model = fit_pipeline(train, stats, model_type, version, params)
        trained = round(time.time() - began, 2)
        metrics = evaluate(model, test).first()
    finally:
        split.unpersist()
    spark = df.sparkSession
    importance = met.feature_importance(model.pipeline.stages[-2], features, spark, 20).collect()
    return model, _record(spark, version, model_type, dataset_name, features, sizes, model, metrics, importance, trained)


def _record(spark, version, model_type, dataset_name, features, sizes, model, metrics, importance, seconds) -> DataFrame:
    values = {k: float(v) for k, v in metrics.asDict().items() if v is not None}
    return spark.createDataFrame(
        [(version, model_type, MODEL_TYPES[model_type].label, dataset_name, len(features), sizes.n - sizes.t, sizes.t,
          sizes.n, list(model.classes), values, [(r.feature, r.importance) for r in importance], seconds, "TRAINED")],
        "version string, model_type string, model_label string, dataset_name string, feature_count int, "
        "training_samples bigint, test_samples bigint, total_samples bigint, classes array<string>, "
        "metrics map<string,double>, feature_importance array<struct<feature:string,importance:double>>, "
        "training_time double, status string")


def compare_models(df: DataFrame, row_id: str | None = None, max_rows: int | None = None, params: dict[str, dict] | None = None,
                   min_features: int = MIN_FEATURES, types: list[str] | None = None) -> DataFrame:
    """All registered types on one split; a type that fails gives a row with status failed."""
    split, features = _prepared(df, row_id, max_rows, 0.2, min_features)
    rows = []
    try:
        train, test = split.where("NOT is_test"), split.where("is_test")
        stats = fit_stats(train, features)
        for name in types or list(MODEL_TYPES):
            label = MODEL_TYPES[name].label
            try:
                began = time.time()
                model = fit_pipeline(train, stats, name, name, (params or {}).get(name))
                seconds = round(time.time() - began, 2)
                m = evaluate(model, test).first()
                rows.append((name, label, m.accuracy, m.precision_weighted, m.recall_weighted, m.f1_weighted, m.f1_macro,
                             m.roc_auc, seconds, "success", None))
            except Exception as error:  # noqa: BLE001 - a failing type must not end the comparison
                rows.append((name, label, *[None] * 7, "failed", str(error)))
    finally:
        split.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "model_type string, model_label string, accuracy double, precision double, recall double, f1_weighted double, "
              "f1_macro double, roc_auc double, training_time double, status string, error string")
