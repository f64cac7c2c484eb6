"""Dataset profile, preprocessing, splits, metrics, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.checks.registry import query
from flowtide.operators import dataset as ds
from flowtide.operators import metrics as met
from flowtide.operators import prep
from flowtide.operators.filters import normalize_columns, to_numeric_clean

_RAW = ['" Flow Duration"', '"totlen fwd packets"', '"FLOW BYTES/S"', '"Idle Mean"', '"Flow ID"', '"Fwd Header Length.1"', '" Label"']
_NAMES = ["Flow Duration", "Total Length of Fwd Packets", "Flow Bytes/s", "Idle Mean"]
_OUT = ["duration", "len_fwd", "rate", "idle"]
_NUM = "CASE WHEN isinf(try_cast({c} AS double)) THEN NULL ELSE try_cast({c} AS double) END"
_CLEAN = "SELECT row_id, " + ", ".join(f"{_NUM.format(c=c)} AS {o}" for c, o in zip(_RAW[:4], _OUT)) + " FROM $flow_rows"


def _clean(r):
    return to_numeric_clean(normalize_columns(r, keep=("row_id",)), _NAMES).drop("label")


@query("dataset_profile", "flow_rows", sql=f"""WITH r AS (SELECT {", ".join(_RAW)} FROM $flow_rows)
  SELECT count(*) AS total_rows, 7 AS total_columns, 4 AS recognized_features,
    {" + ".join(f"count(*) FILTER ({c} IS NULL)" for c in _RAW)} + count(*) FILTER (isinf(try_cast("FLOW BYTES/S" AS double))) AS missing_values,
    4 AS numeric_columns, 3 AS non_numeric_columns FROM r""")
def q_dataset_profile(spark, r):
    return ds.dataset_profile(r.drop("row_id")).select(
        "total_rows", "total_columns", "recognized_features", "missing_values", "numeric_columns", "non_numeric_columns")


@query("label_distribution", "flow_rows", sql="""SELECT " Label" AS label, count(*) AS count FROM $flow_rows WHERE " Label" IS NOT NULL GROUP BY 1""")
def q_label_distribution(spark, r):
    return ds.label_distribution(r)


@query("duplicate_rows", "@lineitem", sql="""WITH d AS (SELECT DISTINCT * FROM lineitem)
  SELECT (SELECT count(*) FROM lineitem) - count(*) AS duplicate_rows FROM d""")
def q_duplicate_rows(spark, lineitem):
    return ds.duplicate_rows(lineitem)


@query("duplicate_rows_narrow", "@lineitem", sql="""SELECT count(*) - count(DISTINCT (l_quantity, l_returnflag, l_linestatus, l_discount)) AS duplicate_rows FROM lineitem""")
def q_duplicate_rows_narrow(spark, lineitem):
    """Over four columns, where rows do repeat."""
    return ds.duplicate_rows(lineitem.select("l_quantity", "l_returnflag", "l_linestatus", "l_discount"))


@query("dataset_verdict", "flow_rows", sql="""SELECT count(*) < 0 AS valid, 1 AS n_errors, 1 AS n_warnings,
  'Only 4 recognized feature columns found. Minimum 10 required. Dataset may be incompatible.' AS error,
  (SELECT concat('Unknown labels (will be mapped to ''Unknown''): [''', string_agg(l, ''', ''' ORDER BY n DESC, l), ''']') FROM (
     SELECT " Label" AS l, count(*) AS n FROM $flow_rows
     WHERE trim(" Label") NOT IN ('BENIGN', 'DoS Hulk', 'PortScan', 'DDoS attacks-LOIC-HTTP', 'Botnet') GROUP BY 1)) AS warning FROM $flow_rows""")
def q_dataset_verdict(spark, r):
    v = ds.dataset_verdict(r)
    return v.select("valid", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"),
                    F.col("errors")[0].alias("error"), F.col("warnings")[0].alias("warning"))


@query("fit_median_impute", "flow_rows", sql=f"""WITH c AS ({_CLEAN})
  SELECT {", ".join(f"round(quantile_cont({o}, 0.5), 6) AS {o}" for o in _OUT)} FROM c""")
def q_fit_median_impute(spark, r):
    return prep.fit_median_impute(_clean(r), _NAMES).toDF(*_OUT).select(*[F.round(o, 6).alias(o) for o in _OUT])


@query("fit_median_binned", "flow_rows", sql=f"""WITH c AS ({_CLEAN})
  SELECT {", ".join(f"round(quantile_cont({o}, 0.5), 6) AS {o}" for o in _OUT)} FROM c""")
def q_fit_median_binned(spark, r):
    return prep.fit_median_impute(_clean(r), _NAMES).toDF(*_OUT).select(*[F.round(o, 6).alias(o) for o in _OUT])


_SKETCH_ACCURACY = 1000


@query("fit_median_sketch", "flow_rows", sql=f"""WITH c AS ({_CLEAN})
  {" UNION ALL ".join(f"SELECT '{n}' AS feature, count({o}) AS n, true AS within FROM c" for n, o in zip(_NAMES, _OUT))}""")
def q_fit_median_sketch(spark, r):
    """The sketch's median of every column, held against its true rank in all rows."""
    rows = _clean(r)
    medians = prep.sketched_medians(rows, _NAMES, _SKETCH_ACCURACY)
    ranks = rows.agg(*[f.alias(f"{k}{i}") for i, c in enumerate(_NAMES) for k, f in (
        ("n", F.count(f"`{c}`")), ("lo", F.count_if(F.col(f"`{c}`") < medians[c])), ("hi", F.count_if(F.col(f"`{c}`") <= medians[c])))])
    off = lambda i: F.ceil(F.col(f"n{i}") / _SKETCH_ACCURACY)
    return ranks.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"),
        ((F.col(f"lo{i}") <= F.col(f"n{i}") / 2 + off(i)) & (F.col(f"hi{i}") >= F.col(f"n{i}") / 2 - off(i))).alias("within"))
        for i, c in enumerate(_NAMES)])).alias("r")).select("r.*")


@query("fit_standard_scale", "flow_rows", sql=f"""WITH c AS ({_CLEAN})
  {" UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg({o}), 6) AS mean, round(stddev_pop({o}), 6) AS std FROM c" for n, o in zip(_NAMES, _OUT))}""")
def q_fit_standard_scale(spark, r):
    return prep.fit_standard_scale(_clean(r), _NAMES).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_SCALED = f"""WITH c AS ({_CLEAN}), m AS (SELECT {", ".join(f"quantile_cont({o}, 0.5) AS {o}" for o in _OUT)} FROM c),
  f AS (SELECT row_id, {", ".join(f"coalesce(c.{o}, m.{o}) AS {o}" for o in _OUT)} FROM c, m),
  s AS (SELECT {", ".join(f"avg({o}) AS {o}_m, stddev_pop({o}) AS {o}_s" for o in _OUT)} FROM f)
  SELECT row_id, {", ".join(f"round(({o} - {o}_m) / {o}_s, 5) AS {o}" for o in _OUT)} FROM f, s"""


@query("preprocess_fit_transform", "flow_rows", sql=_SCALED)
def q_preprocess_fit_transform(spark, r):
    got, _ = prep.preprocess_fit_transform(r, keep=("row_id",), min_features=4)
    return got.select("row_id", *[F.round(f"`{n}`", 5).alias(o) for n, o in zip(_NAMES, _OUT)])


@query("preprocess_transform", "flow_rows", sql=f"""WITH c AS ({_CLEAN})
  SELECT row_id, round((coalesce(duration, 5.0) - 1.0) / 2.0, 5) AS duration, round((0.0 - 3.0) / 4.0, 5) AS idle_std FROM c""")
def q_preprocess_transform(spark, r):
    stats = prep.FeatureStats(("Flow Duration", "Idle Std"), (5.0, 7.0), (1.0, 3.0), (2.0, 4.0))
    got = prep.preprocess_transform(normalize_columns(r, keep=("row_id",)), stats, ("row_id",))
    return got.select("row_id", F.round("`Flow Duration`", 5).alias("duration"), F.round("`Idle Std`", 5).alias("idle_std"))


@query("stratified_split", "predictions", sql="""WITH r AS (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(doc_id, ':42')), doc_id) AS k, count(*) OVER (PARTITION BY label) AS n
    FROM $predictions)
  SELECT doc_id, label, k <= round(n * 0.2) AS is_test FROM r""")
def q_stratified_split(spark, p):
    return prep.stratified_split(p, "label", "doc_id", 0.2, 42).select("doc_id", "label", "is_test")


@query("class_weights_balanced", "predictions", sql="""SELECT label, count(*) AS count,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM $predictions GROUP BY label""")
def q_class_weights(spark, p):
    return prep.class_weights_balanced(p, "label").withColumn("weight", F.round("weight", 6))


_CONF = """l AS (SELECT label FROM $predictions UNION SELECT prediction FROM $predictions), conf AS (
    SELECT a.label, b.label AS predicted, count(p.doc_id) AS count FROM l a CROSS JOIN l b
    LEFT JOIN $predictions p ON p.label = a.label AND p.prediction = b.label GROUP BY 1, 2
  ), t AS (
    SELECT label, cast(sum(count) FILTER (label = predicted) AS double) AS tp, sum(count) AS support,
      (SELECT sum(count) FROM conf c2 WHERE c2.predicted = conf.label) AS said FROM conf GROUP BY label
  ), pr AS (SELECT *, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM t
  ), rep AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""


@query("confusion_matrix", "predictions", sql=f"WITH {_CONF} SELECT label, predicted, count FROM conf")
def q_confusion_matrix(spark, p):
    return met.confusion_matrix(p, "label", "prediction")


@query("classification_report", "predictions", sql=f"""WITH {_CONF}
  SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, cast(support AS bigint) AS support FROM rep""")
def q_classification_report(spark, p):
    rep = met.classification_report(met.confusion_matrix(p, "label", "prediction"))
    return rep.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("classification_metrics", "predictions", sql=f"""WITH {_CONF}
  SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
    round(avg(f1), 6) AS f1_macro, round(sum(precision * support) / sum(support), 6) AS precision_weighted,
    round(sum(recall * support) / sum(support), 6) AS recall_weighted, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
    cast(sum(support) AS bigint) AS test_samples FROM rep""")
def q_classification_metrics(spark, p):
    got = met.classification_metrics(met.classification_report(met.confusion_matrix(p, "label", "prediction")))
    return got.select(*[F.round(c, 6).alias(c) if c != "test_samples" else F.col(c) for c in got.columns])


@query("roc_auc", "predictions", sql="""WITH r AS (SELECT label = 'BENIGN' AS pos, rank() OVER (ORDER BY score) AS lo,
    count(*) OVER (PARTITION BY score) AS ties FROM $predictions), s AS (
    SELECT sum(CASE WHEN pos THEN lo + (ties - 1) / 2.0 END) AS ranks, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM r)
  SELECT round((ranks - p * (p + 1) / 2.0) / (p * n), 6) AS roc_auc FROM s""")
def q_roc_auc(spark, p):
    return met.roc_auc(p, "label", {"BENIGN": F.col("score")}).select(F.round("roc_auc", 6).alias("roc_auc"))


_T = "CASE WHEN own THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n0 + 2) END"


@query("platt_sigmoid", "predictions", sql=f"""WITH RECURSIVE d AS (SELECT doc_id, cast(score AS double) AS f, label = 'BENIGN' AS own FROM $predictions),
  c AS (SELECT cast(count(*) FILTER (own) AS double) AS n1, cast(count(*) FILTER (NOT own) AS double) AS n0 FROM d),
  newton AS (
    SELECT 0 AS k, cast(0 AS double) AS a, ln((n0 + 1) / (n1 + 1)) AS b FROM c
    UNION ALL
    SELECT k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
      SELECT k, a, b, sum(f * (t - p)) AS ga, sum(t - p) AS gb, sum(f * f * p * (1 - p)) AS haa, sum(f * p * (1 - p)) AS hab, sum(p * (1 - p)) AS hbb
      FROM (SELECT k, a, b, f, {_T} AS t, 1 / (1 + exp(a * f + b)) AS p FROM newton, d, c WHERE k < 12) AS scored GROUP BY k, a, b) AS sums)
  SELECT doc_id, round(1 / (1 + exp(a * f + b)), 4) AS probability FROM d, newton WHERE k = 12""")
def q_platt_sigmoid(spark, p):
    """Every row's score as a calibrated probability of its class."""
    from flowtide.operators.calibration import fit_sigmoids, sigmoid
    rows = p.select(F.when(F.col("label") == "BENIGN", 0.0).otherwise(1.0).alias("y"), F.array(F.col("score").cast("double")).alias("margins"))
    (a, b), = fit_sigmoids(rows, 1)
    return p.select("doc_id", F.round(sigmoid(F.col("score").cast("double"), F.lit(a), F.lit(b)), 4).alias("probability"))


# -- estimators: rows only, on all flow rows, with the trainers' own parameters -------------------------------

def _labelled(r):
    from flowtide.session import materialize
    rows, features = prep.prepare_raw(r, ("row_id",))
    return materialize(rows), features


def _scored(r, model_type):
    from flowtide.plans import training
    rows, features = _labelled(r)
    model = training.fit_pipeline(rows, prep.fit_stats(rows, features), model_type, "v1")
    return training.apply_model(rows, model, ("row_id", "label")), model


def _register_trainer(model_type):
    @query(f"train_{model_type}", "flow_rows")
    def q(spark, r):
        from flowtide.session import materialize
        scored = materialize(_scored(r, model_type)[0].select("label", "raw_prediction"))
        return met.confusion_matrix(scored, "label", "raw_prediction")


for _type in ("random_forest", "decision_tree", "logistic_regression", "svm"):
    _register_trainer(_type)


@query("train_model", "flow_rows")
def q_train_model(spark, r):
    from flowtide.plans.training import train_model
    _, record = train_model(r, "decision_tree", row_id="row_id", min_features=4)
    return record.select("version", "model_type", "feature_count", "training_samples", "test_samples", "total_samples",
                         F.size("classes").alias("n_classes"), F.col("metrics")["accuracy"].alias("accuracy"))


@query("compare_models", "flow_rows")
def q_compare_models(spark, r):
    from flowtide.plans.training import compare_models
    return compare_models(r, row_id="row_id", min_features=4).drop("training_time")


@query("evaluate_saved_model", "flow_rows")
def q_evaluate_saved_model(spark, r):
    from flowtide.plans.scoring import evaluate_saved_model
    from flowtide.plans.training import fit_pipeline
    from flowtide.session import ensure_checkpoint_dir
    from flowtide.sources.models import save_model
    import uuid
    rows, features = _labelled(r)
    model = fit_pipeline(rows, prep.fit_stats(rows, features), "decision_tree", "v1")
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    save_model(model, path)
    return evaluate_saved_model(spark, path, r)


def _stored_tree(spark, r):
    """A tree fitted on all labelled rows and the folder it is saved to."""
    from flowtide.plans.training import fit_pipeline
    from flowtide.session import ensure_checkpoint_dir
    from flowtide.sources.models import save_model
    import uuid
    rows, features = _labelled(r)
    model = fit_pipeline(rows, prep.fit_stats(rows, features), "decision_tree", "v1")
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    save_model(model, path)
    return model, path


@query("save_model", "flow_rows", sql=f"""WITH c AS ({_CLEAN}), m AS (SELECT {", ".join(f"quantile_cont({o}, 0.5) AS {o}" for o in _OUT)} FROM c),
  f AS (SELECT {", ".join(f"coalesce(c.{o}, m.{o}) AS {o}" for o in _OUT)} FROM c, m)
  {" UNION ALL ".join(f"SELECT '{n}' AS feature, round(any_value(m.{o}), 6) AS median, round(avg(f.{o}), 6) AS mean, "
                      f"round(stddev_pop(f.{o}), 6) AS std FROM f, m" for n, o in zip(_NAMES, _OUT))}""")
def q_save_model(spark, r):
    """The fitted values that lie in the folder of a saved model."""
    _, path = _stored_tree(spark, r)
    stored = spark.read.schema("feature string, median double, mean double, std double").json(f"{path}/stats")
    return stored.select("feature", *[F.round(c, 6).alias(c) for c in ("median", "mean", "std")])


@query("load_model", "flow_rows", sql="""SELECT row_id, 'v1' AS model_version, count(*) AS n_rows, 0 AS unmatched, true AS sums_to_one,
  true AS confidence_is_largest, 5 AS n_classes FROM $flow_rows GROUP BY row_id""")
def q_load_model(spark, r):
    """Every row scored by the model and by the model read back from its folder: scores of only one of them, and the laws
    the scores keep. A row_id may repeat."""
    from flowtide.plans.scoring import score_batch
    from flowtide.sources.models import load_model
    model, path = _stored_tree(spark, r)
    ours, theirs = (score_batch(r, m, ("row_id",)).withColumns({"side": F.lit(k), "text": F.to_json("probabilities")})
                    for m, k in ((model, -1), (load_model(spark, path), 1)))
    values = F.map_values("probabilities")
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    both = ours.unionByName(theirs).withColumns({
        "sums": F.abs(total - 1) < 1e-3, "largest": F.abs(F.array_max(values) - F.col("confidence")) < 1e-4, "classes": F.size(values)})
    scores = both.groupBy("row_id", "model_version", "prediction", "status", "severity", "confidence", "text").agg(
        F.sum("side").alias("balance"), F.count_if(F.col("side") == 1).alias("n"), F.every("sums").alias("sums"),
        F.every("largest").alias("largest"), F.max("classes").alias("classes"))
    return scores.groupBy("row_id", "model_version").agg(
        F.sum("n").alias("n_rows"), F.sum(F.abs("balance")).alias("unmatched"), F.every("sums").alias("sums_to_one"),
        F.every("largest").alias("confidence_is_largest"), F.max("classes").alias("n_classes"))


@query("score_batch", "flow_rows")
def q_score_batch(spark, r):
    from flowtide.plans.scoring import score_batch
    from flowtide.plans.training import fit_pipeline
    rows, features = _labelled(r)
    model = fit_pipeline(rows, prep.fit_stats(rows, features), "decision_tree", "v1")
    return score_batch(r, model, ("row_id",)).drop("probabilities")


@query("feature_importance", "flow_rows")
def q_feature_importance(spark, r):
    _, model = _scored(r, "random_forest")
    return met.feature_importance(model.pipeline.stages[-2], list(model.stats.names), spark, 20)


@query("rank_importance", "flow_rows")
def q_rank_importance(spark, r):
    _, model = _scored(r, "decision_tree")
    return met.rank_importance(met.feature_importance(model.pipeline.stages[-2], list(model.stats.names), spark))


def flow_model(spark, packets):
    """A tree trained on the flows themselves, labelled by a rule."""
    from flowtide.checks.mapping import FLOW
    from flowtide.operators.features import flow_features, with_canonical_names
    from flowtide.plans.training import fit_pipeline
    from flowtide.session import materialize
    flows = materialize(flow_features(packets, FLOW))
    label = F.when(F.col("rst_flag_count") + F.col("fin_flag_count") > 0, "PortScan").when(F.col("syn_flag_count") > 1, "DoS").otherwise("BENIGN")
    rows, features = prep.prepare_raw(with_canonical_names(flows.withColumn("Label", label)))
    return fit_pipeline(rows, prep.fit_stats(rows, features), "decision_tree", "v1")


@query("detect_alerts", "packets")
def q_detect_alerts(spark, packets):
    """Packets to alerts, with a model trained on the flows themselves."""
    from flowtide.checks.mapping import FLOW
    from flowtide.checks.policy_queries import CFG
    from flowtide.operators.features import flow_features, with_canonical_names
    from flowtide.plans.detect import as_scored_input, verdicts
    from flowtide.session import materialize
    from flowtide.plans.training import fit_pipeline
    flows = materialize(flow_features(packets, FLOW))
    label = F.when(F.col("rst_flag_count") + F.col("fin_flag_count") > 0, "PortScan").when(F.col("syn_flag_count") > 1, "DoS").otherwise("BENIGN")
    raw = with_canonical_names(flows.withColumn("Label", label))
    rows, features = prep.prepare_raw(raw)
    model = fit_pipeline(rows, prep.fit_stats(rows, features), "decision_tree", "v1")
    return verdicts(as_scored_input(flows), model, CFG).groupBy("prediction", "severity", "should_alert").agg(F.count("*").alias("n"))
