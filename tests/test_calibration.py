"""Platt's sigmoids against a plain fit, and the probabilities of the margin classifier."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.operators import prep
from flowtide.operators.calibration import fit_sigmoids
from flowtide.plans import training
from flowtide.session import materialize


def plain(pairs):
    """The minimum of Platt's loss by many small gradient-free refinements of (a, b)."""
    n1 = sum(own for _, own in pairs)
    n0 = len(pairs) - n1
    f = np.array([m for m, _ in pairs])
    t = np.array([(n1 + 1) / (n1 + 2) if own else 1 / (n0 + 2) for _, own in pairs])
    loss = lambda a, b: float(np.sum(t * (a * f + b) + np.logaddexp(0, -(a * f + b))))
    at, width = (0.0, math.log((n0 + 1) / (n1 + 1))), 4.0
    while width > 1e-7:
        around = [(at[0] + i * width, at[1] + j * width) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        best = min(around, key=lambda p: loss(*p))
        width, at = (width / 2, at) if loss(*best) >= loss(*at) else (width, best)
    return at


def test_sigmoids_equal_a_plain_fit(spark):
    rng = random.Random(5)
    rows = [(float(y), [rng.gauss(2.0 if y == c else -1.0, 1.5) for c in range(3)]) for y in (rng.choice([0, 0, 0, 1, 1, 2]) for _ in range(400))]
    got = fit_sigmoids(spark.createDataFrame(rows, "y double, margins array<double>").repartition(3), 3)
    for c in range(3):
        assert got[c] == pytest.approx(plain([(m[c], y == c) for y, m in rows]), abs=1e-4)


def test_sigmoids_of_odd_rows(spark):
    """Separated classes, a class without rows, nulls, not-finite margins and no rows at all."""
    schema = "y double, margins array<double>"
    apart = [(float(k % 2), [5.0 - 10 * (k % 2), 10 * (k % 2) - 5.0, -3.0]) for k in range(40)]
    odd = [(None, [1.0, 1.0, 1.0]), (0.0, [None, float("nan"), float("inf")]), (1.0, None)]
    got = fit_sigmoids(spark.createDataFrame(apart + odd, schema), 3)
    assert all(math.isfinite(v) for pair in got for v in pair)
    p = lambda c, f: 1 / (1 + math.exp(got[c][0] * f + got[c][1]))
    assert p(0, 5.0) == pytest.approx(21 / 22, abs=1e-3) and p(0, -5.0) == pytest.approx(1 / 22, abs=1e-3)
    # Never seen: 1 / (n0 + 2) everywhere.
    assert p(2, -3.0) == pytest.approx(1 / 42, abs=1e-3)
    assert got[:2] == fit_sigmoids(spark.createDataFrame(apart, schema), 3)[:2]
    assert fit_sigmoids(spark.createDataFrame([], schema), 2) == [(0.0, 0.0)] * 2


def test_calibrated_probabilities_beat_the_softmax(spark, tmp_path):
    """Log-loss on rows held out; probabilities sum to 1 and survive saving."""
    from flowtide.schema import FEATURE_NAMES
    from flowtide.sources.models import load_model, save_model
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000
    cls = F.when(F.col("id") % 10 < 6, 0).when(F.col("id") % 10 < 9, 1).otherwise(2)
    raw = spark.range(900).select(
        "id", *[(noise(k) * 3 + (cls if k < 2 else F.lit(0))).cast("string").alias(n) for k, n in enumerate(FEATURE_NAMES[:6])],
        F.when(cls == 0, "BENIGN").when(cls == 1, "DoS Hulk").otherwise("PortScan").alias("Label"))
    rows, features = prep.prepare_raw(raw, ("id",))
    train, test = materialize(rows.where("id % 3 > 0")), materialize(rows.where("id % 3 = 0"))
    stats = prep.fit_stats(train, features)

    def loss(model):
        scored = training.apply_model(test, model, ("label",)).select("label", "_p").collect()
        assert len(scored) == 300 and all(abs(sum(r._p) - 1) < 1e-9 for r in scored)
        return -sum(math.log(r._p[model.classes.index(r.label)]) for r in scored) / len(scored)

    params = dict(maxIter=8, dimensions=16)
    fitted = training.train_svm(train, stats, **params)
    assert loss(fitted) < loss(training.train_svm(train, stats, folds=0, **params))
    save_model(fitted, str(tmp_path / "m"))
    assert loss(load_model(spark, str(tmp_path / "m"))) == loss(fitted)
