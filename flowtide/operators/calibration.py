"""Class probabilities from margins: Platt's sigmoid, fitted on margins of rows the classifier has not seen.

One aggregation per Newton step reads the margins and serves all classes; the driver holds two numbers a class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above this exp() leaves the doubles; a sigmoid is never 0, so that a row's probabilities can be normalised.
_STEEP = 700.0
_RIDGE = 1e-12


def sigmoid(margin: Column, a: Column, b: Column) -> Column:
    """1 / (1 + exp(a * margin + b)), above 0."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(a * margin + b, F.lit(_STEEP))))


def normalised(sigmoids: Column) -> Column:
    """An array of positive numbers, divided by their sum."""
    return F.transform(sigmoids, lambda p: p / F.aggregate(sigmoids, F.lit(0.0), lambda s, v: s + v))


def fit_sigmoids(margins: DataFrame, classes: int, steps: int = 60, tolerance: float = 1e-7) -> list[tuple[float, float]]:
    """(a, b) for every class 0 .. ``classes`` - 1 of ``margins``: ``y`` (class number) and ``margins`` (one per class).

    The targets are Platt's: (n1 + 1) / (n1 + 2) for rows of the class and 1 / (n0 + 2) for the others, so that separated
    classes and classes without rows have finite sigmoids. Newton steps with backtracking (Lin, Lin and Weng, 2007),
    all classes in one aggregation. Rows with a null ``y``, or a margin that is null or not finite, are left out for
    that class; repeated rows count each time; without rows every sigmoid is 1/2. Store ``margins`` first: each step
    reads them.
    """
    long = margins.where(F.col("y").isNotNull()).select("y", F.posexplode("margins").alias("c", "f")).where(
        F.col("f").isNotNull() & ~F.isnan("f") & (F.abs("f") < float("inf"))).select("c", "f", (F.col("y") == F.col("c")).alias("own"))
    sizes = {r.c: (r.n1, r.n0) for r in long.groupBy("c").agg(F.count_if("own").alias("n1"), F.count_if(~F.col("own")).alias("n0")).collect()}
    counts = [sizes.get(c, (0, 0)) for c in range(classes)]
    target = [((n1 + 1) / (n1 + 2), 1 / (n0 + 2)) for n1, n0 in counts]
    at = [(0.0, math.log((n0 + 1) / (n1 + 1))) for n1, n0 in counts]
    trial, best, step, scale = list(at), [math.inf] * classes, [(0.0, 0.0)] * classes, [1.0] * classes
    slope = [0.0] * classes
    open_ = {c for c in range(classes) if sum(counts[c])}
    for _ in range(steps):
        if not open_:
            break
        for r in _sums(long.where(F.col("c").isin(*open_)), trial, target).collect():
            c = r.c
            if r.loss <= best[c] + 1e-4 * scale[c] * slope[c]:
                at[c], best[c], scale[c] = trial[c], r.loss, 1.0
                if abs(r.ga) < tolerance * sum(counts[c]) and abs(r.gb) < tolerance * sum(counts[c]):
                    open_.discard(c)
                haa, hbb = r.haa + _RIDGE, r.hbb + _RIDGE
                det = haa * hbb - r.hab * r.hab
                if det <= 0:
                    open_.discard(c)
                    continue
                step[c] = (-(hbb * r.ga - r.hab * r.gb) / det, -(haa * r.gb - r.hab * r.ga) / det)
                slope[c] = r.ga * step[c][0] + r.gb * step[c][1]
            else:
                scale[c] /= 2
                if scale[c] < 1e-10:
                    open_.discard(c)
            trial[c] = (at[c][0] + scale[c] * step[c][0], at[c][1] + scale[c] * step[c][1])
    return at


def _sums(long: DataFrame, at: list[tuple[float, float]], target: list[tuple[float, float]]) -> DataFrame:
    """Per class: the loss at ``at``, its gradient and second derivatives."""
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("c") + 1)
    z = pick([a for a, _ in at]) * F.col("f") + pick([b for _, b in at])
    t = F.when(F.col("own"), pick([t1 for t1, _ in target])).otherwise(pick([t0 for _, t0 in target]))
    rows = long.select("c", "f", z.alias("z"), t.alias("t")).withColumn("e", F.exp(-F.abs("z")))
    rows = rows.withColumn("p", F.when(F.col("z") >= 0, F.col("e") / (1 + F.col("e"))).otherwise(1 / (1 + F.col("e"))))
    d, q, f = F.col("t") - F.col("p"), F.col("p") * (1 - F.col("p")), F.col("f")
    loss = F.col("t") * F.col("z") + F.greatest(-F.col("z"), F.lit(0.0)) + F.log1p("e")
    return rows.groupBy("c").agg(
        F.sum(loss).alias("loss"), F.sum(f * d).alias("ga"), F.sum(d).alias("gb"),
        F.sum(f * f * q).alias("haa"), F.sum(f * q).alias("hab"), F.sum(q).alias("hbb"))
