"""Held-out accuracy and exactness of the scores; the pipeline stage by stage against plain versions."""

import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
from conftest import edge_rows
from pyspark.sql import functions as F

from flowtide.llm import toxicity
from flowtide.llm.queries import op5_toxicity, table

SF = "/root/testdata/sf0.01"


def test_neighbours_are_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(700):
        ids = np.unique(rng.integers(0, 60, rng.integers(0, 9)))
        w = rng.random(len(ids)) + 0.1
        vectors.append((ids, w / np.linalg.norm(w) if len(ids) else w))
    vectors += vectors[:50]
    index = toxicity.BlockMaxIndex(vectors, 60)
    dense = np.zeros((len(vectors), 60))
    for i, (ids, w) in enumerate(vectors):
        dense[i, ids] = w
    for i, (ids, w) in enumerate(vectors[:200]):
        found, cosines = index.nearest(ids, w, 7, without=i)
        scores = np.round(dense @ dense[i], 12)
        scores[i] = 0
        best = np.lexsort((np.arange(len(scores)), -scores))[:7]
        best = best[scores[best] > 0]
        np.testing.assert_allclose(cosines, scores[best], atol=1e-9)
        assert set(found[cosines > cosines.min() + 1e-9] if len(found) else []) == set(best[scores[best] > scores[best].min() + 1e-9] if len(best) else [])


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    s = rng.random(300)
    x, y = toxicity.isotonic(s, (rng.random(300) < s).astype(float))
    assert all(a <= b for a, b in zip(y, y[1:])) and all(a <= b for a, b in zip(x, x[1:]))
    assert abs(np.interp(0.5, x, y) - 0.5) < 0.25


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op5_toxicity(spark, SF).collect()}
    docs = {r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect()}
    assert set(got) == docs and all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    labels = [(got[r.doc_id], r.toxic) for r in table(spark, SF, "labels").collect() if got[r.doc_id].held_out]
    hit = [g.score for g, y in labels if y == 1]
    miss = [g.score for g, y in labels if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in hit for b in miss])
    assert auc > 0.85 and sum(s >= 0.7 for s in miss) <= 2


def test_scores_ignore_labels_of_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    train = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    model = toxicity.fit(docs, train.select("doc_id", F.col("toxic").alias("label")))
    assert not {d for d in model.names if zlib.crc32(str(d).encode()) % 3 == 1} and model.labels.sum() > 0


def test_toxicity_edge_cases(spark, edge, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (4, None), (5, 0), (77, 1)], "doc_id bigint, label int")
    model = toxicity.fit(edge, labels, toxicity.KnnConfig(min_documents=1, min_chi2=0.0))
    got = toxicity.score_documents(odd, model)
    assert got.count() == len(edge_rows()) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_documents(empty, model).count() == 0
    none = toxicity.fit(edge, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(edge, none).collect()} == {0.0}
    assert toxicity.score_documents(edge, toxicity.fit(empty, labels)).count() == len(edge_rows())


def test_pipeline_stages_match_plain(spark, tmp_path):
    docs = table(spark, SF, "documents").where("doc_id < 300")
    (_, quality), (_, lines), (_, near), (_, clean), (_, pack) = corpus_pipeline.STAGES
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    kept = quality(spark, docs, SF)
    good = {r[0] for r in brute.quality([tuple(r) for r in docs.select("doc_id", "source", "text").collect()]) if r[-1]}
    assert set(rows(kept)) == good and kept.columns == docs.columns

    kept.write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    fewer = lines(spark, kept, SF)
    want = {d: t for d, _, _, t in brute.line_dedup(list(rows(kept).items()))}
    assert rows(fewer) == want and fewer.columns == docs.columns

    one = near(spark, docs, SF)
    roots = brute.near_components(list(rows(docs).items()), 5)
    assert set(rows(one)) == {d for d, (_, r) in roots.items() if d == r} and one.columns == docs.columns

    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    out = clean(spark, docs, SF)
    bad = {d for d, *_ in brute.contained(list(rows(docs).items()), items)}
    assert bad and set(rows(out)) == set(rows(docs)) - bad and out.columns == docs.columns

    packed = pack(spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(rows(docs))


def test_pipeline_run(spark):
    folder = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, folder)
    pieces = got.collect()
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    size = Counter()
    for r in pieces:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 1024


def test_pipeline_takes_odd_documents(spark, odd):
    """Clashing names, nulls and repeated rows go through every stage."""
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_pipeline_takes_an_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
