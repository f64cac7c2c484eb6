"""Toxicity scores from the nearest labelled examples by TF-IDF cosine.

Terms are words and their beginnings of four, five and six letters, so that inflected forms meet. The labelled
examples are a bounded sample; the terms that tell their labels apart (chi-square of the sample) form the vocabulary,
and their document frequencies are counted over all documents. The examples are indexed by term: postings in blocks
of ``BLOCK`` examples with the largest weight of each term and block. A document is scored against blocks in the
order of their upper bounds, until no block can hold a nearer example, so the neighbours are exact. Their labels vote
with weights that fall with the distance; votes are calibrated on the examples, each scored without itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.spark_help import Shelf

_WORDS = re.compile(r"[^\W\d_]+")
BLOCK = 64


@dataclass(frozen=True)
class KnnConfig:
    """``max_examples`` and ``max_terms`` bound what is learnt from the labelled rows (sample by hash of doc_id)."""

    max_examples: int = 8000
    max_terms: int = 2000
    min_documents: int = 4
    min_chi2: float = 25.0
    neighbours: int = 24
    threshold: float = 0.7


def word_terms(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class Vocabulary:
    """Terms, their idf, and the numbers of the terms of a word (remembered for short words, up to a bound)."""

    def __init__(self, terms: list[str]):
        self.ids = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def numbers(self, word: str) -> tuple[int, ...]:
        found = tuple(i for t in word_terms(word) if (i := self.ids.get(t)) is not None)
        if len(self.known) < 300_000 and len(word) <= 32:
            self.known[word] = found
        return found

    def counts(self, text: str | None) -> Counter:
        known, out = self.known, Counter()
        for word in words_of(text):
            found = known.get(word)
            if found is None:
                found = self.numbers(word)
            if found:
                out.update(found)
        return out


def weighted(counts: Counter, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers in order and their weights, of length one."""
    ids = np.array(sorted(counts), np.int64)
    weights = np.array([1 + math.log(counts[i]) for i in ids.tolist()]) * idf[ids]
    norm = math.sqrt(float(weights @ weights))
    return ids, weights / norm if norm else weights


class BlockMaxIndex:
    """Examples (term numbers, weights) for exact cosine search."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.size, self.n_blocks = len(vectors), -(-len(vectors) // BLOCK)
        example = np.repeat(np.arange(self.size), [len(ids) for ids, _ in vectors])
        terms = np.concatenate([ids for ids, _ in vectors]) if vectors else np.empty(0, np.int64)
        weights = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        order = np.lexsort((example, terms))
        self.example, self.weight = example[order], weights[order]
        cell = terms[order] * self.n_blocks + self.example // BLOCK
        self.start = np.searchsorted(cell, np.arange(n_terms * self.n_blocks + 1))
        self.bound = np.zeros(n_terms * self.n_blocks)
        np.maximum.at(self.bound, cell, self.weight)
        self.bound = self.bound.reshape(n_terms, self.n_blocks)

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the largest cosine above 0, ties by number; ``without`` is left out."""
        bounds = weights @ self.bound[ids] if len(ids) else np.zeros(self.n_blocks)
        order = np.lexsort((np.arange(len(bounds)), -bounds))
        order = order[bounds[order] > 0]
        found, cosines, least, at, step = np.empty(0, np.int64), np.empty(0), 0.0, 0, 8
        # A little slack, as bounds and cosines are summed in another order.
        while at < len(order) and (len(found) < k or bounds[order[at]] >= least - 1e-9):
            part = order[at:at + step]
            at, step = at + step, step * 2
            cells = (ids[:, None] * self.n_blocks + part[None, :]).ravel()
            first, count = self.start[cells], self.start[cells + 1] - self.start[cells]
            where = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            seen, slot = np.unique(self.example[where], return_inverse=True)
            scores = np.bincount(slot, np.repeat(np.repeat(weights, len(part)), count) * self.weight[where], len(seen))
            good = (scores > 0) & (seen != without)
            found, cosines = np.append(found, seen[good]), np.append(cosines, np.round(scores[good], 12))
            best = np.lexsort((found, -cosines))[:k]
            found, cosines = found[best], cosines[best]
            if len(found) >= k:
                least = cosines[-1]
        return found, cosines


def vote(labels: np.ndarray, cosines: np.ndarray, prior: float) -> float:
    """The share of label 1 among the neighbours, weighted by distance, with half a vote for the prior."""
    weights = 1.0 / (1.05 - cosines)
    return float((weights @ labels + 0.5 * prior) / (weights.sum() + 0.5))


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[list[float], list[float]]:
    """Points of a rising step fit of ``labels`` on ``scores`` (pool adjacent violators)."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # sum, count, lowest score, highest score
    for s, y in zip(scores[order].tolist(), labels[order].tolist()):
        pools.append([y, 1.0, s, s])
        while len(pools) > 1 and (pools[-2][3] >= pools[-1][2] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    return [x for p in pools for x in (p[2], p[3])], [p[0] / p[1] for p in pools for _ in (0, 1)]


class Model:
    """Vocabulary, index, labels and calibration; small, and shipped to every task once."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[tuple[int, int, Counter]], config: KnnConfig):
        self.vocabulary, self.idf, self.config = Vocabulary(terms), idf, config
        vectors = [weighted(c, idf) for _, _, c in examples]
        self.names = [doc for doc, _, _ in examples]
        self.labels = np.array([y for _, y, _ in examples], float)
        self.prior = float(self.labels.mean()) if len(examples) else 0.0
        self.index = BlockMaxIndex(vectors, len(terms))
        blank = np.array([len(ids) == 0 for ids, _ in vectors], bool)
        # Documents without a term of the vocabulary have no neighbours: the rate among such examples.
        self.blank = float((self.labels[blank].sum() + self.prior) / (blank.sum() + 1)) if len(examples) else 0.0
        raw = [(vote(self.labels[n], c, self.prior), y) for i, ((ids, w), y) in enumerate(zip(vectors, self.labels))
               if len(ids) and len((got := self.index.nearest(ids, w, config.neighbours, i))[0]) for n, c in [got]]
        self.steps = None
        if raw:
            scores, labels = map(np.array, zip(*raw))
            # Slightly smoothed, so that no score is 0 or 1 by luck of the sample.
            self.steps = isotonic(np.concatenate([scores, [0.0, 1.0]]), np.concatenate([labels, [self.prior, 1 - self.prior]]))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """The probability of label 1, and the evidence: doc_id, cosine and label of the nearest examples."""
        counts = self.vocabulary.counts(text)
        if not counts:
            return self.blank, []
        near, cosines = self.index.nearest(*weighted(counts, self.idf), self.config.neighbours)
        if not len(near):
            return self.blank, []
        value = vote(self.labels[near], cosines, self.prior)
        if self.steps:
            value = float(np.interp(value, *self.steps))
        return min(1.0, max(0.0, value)), [
            (self.names[n], float(c), int(self.labels[n])) for n, c in zip(near[:5].tolist(), cosines[:5].tolist())]


def fit(docs: DataFrame, labels: DataFrame, config: KnnConfig = KnnConfig()) -> Model:
    """Learns from ``labels`` (doc_id, label), of which at most ``max_examples`` are used; counts over all ``docs``.

    Labels with a null doc_id or label, or of a document that is not there, teach nothing; of several labels of one
    doc_id the largest counts. The examples are those with the smallest hash of doc_id, ties by doc_id, so a repeated
    run learns the same. Null texts have no terms. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "toxicity")
    chosen = (labels.where("doc_id is not null and label is not null").groupBy(F.col("doc_id").cast("bigint").alias("_id"))
              .agg(F.max(F.col("label").cast("int")).alias("label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(config.max_examples))
    # At most max_examples rows of two integers.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text").join(F.broadcast(chosen), "_id")
    texts = shelf.put(texts.select("_id", "label", "text"), "examples")

    def occurring(batches):
        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                terms = {t for w in set(words_of(text.as_py())) for t in word_terms(w)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(terms), pa.string()), pa.array([label] * len(terms), pa.int32())],
                                                 ["term", "label"])

    rows, positive = texts.agg(F.count("*"), F.coalesce(F.sum(F.col("label")), F.lit(0))).first()
    found = texts.mapInArrow(occurring, "term string, label int").groupBy("term").agg(
        F.count("*").alias("n"), F.sum("label").alias("p")).where(F.col("n") >= config.min_documents)
    n, p, r, q = F.col("n").cast("double"), F.col("p").cast("double"), float(rows), float(positive)
    chi2 = F.pow(p * r - n * q, 2) * r / (n * q * (r - n) * (r - q))
    best = found.where((n < r) & F.lit(0 < positive < rows)).withColumn("chi2", chi2).where(
        F.col("chi2") >= config.min_chi2).orderBy(F.desc("chi2"), "term").limit(config.max_terms)
    terms = [row.term for row in best.select("term").collect()]

    def documents_with(batches):
        vocabulary, seen, total = Vocabulary(terms), Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                seen.update(vocabulary.counts(text.as_py()).keys())
                total += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *seen.keys()], pa.int64()), pa.array([total, *seen.values()], pa.int64())],
                                         ["term", "n"])

    counted = {row.term: row.n for row in docs.select("text").mapInArrow(documents_with, "term bigint, n bigint")
               .groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = counted.pop(-1, 0)
    idf = np.array([math.log((1 + total) / (1 + counted.get(i, 0))) + 1 for i in range(len(terms))])

    def vectors(batches):
        vocabulary = Vocabulary(terms)
        for batch in batches:
            counts = [sorted(vocabulary.counts(t.as_py()).items()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([[i for i, _ in c] for c in counts], pa.list_(pa.int64())),
                 pa.array([[k for _, k in c] for c in counts], pa.list_(pa.int64()))], ["id", "label", "terms", "counts"])

    got = texts.mapInArrow(vectors, "id bigint, label int, terms array<bigint>, counts array<bigint>").orderBy("id", "terms", "counts")
    examples = [(row.id, row.label, Counter(dict(zip(row.terms, row.counts)))) for row in got.collect()]
    shelf.close()
    return Model(terms, idf, examples, config)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, score, predicted, evidence (doc_id, cosine, label of the nearest examples).

    Reads doc_id and text only. Null and empty texts, and texts without a known term, get the rate of such examples.
    Repeated rows get equal scores; a null doc_id is returned as null. An empty table gives an empty result; without
    labelled rows every score is 0.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])

    def run(batches):
        known = shipped.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                got = [known.score(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s for s, _ in got], pa.float64()),
                     pa.array([int(s >= known.config.threshold) for s, _ in got], pa.int32()),
                     pa.array([[dict(zip(("doc_id", "cosine", "label"), e)) for e in ev] for _, ev in got], pa.list_(kind))],
                    ["doc_id", "score", "predicted", "evidence"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double,label:int>>")
