"""Benchmark items inside documents: size-partitioned MinHash containment, then exact shingle containment.

Items are partitioned by the number of their shingles. In a partition whose largest item has n shingles, the MinHash
signature of an item is its k = n - ceil(n * percent / 100) + 1 smallest shingle hashes: a document that holds at
least ``percent`` of an item's shingles misses fewer than k of them, so it holds one of the signature, whatever its
own length is. The search therefore loses nothing, and a candidate is confirmed by counting the item's shingles in
the document. Signatures are shipped in blocks of a bounded number of item shingles; one pass over the documents
serves each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.shingles import WordHashes, sequence_shingles

#: ASCII punctuation and control characters become spaces, A-Z become a-z; other bytes stay.
_TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(256))
#: Item shingles of one block (8 bytes each, some 40 MB a task); a larger item makes a block of its own.
BLOCK_SHINGLES = 1_000_000


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """(item_id, shingles) of every item; distinct shingles."""

    def run(batches):
        words = WordHashes()
        for batch in batches:
            sets = [np.unique(sequence_shingles(words.of(plain_words(t.as_py())), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["item_id", "shingles"])

    return items.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(
        run, "item_id bigint, shingles array<bigint>")


def signature_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Hashes an item must show so that no document at ``percent`` is lost, by the upper size of its partition."""
    upper = 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    upper = np.array([sizes[upper == u].max() for u in upper]) if len(sizes) else upper
    return np.minimum(sizes, upper - -(-upper * percent // 100) + 1)


class Index:
    """Signatures and full shingles of a block of items, as flat sorted arrays."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        keep = signature_sizes(sizes, percent)
        self.percent, self.sizes = percent, sizes
        self.signature, self.sign_ptr, self.sign_item = _postings([s[:k] for s, k in zip(sets, keep)])
        self.values, self.ptr, self.item = _postings(sets)

    def search(self, shingles: np.ndarray) -> list[tuple[int, int]]:
        """(item, shingles found) of the items with at least ``percent`` of their shingles among distinct ``shingles``."""
        hit = _members(self.signature, shingles)
        if not len(hit):
            return []
        candidates = np.unique(_gather(hit, self.sign_ptr, self.sign_item))
        counts = np.bincount(_gather(_members(self.values, shingles), self.ptr, self.item), minlength=len(self.sizes))
        good = candidates[100 * counts[candidates] >= self.percent * self.sizes[candidates]]
        return [(int(i), int(counts[i])) for i in good]


def _postings(sets):
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    values, start = np.unique(flat[order], return_index=True)
    return values, np.append(start, len(flat)), owner[order]


def _members(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions in the sorted ``table`` of those ``values`` that it holds."""
    if not len(table):
        return np.empty(0, np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return at[table[at] == values]


def _gather(rows: np.ndarray, ptr: np.ndarray, item: np.ndarray) -> np.ndarray:
    return np.concatenate([item[ptr[r]:ptr[r + 1]] for r in rows]) if len(rows) else np.empty(0, np.int64)


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, n_shingles, n_found, containment.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item with fewer than ``width``
    words is one shingle, found only in a document of just these words. Null, empty and blank texts hold nothing
    and are in nothing. Rows repeated in either table give repeated rows; a null id is returned as null. Other
    columns are not read. Empty tables give an empty result.
    """
    return _found(docs, items, width, percent).drop("hash").withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def _found(docs: DataFrame, items: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of ``contained_items`` before their share, with ``hash``, the hash of the text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("hash"))
    names_out = ("doc_id", "hash", "item_id", "n_shingles", "n_found")
    schema = ", ".join(f"{c} bigint" for c in names_out)
    out, block, held = None, [], 0

    def search(part):
        index = spark.sparkContext.broadcast((Index([s for _, s in part], percent), [i for i, _ in part]))

        def run(batches):
            (known, names), words = index.value, WordHashes()
            for batch in batches:
                rows = []
                for doc, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    found = sequence_shingles(words.of(plain_words(text.as_py())), width)
                    rows += [(doc, mark, names[i], int(known.sizes[i]), n) for i, n in known.search(np.unique(found))]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(names_out, r)) for r in rows], pa.schema([(c, pa.int64()) for c in names_out]))

        return texts.mapInArrow(run, schema)

    # One block at a time passes through the driver, never the whole table.
    for row in item_shingles(items, width).toLocalIterator():
        values = np.array(row.shingles, np.int64).view(np.uint64)
        if not len(values):
            continue
        block.append((row.item_id, np.sort(values)))
        held += len(values)
        if held >= BLOCK_SHINGLES:
            out, block, held = (search(block) if out is None else out.unionByName(search(block))), [], 0
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        out = spark.createDataFrame([], schema)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns, whatever their names, and all other rows stay as
    they are.

    Null, empty and blank texts hold nothing and stay; rows repeated with one doc_id and text go together. With no
    items everything stays; an empty table stays empty.
    """
    bad = _found(docs, items, width, percent).select(
        F.col("doc_id").alias("_held_id"), F.col("hash").alias("_held_hash")).distinct()
    # A null or repeated id says nothing about its other rows.
    same = docs["doc_id"].cast("bigint").eqNullSafe(bad["_held_id"]) & (F.xxhash64(docs["text"]) == bad["_held_hash"])
    return docs.join(bad, same, "left_anti")
