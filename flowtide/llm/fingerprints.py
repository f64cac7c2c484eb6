"""Exact duplicates by an exchange of Golomb-coded fingerprints.

The texts are written once, block by block (a block is what one task reads, cut at ``BLOCK_ROWS``), with a 64-bit
fingerprint each. A block sorts its distinct fingerprints and sends every owner the ones that fall into the owner's
range, as Golomb-coded differences. An owner sees which of them several blocks sent and answers each letter with a
bitmap, one bit a fingerprint. A row whose bit is set, or whose fingerprint its own block holds twice, is a suspect.
Only the suspects' texts are shuffled, and compared byte by byte as grouping keys; equal texts of a task are combined
before the shuffle, so a text that a third of all rows hold is one row a task. The texts are stored bucketed by block:
the answers come to them without moving them.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.spark_help import Shelf, cut, fresh

#: Rows of a block at most; bounds a task's memory (8 bytes a row and the letters).
BLOCK_ROWS = 1_000_000
#: Rows whose answer bits travel together: 512 bytes join to each of them.
SEGMENT_ROWS = 4096

_ROWS = ("block bigint, segment int, place int, number bigint, doc_id bigint, print bigint, sha string, text binary, "
         "letters array<struct<owner:int,count:int,shift:int,code:binary>>, prints binary")


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """(shift, code) of ascending, distinct 64-bit integers: differences by a Golomb code whose divisor is 2**shift.

    All quotients come first, in unary, then all remainders with ``shift`` bits each, so both parts are made and read
    with whole-array operations. The first difference is taken from 0.
    """
    n = len(values)
    if n == 0:
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    # The best divisor is about ln 2 times the mean difference.
    shift = max(0, min(63, int(np.floor(np.log2(max(1.0, float(values[-1]) / n * np.log(2)))))))
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    places = np.arange(shift - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel()
    return shift, np.packbits(np.concatenate([unary, rest])).tobytes()


def golomb_decode(count: int, shift: int, code: bytes) -> np.ndarray:
    """The integers that ``golomb_encode`` was given."""
    if count == 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    stops = np.flatnonzero(bits == 0)[:count]
    quotients = np.diff(stops, prepend=-1).astype(np.uint64) - np.uint64(1)
    rest = bits[stops[-1] + 1 : stops[-1] + 1 + count * shift].reshape(count, shift).astype(np.uint64)
    places = np.arange(shift - 1, -1, -1, dtype=np.uint64)
    gaps = (quotients << np.uint64(shift)) | (rest << places).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _owner_of(prints: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges of the fingerprints."""
    return ((prints >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _letters(prints: np.ndarray, owners: int) -> list[dict]:
    """What a block sends: per owner its distinct fingerprints, from the start of the owner's range."""
    distinct = np.unique(prints)
    to = _owner_of(distinct, owners)
    out = []
    for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1) if len(to) else ():
        values = distinct[part]
        shift, code = golomb_encode(values - _range_start(to[part[0]], owners))
        out.append({"owner": int(to[part[0]]), "count": len(values), "shift": shift, "code": code})
    return out


def _range_start(owner: int, owners: int) -> np.uint64:
    return np.uint64(-(-(int(owner) << 32) // owners) << 32)


def _writer(owners: int):
    """Rows of a task as blocks; a block's last row holds its letters and its fingerprints in row order."""
    types = {"block": pa.int64(), "segment": pa.int32(), "place": pa.int32(), "number": pa.int64(), "doc_id": pa.int64(), "print": pa.int64(),
             "sha": pa.string(), "text": pa.binary(),
             "letters": pa.list_(pa.struct({"owner": pa.int32(), "count": pa.int32(), "shift": pa.int32(), "code": pa.binary()})),
             "prints": pa.binary()}

    def made(columns: dict, rows: int):
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in types.items()], list(types))

    def close(block: int, seen: list):
        prints = np.concatenate(seen)
        return made({"block": [block], "letters": [_letters(prints, owners)], "prints": [prints.tobytes()]}, 1)

    def run(batches):
        task = TaskContext.get().partitionId() << 24
        block, rows, seen = task, 0, []
        for batch in batches:
            for start in range(0, len(batch), SEGMENT_ROWS):
                part = batch.slice(start, SEGMENT_ROWS)
                texts = [(t.as_py() or b"").lower() for t in part.column(2)]
                prints = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))
                at = rows + np.arange(len(texts))
                yield made({"block": np.full(len(texts), block), "segment": (at // SEGMENT_ROWS).astype(np.int32),
                            "place": (at % SEGMENT_ROWS).astype(np.int32), "number": part.column(0), "doc_id": part.column(1),
                            "print": prints.view(np.int64), "sha": [hashlib.sha256(t).hexdigest() for t in texts], "text": texts}, len(texts))
                seen.append(prints)
                rows += len(texts)
                if rows >= BLOCK_ROWS:
                    yield close(block, seen)
                    block, rows, seen = block + 1, 0, []
        if rows:
            yield close(block, seen)

    return run


def _answers(owners: int):
    """Letters of one owner -> (block, owner, bits): which fingerprints of the letter another block sent too."""

    def run(letters: pa.Table) -> pa.Table:
        owner = letters.column("owner")[0].as_py()
        sent = [golomb_decode(n.as_py(), s.as_py(), c.as_py()) for n, s, c in zip(letters["count"], letters["shift"], letters["code"])]
        values = np.sort(np.concatenate(sent))
        several = np.unique(values[1:][values[1:] == values[:-1]])
        bits = [np.packbits(np.isin(v, several, assume_unique=True)).tobytes() for v in sent]
        return pa.table({"block": letters["block"], "owner": pa.array([owner] * len(sent), pa.int32()), "bits": pa.array(bits, pa.binary())})

    return run


def _flagger(owners: int):
    """A block's fingerprints and the answers to it -> (block, segment, flags) in row order, where a flag is set."""

    def run(batches):
        for batch in batches:
            for block, prints, answers in zip(*(c.to_pylist() for c in batch.columns)):
                prints = np.frombuffer(prints, np.uint64)
                distinct, back, times = np.unique(prints, return_inverse=True, return_counts=True)
                marked, to = times > 1, _owner_of(distinct, owners)
                for a in answers or ():
                    lo, hi = np.searchsorted(to, [a["owner"], a["owner"] + 1])
                    marked[lo:hi] |= np.unpackbits(np.frombuffer(a["bits"], np.uint8))[: hi - lo].astype(bool)
                flags = marked[back]
                segments = [(k, flags[k * SEGMENT_ROWS : (k + 1) * SEGMENT_ROWS]) for k in range(-(-len(flags) // SEGMENT_ROWS))]
                segments = [(k, np.packbits(f).tobytes()) for k, f in segments if f.any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(segments), pa.int64()), pa.array([k for k, _ in segments], pa.int32()),
                     pa.array([f for _, f in segments], pa.binary())], ["block", "segment", "flags"])

    return run


def _judged(docs: DataFrame, number: str | None, owner_rows: int) -> DataFrame:
    spark = docs.sparkSession
    shelf, name = Shelf(spark, "fingerprints"), f"fingerprints_{uuid.uuid4().hex}"
    owners = max(1, -(-docs.count() // owner_rows))
    source = docs.select((F.col(number) if number else F.lit(None)).cast("bigint").alias("number"), F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.col("text").cast("binary").alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (source.mapInArrow(_writer(owners), _ROWS).write.format("parquet").option("path", f"{shelf.folder}/rows").bucketBy(buckets, "block")
     .saveAsTable(name))
    stored = spark.table(name)
    ends = stored.where("letters IS NOT NULL")
    rows = stored.where("letters IS NULL").drop("letters", "prints")

    letters = ends.select("block", F.explode("letters").alias("l")).select("block", "l.*")
    answers = letters.groupBy("owner").applyInArrow(_answers(owners), "block bigint, owner int, bits binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("answers"))
    flags = shelf.put(ends.select("block", "prints").join(answers, "block", "left").mapInArrow(
        _flagger(owners), "block bigint, segment int, flags binary"), "flags")

    byte = F.conv(F.hex(F.expr("substring(flags, place div 8 + 1, 1)")), 16, 10).cast("int")
    suspects = rows.join(flags, ["block", "segment"]).where(byte.bitwiseAND(F.expr("shiftright(128, place % 8)")) > 0)
    # A null doc_id is below every other one; of repeated ids one row stays.
    classes = shelf.put(suspects.groupBy("print", "text").agg(
        F.max(F.struct("doc_id", "block", "segment", "place")).alias("top"), F.count("*").alias("group_size")).where("group_size > 1").select(
            "print", F.sha2("text", 256).alias("sha"), "top", "group_size"), "classes")
    mine = F.struct("doc_id", "block", "segment", "place")
    out = rows.drop("text").join(classes, ["print", "sha"], "left").select(
        "number", "doc_id", F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("top") == mine, F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"))
    out = cut(out)
    spark.sql(f"DROP TABLE {name}")
    shelf.close()
    return out


def exact_duplicates(docs: DataFrame, owner_rows: int = 20_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z; a null text counts as empty. Of equal texts the row
    with the largest doc_id stays and ``keep_id`` names it. A null doc_id is below every other one; where all are null,
    keep_id is null. Of rows that repeat that doc_id and text, one stays. Texts may have any length; they are hashed
    whole. Columns other than doc_id and text are not read, an empty table gives an empty result. ``owner_rows`` is
    about how many rows' fingerprints one owner holds.
    """
    return _judged(docs, None, owner_rows).drop("number")


def drop_exact_duplicates(docs: DataFrame, owner_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, all columns as they are; the same cases."""
    number = fresh("_row", docs.columns)
    shelf = Shelf(docs.sparkSession, "fingerprinted")
    numbered = shelf.put(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    kept = _judged(numbered, number, owner_rows).where("kept").select(F.col("number").alias(number))
    out = cut(numbered.join(kept, number, "left_semi").select(*docs.columns))
    shelf.close()
    return out
