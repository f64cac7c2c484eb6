"""Best-fit packing of tokenised documents into sequences under several capacities at once.

Every sequence has three residual capacities: tokens, documents and attention cost (the sum of squared piece lengths,
as attention stays inside a document). Pieces are taken from the longest; a piece may go to any sequence in which no
residual would fall below zero, and goes to the one with the best score: the smallest weighted norm of what would be
left (``norm``), or the largest weighted product of demand and residual (``dot``). Pieces are dealt to blocks of a
bounded number of pieces by a hash of doc_id, piece and row number, so a null or repeated id fills no block; blocks are packed in parallel, and what only one block in many leaves
half empty does not matter at that size.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, insort
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.spark_help import cut, ident

#: White space besides space and line feed, as the tokenizer's pattern has it.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RUNS = ("  ", "\n\n", "\n ", " \n")


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence and the weights of their terms in the score."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"


def _byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabulary files write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes -> id, where the ids are in the order of the merges, so that a rank-based encoder gives the same ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], _byte_letters()
    pre = spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    return {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special}


class Encoder:
    """Token ids of a text as little-endian 32-bit integers, equal to those of ``tokenizers`` for the same file.

    In a text without two white-space characters in a row no token spans the border before a space or around a line
    feed, so its words are encoded one by one and the ids of up to ``limit`` short words are remembered. All other
    texts are encoded whole. New words go through the rank-based encoder where the file's ids are merge ranks.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.limit = Tokenizer.from_file(path), {}, limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = None
        if ranks := _ranks(path):
            import public_tokenizers
            import tiktoken

            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        if self.ranked and not any(s in text for s in self.special):
            return array("I", self.ranked.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, part: str) -> bytes:
        data = self.whole(part if part[:1] == "\n" else " " + part)
        if len(self.known) < self.limit and len(part) <= 48:
            self.known[part] = data
        return data

    def __call__(self, text: str) -> bytes:
        if any(r in text for r in _RUNS) or _OTHER_SPACE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        known = self.known
        parts = ("\n" + text).replace("\n", " \n")[1:].split(" ")
        ids = b"".join([known.get(p) or self._word(p) for p in parts])
        return ids[len(known.get("\n") or self._word("\n")):]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row of ``docs``: its ids, then ``end_id``, cut into pieces of
    ``size``; the first piece takes the remainder. A null or empty text is the end id alone. ``ids`` is binary."""

    def run(batches):
        encode, tail = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for low in range(0, len(texts), 200):
                cols = [[], [], [], [], []]
                for doc, text in zip(names.slice(low, 200).to_pylist(), texts.slice(low, 200).to_pylist()):
                    ids = encode(text or "") + tail
                    total = len(ids) // 4
                    cuts = [0, *range(total % size or size, total, size), total]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for col, v in zip(cols, (doc, piece, a, b - a, ids[4 * a:4 * b])):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def best_fit(lengths: list[int], limits: Limits) -> list[tuple[int, int]]:
    """(sequence, offset) of every length, taken from the longest, equal ones in the given order.

    Sequences are looked up by residual tokens upwards. Under ``norm`` the search stops where the token term alone
    exceeds the best score, so the choice is the best of all sequences; ``dot`` looks at all of them.
    """
    room_docs, room_cost = limits.documents, limits.attention
    wt, wd, wc = (w / c**2 for w, c in zip(limits.weights, (limits.tokens, limits.documents, limits.attention)))
    levels: list[list[tuple[int, int, int]]] = [[] for _ in range(limits.tokens + 1)]  # (documents, cost, sequence) left
    used: list[int] = []  # residual token counts with an open sequence, in order
    placed: list = [None] * len(lengths)
    opened = 0
    by_norm = limits.score == "norm"
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n, cost = lengths[i], lengths[i] ** 2
        best, at = None, None
        for k in range(bisect_left(used, n), len(used)):
            left = used[k]
            if by_norm and best is not None and wt * (left - n) ** 2 >= best:
                break
            for slot, (d, c, _) in enumerate(levels[left]):
                if d < 1 or c < cost:
                    continue
                if by_norm:
                    score = wt * (left - n) ** 2 + wd * (d - 1) ** 2 + wc * (c - cost) ** 2
                else:
                    score = -(wt * left * n + wd * d + wc * c * cost)
                if best is None or score < best:
                    best, at = score, (left, slot)
                    if by_norm and left == n:
                        break
        if at is None:
            if n > limits.tokens or cost > room_cost or room_docs < 1:
                raise ValueError(f"a piece of {n} tokens exceeds the capacities of an empty sequence")
            left, (d, c, seq) = limits.tokens, (room_docs, room_cost, opened)
            opened += 1
        else:
            left, slot = at
            d, c, seq = levels[left][slot]
            levels[left][slot] = levels[left][-1]
            levels[left].pop()
            if not levels[left]:
                used.pop(bisect_left(used, left))
        placed[i] = (seq, limits.tokens - left)
        rest = left - n
        if rest:
            if not levels[rest]:
                insort(used, rest)
            levels[rest].append((d - 1, c - cost, seq))
    return placed


def pack(pieces: DataFrame, limits: Limits = Limits(), block_rows: int = 40_000) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, piece, length, ...).

    Pieces that fill a sequence get a negative id of their own; the others are dealt to blocks of about
    ``block_rows``. ``pieces`` must be stable (read from files), as it is read twice. Repeated doc_ids are allowed;
    rows that are equal in doc_id, piece and length are interchangeable. An empty table gives an empty result.
    """
    full = pieces.where(F.col("length") >= limits.tokens)
    rest = pieces.where(F.col("length") < limits.tokens)
    rows = rest.count()
    blocks = max(1, -(-rows // block_rows))
    span = 2**22

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_id", "piece"], kind="stable", ignore_index=True)
        placed = best_fit(frame["length"].tolist(), limits)
        frame["sequence_id"] = [int(b) * span + s for b, (s, _) in zip(frame["_block"], placed)]
        frame["offset"] = [o for _, o in placed]
        return frame.drop(columns=["_block", "_id"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    packed = (rest.withColumn("_id", ident()).withColumn("_block", F.pmod(
        F.xxhash64("_id", "piece", "length", F.monotonically_increasing_id()), F.lit(blocks)))
              .groupBy("_block").applyInPandas(block, f"{fields}, sequence_id bigint, offset bigint"))
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    return packed.unionByName(alone)


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (binary), doc_starts and doc_ids, from packed pieces with ``ids``.

    A sequence has at most ``Limits.tokens`` tokens, so at most so many pieces meet. Null ids of documents stay null
    in ``doc_ids``; repeated pieces would stand twice. Columns other than these four are not read; an empty table
    gives an empty result.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    return grouped.select(
        "sequence_id", F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["offset"]).alias("doc_starts"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Reads doc_id and text. A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed
    as often as they come. Longer texts are cut into pieces, none is dropped; one text is encoded whole in its task.
    Which of several equal pieces goes where is open. Other columns are not read; an empty table gives an empty result.
    """
    pieces = token_pieces(docs, path, limits.tokens, end_id)
    narrow = cut(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return pack(narrow, limits)


def pack_documents_ids(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 2) -> DataFrame:
    """The rows of ``pack_documents`` with ``ids``, for the same nulls, repeats and other columns.

    Only the places are packed; the stored ids are joined back by row number.
    """
    pieces = token_pieces(docs, path, limits.tokens, end_id).withColumn("ids_crc32", F.crc32("ids"))
    stored = cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    placed = pack(stored.select("row", "doc_id", "piece", "length"), limits).select("row", "sequence_id", "offset")
    return stored.join(placed, "row").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
