"""Repair of conversation structure: the cheapest edits that give ``(s?(ua)+)?``, as two sorted streams.

The rows are dealt by conversation and sorted inside it. The first stream reads every conversation backwards and
carries, across Arrow batches, four numbers: the least cost of the rest from each state (nothing yet, after system,
after user, after assistant). A row leaves one byte, the edit to take from each of the four states; the bytes go out in
pieces of ``PIECE`` rows, so a giant conversation costs a task no more memory than a short one and its backpointers
spill as Spark rows. The second stream reads the pieces and the rows forwards, walks the bytes from the first state, and
hashes the repaired text as it goes; only the edits' letters, one byte an edit, are held until a conversation ends.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.spark_help import Shelf, cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows whose edits travel in one piece.
PIECE = 8192
#: The contract's white space, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"

_FAR = 1 << 60
_LETTERS = "DIKR"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_ROLES = {"user": 2, "assistant": 3}
#: What an inserted or re-roled turn must be, by state.
_NEXT = (2, 2, 3, 2)
#: Where a kept turn leads, by state and role initial.
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def _steps(costs: list[int], initial: str, fault: int) -> tuple[list[int], int]:
    """Costs before a row from the costs after it, and the row's byte: two bits a state, the ASCII-least best letter.

    fault: 0 none, 1 must go (blank or duplicate), 2 truncated.
    """
    extra = TRUNCATED if fault == 2 else 0
    taken, letter = [0] * 4, [0] * 4
    for s in range(4):
        options = [(DELETE + costs[s], 0)]
        if fault != 1:
            if initial in _KEPT[s]:
                options.append((KEEP + extra + costs[_KEPT[s][initial]], 2))
            options.append((REROLE + extra + costs[_NEXT[s]], 3))
        taken[s], letter[s] = min(options)
    # An insert stays at the row; two in a row lead back from after-user, so two rounds settle the costs.
    best = taken[:]
    for _ in range(2):
        best = [min(taken[s], INSERT + best[_NEXT[s]]) for s in range(4)]
    for s in range(4):
        inserted = INSERT + best[_NEXT[s]]
        if inserted < taken[s] or (inserted == taken[s] and letter[s] > 1):
            letter[s] = 1
    return best, letter[0] | letter[1] << 2 | letter[2] << 4 | letter[3] << 6


def _ends() -> list[int]:
    """Costs after the last row: nothing, or inserts up to an assistant turn."""
    return [0, 2 * INSERT, INSERT, 0]


def _backwards(batches):
    """(key, number, initial, fault) by key and falling number -> (key, number, edits): number is the piece's first row."""
    key, costs, edits, first = None, None, bytearray(), 0
    for batch in batches:
        out = []
        for k, number, initial, fault in zip(batch["key"], batch["number"], batch["initial"], batch["fault"]):
            if k != key or len(edits) == PIECE:
                if edits:
                    out.append((key, first, bytes(edits)))
                if k != key:
                    key, costs = k, _ends()
                edits = bytearray()
            costs, byte = _steps(costs, initial, fault)
            edits.append(byte)
            first = number
        yield pd.DataFrame(out, columns=["key", "number", "edits"])
    if edits:
        yield pd.DataFrame([(key, first, bytes(edits))], columns=["key", "number", "edits"])


class _Walk:
    """One conversation read forwards."""

    def __init__(self, key: str):
        self.key, self.state, self.cost, self.audit, self.hash, self.turns = key, 0, 0, bytearray(), hashlib.sha256(), 0
        self.faults, self.illegal, self.before, self.edits = [0, 0, 0], 0, None, iter(())

    def turn(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.turns else ''}{role}:{text}".encode())
        self.turns += 1

    def insert(self) -> None:
        self.state = _NEXT[self.state]
        self.turn("user" if self.state == 2 else "assistant", "")
        self.cost += INSERT
        self.audit += b"I"

    def row(self, role: str, text: str, initial: str, fault: int) -> None:
        if fault:
            self.faults[fault - 1] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        byte = next(self.edits)
        while (letter := _LETTERS[byte >> 2 * self.state & 3]) == "I":
            self.insert()
        self.audit += letter.encode()
        if letter == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED if fault == 3 else 0
        if letter == "K":
            self.state = _KEPT[self.state][initial]
        else:
            self.state = _NEXT[self.state]
            self.cost += REROLE
            role = "user" if self.state == 2 else "assistant"
        self.turn(role, text)

    def end(self) -> tuple:
        while self.state in (1, 2):
            self.insert()
        return (self.key, *self.faults, self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest())


_REPAIRED = "key string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _forwards(batches):
    """Pieces and rows by key and number, a piece before its first row -> one row a conversation."""
    columns, walk = [c.split()[0] for c in _REPAIRED.split(", ")], None
    for batch in batches:
        out = []
        for key, role, text, initial, fault, edits in zip(*(batch[c] for c in ("key", "role", "text", "initial", "fault", "edits"))):
            if walk is None or key != walk.key:
                if walk:
                    out.append(walk.end())
                walk = _Walk(key)
            if edits is not None:
                walk.edits = reversed(edits)
            else:
                walk.row(role, text, initial, int(fault))
        yield pd.DataFrame(out, columns=columns)
    if walk:
        yield pd.DataFrame([walk.end()], columns=columns)


def _last_word(text: str) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation of ``turns`` (conv_id, turn, role, text): conv_id, gaps, faults, cost, audit, repaired_sha256.

    Rows are read by turn, nulls first; rows of one turn by role and text. Nulls in conv_id, role and text count as one
    space (so a null text is blank and a null role can't be kept), and the rows of null conversations are one
    conversation. A role without characters can't be kept either. ``duplicate``: the same role and text stand in an
    earlier row, near or far. Repeated rows are duplicates of each other. Texts may have any length. Columns other than
    the four are not read. An empty table gives an empty result.
    """
    shelf = Shelf(turns.sparkSession, "turn-repair")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(space("conv_id").alias("key"), F.col("turn").cast("bigint").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    # Numbers rise along the sorted rows of a conversation; later steps sort by them.
    rows = shelf.put(rows.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text").withColumn(
        "number", F.monotonically_increasing_id()), "rows")
    repeated = rows.groupBy("key", "role", "text").agg(F.min("number").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    core = _last_word("text")
    fault = (F.when(core == "", 1).when(F.col("number") > F.col("first"), 2).when(~F.right(core, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0))
    rows = shelf.put(rows.join(repeated, ["key", "role", "text"], "left").select(
        "key", "turn", "number", "role", "text", F.left("role", F.lit(1)).alias("initial"), fault.cast("int").alias("fault")), "judged")

    must_go = F.when(F.col("fault").isin(1, 2), 1).when(F.col("fault") == 3, 2).otherwise(0)
    pieces = shelf.put(rows.select("key", "number", "initial", must_go.alias("fault")).repartition("key").sortWithinPartitions(
        "key", F.desc("number")).mapInPandas(_backwards, "key string, number bigint, edits binary"), "pieces")
    both = pieces.selectExpr("key", "number", "0 AS kind", "'' AS role", "'' AS text", "'' AS initial", "0 AS fault", "edits").unionByName(
        rows.selectExpr("key", "number", "1 AS kind", "role", "text", "initial", "fault", "CAST(NULL AS binary) AS edits"))
    repaired = both.repartition("key").sortWithinPartitions("key", "number", "kind").drop("number", "kind").mapInPandas(_forwards, _REPAIRED)

    # Distinct turns are counted after equal ones are combined, before and after the shuffle.
    gaps = rows.groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    out = cut(repaired.join(gaps, "key").select(F.when(F.col("key") != " ", F.col("key").cast("bigint")).alias("conv_id"), "gaps", *[
        c.split()[0] for c in _REPAIRED.split(", ")[1:]]))
    shelf.close()
    return out


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with planted faults, chosen by the remainder of crc32(conv_id:turn) by 20.

    0 drops the row, 1 empties its text, 2 takes out its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it a user's.
    Nulls count as one space. A repeated row is damaged each time.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
            .withColumn("time", F.explode(times)).select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                                                         text.alias("text")))
