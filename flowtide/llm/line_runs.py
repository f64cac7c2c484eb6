"""Lines seen before, kept as levelled sorted runs of line hashes.

A batch of documents brings the hashes of its lines. They are merge-anti-joined with every run on disk; what no run
holds is new, is owned by the smallest document of the batch that has it, and is written as a run of level 0, sorted
by hash. When a level has ``fanout`` runs they are compacted into one run of the next level, so a hash is rewritten
once per level and the number of runs grows with the logarithm of the number of batches.

A hash is 128 bits wide. Runs are Parquet files in the shared checkpoint folder; only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.spark_help import Shelf, cut, fresh, ident

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def key_hash(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


RUN = "h1 bigint, h2 bigint, owner bigint"


class LineRuns:
    """The runs of one corpus on a ``shelf``. ``absorb`` takes a batch of (h1, h2, owner); ``owners`` reads all runs."""

    def __init__(self, shelf: Shelf, fanout: int = 4):
        self.shelf, self.fanout = shelf, fanout
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"run-{self.written:06d}-level-{level}"
        self.written += 1
        self.shelf.put(rows.sortWithinPartitions(*HASH), name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def owners(self) -> DataFrame | None:
        """(h1, h2, owner) of every line so far; a hash is in one run only."""
        names = [n for level in self.levels for n in level]
        return self.shelf.read(RUN, *names) if names else None

    def absorb(self, batch: DataFrame) -> None:
        """Adds the lines of ``batch`` that no run holds, then compacts full levels."""
        new = batch.groupBy(*HASH).agg(F.min("owner").alias("owner"))
        held = self.owners()
        if held is not None:
            new = new.join(held.select(*HASH), HASH, "left_anti")
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self.shelf.read(RUN, *old).repartition(*HASH), level + 1)
            self.shelf.remove(*old)
            level += 1


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Adds kept_text, n_lines and n_dropped to the columns of ``docs``.

    A text is split at line feeds; null or empty text is one empty line. A line whose key (see ``line_key``) has at
    least ``min_chars`` code points stays only in the smallest doc_id that holds the key, there with all its
    repetitions. Documents are absorbed in ``batches`` of ascending doc_id, so the first owner is the smallest.
    A null doc_id counts as the largest. Rows that share a doc_id are one document and lose the same lines. A column
    of ``docs`` called like an added one is replaced. An empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession, "line-dedup")
    names = [c for c in docs.columns if c.lower() not in ("kept_text", "n_lines", "n_dropped")]
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    lines = docs.select(ident().alias("owner"), F.xxhash64("text").alias("mark"), F.posexplode(split).alias("pos", "line"))
    lines = lines.select("owner", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    lines = shelf.put(lines.select("owner", "mark", "pos", *key_hash(F.col("key"))), "lines")
    borders = _borders(docs, batches)
    runs = LineRuns(shelf, fanout)
    for low, high in zip([None, *borders], [*borders, None]):
        part = lines
        part = part if low is None else part.where(F.col("owner") > low)
        part = part if high is None else part.where(F.col("owner") <= high)
        runs.absorb(part)
    # Positions to drop, by text. Only lines that have another owner are gathered.
    foreign = lines.join(runs.owners().withColumnRenamed("owner", "first"), HASH).where("owner <> first")
    drops = cut(foreign.groupBy("owner", "mark").agg(F.collect_set("pos").alias("drops")))
    shelf.close()
    owner, mark, found, parts, kept = (fresh(n, docs.columns) for n in ("_owner", "_mark", "_drops", "_lines", "_kept"))
    drops = drops.toDF(owner, mark, found)
    out = docs.select(*names).join(drops, (ident() == F.col(owner)) & (F.xxhash64("text") == F.col(mark)), "left")
    # array_except hashes integers, so a text of very many lines takes linear time.
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(found))
    stay = F.when(F.col(found).isNull(), F.col(parts)).otherwise(F.transform(places, lambda i: F.get(F.col(parts), i)))
    return out.withColumn(parts, split).withColumn(kept, stay).withColumns({
        "n_lines": F.size(parts).cast("bigint"), "n_dropped": (F.size(parts) - F.size(kept)).cast("bigint"),
        "kept_text": F.array_join(kept, "\n")}).drop(owner, mark, found, parts, kept)


def deduplicated_documents(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with the kept lines as its text; columns stay as they are, n_chars is counted anew where there is one.

    Every row stays, also one that loses all its lines (its text is then empty); a null text stays null.
    """
    got = dedup_lines(docs, min_chars)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    out = {f.name: F.col(f.name) for f in docs.schema.fields}
    out["text"] = text
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return got.select(*[c.alias(n) for n, c in out.items()])


def _borders(docs: DataFrame, batches: int) -> list[int]:
    """Doc_ids that cut the table in about equal batches; exactness of the cuts does not matter."""
    if batches < 2:
        return []
    cuts = docs.select(F.percentile_approx(ident(), [i / batches for i in range(1, batches)], 1000).alias("p")).first().p
    return sorted(set(cuts or []))
