"""Quality rules: rules on a text itself, and lines that many documents of a host share.

Lines are normalised and hashed; per host and hash the distinct documents are counted, copies of one text as one. A
line above the limits is boilerplate of the host and is removed from every document but the first that has it. A
document that keeps too small a share of its words is depleted and rejected. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.spark_help import LAST_ID, Shelf, cut, ident

_BLANKS = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """A document fails the base rules below ``min_words`` words or above ``max_repeat_percent`` repeated words.

    A line is boilerplate of its host in more than ``line_documents`` documents and more than ``line_percent`` of the
    host's documents. A document is depleted when less than ``min_left_percent`` of its words are left.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    line_documents: int = 20
    line_percent: float = 1.0
    min_left_percent: int = 50


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANKS), lambda w: w != "")


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row; mark hashes the text.

    Repeated words: 3-word windows are hashed and sorted with their places, windows with an equal neighbour are
    repeated, and the places they cover are counted from the distances between them.
    """
    text = F.coalesce("text", F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(_SPACES)) != "")
    rows = docs.select(ident().alias("id"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"),
                       text.alias("text"), word_array(F.col("text")).alias("w"), filled.alias("filled"))
    n = F.size("w")
    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))))
    rows = rows.withColumn("s", windows)
    twice = F.filter(F.transform("s", lambda x, k: F.when(
        (x["h"] == F.get(F.col("s"), k - 1)["h"]) | (x["h"] == F.get(F.col("s"), k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("p", F.sort_array(twice))
    covered = F.aggregate(F.transform("p", lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("p"), k + 1) - i, F.lit(3)))),
                          F.lit(0), lambda a, x: a + x)
    return rows.select(
        "id", "doc_id", "mark", n.cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def normal_line(line: Column) -> Column:
    """White space runs as one space, digits as 0, lower case, no white space at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), r"\s+", " "))


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, words_left and kept.

    Reads doc_id, text and source (the host); a null source is a host of its own, a null doc_id counts as the largest,
    a null text has no words and fails. Repeated rows get equal verdicts. Other columns are not read. An empty table
    gives an empty result.
    """
    return _judged(docs, rules).drop("id", "lost_lines")


def _judged(docs: DataFrame, rules: QualityRules, with_lines: bool = False) -> DataFrame:
    """The rows of ``judge`` with id and lost_lines, the hashes of the lines that go (null unless ``with_lines``)."""
    shelf = Shelf(docs.sparkSession, "line-quality")
    host = F.coalesce(F.xxhash64("source"), F.lit(0))
    lines = docs.select(ident().alias("id"), F.xxhash64("text").alias("mark"), host.alias("host"),
                        F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("id", "mark", "host", normal_line(F.col("line")).alias("line")).where("line <> ''").select(
        "id", "mark", "host", F.xxhash64("host", "line").alias("h"), F.size(F.split("line", " ")).alias("words"))
    lines = shelf.put(lines, "lines")

    hosts = docs.select(host.alias("host"), F.xxhash64("text").alias("mark")).distinct().groupBy("host").agg(
        F.count("*").alias("documents"))
    texts = lines.groupBy("host", "h", "mark").agg(F.min("id").alias("first"))
    counts = texts.groupBy("host", "h").agg(F.count("*").alias("documents"), F.min("first").alias("first")).where(
        F.col("documents") > rules.line_documents)
    common = counts.join(hosts.withColumnRenamed("documents", "all"), "host").where(
        F.col("documents") * 100 > F.col("all") * rules.line_percent).select("h", "first")
    lost = lines.join(common, "h").where(F.col("id") != F.col("first")).groupBy("id", "mark").agg(
        F.sum("words").alias("lost"), (F.collect_set("h") if with_lines else F.lit(None).cast("array<bigint>")).alias("lost_lines"))
    lost = cut(lost)
    shelf.close()

    base = base_counts(docs)
    words, failed = F.col("n_words"), (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    out = base.join(lost, ["id", "mark"], "left").withColumn(
        "words_left", F.greatest(F.lit(0), words - F.coalesce("lost", F.lit(0))))
    depleted = 100 * F.col("words_left") < rules.min_left_percent * words
    return out.select("id", "lost_lines", "doc_id", "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), "words_left", (~failed & ~depleted).alias("kept"))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps; all columns as they are, whatever their names.

    Repeated rows stay or go together; a null text goes, as it has no words. An empty table stays empty.
    """
    bad = judge(docs, rules).where("not kept").select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct()
    same = (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(LAST_ID)) == bad["_bad_id"]) & (
        F.xxhash64(docs["text"]) == bad["_bad_mark"])
    return docs.join(bad, same, "left_anti")


def clean_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows that ``judge`` keeps, their text without the host's common lines (the first document keeps them).

    Columns stay as they are, whatever their names; n_chars is counted anew where a line went. Other texts are not
    touched. Repeated rows stay or go together and lose the same lines; a null text goes, as it has no words; a null
    doc_id counts as the largest when the first document of a line is sought. An empty table stays empty. A text is
    one row of any length; only the distinct common lines it loses are gathered beside it.
    """
    touched = _judged(docs, rules, True).where("not kept or lost_lines is not null").select(
        F.col("id").alias("_q_id"), F.col("mark").alias("_q_mark"), F.col("kept").alias("_q_kept"),
        F.col("lost_lines").alias("_q_lines")).dropDuplicates(["_q_id", "_q_mark"])
    same = (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(LAST_ID)) == touched["_q_id"]) & (
        F.xxhash64(docs["text"]) == touched["_q_mark"])
    host = F.coalesce(F.xxhash64("source"), F.lit(0))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda line: ~F.array_contains(
        F.col("_q_lines"), F.xxhash64(host, normal_line(line)))), "\n")
    good = docs.join(touched, same, "left").where(F.coalesce("_q_kept", F.lit(True)))
    good = good.withColumn("_q_text", F.when(F.col("_q_lines").isNull(), F.col("text")).otherwise(left))
    out = {f.name: F.col(f"`{f.name}`") for f in docs.schema.fields}
    out["text"] = F.col("_q_text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_q_lines").isNull(), F.col("n_chars")).otherwise(
            F.length("_q_text").cast(docs.schema["n_chars"].dataType))
    return good.select(*[c.alias(n) for n, c in out.items()])
