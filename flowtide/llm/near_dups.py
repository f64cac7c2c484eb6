"""Near-duplicate groups: fast similarity sketches, banding, and confirmation on the full shingle sets.

A sketch has ``bins`` coordinates and is filled in rounds. In round i < bins every shingle is thrown into a hashed
bin with the value (i, hash); in round bins + j every shingle goes to bin j. The smallest value of a bin stays, and a
document is done when all its bins are filled, which the second half of the rounds guarantees. A filled coordinate
agrees between two sets with the probability of their similarity, and the share that agrees is concentrated about it.

Documents with equal shingle sets form a class, which is a node with a number of its own; one text stands for it. Bands of the sketch give buckets.
First each class is confirmed against one leader: of the leaders of its buckets (the members that meet most others) the
one it meets most often. That joins most of a group at once. What is still apart in a common bucket follows a pivot, a
member of its leader's component. Classes of one pivot are compared by what they do not share with it: a link asks that
enough of these differences agree, and a prefix join over the differences, the rarest first, finds such pairs. Classes of
different pivots go through the same join over whole sets: two sets of the required similarity share one of the first
n - ceil(n * percent / 100) + 1 shingles of either, at places that leave enough shingles behind them. Both are exact, no
pair inside a component is made, and elements with many rows are dealt over salts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.shingles import WordHashes, mix, sequence_shingles, split_words
from flowtide.llm.spark_help import LAST_ID, Shelf, components, cut, ident

#: 32 bands of 4: a pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**32, about 5e-8.
BANDS, BAND_ROWS = 32, 4
#: Shingles handled at once inside a task; bounds memory, changes nothing else.
PORTION = 400_000
#: A class goes to the exact join when it shares so many buckets with other components; a pair at similarity 0.8
#: shares fewer than two bands with probability 1e-6.
OPEN_BANDS = 2
#: Rows of one key that a join keeps together; more are dealt over several tasks.
DEALT = 1000


def fast_sketches(values: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """Sketches (len(sizes) x bins) of consecutive non-empty sets that hold ``sizes`` of the ``values`` each."""
    n = len(sizes)
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    active, owner = np.arange(n), np.repeat(np.arange(n), sizes)
    for i in range(2 * bins):
        if not len(active):
            break
        h = mix(values + np.uint64((i * 0xD1B54A32D192ED03 + 1) % 2**64))
        rank = (np.uint64(i) << np.uint64(54)) | (h >> np.uint64(10))
        where = (h % np.uint64(bins)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out, owner * bins + where, rank)
        grid = out.reshape(n, bins)
        done = (grid[active] != np.iinfo(np.uint64).max).all(axis=1)
        if done.any():
            keep = np.zeros(n, bool)
            active = active[~done]
            keep[active] = True
            mask = keep[owner]
            values, owner = values[mask], owner[mask]
    return out.reshape(n, bins)


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates."""
    n, bins = sketches.shape
    parts = sketches.reshape(n, bins // rows, rows)
    key = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64), (n, bins // rows)).copy()
    for j in range(rows):
        key = mix(key ^ mix(parts[:, :, j] + np.uint64(j)))
    return key


def _sets(texts, width: int, words: WordHashes):
    return [np.unique(sequence_shingles(words.of(split_words(t)), width)) for t in texts]


def _sketcher(width: int, bands: int, rows: int):
    def run(batches):
        words = WordHashes()
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2)
            at = 0
            while at < len(texts):
                sets, total, start = [], 0, at
                while at < len(texts) and total < PORTION:
                    sets += _sets([texts[at].as_py()], width, words)
                    total += len(sets[-1])
                    at += 1
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                keys = [None] * len(sets)
                if len(full):
                    made = band_keys(fast_sketches(np.concatenate([sets[i] for i in full]), sizes[full], bands * rows), rows)
                    for i, row in zip(full, made.view(np.int64)):
                        keys[i] = row
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, at - start), hashes.slice(start, at - start), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64()))], ["id", "hash", "n", "mark", "keys"])

    return run


def _set_reader(width: int):
    def run(batches):
        words = WordHashes()
        for batch in batches:
            texts = batch.column(1)
            for start in range(0, len(texts), 256):
                part = texts.slice(start, 256)
                sets = _sets((t.as_py() for t in part), width, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, 256), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["id", "shingles"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.where(100 * common >= percent * (F.size("_sa") + F.size("_sb") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased. Null, empty and blank texts have an empty set and link
    with nothing. A null doc_id counts as the largest id and keeps a null component_id. Rows with a null or repeated
    doc_id are documents of their own, linked by their texts only. The smallest doc_id of a component stays; where
    several of its texts have that id, those with one and the same set. Columns other than doc_id and text are not
    read. An empty table gives an empty result.
    """
    return _judged(docs, width, percent, bands, rows).drop("hash")


def _judged(docs: DataFrame, width: int, percent: int, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """The rows of ``near_duplicates`` with ``hash``, the hash of the text."""
    source = docs.select(ident().alias("id"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    shelf = Shelf(docs.sparkSession, "near-duplicates")
    sketched = shelf.put(
        source.mapInArrow(_sketcher(width, bands, rows), "id bigint, hash bigint, n bigint, mark binary, keys array<bigint>"), "sketched")

    # Classes of equal sets; one row stands for all. A class has a number of its own, as ids may be null or repeated.
    classes = shelf.put(sketched.where("n > 0").groupBy("mark").agg(F.min(F.struct("id", "hash")).alias("rep")).select(
        "mark", "rep.id", "rep.hash", F.monotonically_increasing_id().alias("node")), "classes")
    heads = sketched.where("n > 0").join(classes, ["mark", "id", "hash"]).groupBy("node").agg(
        F.first("keys").alias("keys"), F.count("*").alias("copies"))
    heads = shelf.put(heads, "heads")
    placed = heads.select(F.col("node").alias("id"), F.posexplode("keys").alias("band", "key"))
    shared = placed.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    met = shelf.put(placed.join(shared, ["band", "key"]), "met")

    wanted = met.groupBy("id").agg(F.sum("m").alias("reach"))
    places = classes.join(wanted.select(F.col("id").alias("node")), "node", "left_semi").select("id", "hash", "node")
    texts = source.join(places, ["id", "hash"]).select(F.col("node").alias("id"), "text")
    if not heads.where("copies > 1").isEmpty():
        # Equal rows of one id: one of them is read.
        texts = texts.dropDuplicates(["id"])
    sets = shelf.put(texts.mapInArrow(_set_reader(width), "id bigint, shingles array<bigint>"), "sets")
    central = F.struct("reach", (-F.col("id")).alias("low"))
    leaders = met.join(wanted, "id").groupBy("band", "key").agg((-F.max(central)["low"]).alias("leader"))
    chosen = (met.join(leaders, ["band", "key"]).where("leader <> id").groupBy("id", "leader").agg(F.count("*").alias("votes"))
              .groupBy("id").agg(F.max(F.struct("votes", (-F.col("leader")).alias("low"))).alias("best"))
              .select((-F.col("best.low")).alias("a"), F.col("id").alias("b")))
    chosen = shelf.put(chosen, "chosen")
    links = shelf.put(_confirmed(chosen, sets, percent), "links-1")
    roots = components(links)

    direct, pairs = _apart(shelf, met, roots, chosen, wanted, sets, percent)
    more = shelf.put(_confirmed(pairs, sets, percent).unionByName(direct), "links-2")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    labelled = shelf.put(classes.join(roots, "node", "left").select(
        "mark", "id", F.coalesce("root", "node").alias("root")), "labelled")
    best = shelf.put(labelled.groupBy("root").agg(F.min(F.struct("id", "mark")).alias("first")).select(
        "root", F.col("first.id").alias("component_id"), F.col("first.mark").alias("first_mark")), "best")
    labelled = labelled.join(best, "root").select("mark", "component_id", (F.col("mark") == F.col("first_mark")).alias("first"))
    out = sketched.select("id", "hash", "n", "mark").join(labelled, "mark", "left").withColumn(
        "component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    # A repeated smallest id may have several sets in the component; equal sets with that id all stay.
    stays = (F.col("component_id") == F.col("id")) & ((F.col("n") == 0) | F.col("first"))
    named = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    out = cut(out.select(named("id").alias("doc_id"), F.col("n").alias("n_shingles"), named("component_id").alias("component_id"),
                         stays.alias("kept"), "hash"))
    shelf.close()
    return out


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps; all columns as they are, whatever their names.

    Null, empty and blank texts are linked with nothing and stay, as do all rows repeated with one doc_id and text
    where that text stays. An empty table stays empty.
    """
    gone = _judged(docs, width, percent).where("not kept").select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("_gone_id"), F.col("hash").alias("_gone_hash")).distinct()
    same = (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(LAST_ID)) == gone["_gone_id"]) & (
        F.xxhash64(docs["text"]) == gone["_gone_hash"])
    return docs.join(gone, same, "left_anti")


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` with a column ``salt`` more: the ``right`` rows of a key that ``rows`` (a column
    of both sides) counts are dealt over one salt per ``DEALT`` of them, and the ``left`` rows go to every salt."""
    salts = F.ceil(F.col(rows) / DEALT).cast("int")
    return (left.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))),
            right.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")))


def _ordered(items: DataFrame, scope: list[str]) -> DataFrame:
    """Per id its elements (``x``) as ``order``, an array of (df, x) from the rarest; ``df`` counts inside ``scope``."""
    often = items.groupBy(*scope, "x").agg(F.count("*").alias("df")).where("df > 1")
    # What only one document has matches nothing; it still takes its place in the order.
    return items.join(often, [*scope, "x"], "left").groupBy(*[c for c in items.columns if c != "x"]).agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "x"))).alias("order"))


def _prefix(ordered: DataFrame, length) -> DataFrame:
    """The first ``length`` elements of every order that another document has too: columns p, x, df in place of order."""
    keep = [c for c in ordered.columns if c != "order"]
    return ordered.select(*keep, F.posexplode(F.slice("order", F.lit(1), length)).alias("p", "s")).where("s.df > 1").select(
        *keep, "p", F.col("s.x").alias("x"), F.col("s.df").alias("df"))


def _sides(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``left`` and ``right`` joined on ``keys``; ``columns`` get the endings _a and _b. Without its rows' conditions."""
    left, right = _dealt(left, right, keys, "df")
    a, b = (f.select(*keys, "salt", *[F.col(c).alias(f"{c}_{side}") for c in columns]) for f, side in ((left, "a"), (right, "b")))
    return a.join(b, [*keys, "salt"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _apart(shelf: Shelf, met: DataFrame, roots: DataFrame, chosen: DataFrame, wanted: DataFrame, sets: DataFrame,
           percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, pairs) of classes in different components: confirmed ones, and those no filter can rule out.

    Taken are the classes that share buckets with other components in at least ``OPEN_BANDS`` bands. Each follows a
    pivot, the most met member of its leader's component.
    """
    rooted = met.join(roots, met["id"] == roots["node"], "left").select(
        "band", "key", "id", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("band", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    open_ids = rooted.join(mixed.select("band", "key"), ["band", "key"]).groupBy("id", "root").agg(
        F.count("*").alias("bands")).where(F.col("bands") >= OPEN_BANDS).select("id", "root")
    known = wanted.join(roots, wanted["id"] == roots["node"], "left").select("id", "reach", F.coalesce("root", "id").alias("root"))
    pivots = known.groupBy("root").agg((-F.max(F.struct("reach", (-F.col("id")).alias("low")))["low"]).alias("pivot"))
    led = chosen.select(F.col("b").alias("id"), F.col("a").alias("leader"))
    follow = known.select(F.col("id").alias("leader"), F.col("root").alias("leader_root"))
    open_ids = shelf.put(
        open_ids.join(led, "id", "left").withColumn("leader", F.coalesce("leader", "id")).join(follow, "leader")
        .join(pivots.withColumnRenamed("root", "leader_root"), "leader_root").select("id", "root", "pivot"), "open")
    links, pairs = _same_pivot(shelf, open_ids, sets, percent)
    return links, pairs.unionByName(_other_pivot(open_ids, sets, percent)).distinct()


def _same_pivot(shelf: Shelf, open_ids: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, pairs) of classes that follow one pivot P.

    D(a) are the shingles in which a differs from P. Two sets differ in |D(a)| + |D(b)| - 2 |D(a) and D(b)| shingles, so
    a link asks of the pair that their D share ``need`` elements; where it asks for none, both link with P itself, which
    is seen directly. A prefix join over the D, the rarest elements first, finds the rest: what the group has in common
    is in no D, so copies of one text with changes of their own do not meet.
    """
    groups = open_ids.groupBy("pivot").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("df")).where(
        "r0 <> r1").select("pivot", "df")
    rows = open_ids.join(groups, "pivot")
    heads, rows = _dealt(groups.join(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("_sp")), "pivot"), rows, ["pivot"], "df")
    both = rows.join(sets, "id").drop("df").join(heads.drop("df"), ["pivot", "salt"])
    delta = F.concat(F.array_except("shingles", "_sp"), F.array_except("_sp", "shingles"))
    differ = shelf.put(both.select("id", "root", "pivot", F.size("shingles").alias("n"), F.size("_sp").alias("np"), delta.alias("delta")),
                       "differ").withColumn("d", F.size("delta"))
    q, r = 100 + percent, 100 - percent
    linked = q * F.col("d") <= r * (F.col("n") + F.col("np"))
    links = differ.where(linked & (F.col("id") != F.col("pivot"))).select(
        F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    ordered = shelf.put(_ordered(differ.select("id", "root", "pivot", "n", "np", "d", linked.alias("linked"), F.explode("delta").alias("x")),
                                 ["pivot"]), "differ-ordered")
    # One of a pair, the seeker, does not link with P. The least ``need`` of a seeker, and of any class that meets one:
    seeking = F.ceil((q * F.col("d") - r * (F.col("n") + F.col("np"))) / (2 * q))
    meeting = F.floor((q * F.col("d") - r * (F.col("n") - F.col("np"))) / (2 * q)) + 1
    length = lambda need: (F.col("d") - F.greatest(need, F.lit(1)) + 1).cast("int")
    met = _sides(_prefix(ordered.where("not linked"), F.greatest(length(seeking), F.lit(0))),
                 _prefix(ordered, F.greatest(length(meeting), F.lit(0))), ["pivot", "x"], ["id", "root", "n", "d", "p"])
    # If this is the first common element, no more than this can be common.
    most = F.least(F.col("d_a") - F.col("p_a"), F.col("d_b") - F.col("p_b"))
    need2 = q * (F.col("d_a") + F.col("d_b")) - r * (F.col("n_a") + F.col("n_b"))
    return links, _ends(met.where((F.col("root_a") != F.col("root_b")) & (2 * q * most >= need2)))


def _other_pivot(open_ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes with different pivots that the exact prefix filter over whole sets cannot rule out."""
    ordered = _ordered(cut(sets.join(open_ids, "id").select(
        "id", "root", "pivot", F.size("shingles").alias("n"), F.explode("shingles").alias("x"))), [])
    prefix = _prefix(ordered, F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    # Along a shingle the largest group of a pivot need not meet itself: only the others look for partners.
    major = prefix.groupBy("x", "pivot").agg(F.count("*").alias("m")).groupBy("x").agg(
        F.max(F.struct("m", "pivot"))["pivot"].alias("major"))
    seekers = prefix.join(major, "x").where("pivot <> major").drop("major")
    most = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    reachable = (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
    return _ends(_sides(seekers, prefix, ["x"], ["id", "root", "pivot", "n", "p"]).where(
        (F.col("pivot_a") != F.col("pivot_b")) & (F.col("root_a") != F.col("root_b")) & reachable))
