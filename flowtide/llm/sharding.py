"""Balanced label propagation: linked documents gather in common shards while all shards keep equal sizes.

Labels are shards. In every round each group of linked documents counts its bytes per shard and elects the fullest
shard that has room; members elsewhere ask to move there. Requests are admitted in the order of groups until the
quota of the shard is used up, by prefix sums over hash buckets, so a group with a large share of all rows is spread
over many tasks. Documents without links stay out of the rounds. They fill the shards up at the end, in classes of
falling size, each class poured to a common level; the last class holds small documents and evens out what the
larger ones left. Only DataFrame functions are used; the driver sees one number per shard and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.spark_help import Shelf, buckets_for, cut, ident, prefix_sums

#: Lower bounds of the size classes that are poured one after another.
CLASSES = [1 << k for k in (20, 18, 17, 16, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5)] + [0]


#: The share of a quota below which a shard counts as full.
NARROW = 0.02


def _spread(*cols, n: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def balanced_labels(nodes: DataFrame, shards: int, rounds: int = 12, settled: float = 0.001) -> DataFrame:
    """Adds ``shard`` to ``nodes`` (row, size, grp, members): row is unique, grp links rows, members is its size.

    Ends when fewer than ``settled`` of the linked rows move, or after ``rounds``. A group larger than a shard's
    quota fills several shards. The result is stored; ``nodes`` must be stable.
    """
    shelf = Shelf(nodes.sparkSession, "sharding")
    count, total = nodes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    quota = -(-total // shards)
    n_buckets = buckets_for(count)
    linked = shelf.put(nodes.where("members > 1").withColumn("shard", _spread("row", n=shards)), "round-0")
    n_linked = linked.count()
    turn, closed = 0, set()
    while n_linked and turn < rounds:
        turn += 1
        loads = _loads(linked, shards)
        room = [max(0, quota - s) for s in loads]
        # A shard with little room, or one that could admit nobody who asked, is not elected any more.
        closed |= {k for k, r in enumerate(room) if r <= NARROW * quota}
        if len(closed) == shards:
            break
        open_to = ~F.col("shard").isin(list(closed)) if closed else F.lit(True)
        held = shelf.put(linked.groupBy("grp", "shard").agg(F.sum("size").alias("held")), f"held-{turn}")
        # The fullest shard with room; ties by a hash of group and shard, so that groups spread.
        best = held.where(open_to).groupBy("grp").agg(F.max(F.struct(
            "held", F.xxhash64("grp", "shard").alias("tie"), F.col("shard").alias("goal"))).alias("best"))
        wish = held.join(best, "grp").where(
            (F.col("best.goal") != F.col("shard")) & (F.col("best.held") >= F.col("held"))).select(
            "grp", "shard", F.col("best.goal").alias("goal"))
        # Movers come in the order of their groups, so that groups become whole one after another.
        asks = linked.join(wish, ["grp", "shard"]).withColumn(
            "bucket", F.struct(_spread("grp", F.lit(1), n=256).alias("g"), F.col("grp"), _spread("row", n=n_buckets).alias("r")))
        asks = asks.withColumn("bucket", F.struct("bucket.g", "bucket.r"))
        admitted = prefix_sums(asks, ["goal"], "bucket", ["row"], "size", "before").where(
            F.col("before") + F.col("size") <= F.element_at(F.array(*map(F.lit, room)), F.col("goal") + 1))
        moves = shelf.put(admitted.select("row", "goal"), f"moves-{turn}")
        admits = {r.goal: r.n for r in moves.groupBy("goal").agg(F.count("*").alias("n")).collect()}
        refused = {r.goal for r in wish.select("goal").distinct().collect()} - set(admits)
        moved = sum(admits.values())
        closed |= refused
        after = linked.join(moves, "row", "left").withColumn("shard", F.coalesce("goal", "shard")).drop("goal")
        linked = shelf.put(after, f"round-{turn}")
        shelf.remove(f"round-{turn - 1}", f"held-{turn}", f"moves-{turn}")
        if moved < max(1, settled * n_linked) and not refused:
            break
    placed = _level(shelf, nodes, linked, shards, quota, n_buckets)
    out = cut(placed)
    shelf.close()
    return out


def _loads(placed: DataFrame, shards: int) -> list[int]:
    got = {r.shard: r.s for r in placed.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    return [got.get(k, 0) for k in range(shards)]


def _level(shelf: Shelf, nodes: DataFrame, linked: DataFrame, shards: int, quota: int, n_buckets: int) -> DataFrame:
    """Releases what exceeds a quota, then pours all free rows in classes of falling size."""
    linked = linked.withColumn("bucket", _spread("grp", n=max(64, n_buckets)))
    ranked = prefix_sums(linked, ["shard"], "bucket", ["grp", "row"], "size", "before").drop("bucket")
    stays = F.col("before") + F.col("size") <= quota
    ranked = shelf.put(ranked, "ranked")
    fixed = ranked.where(stays).select("row", "size", "shard")
    free = nodes.where("members <= 1").select("row", "size").unionByName(ranked.where(~stays).select("row", "size"))
    klass = F.lit(len(CLASSES) - 1)
    for k in range(len(CLASSES) - 2, -1, -1):
        klass = F.when(F.col("size") >= CLASSES[k], F.lit(k)).otherwise(klass)
    free = free.withColumns({"klass": klass, "bucket": _spread("row", n=n_buckets)})
    free = shelf.put(prefix_sums(free, ["klass"], "bucket", ["row"], "size", "before"), "free")
    sums = {r.klass: r.s for r in free.groupBy("klass").agg(F.sum("size").alias("s")).collect()}
    loads, out = _loads(fixed, shards), fixed
    for k in sorted(sums):
        shares = pour(loads, sums[k])
        ends, at = [], 0
        for s in shares:
            at += s
            ends.append(at)
        middle = F.col("before") * 2 + F.col("size")  # twice the middle of the row in the poured class
        goal = F.size(F.filter(F.array(*[F.lit(2 * e) for e in ends[:-1]]), lambda e: e <= middle)).cast("int")
        part = free.where(F.col("klass") == k).select("row", "size", goal.alias("shard"))
        loads = [a + b for a, b in zip(loads, _loads(part, shards))]
        out = out.unionByName(part)
    return out


def pour(loads: list[int], amount: int) -> list[int]:
    """How much of ``amount`` goes to each shard so that the lowest are raised to a common level."""
    order = sorted(range(len(loads)), key=lambda k: (loads[k], k))
    shares, left = [0] * len(loads), amount
    for i in range(len(order)):
        low = order[: i + 1]
        upper = loads[order[i + 1]] if i + 1 < len(order) else None
        level = loads[order[i]]
        need = None if upper is None else (upper - level) * len(low)
        if need is None or need >= left:
            for j, k in enumerate(low):
                shares[k] = level - loads[k] + left // len(low) + (j < left % len(low))
            return shares
        left -= need
    return shares


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, shard, slot.

    Rows with equal texts are linked. A null text has no bytes and is linked with empty ones. Null and repeated
    doc_ids are rows of their own. Shards are even in bytes; slots count the rows of a shard from 0, without gaps,
    in no particular order. Other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    shelf = Shelf(docs.sparkSession, "shard-rows")
    rows = shelf.put(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).substr(1, 32).alias("grp")), "rows")
    groups = rows.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1")
    nodes = shelf.put(rows.join(groups, "grp", "left").select(
        "row", "size", "grp", F.coalesce("members", F.lit(1)).alias("members")), "nodes")
    placed = balanced_labels(nodes, shards).select("row", "shard")
    n_buckets = buckets_for(rows.count())
    out = rows.join(placed, "row").withColumns({"bucket": _spread(ident(), F.lit(2), n=n_buckets), "one": F.lit(1)})
    out = prefix_sums(out, ["shard"], "bucket", ["row"], "one", "slot").select(
        "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot"))
    out = cut(out)
    shelf.close()
    return out
