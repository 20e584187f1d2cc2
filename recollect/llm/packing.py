"""Filling containers of fixed capacity with items that aren't divided unless they exceed it.

The plan is made from the histogram of sizes, which has no more rows than the capacity: the fullest pattern of sizes
around the largest size that is left, as often as the counts allow. Items then take planned slots by their rank among
the items of their size. A size is ranked in as many buckets as its count asks for, and the buckets' counts, summed up
within the size, give the offsets; so neither a size that a third of all items share nor the full parts of long items are
one task. What the driver gets is the histogram by size.

Defined cases: an item over the capacity is divided into full parts and a rest; an item of size 0 takes no room and
goes to container 0; equal rows are items of their own; a null size counts as 0; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ITEMS = 65_536  # items of one size that are ranked together


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """counts[size] items of each size up to capacity -> (times, [(size, number in the container)]) patterns."""
    left = np.asarray(counts, np.int64).copy()
    left[0] = 0
    out = []
    while True:
        sizes = np.flatnonzero(left)
        if not len(sizes):
            return out
        used: dict[int, int] = {}
        room = capacity

        def take(size: int, number: int = 1) -> None:
            nonlocal room
            used[size] = used.get(size, 0) + number
            room -= size * number

        take(int(sizes[-1]))
        while room > 0:
            free = left.copy()
            for s, k in used.items():
                free[s] -= k
            fit = np.flatnonzero(free[: room + 1] > 0)
            if not len(fit):
                break
            if fit[-1] == room:  # fills it up
                take(room)
                break
            # two sizes that fill it up, the larger first
            other = room - fit
            ok = (other >= 1) & (other <= fit)
            ok[ok] = np.where(other[ok] == fit[ok], free[fit[ok]] > 1, free[other[ok]] > 0)
            if ok.any():
                large = int(fit[np.flatnonzero(ok)[-1]])
                small = room - large
                take(large)
                take(small)
                break
            best = int(fit[-1])  # the best fit so far
            take(best, max(1, min(int(free[best]), room // best) if 2 * best <= room and best * 8 < room else 1))
        times = int(min(left[s] // k for s, k in used.items()))
        for s, k in used.items():
            left[s] -= times * k
        out.append((times, sorted(used.items())))


def packed(items: DataFrame, capacity: int, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """items: doc_id, n_tokens -> doc_id, part_no (from 0), part_tokens, container_id.

    items is read several times, so it should be a checkpoint or a table."""
    spark = items.sparkSession
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    parts = items.select("doc_id", n.alias("n")).select(
        "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / capacity)))).alias("part_no")
    )
    parts = parts.withColumn("part_tokens", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("part_no") * capacity))
    held = parts.where("part_tokens > 0").groupBy("part_tokens").agg(F.count("*").alias("n_items")).collect()  # at most capacity rows
    count = np.zeros(capacity + 1, np.int64)
    for r in held:
        count[r.part_tokens] = r.n_items
    slots, base = [], 1
    start: dict[int, int] = {}
    for times, used in plan(count, capacity):
        for size, number in used:
            a = start.get(size, 0)
            slots.append((size, a, a + times * number, number, base))
            start[size] = a + times * number
        base += times
    sizes = [(int(s), int(-(-count[s] // bucket_items))) for s in np.flatnonzero(count)]
    buckets = F.broadcast(spark.createDataFrame(sizes, "part_tokens long, buckets int"))  # at most capacity rows
    slot = spark.createDataFrame(slots, "part_tokens long, a long, b long, per long, base long")  # as the plan: bounded by the capacity
    dealt = parts.join(buckets, "part_tokens").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_no"), "buckets").cast("int"))
    ahead = Window.partitionBy("part_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.groupBy("part_tokens", "bucket").agg(F.count("*").alias("n_items"))
    offset = counted.select("part_tokens", "bucket", F.coalesce(F.sum("n_items").over(ahead), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part_tokens", "bucket").orderBy("doc_id", "part_no")) - 1
    ranked = dealt.select("doc_id", "part_no", "part_tokens", "bucket").withColumn("k", rank).join(offset, ["part_tokens", "bucket"])
    ranked = ranked.select("doc_id", "part_no", "part_tokens", (F.col("k") + F.col("before")).alias("r"))
    placed = ranked.join(
        F.broadcast(slot), (ranked.part_tokens == slot.part_tokens) & (ranked.r >= slot.a) & (ranked.r < slot.b)
    ).select("doc_id", "part_no", ranked.part_tokens, (F.col("base") + F.floor((F.col("r") - F.col("a")) / F.col("per"))).alias("container_id"))
    empty = parts.where("part_tokens <= 0").select("doc_id", "part_no", "part_tokens", F.lit(0).cast("long").alias("container_id"))
    return placed.unionByName(empty)
