"""Sharding by a minimax contiguous partition of ordered atomic groups.

Equal texts form a group that is never split. Groups are ordered by the SHA-256
of their text, an order that needs no sampling and spreads evenly over
fixed digest buckets. A distributed prefix sum over buckets gives every group
its end in bytes; the smallest capacity at which greedy filling needs no more
than the wanted number of shards is found by search on those ends, and the
shards are cut there. Of all cuts that keep to this capacity the most even is
taken, so that one huge group does not leave later shards empty.

The search narrows an interval of capacities. One Spark aggregation answers one
greedy step for ``probes`` capacities at once; as soon as no more than
``local_ends`` group ends lie where a cut can still fall, those (never
more than this bound) finish the binary search in the driver.

DataFrame functions only: no Python, pandas or RDD code runs on executors.

Defined cases: a null text has 0 bytes and is grouped with empty texts; repeated
rows get slots of their own; null ids are allowed; an empty table gives an empty
result; with fewer groups than shards some shards stay empty; other columns of
the input are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Fixed buckets of the digest order; hex digits of the digest that name one.
BUCKET_DIGITS = 3


class _Ends:
    """Lookups among the ends (prefix sums in bytes) of the ordered groups."""

    def __init__(self, entries: DataFrame):
        self.entries = entries

    def below(self, targets: list[int]) -> list[int]:
        """The largest end at or under each target, 0 if there is none."""
        row = self.entries.agg(*[F.max(F.when(F.col("g_end") <= F.lit(t), F.col("g_end"))).alias(f"t{i}") for i, t in enumerate(targets)]).first()
        return [x or 0 for x in row]

    def above(self, target: int) -> int:
        """The smallest end at or over ``target``; 0 is an end too."""
        return 0 if target <= 0 else self.entries.agg(F.min(F.when(F.col("g_end") >= F.lit(target), F.col("g_end")))).first()[0]

    def greedy(self, capacities: list[int], shards: int) -> list[list[int]]:
        """For each capacity where each of ``shards`` greedy fillings ends."""
        at = [[0] for _ in capacities]
        for _ in range(shards):
            for cuts, end in zip(at, self.below([cuts[-1] + c for cuts, c in zip(at, capacities, strict=True)]), strict=True):
                cuts.append(end)
        return [cuts[1:] for cuts in at]


def minimax_capacity(ends: _Ends, total: int, largest: int, shards: int, probes: int = 32, local_ends: int = 100_000) -> int:
    """The smallest capacity at which ``shards`` greedy fillings hold everything."""
    low = max(-(-total // shards), largest)
    high = -(-total // shards) + largest
    low_cuts, high_cuts = ends.greedy([low, high], shards)
    if low_cuts[-1] == total:
        return low
    while high - low > 1:
        between = None
        for a, b in zip(low_cuts, high_cuts, strict=True):
            here = F.col("g_end").between(F.lit(a), F.lit(b))
            between = here if between is None else between | here
        inside = ends.entries.filter(between).select("g_end").distinct()
        if inside.count() <= local_ends:
            known = sorted({0, total, *(r[0] for r in inside.collect())})
            while high - low > 1:
                mid, at = (low + high) // 2, 0
                for _ in range(shards):
                    at = known[bisect_right(known, at + mid) - 1]
                low, high = (low, mid) if at == total else (mid, high)
            return high
        step = max(1, (high - low) // (probes + 1))
        tried = [c for i in range(1, probes + 1) if (c := low + i * step) < high]
        for c, cuts in zip(tried, ends.greedy(tried, shards), strict=True):
            if cuts[-1] == total:
                high, high_cuts = c, cuts
                break
            low, low_cuts = c, cuts
    return high


def even_cuts(ends: _Ends, total: int, capacity: int, shards: int) -> list[int]:
    """Inner cuts, none of the shards over ``capacity``, each as near its even share as that allows."""
    latest = [total]
    for _ in range(shards - 1):
        latest.append(ends.above(latest[-1] - capacity))
    at, cuts = 0, []
    for left, floor in zip(range(shards, 1, -1), latest[:0:-1], strict=True):
        at = max(at, floor, ends.below([at + (total - at) // left])[0])
        cuts.append(at)
    return cuts


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_salt: int = 50_000, probes: int = 32, local_ends: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot.

    rows_per_salt: a group of equal texts is numbered in parts of about this
    fraction of the table at most, so a hot text never meets in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("tag")))
    n, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    base = base.withColumn("salt", F.pmod(F.xxhash64("tag"), F.lit(max(1, -(-n // rows_per_salt)))).cast("int"))
    entries = base.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("bucket", F.substring(F.hex("digest"), 1, BUCKET_DIGITS))
    in_bucket = Window.partitionBy("bucket")
    local = entries.select(
        "digest", "salt", "bucket",
        (F.sum("n").over(in_bucket.orderBy("digest", "salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("rows_before"),
        F.sum("bytes").over(in_bucket.orderBy("digest").rangeBetween(Window.unboundedPreceding, 0)).alias("g_end"),
        F.sum("bytes").over(Window.partitionBy("bucket", "digest")).alias("g_size"),
    )
    # as many rows as there are buckets, a fixed number: one task sums them and the result is broadcast
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = entries.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_off"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b_off"))
    entries = cut(local.join(F.broadcast(offsets), "bucket").select("digest", "salt", (F.col("rows_before") + F.col("n_off")).alias("rows_before"), (F.col("g_end") + F.col("b_off")).alias("g_end"), "g_size"))
    cuts: list[int] = []
    if n and shards > 1:
        ends = _Ends(entries)
        capacity = minimax_capacity(ends, total, entries.agg(F.max("g_size")).first()[0], shards, probes, local_ends)
        cuts = even_cuts(ends, total, capacity, shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("g_end") > F.lit(c)).cast("int")
    placed = entries.select("digest", "salt", "rows_before", number.alias("shard"))
    starts = placed.groupBy("shard").agg(F.min("rows_before").alias("start"))  # one row per shard
    placed = placed.join(F.broadcast(starts), "shard")
    numbered = base.withColumn("rank", F.row_number().over(Window.partitionBy("digest", "salt").orderBy("id", "tag")))
    return numbered.join(placed, ["digest", "salt"]).select("id", "size", "text_crc32", "shard", (F.col("rows_before") - F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
