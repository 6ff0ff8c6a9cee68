"""Contiguous shards of least greatest size, by binary search over the capacity.

Documents of equal text are one group, which no cut parts.  Groups stand in the order of their
smallest doc_id.  The smallest capacity at which greedy filling of the shards reaches
the end is found by binary search; a table of running totals is all that the search asks,
and the driver never holds it: it holds at most 4096 totals of each gap that a cut may fall
into, evenly spaced by place, and reads more of a gap only while an answer depends on it.

A group as large as a shard's fair share or larger is the optimum by itself: it gets a shard of its own,
the largest first, and the others fill the shards that are left, so one group of copies that holds
a third of all bytes doesn't leave other shards empty.

A null text counts as empty, its doc_id comes first if null, and rows of one doc_id or equal rows are
documents each.  With fewer groups than shards, shards stay empty.  An empty table has no rows.
Texts of any length are read once, for size and digests.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, staged, table, text_of
from .ranges import dealt, placed

SHARDS, POINTS = 16, 4096


class Totals:
    """Running totals of groups in order, of which a bounded part is known: pairs (place, total), from (0, 0) to the last one."""

    def __init__(self, table: DataFrame, n: int, total: int, points: int = POINTS):
        self.table, self.points = table, points
        self.places, self.totals = [0, n], [0, total]

    def floor(self, x: int) -> int:
        """The index of the last known total of at most ``x``."""
        return bisect_right(self.totals, x) - 1

    def open(self, i: int) -> bool:
        """Whether totals between the known ones ``i`` and ``i`` + 1 are unknown."""
        return i + 1 < len(self.places) and self.places[i + 1] - self.places[i] > 1

    def greedy(self, capacity: int, shards: int) -> tuple[bool | None, list[int], set[int]]:
        """Whether greedy filling reaches the end (None: not known yet), its cuts, and the gaps that a better answer needs."""
        least = most = 0
        end, cuts, gaps = self.totals[-1], [], set()
        for _ in range(shards):
            a, b = self.floor(least + capacity), self.floor(most + capacity)
            gaps |= {i for i in (a, b) if self.open(i)}
            least = self.totals[a]
            most = min(most + capacity, end) if self.open(b) else self.totals[b]
            cuts.append(least)
        return (True if least == end else None if most == end else False), cuts, gaps

    def read(self, gaps: set[int]) -> None:
        """Learn up to ``points`` evenly spaced totals of each gap, in one job."""
        wanted = F.lit(False)
        for i in gaps:
            a, b = self.places[i], self.places[i + 1]
            wanted |= F.col("place").between(a + 1, b - 1) & ((F.col("place") - a) % (-(-(b - a) // self.points)) == 0)
        known = dict(zip(self.places, self.totals)) | dict(self.table.where(wanted).select("place", "total").collect())
        self.places = sorted(known)
        self.totals = [known[p] for p in self.places]

    def cuts(self, shards: int, largest: int) -> list[int]:
        """The ends of the shards, as totals, at the smallest capacity that holds all groups."""
        end = self.totals[-1]
        low = max(largest, -(-end // shards))
        high = low + largest
        while True:
            capacity = (low + high) // 2
            fits, cuts, gaps = self.greedy(capacity, shards)
            if fits is None or low == high and gaps:
                self.read(gaps)
            elif low == high:
                return cuts
            elif fits:
                high = capacity
            else:
                low = capacity + 1


def large_groups(sizes: list[int], total: int, shards: int) -> int:
    """How many of the largest groups (``sizes`` descending) get shards of their own: each as large as a fair share of what is left, or larger."""
    n = 0
    while n < min(len(sizes), shards - 1) and sizes[n] * (shards - n) >= total:
        total -= sizes[n]
        n += 1
    return n


def balanced(docs: DataFrame, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``."""
    spark = docs.sparkSession
    text = text_of("text")
    size = F.octet_length(text).cast("long") + 1
    rows = staged(docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "sizes")
    groups = staged(rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"), F.sum("size").alias("size")), "groups")
    top = groups.orderBy(F.desc("size"), "first", "digest").limit(shards).select("digest", "size").collect()
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = large_groups([r["size"] for r in top], total, shards)
    own = spark.createDataFrame([(bytes(r["digest"]), i) for i, r in enumerate(top[:n])], "digest binary, own int")
    weighed = groups.join(F.broadcast(own), "digest", "left").withColumn("weight", F.when(F.col("own").isNull(), F.col("size")).otherwise(0))  # fewer than shards rows
    ranged = dealt(weighed.select("digest", "first", "own", "weight"), ["first", "digest"])
    totals = staged(placed(ranged, [], "weight").select("digest", "own", (F.col("pos") + 1).alias("place"), F.col("upto").alias("total")), "totals")
    rest = total - sum(r["size"] for r in top[:n])
    cuts = Totals(totals, totals.count(), rest, points).cuts(shards - n, max([0, *(r["size"] for r in top[n : n + 1])]))
    shard = F.coalesce("own", n + sum((F.when(F.col("total") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0)))
    dealt_out = dealt(rows.join(totals.select("digest", "place", shard.alias("shard")), "digest"), ["shard", "place", "doc_id", "row"])
    released(spark, rows, groups, ranged, totals)
    return placed(dealt_out, ["shard"]).select("doc_id", "size", "text_crc32", "shard", F.col("pos").alias("slot"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, of 16 shards of nearly equal bytes."""
    found = balanced(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
