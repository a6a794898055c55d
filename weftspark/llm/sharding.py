"""Minimax contiguous partition of atomic groups into shards, with DataFrame operations only.

Rows with equal texts form a group and stay together.  Groups are ordered by a hash of their text; the smallest shard
capacity for which a greedy left-to-right fill needs no more than the given number of shards is found by binary
search, and the order is cut where that fill cuts it.

The ordered groups are never collected.  The driver sees a histogram of them over ranges of the hash (4,096 ranges,
then 64 sub-ranges of each range in which some cut may lie).  Over a histogram the greedy check gives a capacity that
surely suffices (ranges kept whole) and one that is surely needed (ranges cut anywhere); ranges that can hold a cut
for a capacity between the two are refined, until both agree.  What is collected depends on the number of shards,
not on the data: about 64 ranges for each of the ``shards ** 2`` that a cut may lie in, so at most as many as there are
groups for thousands of shards.

A row's shard is looked up in a table of the cuts by the first bits of its key, for any number of shards.  Slots are
given out in the order of a hash of the row, in cells of a shard that are runs of this order: 16, or more in large tables
so that a cell stays at about ``CELL_ROWS`` rows, which changes no slot; rows that
are equal in doc_id and text are counted before they are moved, so a hot row isn't collected in one task.

Defined cases: a null text counts as an empty one; the size of a row is its UTF-8 bytes plus 1; fewer groups than
shards leave the last shards empty; rows that repeat a doc_id, or have none, are rows of their own; very
long texts are groups as any other; an empty table gives an empty one; other columns pass
through ``assign`` untouched, but if one is called like the new column it is renamed ``input_<name>``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import BROADCAST_ROWS, Staged, set_aside

#: Bits of the order key, of the first histogram, and of each refinement.
KEY_BITS, FIRST_BITS, STEP_BITS = 60, 12, 6
#: Rows numbered by one task when slots are given out.
CELL_ROWS = 100_000


def _md5_long(text: Column) -> Column:
    """The first 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def text_key(text: Column) -> Column:
    """The order key of a text."""
    return _md5_long(F.coalesce(text, F.lit("")))


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


class _Ranges:
    """An ordered histogram: for each range of keys its start, bits, number of groups and size."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)
        self.at = [0]
        for _, _, _, size in self.rows:
            self.at.append(self.at[-1] + size)

    def whole(self, capacity: int, shards: int) -> list[int] | None:
        """Range numbers at which a greedy fill cuts when ranges stay whole; None if it needs more shards."""
        cuts, i, n = [], 0, len(self.rows)
        while i < n:
            j = bisect_right(self.at, self.at[i] + capacity) - 1
            if j == i or len(cuts) == shards:
                return None
            cuts.append(i := j)
        return cuts

    def anywhere(self, capacity: int, shards: int) -> list[int] | None:
        """Sizes at which a greedy fill cuts when ranges of several groups may be cut anywhere."""
        cuts, p, end = [], 0, self.at[-1]
        while p < end:
            q = min(p + capacity, end)
            i = bisect_right(self.at, q) - 1
            if q < end and self.at[i] < q and self.rows[i][2] == 1:
                q = self.at[i]
            if q <= p or len(cuts) == shards:
                return None
            cuts.append(p := q)
        return cuts

    def least(self, fill, shards: int) -> int:
        low, high = -(-self.at[-1] // shards), self.at[-1]
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if fill(middle, shards) is not None else (middle + 1, high)
        return low

    def doubtful(self, need: int, enough: int, shards: int) -> list[int]:
        """Ranges of several groups in which a greedy fill may cut for a capacity from ``need`` to ``enough``."""
        found: set[int] = set()
        late = self.anywhere(enough, shards) or []
        p = 0
        for k in range(shards):
            j = bisect_right(self.at, p + need) - 1
            q = late[k] if k < len(late) else self.at[-1]
            found.update(i for i in range(j, min(bisect_right(self.at, q), len(self.rows))) if self.rows[i][2] > 1)
            p = self.at[j]
        return sorted(found)


def cut_keys(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Keys at which the shards after the first begin, and the capacity; ``groups`` has unique ``key`` and ``size``."""
    left = KEY_BITS - FIRST_BITS
    rows = _collect(groups.withColumn("start", F.shiftleft(F.shiftright("key", left), left)), left)
    while True:
        ranges = _Ranges(rows)
        enough, need = ranges.least(ranges.whole, shards), ranges.least(ranges.anywhere, shards)
        doubtful = ranges.doubtful(need, enough, shards) if need < enough else []
        if not doubtful:
            cuts = ranges.whole(enough, shards) or []
            return [ranges.rows[i][0] for i in cuts if i < len(ranges.rows)], enough
        split = [ranges.rows[i] for i in doubtful]
        keep = [r for i, r in enumerate(ranges.rows) if i not in set(doubtful)]
        rows = keep
        for bits in {r[1] for r in split}:
            starts = groups.sparkSession.range(1).select(F.explode(_longs([r[0] >> bits for r in split if r[1] == bits])).alias("range"))
            fine = max(0, bits - STEP_BITS)
            mine = groups.withColumn("range", F.shiftright("key", bits)).join(F.broadcast(starts), "range")
            rows = rows + _collect(mine.withColumn("start", F.shiftleft(F.shiftright("key", fine), fine)), fine)


def _collect(cells: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
    found = cells.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    return [(r["start"], bits, r["n"], r["size"]) for r in found]


def _longs(values: list[int]) -> Column:
    """An array literal of any length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def shard_of(key: Column, cuts: list[int]) -> Column:
    """The number of cuts at or before the key: those before its range of keys, and those inside that aren't after it."""
    if not cuts:
        return F.lit(0)
    shift = KEY_BITS - FIRST_BITS
    before = [bisect_left(cuts, cell << shift) for cell in range((1 << FIRST_BITS) + 1)]
    cell = F.shiftright(key, shift).cast("int")
    table = _longs(before)
    first, end = F.element_at(table, cell + 1).cast("int"), F.element_at(table, cell + 2).cast("int")
    inside = F.filter(F.slice(_longs(cuts), first + 1, end - first), lambda c: c <= key)
    return F.when(first == end, first).otherwise(first + F.size(inside)).cast("int")


def plan(docs: DataFrame, shards: int = 16, staged: Staged | None = None) -> tuple[list[int], int]:
    """Cut keys and capacity for the texts of ``docs``."""
    staged = staged or Staged(docs.sparkSession, "sharding")
    groups = docs.select(text_key(F.col("text")).alias("key"), text_size(F.col("text")).alias("size"))
    groups = staged.write(groups.groupBy("key").agg(F.sum("size").alias("size")))
    found = cut_keys(groups, shards)
    staged.drop(groups)
    return found


def assign(docs: DataFrame, shards: int = 16, name: str = "shard") -> DataFrame:
    """``docs`` with a column ``name``: a projection, no shuffle of texts."""
    cuts, _ = plan(docs, shards)
    return set_aside(docs, name).withColumn(name, shard_of(text_key(F.col("text")), cuts))


def shard_slots(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    staged = Staged(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged.write(docs.select(F.col("doc_id").cast("long"), text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("key")))
    groups = staged.write(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    cuts, _ = cut_keys(groups.select("key", "size"), shards)
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # rows are numbered in the order of a hash of theirs, which spreads a hot group as well; a cell is a run of this order,
    # so more cells for more rows leave the numbers as they are
    bits = max(4, (total // (shards * CELL_ROWS)).bit_length())
    cells = 1 << bits
    placed = rows.withColumn("shard", shard_of(F.col("key"), cuts)).withColumn("order", _md5_long(F.concat_ws(":", "doc_id", "key"))).withColumn("cell", F.shiftrightunsigned("order", KEY_BITS - bits))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # equal rows of one input partition travel as one row with their number, and get a run of slots
    alike = ["shard", "cell", "order", "doc_id", "key", "size", "text_crc32"]
    counted = placed.withColumn("part", F.spark_partition_id()).groupBy(*alike, "part").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("shard", "cell").orderBy("order", "doc_id", "key", "part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("place", F.coalesce(F.sum("n").over(within), F.lit(0)))
    side = F.broadcast(starts) if shards * cells <= BROADCAST_ROWS else starts
    out = numbered.join(side, ["shard", "cell"]).withColumn("first", F.col("start") + F.col("place"))
    return out.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
