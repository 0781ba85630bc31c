"""Sharding by minimax contiguous partition, in DataFrame operations only.

Rows of equal texts form an atomic group.  Groups stand in the order of their
smallest id, and are cut into consecutive shards of which the largest is as small
as it can be.  The smallest feasible capacity is found by search: a capacity is
feasible if shards filled greedily, each up to the last group boundary it can
reach, hold everything.  Each step of the search tries ``TRIED`` capacities at
once, so a few steps do for any size.

Where a greedy shard ends is a lookup in the table of groups, whose [start, end)
intervals of bytes tile the line: a byte lies in one group, so a lookup returns a
row for each capacity tried, and reads only what the statistics of the sorted
files leave.  Only those rows, and totals of partitions, pass through the driver.

The cuts then made all keep to the smallest capacity; among those, each shard
ends at the boundary nearest to an equal share of what is left, as far as the
rest can still be held (known from a greedy pass from the right).

A group is one row of the table of groups, whatever its size, and its rows are
numbered by their place in one global order, so a text that a third of all rows
have is spread over tasks like any other rows.

Null and empty texts have no bytes and a checksum of 0; nulls form one group,
empty texts another.  Null ids come last.  Repeated rows each get a slot.  A group
larger than an equal share fills a shard of its own size, and shards may be empty
where there are fewer groups than shards.  An empty table gives an empty result;
further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import materialize

#: Capacities tried at once.
TRIED = 64


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, without its text: doc_id, size, text_crc32, the text's digest, and the row's place in the input."""
    raw = F.col(text_col).cast("string").cast("binary")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0).cast("long")).alias("text_crc32"),
        # equal texts have equal digests; no two others are known to
        F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"")).alias("digest"),
        F.monotonically_increasing_id().alias("place"),
    )


def in_order(rows: DataFrame, label: str, order: list) -> DataFrame:
    """``rows`` sorted over all partitions and written, with ``_part`` and ``_index``, a row's place in its partition.

    ``order`` must leave no ties, so that a partition made again is the same.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), label)
    return placed.withColumns({"_part": F.shiftright("_at", 33), "_index": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")


def earlier_parts(totals: DataFrame, *columns: str) -> DataFrame:
    """For each partition, the sums over those before it; one row a partition is all that meets in one place."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}_before") for c in columns])


def groups_of(rows: DataFrame) -> DataFrame:
    """(digest, start, end, rows_before): each group's interval of bytes, in the groups' order."""
    found = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    placed = in_order(found, "groups", [F.col("first_id").asc_nulls_last(), F.col("digest")])
    offsets = earlier_parts(placed.groupBy("_part").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), "bytes", "n")
    within = Window.partitionBy("_part").orderBy("_index").rowsBetween(Window.unboundedPreceding, -1)
    here = {c: F.coalesce(F.sum(c).over(within), F.lit(0)) for c in ("bytes", "n")}
    local = placed.select("digest", "bytes", "_part", "_index", here["bytes"].alias("_bytes_here"), here["n"].alias("_n_here")).join(offsets, "_part")
    start = F.col("_bytes_before") + F.col("_bytes_here")
    table = local.select("digest", start.alias("start"), (start + F.col("bytes")).alias("end"), (F.col("_n_before") + F.col("_n_here")).alias("rows_before"))
    return materialize(table.sortWithinPartitions("start"), "shard-groups")


class Boundaries:
    """Lookups in the table of groups, a job for any number of bytes."""

    def __init__(self, groups: DataFrame) -> None:
        self.groups = groups
        found = groups.agg(F.coalesce(F.max("end"), F.lit(0)).alias("total"), F.coalesce(F.max(F.col("end") - F.col("start")), F.lit(0)).alias("largest")).first()
        self.total, self.largest = found["total"], found["largest"]

    def around(self, points: list[int]) -> dict[int, tuple[int, int, int]]:
        """For each byte of the line: start and end of the group it lies in, and the rows before that group."""
        inside = sorted({p for p in points if 0 <= p < self.total})
        if not inside:
            return {}
        near = self.groups.where((F.col("start") <= inside[-1]) & (F.col("end") > inside[0]))
        hit = near.where(F.exists(F.array(*map(F.lit, inside)), lambda p: (p >= F.col("start")) & (p < F.col("end"))))
        # as many rows as points at most
        found = [(r["start"], r["end"], r["rows_before"]) for r in hit.collect()]
        return {p: next(g for g in found if g[0] <= p < g[1]) for p in inside}

    def down(self, points: list[int]) -> list[int]:
        """The last boundary at or before each point."""
        found = self.around(points)
        return [min(p, self.total) if p >= self.total else found[p][0] for p in points]

    def up(self, points: list[int]) -> list[int]:
        """The first boundary at or after each point."""
        found = self.around([p - 1 for p in points])
        return [0 if p <= 0 else found[p - 1][1] for p in points]


def smallest_capacity(at: Boundaries, shards: int, tried: int = TRIED) -> int:
    """The least capacity at which ``shards`` greedily filled shards hold all groups."""
    # a shard filled greedily stops less than the largest group short of its capacity
    low, high = max(-(-at.total // shards), at.largest), -(-at.total // shards) + at.largest
    while low < high:
        step = max(1, -(-(high - low) // (tried + 1)))
        capacities = list(range(low, high, step))
        reached = [0] * len(capacities)
        for _ in range(shards):
            reached = at.down([r + c for r, c in zip(reached, capacities, strict=True)])
        feasible = [c for c, r in zip(capacities, reached, strict=True) if r >= at.total]
        high = min(feasible, default=high)
        low = max((c + 1 for c in capacities if c < high), default=low)
    return high


def balanced_cuts(at: Boundaries, shards: int, capacity: int) -> list[int]:
    """Starts of the shards after the first: near equal, none above ``capacity``."""
    least = [at.total]
    for _ in range(shards - 1):
        least += at.up([max(0, least[-1] - capacity)])
    cuts: list[int] = []
    now = 0
    for left in range(shards - 1, 0, -1):
        share = now + -(-(at.total - now) // (left + 1))
        found = at.around([share])
        below, above = found[share][:2] if share in found else (at.total, at.total)
        # a shard is not left empty while there is something to put in
        near = below if now < below and share - below <= above - share else above
        reach = at.down([now + capacity])[0]
        now = min(reach, max(least[left], near))
        cuts.append(now)
    return cuts


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot in it, and grown_shard (null: another shard moves many rows)."""
    rows = materialize(measured(docs, id_col, text_col), "measured")
    groups = groups_of(rows)
    at = Boundaries(groups)
    cuts = balanced_cuts(at, shards, smallest_capacity(at, shards)) if at.total else []
    # one row a shard
    found = at.around(cuts)
    n_rows = rows.count()
    first = [0, *[found[c][2] if c in found else n_rows for c in cuts]]
    number = F.lit(0)
    for c in cuts:
        number = number + F.when(F.col("start") >= c, 1).otherwise(0)
    placed = rows.join(groups.select("digest", "start", number.cast("int").alias("shard")), "digest").select("doc_id", "size", "text_crc32", "start", "shard", "place")
    ordered = in_order(placed, "shards", [F.col("start"), F.col("doc_id").asc_nulls_last(), F.col("place")])
    # which partition a row is in says how many rows of all shards come before
    ordered = ordered.join(earlier_parts(ordered.groupBy("_part").agg(F.count("*").alias("n")), "n"), "_part")
    before = F.get(F.array(*map(F.lit, first)), F.col("shard"))
    slot = (F.col("_n_before") + F.col("_index") - before).cast("long")
    return ordered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
