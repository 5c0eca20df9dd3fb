"""Sharding by best-fit decreasing over indivisible groups.

Groups (here: rows of equal text) sorted by size, largest first, each enter
the open bin with the tightest remaining capacity that still holds them; a
balanced tree finds that bin in O(log n), and a new bin is opened only where
none fits, which minimises the number of fixed-capacity shards.

Groups of one size are interchangeable, and the bin that took one of them is
still the tightest for the next, as long as it has room.  So Spark counts the
groups of each size, the driver packs these counts (with the same result as one
by one), and its plan says which groups of a size, by their number, enter which
bin; Spark numbers the groups of a size and joins the plan.  Sizes are rounded
up to ``fine`` significant bits for this, so they are exact below 2^``fine``
bytes, at most 1 / 2^(``fine`` - 1) too large above, and there are at most a few
thousand of them whatever the input.  A shard never holds more than its capacity.

``fixed`` returns as few shards of a capacity as the method finds; a group
above the capacity gets a shard of its own.  ``assign`` looks for the smallest
capacity with which the method needs no more than a given number of shards,
which makes the shard sizes near equal.  A single group of more than one
shard's fair share cannot be split and has a shard of its own; the others share the rest.

Null text has no bytes, so it counts as an empty text; a table without rows
gives an empty result; rows with the same id are placed one by one; groups of
one size are numbered by their text's digest, and slots follow the order in
which Spark reads the rows; other columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ids_and_texts, partitions, reliable, written

FINE = 11
CELL = 1024  # groups of one size whose plan is looked up together


class OpenBins:
    """Balanced search tree (a treap) of (remaining capacity, bin)."""

    def __init__(self):
        self.root, self.random = None, random.Random(0)

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], self._merge(a[3], b)
        return b[0], b[1], self._merge(a, b[2]), b[3]

    def _split(self, node, key):
        """Two trees: keys below ``key``, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = self._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    def add(self, remaining: int, bin_id: int) -> None:
        low, high = self._split(self.root, (remaining, bin_id))
        self.root = self._merge(self._merge(low, ((remaining, bin_id), self.random.random(), None, None)), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest (remaining, bin) with room for ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._merge(low, rest)
        return node[0]


Plan = list[tuple[int, int, int, int]]  # size, first and one past the last group of that size, bin


def pack_counts(counts: dict[int, int], capacity: int, most: int | None = None) -> Plan | None:
    """Best-fit decreasing of ``counts`` (size -> number of groups); None if more than ``most`` bins would be opened."""
    tree, plan, opened = OpenBins(), [], 0
    for size, n in sorted(counts.items(), reverse=True):
        done = 0
        while done < n:
            found = tree.take(size)
            if found is None:
                if opened == most:
                    return None
                found = (max(capacity, size), opened)
                opened += 1
            remaining, own = found
            taken = min(n - done, remaining // size)
            plan.append((size, done, done + taken, own))
            done += taken
            if remaining > taken * size:
                tree.add(remaining - taken * size, own)
    return plan


def pack(sizes: dict[int, int], capacity: int, most: int | None = None) -> dict[int, int] | None:
    """item -> bin by best-fit decreasing; None if more than ``most`` bins would be opened."""
    items: dict[int, list[int]] = {}
    for item, size in sorted(sizes.items()):
        items.setdefault(size, []).append(item)
    plan = pack_counts({size: len(own) for size, own in items.items()}, capacity, most)
    return None if plan is None else {item: own for size, a, b, own in plan for item in items[size][a:b]}


def pack_into(counts: dict[int, int], shards: int) -> Plan:
    """The plan with the smallest capacity, as far as doubling steps and halving find it, that needs no more than ``shards`` bins."""
    rest, left = sum(size * n for size, n in counts.items()), shards
    for size, n in sorted(counts.items(), reverse=True):
        alone = min(n, left - 1) if size * left > rest else 0  # above a fair share of what is left: a bin of its own
        if not alone:
            break
        rest, left = rest - size * alone, left - alone
    low = max(-(-rest // left), 1)
    step, best = 0, None
    while best is None:  # succeeds at the latest with the largest group of slack
        capacity = low + step
        best = pack_counts(counts, capacity, shards)
        if best is None:
            low, step = capacity + 1, 2 * step + 1
    while low < capacity:
        middle = (low + capacity) // 2
        plan = pack_counts(counts, middle, shards)
        if plan is None:
            low = middle + 1
        else:
            best, capacity = plan, middle
    return best


def text_key(text: Column) -> Column:
    """128 bits of a text: equal keys mean equal texts."""
    return F.md5(text.cast("binary"))


def rounded(size: Column, fine: int = FINE) -> Column:
    """``size`` rounded up to ``fine`` significant bits."""
    unit = F.pow(F.lit(2), F.greatest(F.length(F.bin(size)) - fine, F.lit(0))).cast("bigint")  # exact: a power of two
    return (size + unit - 1) - F.pmod(size + unit - 1, unit)


def _blocked(rows: DataFrame, keys: list[str], order: list[str], start: str) -> DataFrame:
    """``rows`` with a gapless number ``start`` from 0 within ``keys``: blocks (column ``block``) are counted first, each starts where the one before ends.

    A window sees the counts of one key, at most one for each block, or the rows of one key and block.
    """
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"))
              .select(*keys, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__tw_before")))
    within = F.row_number().over(Window.partitionBy(*keys, "block").orderBy(*order))
    return rows.join(starts, [*keys, "block"]).withColumn(start, F.col("__tw_before") + within - 1).drop("__tw_before")


def _measured(docs: DataFrame, fine: int) -> tuple[DataFrame, DataFrame, DataFrame, dict[int, int]]:
    """Rows, their counts by text and block, groups with their rounded size, and the number of groups of each size."""
    spark = docs.sparkSession
    blocks = 4 * partitions(spark)
    text = F.col("text").cast("binary")
    rows = ids_and_texts(docs).select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                                      text_key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("place"))
    # the checkpoint fixes the places; blocks cut a hot text, and repeated rows, into parts
    rows = reliable(rows).withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int"))
    parts = rows.groupBy("key", "block").agg(F.sum("size").alias("bytes"))
    groups = written(parts.groupBy("key").agg(rounded(F.sum("bytes"), fine).alias("size"))
                     .withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")))
    counts = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded by ``rounded``
    return rows, parts, groups, counts


def _placed(rows: DataFrame, parts: DataFrame, groups: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    ranges = (rows.sparkSession.createDataFrame(plan, "size bigint, first bigint, last bigint, shard int")
              .withColumn("cell", F.explode(F.expr(f"sequence(first div {CELL}, (last - 1) div {CELL})"))))
    # a cell has CELL groups and at most as many ranges
    numbered = _blocked(groups, ["size"], ["key"], "number").withColumn("cell", F.expr(f"number div {CELL}"))
    shards = numbered.join(ranges, ["size", "cell"]).where("number >= first and number < last").select("key", "shard")
    by_part = parts.select("key", "block").join(shards, "key")
    sharded = rows.join(by_part, ["key", "block"]).select("doc_id", "size", "text_crc32", "shard", "block", "place")
    return _blocked(sharded, ["shard"], ["place"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def fixed(docs: DataFrame, capacity: int, fine: int = FINE) -> DataFrame:
    """doc_id, size (bytes + 1), text_crc32, shard and slot of every row, in as few shards of ``capacity`` bytes as best fit finds."""
    rows, parts, groups, counts = _measured(docs, fine)
    return _placed(rows, parts, groups, pack_counts(counts, capacity))


def assign(docs: DataFrame, shards: int = 8, fine: int = FINE) -> DataFrame:
    """doc_id, size (bytes + 1), text_crc32, law 'bytes', shard, slot and grown_shard (null) of every row.

    Rows of equal text share a shard.  Slots number the rows of a shard without gaps.
    """
    rows, parts, groups, counts = _measured(docs, fine)
    placed = _placed(rows, parts, groups, pack_into(counts, shards))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
