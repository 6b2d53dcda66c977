"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import random
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, save, with_rank

#: Sizes below this are planned exactly; larger ones are rounded up by at most 1/1024.
EXACT_SIZES = 65536
#: Bytes that a row takes besides its text.
ROW_BYTES = 8


class FreeSpace:
    """Bins by free space in a balanced tree (a treap): ``take(size)`` gives the tightest bin that fits."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.random = random.Random(7)

    def put(self, free: int, bin_: int) -> None:
        low, high = self._split(self.root, (free, bin_))
        self.root = self._merge(self._merge(low, [(free, bin_), self.random.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._merge(low, rest)
        return node[0]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] < high[1]:
            return [low[0], low[1], low[2], self._merge(low[3], high)]
        return [high[0], high[1], self._merge(low, high[2]), high[3]]


def plan(sizes: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over (size, count): runs (size, first rank, rank after the last, bin), and the number of bins.

    A group over the capacity gets a bin of its own. Equal sizes are placed as
    runs: a bin that has taken one group is the tightest for the next.
    """
    free, runs, bins = FreeSpace(), [], 0
    for size, count in sorted(sizes, reverse=True):
        done = 0
        while done < count:
            found = free.take(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
            n = min(count - done, found[0] // size)
            runs.append((size, done, done + n, found[1]))
            done += n
            if size <= capacity and found[0] - n * size > 0:
                free.put(found[0] - n * size, found[1])
    return runs, bins


def least_capacity(sizes: list[tuple[int, int]], shards: int) -> int:
    """The smallest capacity, to one part in 10,000, at which best-fit decreasing needs at most ``shards`` bins."""
    total = sum(s * n for s, n in sizes)
    low, high = 0, max(1, -(-total // shards))
    while plan(sizes, high)[1] > shards:
        low, high = high, high + max(1, high // 8)
    # groups that fill bins of their own leave less for the others: the bound is below the mean, too
    low = low or min(high, max(1, high // 2))
    while high - low > max(1, high // 10_000):
        middle = (low + high) // 2
        low, high = (low, middle) if plan(sizes, middle)[1] <= shards else (middle, high)
    return high


def shard(docs: DataFrame, shards: int | None = 24, capacity: int | None = None) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into a shard; equal texts stay together.

    Give ``capacity`` for as few shards of that many bytes as possible, or
    ``shards`` for the smallest capacity that needs no more. A row's size is the
    UTF-8 bytes of its text plus 8.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in its shard).
    Null text counts as empty, so null and empty texts are one group. A group over
    the capacity gets a shard of its own. Equal ids are separate rows. An empty
    table gives an empty result. Other columns are ignored.

    The driver sees a histogram of group sizes: at most 65,536 exact sizes and
    1,024 for each doubling above, however many groups there are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = save(docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")), "shard-rows")
    grouped = rows.groupBy("digest").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("bytes")) - 10, F.lit(0)))
    planned = F.when(F.col("bytes") < EXACT_SIZES, F.col("bytes")).otherwise((F.ceil(F.col("bytes") / step) * step).cast("long"))
    groups = save(grouped.withColumn("planned", planned), "shard-groups")
    sizes = [(r["planned"], r["n"]) for r in groups.groupBy("planned").agg(F.count("*").alias("n")).collect()]
    runs = plan(sizes, capacity or least_capacity(sizes, shards or 1))[0]
    runs_df = docs.sparkSession.createDataFrame(pd.DataFrame(runs, columns=["planned", "first", "after", "shard"], dtype="int64"), "planned long, first long, after long, shard int")
    # runs: one for each size and bin it reaches, so bounded like the histogram
    ranked = with_rank(groups, ["planned"], ["digest"], "rank")
    placed = save(ranked.join(F.broadcast(runs_df), "planned").filter("rank >= first and rank < after").select("digest", "n", "shard"), "shard-groups-placed")
    whole = save(join_groups(rows, placed, "digest", "n").select("doc_id", "size", "text_crc32", "shard"), "shard-rows-placed")
    return with_rank(whole, ["shard"], ["doc_id", "text_crc32"], "slot")
