"""Best-fit packing of documents into sequences, planned on a histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small_batches, tidied
from .tokens import encoder

LENGTH = 2048
#: Ids after which a worker hands on what it has cut.
HELD_IDS = 1 << 19
#: Slots that are broadcast, of 48 bytes each; beyond, pieces and slots meet in a shuffle.
BROADCAST_SLOTS = 1_000_000


def cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces, each with its partition and its rank among the pieces of its length there."""
    from pyspark import TaskContext

    own, part, met = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (length + 1)
    end = np.array([end_id], "<u4")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "own_rank", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    rows: list[tuple] = []
    held = 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    for batch in tidied(batches, keep=True):
        for doc, found in zip(batch.column(0).to_pylist(), own.encode_all(batch.column(1)), strict=True):
            ids = np.concatenate([found.astype("<u4"), end])
            for piece, start in enumerate(range(0, len(ids), length)):
                digest = ids[start : start + length].tobytes()
                n = len(digest) // 4
                rows.append((doc, piece, start, n, zlib.crc32(digest), part, met[n], *([digest] if with_ids else [])))
                met[n] += 1
            held += len(ids)
            if held >= HELD_IDS:
                yield close()
                rows, held = [], 0
    if rows:
        yield close()


def plan(counts: dict[int, int], length: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over the counts of lengths.

    Returns runs (length, first rank, rank after the last, first sequence, offset),
    in which piece ``first rank + i`` goes to ``first sequence + i``, and the number of
    sequences. Sequences with equal free space are handled as ranges, so the work
    follows the number of lengths, not of pieces.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # by free space: ranges of sequences
    runs, used = [], 0
    for size in sorted(counts, reverse=True):
        rank, left, space = 0, counts[size], size
        while left:
            while space <= length and not free[space]:
                space += 1
            if space <= length:
                first, after = free[space].pop()
                room = space
            else:
                fit = length // size
                first, after, room = used, used - (-left // fit), length
                used = after
            fit = room // size
            full = min(after - first, left // fit)  # sequences that take as many as fit
            for k in range(fit if full else 0):
                runs.append((size, rank, rank + full, first, length - room + k * size))
                rank += full
            left -= fit * full
            if full and room - fit * size:
                free[room - fit * size].append((first, first + full))
            if left and first + full < after:  # the last pieces, in one sequence
                for k in range(left):
                    runs.append((size, rank + k, rank + k + 1, first + full, length - room + k * size))
                if room - left * size:
                    free[room - left * size].append((first + full, first + full + 1))
                full, rank, left = full + 1, rank + left, 0
            if first + full < after:
                free[room].append((first + full, after))
            space = size
    return runs, used


def slots(pieces: DataFrame, length: int) -> DataFrame:
    """Where the pieces go: part, length, own ranks from ``low`` to before ``high``, whose first takes place ``offset`` of ``sequence``, the next the same of the next.

    Pieces of a length are ranked by partition, then by their rank there, so only counts are summed and moved.
    """
    spark = pieces.sparkSession
    each = save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = pd.DataFrame(plan(counts, length)[0], columns=["length", "first", "after", "sequence", "offset"], dtype="int64")
    planned = spark.createDataFrame(runs, "length long, first long, after long, sequence long, offset long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # at most length * length runs, whatever the number of documents
    met = ranked.join(F.broadcast(planned), "length").filter("first < before + n and after > before")
    low, high = F.greatest("first", "before"), F.least("after", F.col("before") + F.col("n"))
    return met.select("part", "length", (low - F.col("before")).alias("low"), (high - F.col("before")).alias("high"), (F.col("sequence") + low - F.col("first")).alias("sequence"), "offset")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pack the token ids of ``docs`` (doc_id, text) into as few sequences of at most ``length`` ids as best fit finds.

    A document's ids end with ``end_id``; only documents over ``length`` are cut. Returns
    one row for each piece: doc_id, piece, start (ids of its document before it), length, ids_crc32,
    ids (little-endian unsigned 32-bit; only ``with_ids``), sequence_id, offset (gapless from 0).

    Null text counts as empty and gives the end id alone; null doc_ids are kept. Equal ids are separate
    documents. Of pieces of equal length any may take a planned slot. An empty table gives an empty result. Other columns are ignored. The driver sees one count
    for each length, ``length`` at most. The pieces with their ids stay where they were cut if there are few slots
    (one for each length of a partition, and one more for each run of the plan that ends there); else they move once.
    """
    small_batches(docs.sparkSession)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, own_rank long" + ", ids binary" * with_ids
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = save(text.mapInArrow(partial(cut, tokenizer=tokenizer, end_id=end_id, length=length, with_ids=with_ids), kind), "pieces")
    placed = save(slots(pieces, length), "slots")
    few = placed.count() <= BROADCAST_SLOTS
    found = pieces.join(F.broadcast(placed) if few else placed, ["part", "length"]).filter("own_rank >= low and own_rank < high")
    at = found.withColumn("sequence_id", F.col("sequence") + F.col("own_rank") - F.col("low"))
    return at.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")
