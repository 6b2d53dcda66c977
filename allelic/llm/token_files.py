"""Token files: canonical length-limited Huffman codes in independent blocks with bit-offset checkpoints."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, partitions, save, small_batches, tidied
from .tokens import Encoder, encoder

#: Longest code, in bits; tables of 2 ** LIMIT entries decode it.
LIMIT = 20
#: A block closes once it holds this many ids; a document is never split over blocks.
BLOCK_IDS = 1 << 18
#: Ids between two checkpoints.
STEP = 256
BLOCK = "part int, block int, doc_ids array<long>, lengths array<long>, n long"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for unused symbols."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    merged, leaves = weights, [np.ones(len(used), bool)]
    for _ in range(limit - 1):
        packs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packs])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        leaves.append(order < len(used))
    lengths, take = np.zeros(len(used), np.int64), 2 * len(used) - 2
    for is_leaf in reversed(leaves):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), counted up."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    sizes = lengths[order].astype(np.int64)
    first, code = 0, 0
    for size in range(1, int(sizes.max(initial=0)) + 1):
        n = int((sizes == size).sum())
        code <<= 1
        codes[order[first : first + n]] = np.arange(code, code + n, dtype=np.uint64)
        first, code = first + n, code + n
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """The bits of ``ids``, and the bit offset of every STEP-th id (unsigned 64-bit)."""
    if not len(ids):
        return b"", b""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    word, shift = starts >> 6, 64 - (starts & 63) - size
    code = codes[ids]
    words = np.zeros((int(ends[-1]) >> 6) + 1, np.uint64)
    high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[heads]] = np.bitwise_or.reduceat(high, heads)
    over = np.flatnonzero(shift < 0)
    words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return words.astype(">u8").tobytes(), starts[::STEP].astype("<u8").tobytes()


class Decoder:
    """Table-driven: the next LIMIT bits give the symbol and its length; all stretches between checkpoints go in step."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.symbols, self.sizes = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0].astype(np.uint32)
        spans = 1 << (LIMIT - lengths[order].astype(np.int64))
        total = int(spans.sum())
        self.symbols[:total] = np.repeat(order, spans)
        self.sizes[:total] = np.repeat(lengths[order], spans)

    def decode(self, bits: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        if not n:
            return np.empty(0, np.uint32)
        b = np.frombuffer(bits + bytes(4), np.uint8).astype(np.uint32)
        window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        out, mask = np.empty((STEP, len(at)), np.uint32), np.uint32((1 << LIMIT) - 1)
        last = len(window) - 1
        for i in range(STEP):
            key = window[np.minimum(at >> 3, last)] >> (32 - LIMIT - (at & 7)).astype(np.uint32) & mask
            out[i] = self.symbols[key]
            at = at + self.sizes[key]
        return out.T.reshape(-1)[:n]


def tokenize(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, vocabulary: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole documents, in the order of the partition; then a row, block -1, that holds how often each id occurs in it."""
    from pyspark import TaskContext

    own, part, block, kind = encoder(tokenizer), TaskContext.get().partitionId(), 0, pa.list_(pa.int64())
    counts, end = np.zeros(vocabulary, np.int64), np.array([end_id], own.dtype)
    docs, data, held = [], [], 0

    def row(block: int, docs: list, sizes: list[int], n: int, ids: bytes) -> pa.RecordBatch:
        columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], kind), pa.array([sizes], kind), pa.array([n], pa.int64()), pa.array([ids], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "block", "doc_ids", "lengths", "n", "ids"])

    def close() -> pa.RecordBatch:
        ids = np.concatenate([x for own_ids in data for x in (own_ids, end)])
        np.add(counts, np.bincount(ids, minlength=vocabulary), out=counts)
        return row(block, docs, [len(x) + 1 for x in data], held, ids.tobytes())

    for batch in tidied(batches, keep=True):
        for doc, ids in zip(batch.column(0).to_pylist(), own.encode_all(batch.column(1)), strict=True):
            docs.append(doc)
            data.append(ids)
            held += len(ids) + 1
            if held >= BLOCK_IDS:
                yield close()
                docs, data, held, block = [], [], 0, block + 1
    if docs:
        yield close()
    used = np.flatnonzero(counts)
    yield row(-1, used.tolist(), counts[used].tolist(), 0, b"")


def compress(batches: Iterator[pa.RecordBatch], dtype: np.dtype, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    codes = canonical_codes(lengths)
    for batch in tidied(batches):
        at = batch.schema.get_field_index("ids")
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            bits, checkpoints = pack_bits(np.frombuffer(row.column(at)[0].as_buffer(), dtype), lengths, codes)
            names = ["part", "block", "doc_ids", "lengths", "n", "start"]
            yield pa.RecordBatch.from_arrays([*(row.column(row.schema.get_field_index(c)) for c in names), pa.array([bits], pa.binary()), pa.array([checkpoints], pa.binary())], [*names, "bits", "checkpoints"])


def decompress(batches: Iterator[pa.RecordBatch], lengths: np.ndarray, with_ids: bool) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(lengths)
    for batch in tidied(batches):
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = decoder.decode(row["bits"], row["checkpoints"], row["n"]).astype("<u4")
            sizes = np.array(row["lengths"], np.int64)
            before = np.cumsum(sizes) - sizes
            own = [ids[a : a + n].tobytes() for a, n in zip(before, sizes, strict=True)]
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(before + row["start"], pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of ``docs`` (doc_id, text), each ended by ``end_id``, in ascending doc_id order to the folder ``path``.

    ``path``/codebook holds each used id's code length, from which the canonical codes
    follow; ``path``/blocks a row for each block: part and block (its place in the order), doc_ids
    and lengths of its documents, n and start (ids in it and before it), bits, and a checkpoint, the bit offset, for
    every 256th id, from which decoding can begin. Blocks are rows of Parquet files, so any store that Spark
    reaches will do and a lost task leaves nothing half written.

    Null text counts as empty; equal doc_ids are separate documents; null doc_ids come first. An empty table gives an empty file. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = Encoder(tokenizer)
    dtype, vocabulary = own.dtype, max(own.tokenizer.get_vocab_size(), end_id + 1)
    del own
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = text.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    cut = partial(tokenize, tokenizer=tokenizer, end_id=end_id, vocabulary=vocabulary)
    both = save(ranged.mapInArrow(cut, f"{BLOCK}, ids binary"), "token-blocks")
    raw, counts = both.filter("block >= 0"), np.zeros(vocabulary, np.int64)
    counted = both.filter("block < 0").select(F.explode(F.arrays_zip("doc_ids", "lengths")).alias("c"))
    for r in counted.groupBy(F.col("c.doc_ids").alias("id")).agg(F.sum("c.lengths").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]  # one row for each id of the vocabulary at most
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    # a row for each range partition; then blocks of one part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = raw.groupBy("part").agg(F.sum("n").alias("own")).select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = raw.select("part", "block", "n").withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
    starts = save(starts.select("part", "block", (F.col("part_start") + F.col("inside")).alias("start")), "token-starts")
    # one row for each block of 2 ** 18 ids: broadcast by Spark's own size check, else shuffled
    blocks = raw.join(starts, ["part", "block"]).mapInArrow(partial(compress, dtype=dtype, lengths=lengths), f"{BLOCK}, start long, bits binary, checkpoints binary")
    blocks.write.parquet(f"{path}/blocks")
    drop(both, starts)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode a folder that ``write`` made: doc_id, start, n_tokens, ids_crc32 and, unless refused, ids (little-endian unsigned 32-bit)."""
    book = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.parquet(f"{path}/blocks").select("doc_ids", "lengths", "n", "start", "bits", "checkpoints")
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return blocks.mapInArrow(partial(decompress, lengths=lengths, with_ids=with_ids), kind)
