"""Approximate nearest neighbours by permutations of pivots."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

PIVOTS = 512
#: Nearest pivots of a vector that are posted, and that a query reads.
PREFIX = 64
#: Vectors from which pivots are drawn, far apart from each other.
PIVOT_SAMPLE = 4096
BLOCK = 8192
#: Share of a block, by footrule distance, that is compared exactly.
RERANKED = 0.3
#: Queries that one task holds.
QUERY_CHUNK = 16384


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` directions, each the farthest from those before it."""
    unit = np.unique(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), axis=0)
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    near = -(vectors @ pivots.T)
    first = np.argpartition(near, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.broadcast_to(np.arange(len(pivots)), near.shape)
    return np.take_along_axis(first, np.argsort(np.take_along_axis(near, first, 1), axis=1, kind="stable"), 1)


def post(rows: pa.Table, pivots: np.ndarray, prefix: int) -> pa.Table:
    """One block of the index: its vectors, and for each pivot the vectors near it with their place for it."""
    vectors = matrix(rows["vector"], pivots.shape[1])
    order = nearest_pivots(vectors, pivots, prefix).ravel()
    by_pivot = np.argsort(order, kind="stable")
    ends = np.cumsum(np.bincount(order, minlength=len(pivots)))
    return pa.table({
        "block": pa.array([rows["block"][0].as_py()], pa.int32()),
        "ids": pa.array([rows["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
        "vectors": pa.array([vectors.astype("<f8").tobytes()], pa.binary()),
        "posted": pa.array([(by_pivot // prefix).astype("<i4").tobytes()], pa.binary()),
        "places": pa.array([(by_pivot % prefix).astype("<i2").tobytes()], pa.binary()),
        "ends": pa.array([ends.astype("<i8").tobytes()], pa.binary()),
    })


def search_block(index: pa.Table, queries: pa.Table, pivots: np.ndarray, prefix: int, k: int, reranked: float) -> pa.Table:
    """The ``k`` best of one block for each query, among those of least footrule distance."""
    found: list[tuple[np.ndarray, ...]] = []
    if len(index) and len(queries):
        row = index.to_pylist()[0]
        ids, posted, places, ends = (np.frombuffer(row[c], t) for c, t in (("ids", "<i8"), ("posted", "<i4"), ("places", "<i2"), ("ends", "<i8")))
        vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
        starts, weight = np.r_[0, ends[:-1]], (prefix - places).astype(np.float64)
        asked, q_ids = matrix(queries["vector"], pivots.shape[1]), queries["vec_id"].to_numpy()
        most = max(int(np.ceil(reranked * len(ids))), k + 1)
        for q, q_id, order in zip(asked, q_ids, nearest_pivots(asked, pivots, prefix), strict=True):
            near = np.arange(len(ids))
            if most < len(ids):
                # footrule over the prefixes: prefix * (prefix + 1) - 2 * (sum of the lesser weights)
                lists = [slice(starts[p], ends[p]) for p in order]
                lesser = [np.minimum(weight[s], prefix - j) for j, s in enumerate(lists)]
                shared = np.bincount(np.concatenate([posted[s] for s in lists]), np.concatenate(lesser), len(ids))
                near = np.flatnonzero(shared >= np.partition(shared, len(ids) - most)[len(ids) - most])
            near = near[ids[near] != q_id]
            score = vectors[near] @ q
            if len(near) > k:
                best = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                near, score = near[best], score[best]
            best = np.lexsort((ids[near], -score))[:k]
            found.append((np.full(len(best), q_id), ids[near[best]], score[best]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) without rows whose vec_id is null, and without vectors that are null, empty, zero or hold a null or non-finite component."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    zero = F.forall("embedding", lambda x: x == 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).filter(~zero).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))


class PermutationIndex:
    """Vectors in hashed blocks, each with inverted files from pivots to the vectors near them.

    The pivots come from a sample of ``PIVOT_SAMPLE`` vectors; every vector is
    indexed. Vectors that ``usable`` leaves out, and those of another dimension than the first
    pivot's, take no part.
    """

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, prefix: int = PREFIX) -> None:
        rows = usable(vectors)
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
        self.dim = len(sample[0]["vector"]) if sample else 1
        self.pivots = far_apart(np.array([r["vector"] for r in sample if len(r["vector"]) == self.dim]), pivots) if sample else np.ones((1, 1))
        self.prefix = min(prefix, len(self.pivots))
        self.rows = rows.filter(F.size("vector") == self.dim)
        self.count_blocks = max(1, -(-self.rows.count() // BLOCK))
        placed = self.rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(self.count_blocks)).cast("int"))
        kind = "block int, ids binary, vectors binary, posted binary, places binary, ends binary"
        work = partial(post, pivots=self.pivots, prefix=self.prefix)

        def build(rows: pa.Table) -> pa.Table:
            return work(rows)

        self.blocks = save(placed.groupBy("block").applyInArrow(build, kind), "permutations")

    def search(self, queries: DataFrame, k: int, reranked: float = RERANKED) -> DataFrame:
        """The ``k`` best by inner product of each query (vec_id, vector) but itself: query_id, rank from 1, vec_id, score.

        Each block ranks its vectors by footrule distance between pivot orders, computes
        the inner products of the best ``reranked`` share in double precision and
        gives its ``k`` best; ties go to the smaller vec_id. Queries meet blocks in chunks, so a task holds
        one block and at most about ``QUERY_CHUNK`` queries.
        """
        chunks = max(1, -(-queries.count() // QUERY_CHUNK))
        asked = queries.filter(F.size("vector") == self.dim).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.count_blocks - 1))))
        index = self.blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        work = partial(search_block, pivots=self.pivots, prefix=self.prefix, k=k, reranked=reranked)

        def one(left: pa.Table, right: pa.Table) -> pa.Table:
            return work(left, right)

        found = index.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(one, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, reranked: float = RERANKED) -> DataFrame:
    """The ``k`` nearest of every row whose vec_id is divisible by ``every``, against all rows.

    Blocks of any size are searched through their inverted files; at a share ``reranked`` of 1
    the result is exact. Fewer candidates than ``k`` are all given; repeated rows count once each. An
    empty table gives an empty result. Other columns are ignored.
    """
    index = PermutationIndex(vectors)
    return index.search(index.rows.filter(F.col("vec_id") % every == 0), k, reranked)
