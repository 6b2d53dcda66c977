"""Shared helpers: scratch tables, gapless ranks and skew-safe join-backs."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Functions go to the executors by value, so these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: A group with over 1/HOT_SHARE of all rows is hot: there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="allelic-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/allelic/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*saved: DataFrame) -> None:
    """Delete tables made by ``save`` that nothing reads any more."""
    for df in saved:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on a Python worker gets at most BATCH_BYTES at once, whatever the length of texts; a lower setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Rows of Parquet that a task decodes at once: the texts of a batch lie in the heap together.
READ_ROWS = 8


def small_texts(spark: SparkSession) -> None:
    """From now on a task decodes at most READ_ROWS rows of Parquet at once, and looks at the size of the page it writes from the first row on, not after 100: long texts in its heap are few. Lower settings of the session stay."""
    for name, most, usual in (("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS, "4096"), ("parquet.page.size.row.check.min", 1, "100")):
        if int(spark.conf.get(name, usual)) > most:
            spark.conf.set(name, str(most))


@contextlib.contextmanager
def small_reads(spark: SparkSession) -> Iterator[None]:
    """For what runs meanwhile, a task holds the texts of at most READ_ROWS rows of a Parquet file, however long they are; a lower setting of the session stays."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), READ_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add a gapless rank from 0 within ``keys``.

    Rows of a key are dealt into salted parts, so a key that holds most rows is
    ranked by many tasks; part counts become offsets. ``df`` must be a saved
    table, as it is read twice.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(partitions(df.sparkSession))).cast("int"))
    parts = [*keys, "_salt"]
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(*parts).agg(F.count("*").alias("_n")).select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    return ranked.join(offsets, parts).withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long")).drop("_salt", "_row", "_n", "_before")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with their one row of ``groups``.

    Groups over 1/1000 of all rows, of which there can't be 1000, are broadcast, so
    their rows stay where they are; the rest meets in a shuffle. ``rows`` and
    ``groups`` must be saved tables, as both are read twice.
    """
    least = max(1, rows.count() // HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(size) > least))
    cold = groups.filter(F.col(size) <= least)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


def crc32_of_id(col: str) -> Column:
    """crc32 of an id written as text, as the held-out folds use it."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


#: Ids that are broadcast to leave documents out; more of them meet the documents in a shuffle.
BROADCAST_IDS = 4_000_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``dropped`` (a saved table); texts stay in place if the ids are few."""
    ids = dropped.select("doc_id")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


def as_bytes(column: pa.BinaryArray) -> list[bytes]:
    """The values of a column without nulls."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = bytes(data)
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def slices(texts: pa.StringArray, size: int) -> Iterator[pa.StringArray]:
    """``texts`` (no nulls) in stretches of at most ``size`` bytes, or of one text."""
    before = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)]
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(before, before[at] + size, "right")) - 1 - at)
        yield texts.slice(at, n)
        at += n


def once(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gave the first time in this process, until another key is asked for: a worker holds one cache at a time.

    It is kept in a module of its own, as functions sent by value have new globals in each task.
    """
    kept = sys.modules.setdefault("_allelic_worker", types.ModuleType("_allelic_worker")).__dict__
    if kept.get("key") != key:
        kept["value"] = None
        kept["value"], kept["key"] = make(), key
    return kept["value"]


def tidied(batches: Iterable, keep: bool = False) -> Iterator:
    """The same batches; then, as workers stay for the next stage, memory goes back to the system, at once what ``once`` holds too unless ``keep``."""
    if not keep:
        sys.modules.pop("_allelic_worker", None)
    yield from batches
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
