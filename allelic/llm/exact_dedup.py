"""Exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, new_path, partitions, save

#: Fixed value: white space that counts as one space.
SPACES = r"[\x20\x09-\x0D]+"


class DigestIndex:
    """Digests seen so far, in a Parquet table bucketed and sorted by digest.

    The files carry the layout; the session's catalogue is only told of it, so the
    index outlives the session: open it again with the same path and buckets. A join
    on the digest reads buckets in place, with no shuffle of the index; each append adds a sorted file to a
    bucket, and a bucket of several files is sorted again when it is read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.path, self.buckets = spark, path or new_path(spark, "digests"), buckets or partitions(spark)
        self.name = "digests_" + hashlib.md5(self.path.encode()).hexdigest()
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, new: DataFrame) -> None:
        """``new``: digest, keep_id, none of them in the index. One job, committed as a whole."""
        out = new.select("digest", "keep_id").repartition(self.buckets, "digest")
        out.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)


def normalised(text: str = "text"):
    """Null as empty; each run of white space as one space."""
    found = F.coalesce(F.col(text), F.lit(""))
    return F.regexp_replace(found, SPACES, " ")


def dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Deduplicate a batch of (doc_id, text) against ``index`` and itself, then append its new digests.

    Returns one row for each row: doc_id, keep_id (the row that stays: of the index,
    else the smallest doc_id of the batch), group_size (rows of the batch with that
    text), kept, text_sha256. A repeat of a batch after a failure finds its own
    digests and gives the same keep_id. Null text counts as empty; of rows that share
    a doc_id all are kept or none; null doc_ids are kept only where no other row has
    the text. An empty batch gives an empty result and leaves the index as it is.
    Other columns are ignored.
    """
    rows = save(docs.select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest")), "dedup-rows")
    batch = save(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "dedup-batch")
    known = index.table().hint("merge")
    seen = batch.join(known, "digest", "left").select("digest", "group_size", F.coalesce("keep_id", "first_id").alias("keep_id"))
    groups = save(seen, "dedup-groups")
    index.append(groups.join(known, "digest", "left_anti"))
    out = join_groups(rows, groups, "digest", "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
