"""Sites that arrive out of order, given on in order once nothing smaller can come; counted on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_emit(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, slack: int, files: int = 1) -> list[dict]:
    """Stream Parquet files of sites (chrom, pos, ..) from ``source`` to ``out``, each chromosome in order of pos.

    A site is held in the folder beside ``out`` until the positions seen on its
    chromosome have passed it by ``slack``, the farthest that a site comes late; the rest
    follows when the input ends. Each micro-batch writes its own folder, which a repeat
    overwrites, so a restart from ``checkpoint`` gives every site once, even where all batches are done and only
    the rest is not written. Returns counts for each batch of this run.
    """
    told: list[dict] = []
    held = f"{out}-held"

    def emit(batch: DataFrame, number: int) -> None:
        seen = batch
        if number:
            seen = batch.unionByName(spark.read.schema(schema).parquet(f"{held}/{number - 1}"))
        safe = seen.groupBy("chrom").agg((F.max("pos") - slack).alias("safe"))
        marked = seen.join(F.broadcast(safe), "chrom")  # a row for each chromosome
        ready = marked.filter("pos <= safe").drop("safe")
        ready.repartition("chrom").sortWithinPartitions("chrom", "pos").write.mode("overwrite").parquet(f"{out}/batch={number:06d}")
        marked.filter("pos > safe").drop("safe").write.mode("overwrite").parquet(f"{held}/{number}")
        told.append({"batch": number, "seen": batch.count()})

    query = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(held)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        last = max(int(f.getPath().getName()) for f in fs.listStatus(path))
        rest = spark.read.schema(schema).parquet(f"{held}/{last}")
        rest.repartition("chrom").sortWithinPartitions("chrom", "pos").write.mode("overwrite").parquet(f"{out}/batch={last + 1:06d}")
    return told


def running_spectrum(stream: DataFrame) -> DataFrame:
    """Site counts by allele count, kept up to date while sites stream by."""
    return stream.groupBy("ac").agg(F.count("*").alias("n_sites"))
