"""Intervals of ancestry: merging, tracts, intersection, fractions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], order: list[str], same: Column, name: str = "island") -> DataFrame:
    """Number runs of consecutive rows for which ``same`` (may use lag) holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def haplotypes(segments: DataFrame) -> DataFrame:
    """One row for each segment and haplotype: hap, pop."""
    return segments.select("person", "chrom", "start", "end", F.expr("stack(2, 1, hap1_pop, 2, hap2_pop) as (hap, pop)"))


def tracts(segments: DataFrame) -> DataFrame:
    """Consecutive segments of one population on a haplotype, gaps allowed, broken by chromosome or population."""
    w = Window.partitionBy("person", "hap").orderBy("chrom", "start")
    same = F.coalesce((F.lag("chrom").over(w) == F.col("chrom")) & (F.lag("pop").over(w) == F.col("pop")), F.lit(False))
    rows = haplotypes(segments).withColumn("same", same)
    runs = islands(rows, ["person", "hap"], ["chrom", "start"], F.col("same"))
    return runs.groupBy("person", "hap", "island").agg(F.first("chrom").alias("chrom"), F.first("pop").alias("pop"), F.min("start").alias("start"), F.max("end").alias("end"))


def tract_stats(tracts: DataFrame) -> DataFrame:
    length = F.col("end") - F.col("start")
    return tracts.groupBy("pop").agg(F.count("*").alias("n"), F.round(F.avg(length), 6).alias("mean"), F.floor(F.median(length)).cast("long").alias("median"))


def merge_adjacent(segments: DataFrame) -> DataFrame:
    """Join neighbours that touch and agree in both populations."""
    w = Window.partitionBy("person", "chrom").orderBy("start")
    same = (F.lag("end").over(w) == F.col("start")) & (F.lag("hap1_pop").over(w) == F.col("hap1_pop")) & (F.lag("hap2_pop").over(w) == F.col("hap2_pop"))
    runs = islands(segments.withColumn("same", F.coalesce(same, F.lit(False))), ["person", "chrom"], ["start"], F.col("same"))
    return runs.groupBy("person", "chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("hap1_pop").alias("hap1_pop"), F.first("hap2_pop").alias("hap2_pop")).drop("island")


def intersect(a: DataFrame, b: DataFrame, width: int = 100_000) -> DataFrame:
    """Overlaps of two segment lists (person, chrom, start, end, pop): hap1_pop from ``a``, hap2_pop from ``b``.

    Both sides are dealt into windows of ``width``, so the join is a hash join on
    (person, chrom, window); an overlap is told once, in the window where it begins.
    """
    window = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    left = a.select("person", "chrom", F.col("start").alias("s1"), F.col("end").alias("e1"), F.col("pop").alias("hap1_pop")).filter("s1 < e1").withColumn("w", window("s1", "e1"))
    right = b.select("person", "chrom", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("pop").alias("hap2_pop")).filter("s2 < e2").withColumn("w", window("s2", "e2"))
    start, end = F.greatest("s1", "s2"), F.least("e1", "e2")
    met = left.join(right, ["person", "chrom", "w"]).filter((start < end) & (F.floor(start / width) == F.col("w")))
    return met.select("person", "chrom", start.alias("start"), end.alias("end"), "hap1_pop", "hap2_pop")


def ancestry_fractions(segments: DataFrame, pops: tuple[str, ...] = ("EUR", "SAS", "AFR")) -> DataFrame:
    """Share of each person's base pairs over both haplotypes; the named populations are always there."""
    spans = haplotypes(segments).groupBy("person", "pop").agg(F.sum(F.col("end") - F.col("start")).alias("bp"))
    people = segments.select("person").distinct()
    spine = people.withColumn("pop", F.explode(F.array(*map(F.lit, pops)))).unionByName(spans.select("person", "pop")).distinct()
    full = spine.join(spans, ["person", "pop"], "left").withColumn("bp", F.coalesce("bp", F.lit(0).cast("long")))
    total = F.sum("bp").over(Window.partitionBy("person"))
    return full.withColumn("fraction", F.round(F.col("bp") / total, 6))


def dominant(fractions: DataFrame) -> DataFrame:
    """The population with the greatest share; ties to the first name."""
    best = F.max(F.struct("bp", F.translate("pop", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ZYXWVUTSRQPONMLKJIHGFEDCBA").alias("t"), "pop"))
    return fractions.groupBy("person").agg(best.alias("b")).select("person", F.concat(F.col("b.pop"), F.lit("-dominant")).alias("label"))
