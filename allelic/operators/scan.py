"""Looking for one variant in many files, its carriers, and quality control of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import annotation as A
from ..functions import genotype as G
from ..functions import variant as V

LONGEST_CHROM = 300_000_000


def matches(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Calls at each target's position (chromosome with or without chr), with whether the alleles are the target's."""
    own = calls.withColumn("bare", V.bare_chrom(F.col("chrom"))).drop("chrom")
    t = targets.select("name", V.bare_chrom(F.col("t_chrom")).alias("bare"), F.col("t_pos").alias("pos"), "t_ref", "t_alt", "min_af", "max_af")
    met = own.join(F.broadcast(t), ["bare", "pos"])  # a handful of wanted variants
    return met.withColumn("same", (F.col("ref") == F.col("t_ref")) & (F.col("alt") == F.col("t_alt")))


def variant_scan(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each file and target: a status of seven, frequency, and carriers.

    The frequency is INFO/AF of the first record (by ``ord``) with the target's alleles, where the calls have ``info``
    and ``ord`` and AF is a number; else allele counts over all its calls.
    """
    files = calls.select("file", V.bare_chrom(F.col("chrom")).alias("bare")).distinct()
    names = files.select("file").distinct()
    spine = names.crossJoin(F.broadcast(targets)).withColumn("bare", V.bare_chrom(F.col("t_chrom")))
    spine = spine.join(files.withColumn("has_chrom", F.lit(True)), ["file", "bare"], "left")
    d = F.when(F.col("same"), G.first_alt_dosage(F.col("gt")))
    a = G.alleles(F.col("gt"))
    s = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    told = F.min_by(A.info_value(F.col("info"), "AF").try_cast("double"), F.when(F.col("same"), F.col("ord"))) if {"info", "ord"} <= set(calls.columns) else F.lit(None).cast("double")
    found = matches(calls, targets).groupBy("file", "name").agg(
        F.count("*").alias("n_there"), s(F.col("same")).alias("n_same"), F.sum(F.when(F.col("same"), F.size(F.filter(a, lambda x: ~x.isin(".", "0"))))).alias("ac"),
        F.sum(F.when(F.col("same"), F.size(F.filter(a, lambda x: x != ".")))).alias("an"), s(d == 1).alias("n_het"), s(d == 2).alias("n_hom"), s(d >= 1).alias("n_carriers"), told.alias("told"),
    )
    out = spine.join(found, ["file", "name"], "left").withColumn("af", F.round(F.coalesce("told", F.try_divide(F.col("ac").cast("double"), F.col("an"))), 6))
    status = (
        F.when(F.col("has_chrom").isNull(), "not_applicable").when(F.col("n_there").isNull(), "position_empty").when(F.col("n_same") == 0, "absent").when(F.col("af").isNull(), "present_af_unknown")
        .when(F.col("af") < F.col("min_af"), "present_below_threshold").when(F.col("af") > F.col("max_af"), "present_above_threshold").otherwise("present_in_range")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("file", "name", status.alias("status"), "af", zero("n_same"), zero("n_carriers"), zero("n_het"), zero("n_hom"))


def carriers(calls: DataFrame, targets: DataFrame) -> DataFrame:
    d = G.first_alt_dosage(F.col("gt"))
    return matches(calls, targets).filter(F.col("same") & (d >= 1)).select("name", "file", "sample", F.col("id").alias("variant_id"), F.col("bare").alias("chrom"), "pos", "ref", "alt", F.col("gt").alias("genotype"), d.cast("long").alias("alt_dosage"))


def carrier_report(rows: DataFrame, *keys: str) -> DataFrame:
    s = lambda test: F.coalesce(F.sum(F.when(test, 1)), F.lit(0)).cast("long")
    het, hom = s(F.col("alt_dosage") == 1), s(F.col("alt_dosage") == 2)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct("sample").alias("n_samples"), het.alias("n_het"), hom.alias("n_hom"), F.countDistinct("file").alias("n_files"), (het + 2 * hom).alias("alleles"))


def status_counts(scan: DataFrame) -> DataFrame:
    return scan.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def qc(files: DataFrame) -> DataFrame:
    """Errors, warnings and verdict of each file.

    ``files``: file, exists, size_bytes, indexed, header_ok, chrom_line, samples, reference,
    info_ids, has_gt, contigs (array), n_variants, overlong (array of contigs with positions past 300 Mb). A missing or empty file, or a
    header that can't be read, ends the checks; overlong positions are told only where there is no error.
    """
    c = F.col
    gone, empty = ~c("exists"), c("exists") & (c("size_bytes") == 0)
    there = ~gone & ~empty
    readable = there & c("header_ok")
    say = lambda test, text: F.when(test, F.lit(text) if isinstance(text, str) else text)
    odd = F.filter("contigs", lambda x: ~V.is_human(x))
    human = F.size(F.filter("contigs", V.is_human)) > 0
    seen = F.size("contigs") > 0
    errors = [
        say(gone, "file does not exist"), say(empty, "file is empty"), say(there & ~c("indexed"), "missing tabix index"), say(there & ~c("header_ok"), "cannot read header"),
        say(readable & ~c("chrom_line"), "header has no #CHROM line"), say(readable & c("chrom_line") & (F.size("samples") == 0), "#CHROM line has no sample columns"),
        say(readable & ~seen, "no contigs found in index"), say(readable & (c("n_variants") == 0), "file contains zero variant records"),
    ]
    info = c("info_ids")
    frequency = F.array_contains(info, "AF") | (F.array_contains(info, "AC") & F.array_contains(info, "AN"))
    build = A.genome_build(F.coalesce("reference", F.lit("")))
    out = files.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("reference_build", F.when(readable, build))
    warnings = [
        say(readable & build.isNull(), "reference does not match any recognised human build"), say(readable & seen & ~human, "no indexed contigs match human chromosome names"),
        say(readable & human & (F.size(odd) > 0), F.concat(F.lit("non-human contigs: "), F.array_join(odd, ","))), say(readable & ~c("has_gt"), "header does not declare FORMAT=GT"),
        say(readable & ~frequency, "header declares neither AF nor AC+AN"), say(readable & seen & (F.size("errors") == 0) & (F.size("overlong") > 0), F.concat(F.lit("positions past 300 Mb: "), F.array_join("overlong", ","))),
    ]
    return out.withColumn("warnings", F.array_compact(F.array(*warnings))).withColumn("pass", F.size("errors") == 0)


def qc_report(checked: DataFrame) -> DataFrame:
    s = lambda test: F.coalesce(F.sum(F.when(test, 1)), F.lit(0)).cast("long")
    warned = F.size("warnings") > 0
    return checked.agg(F.count("*").alias("total"), s(F.col("pass")).alias("passed"), s(~F.col("pass")).alias("failed"), s(warned).alias("with_warnings"), s(F.col("pass") & warned).alias("passed_with_warnings"))


def contig_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("file", "chrom").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.max((F.col("pos") > LONGEST_CHROM).cast("long")).alias("overlong"))


def metadata(calls: DataFrame) -> DataFrame:
    """Contigs, records, samples, a hash of the sorted sample names, and the tags in the name of each file: ``file_name``, or ``file`` where calls have no such column."""
    names = calls.select("file", "sample").distinct().groupBy("file").agg(F.count("*").alias("n_samples"), F.md5(F.array_join(F.array_sort(F.collect_list("sample")), "\n")).alias("sample_hash"))
    counted = calls.groupBy("file").agg(F.count("*").alias("n_variants"), F.array_join(F.array_sort(F.collect_set("chrom")), ",").alias("contigs"), F.min("file_name" if "file_name" in calls.columns else "file").alias("file_name"))
    tags = lambda c: F.regexp_extract("file_name", c, 0)
    return counted.join(names, "file").withColumns({"pipeline_tag": tags(r"phase\d+_[a-z0-9_]+"), "date_stamp": tags(r"\d{8}")})


def metadata_report(meta: DataFrame) -> DataFrame:
    names = F.array_distinct(F.flatten(F.collect_list(F.split("contigs", ","))))
    ordered = F.array_sort(F.transform(names, lambda x: F.struct(F.length(x).alias("n"), x.alias("c"))))
    return meta.agg(F.count("*").alias("files"), F.sum(F.coalesce("n_variants", F.lit(0))).alias("n_variants"), F.bool_or(F.col("n_variants").isNull()).alias("partial"), F.array_join(F.transform(ordered, lambda x: x["c"]), ",").alias("contigs"), F.countDistinct("sample_hash").alias("sample_sets"))


def contig_coverage(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """Wanted (chrom, length) against contigs there (chrom, there_length): missing, too_short or ok."""
    met = wanted.withColumn("bare", V.bare_chrom(F.col("chrom"))).join(there.select(V.bare_chrom(F.col("chrom")).alias("bare"), "there_length"), "bare", "left")
    return met.select("chrom", "length", "there_length", F.when(F.col("there_length").isNull(), "missing").when(F.col("there_length") < F.col("length"), "too_short").otherwise("ok").alias("status"))


def parse_chromosomes(spec: str) -> list[str]:
    """``1-3,5,X`` to names, in order, without repeats; anything unknown is an error."""
    out: list[str] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        first, dash, last = part.partition("-")
        names = [str(i) for i in range(int(first), int(last) + 1)] if dash and first.isdigit() and last.isdigit() else [part.removeprefix("chr")]
        for n in names:
            if n not in V.HUMAN:
                raise ValueError(f"unknown chromosome: {n}")
            if n not in out:
                out.append(n)
    if not out:
        raise ValueError("no chromosomes")
    return out


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
