"""Small files beside the variants: reports as JSON, carriers, spectra and ancestry as tab-separated text, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G

#: Names of the files that a run leaves, and what is read of each.
SCHEMAS = {
    "qc": "name string, file string, pass boolean, errors array<string>, warnings array<string>, checks map<string, string>",
    "meta": "name string, file string, contigs array<string>, n_variants long, n_samples long, sample_hash string, reference string, size_bytes long, pipeline_tag string, date_stamp string",
    "variant": "name string, file string, variant_chrom string, variant_pos long, variant_ref string, variant_alt string, min_af double, max_af double, status string, af double, n_het long, n_hom long, n_carriers long",
}
CARRIERS = ["file", "sample", "variant_id", "chrom", "pos", "ref", "alt", "genotype", "alt_dosage"]


def read_reports(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The ``*.<kind>.json`` files of a folder, one row each, with their ``path``, in its order; none give no rows.

    Keys that a file lacks are null. ``kind`` is qc, meta or variant.
    """
    found = spark.read.schema(SCHEMAS[kind]).option("multiLine", True).option("pathGlobFilter", f"*.{kind}.json").json(folder)
    return found.withColumn("path", F.input_file_name()).orderBy("path")


def read_carriers(spark: SparkSession, folder: str) -> DataFrame:
    """The ``*.carriers.tsv`` files of a folder; headers, blank lines and lines of fewer than nine fields are left out, a position or dosage that is no number is null."""
    f = F.split("value", "\t")
    lines = spark.read.option("pathGlobFilter", "*.carriers.tsv").text(folder).filter(~F.col("value").startswith("\t".join(CARRIERS[:2]) + "\t"))
    wide = lines.withColumn("f", f).filter(F.size("f") >= len(CARRIERS)).select(*[F.col("f")[i].alias(c) for i, c in enumerate(CARRIERS)])
    return wide.withColumns({c: F.col(c).try_cast("long") for c in ("pos", "alt_dosage")})


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """A run's manifest; nothing where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def write_tsv(rows: DataFrame, path: str, *order: str, header: bool = True) -> None:
    """One tab-separated file in a folder, in ``order``, for small tables; the header is there even without rows."""
    names = "\t".join(rows.columns)
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    n = F.row_number().over(_whole(order))
    body = rows.select(n.cast("long").alias("n"), line.alias("value"))
    if header:
        body = body.unionByName(rows.sparkSession.createDataFrame([(0, names)], "n long, value string"))
    body.coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def _whole(order):
    from pyspark.sql import Window

    return Window.partitionBy().orderBy(*order)


def write_carriers(rows: DataFrame, path: str) -> None:
    """Carriers of the wanted variants, a few rows of all calls: nine columns."""
    write_tsv(rows.select(*CARRIERS), path, "file", "sample", "chrom", "pos")


def write_spectrum(spectrum: DataFrame, path: str) -> None:
    """Sites by allele count, a row for each count that occurs."""
    write_tsv(spectrum.select("ac", "n_sites"), path, "ac")


def write_genotype_table(calls: DataFrame, path: str) -> None:
    """Of one variant: sample, GT and how many ALT alleles the sample has."""
    write_tsv(calls.select("sample", F.col("gt").alias("GT"), G.first_alt_dosage(F.col("gt")).alias("alt_dosage")), path, "sample", "GT")


def write_ancestry(segments: DataFrame, path: str) -> None:
    """A folder for each person with one BED file: chrom, start, end, hap1_pop, hap2_pop, in order of chromosome and place. ``read_bed`` reads them."""
    from ..functions.variant import chrom_order

    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "hap1_pop", "hap2_pop")
    rows = segments.select("person", chrom_order(F.col("chrom")).alias("o"), "chrom", "start", line.alias("value"))
    rows.repartition("person").sortWithinPartitions("person", "o", "chrom", "start").select("person", "value").write.mode("overwrite").partitionBy("person").text(path)


def manifest(people: DataFrame, build: str, mode: str, chromosomes: list[str], seed: int, cohort: list[str] = (), files: dict[str, str] | None = None, sv: dict | None = None, errors: dict | None = None, overlays: dict | None = None) -> dict:
    """What a run made. ``people`` (sample, sex, lineage, and whatever is told of each) come to the driver: a row for each member of the cohort.

    Modes: cohort has the cohort's files only, per-person and both have an entry for each person as well.
    """
    if mode not in ("cohort", "per-person", "both"):
        raise ValueError(f"unknown mode: {mode}")
    rows = [r.asDict(recursive=True) for r in people.orderBy("sample").collect()]
    out = {
        "build": build, "n_people": len(rows), "mode": mode, "shape": mode, "chromosomes": list(chromosomes), "seed": seed,
        "samples": [r["sample"] for r in rows], "sex": [r["sex"] for r in rows], "mt_lineage_ids": [r["lineage"] for r in rows],
    }
    if mode != "cohort":
        out["people"] = [{**r, "file": (files or {}).get(r["sample"])} for r in rows]
        out["svs"], out["errors"] = sv or {}, errors or {}
    out["cohort_bcfs"] = list(cohort)
    if overlays is not None:
        out["overlays"] = overlays
    return out


def write_manifest(spark: SparkSession, parts: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(parts, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)
