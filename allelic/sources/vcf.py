"""VCF, BED and FASTA text to DataFrames and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.annotation import info_map, payload
from ..functions.variant import bed_end

#: The header of a written file.
HEADER = """##fileformat=VCFv4.2
##INFO=<ID=AC,Number=A,Type=Integer,Description="Allele count">
##INFO=<ID=AN,Number=1,Type=Integer,Description="Allele number">
##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">
##INFO=<ID=CLNSIG,Number=.,Type=String,Description="Significance told by the catalogue">
##INFO=<ID=CLNDN,Number=.,Type=String,Description="Condition told by the catalogue">
##INFO=<ID=COSMIC_ID,Number=1,Type=String,Description="Id of a somatic variant">
##INFO=<ID=COSMIC_GENE,Number=1,Type=String,Description="Gene of a somatic variant">
##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Kind of structural variant">
##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Length of a structural variant">
##INFO=<ID=END,Number=1,Type=Integer,Description="Last position">
##INFO=<ID=CIPOS,Number=2,Type=Integer,Description="Interval around the position">
##INFO=<ID=HIGHLIGHT,Number=0,Type=Flag,Description="The person's highlighted variant">
##ALT=<ID=DEL,Description="Deletion">
##ALT=<ID=DUP,Description="Duplication">
##ALT=<ID=INV,Description="Inversion">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Allelic depths">"""


def parse_records(lines: DataFrame) -> DataFrame:
    """Single-sample lines (column ``value``) to one row for each ALT allele.

    Header lines, short ones and those without a position are left out; depth and quality that aren't numbers are 0;
    every ALT row has the call's genotype and its own allelic depth. INFO is there as text and as a map;
    single keys are told fastest from the text.
    """
    keep = [c for c in lines.columns if c != "value"]
    wide = lines.filter(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t")).filter(F.size("f") >= 10)
    # a generator ends what the optimizer may fold into one expression, so each line is split once
    rows = wide.select(*keep, "f", F.posexplode(F.split(F.col("f")[4], ",")).alias("i", "alt"))
    rows = rows.select(*keep, "f", "i", "alt", F.split(F.col("f")[8], ":").alias("keys"), F.split(F.col("f")[9], ":").alias("values"))

    def value(key: str) -> Column:
        """Of the last field of that name; a field that the call lacks is missing."""
        at = F.size("keys") - F.array_position(F.reverse("keys"), key)
        return F.when(F.array_contains("keys", key), F.coalesce(F.get("values", at.cast("int")), F.lit(".")))

    def number(x: Column) -> Column:
        return F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))

    depths = F.split(value("AD"), ",")
    out = rows.select(
        *keep, F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("long").alias("pos"), F.col("f")[2].alias("id"), F.col("f")[3].alias("ref"), "i", "alt",
        value("GT").alias("gt"), number(value("DP")).alias("dp"), number(value("GQ")).alias("gq"), number(F.get(depths, F.lit(0))).alias("ad_ref"),
        F.col("f")[7].alias("info_text"), info_map(F.col("f")[7]).alias("info"), number(F.get(depths, F.col("i") + 1)).alias("ad_alt"),
    )
    return out.filter("pos is not null")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """A file, folder or glob of single-sample VCF text (gzip included): the records with their file and sample."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    names = lines.filter(F.col("value").startswith("#CHROM")).select("file", F.get(F.split("value", "\t"), F.lit(9)).alias("sample"))
    return parse_records(lines).join(F.broadcast(names), "file", "left")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: #CHROM line present, samples, reference, INFO ids, FORMAT/GT declared."""
    v = F.col("value")
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).filter(v.startswith("#"))
    found = F.regexp_extract(v, "^##INFO=<ID=([^,>]+)", 1)
    return lines.groupBy("file").agg(
        F.bool_or(v.startswith("#CHROM")).alias("chrom_line"), F.max(F.when(v.startswith("#CHROM"), F.slice(F.split(v, "\t"), F.lit(10), F.greatest(F.size(F.split(v, "\t")) - 9, F.lit(0))))).alias("samples"),
        F.max(F.when(v.startswith("##reference="), F.substring(v, 13, 10000))).alias("reference"), F.array_sort(F.collect_set(F.when(found != "", found))).alias("info_ids"), F.bool_or(v.startswith("##FORMAT=<ID=GT,")).alias("has_gt"),
    )


def read_multi_sample(spark: SparkSession, path: str) -> DataFrame:
    """Multi-sample VCF text to one row for each call: file, chrom, pos, id, ref, alt, info, sample, gt. Lines of another width than the header's are left out."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("f", F.split("value", "\t"))
    names = lines.filter(F.col("value").startswith("#CHROM")).select("file", F.col("f").alias("h"))
    rows = lines.filter(~F.col("value").startswith("#")).join(F.broadcast(names), "file").filter(F.size("f") == F.size("h"))
    each = F.explode(F.arrays_zip(F.slice("h", F.lit(10), F.size("h")).alias("s"), F.slice("f", F.lit(10), F.size("f")).alias("g"))).alias("c")
    flat = rows.select("file", *[F.col("f")[i].alias(n) for i, n in enumerate(["chrom", "pos", "id", "ref", "alt"])], F.col("f")[7].alias("info"), each)
    return flat.select("file", "chrom", F.col("pos").try_cast("long").alias("pos"), "id", "ref", "alt", "info", F.col("c")["s"].alias("sample"), F.split(F.col("c")["g"], ":")[0].alias("gt"))


def vcf_text(calls: DataFrame) -> DataFrame:
    """Calls as VCF lines: sample, chrom, pos, value."""
    ad = F.concat_ws(",", F.col("ad_ref").cast("string"), F.col("ad_alt").cast("string"))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", F.lit("100"), F.lit("PASS"), "info", F.lit("GT:DP:GQ:AD"), F.concat_ws(":", "gt", F.col("dp").cast("string"), F.col("gq").cast("string"), ad))
    return calls.select("sample", "chrom", "pos", line.alias("value"))


def write_vcf(calls: DataFrame, path: str) -> None:
    """A folder for each sample with one sorted, gzipped VCF file.

    A sample's records are sorted with its header in front in a single shuffle on the sample.
    """
    from ..functions.variant import chrom_order

    body = vcf_text(calls).select("sample", chrom_order(F.col("chrom")).alias("o"), "pos", "value")
    head = F.concat(F.lit(HEADER + "\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), F.col("sample"))
    heads = calls.select("sample").distinct().select("sample", F.lit(0).alias("o"), F.lit(0).cast("long").alias("pos"), head.alias("value"))
    whole = body.unionByName(heads).repartition("sample").sortWithinPartitions("sample", "o", "pos", "value")
    whole.select("sample", "value").write.partitionBy("sample").option("compression", "gzip").text(path)


def cohort_lines(calls: DataFrame, samples: list[str]) -> DataFrame:
    """Multi-sample lines (chrom, pos, value), one for each site, with genotypes in the order of ``samples``.

    Sites are (chrom, pos, id, ref, alt) and, if the calls have it, ``extra``: INFO text to follow AC, AN and AF, which are
    of the whole cohort (AN is twice its size). A sample without a call has ``./.``, of several calls the
    greatest counts; calls of other samples are left out. Both aggregations share one shuffle by site.
    """
    site = ["chrom", "pos", "id", "ref", "alt", *(["extra"] if "extra" in calls.columns else [])]
    order = calls.sparkSession.createDataFrame(list(enumerate(samples)), "i long, sample string")
    own = calls.select(*site, "sample", "gt").join(order, "sample").repartition(*site)
    cells = own.groupBy(*site, "i").agg(F.max("gt").alias("gt")).groupBy(*site).agg(F.array_sort(F.collect_list(F.struct("i", "gt"))).alias("c"))
    # what lies between two calls is filled by repetition, so a line costs its length
    gap = lambda n: F.repeat(F.lit("\t./."), n.cast("int"))
    each = F.transform("c", lambda x, k: F.concat(gap(x["i"] - F.when(k == 0, -1).otherwise(F.get("c", k - 1)["i"]) - 1), F.lit("\t"), x["gt"]))
    genotypes = F.concat(F.array_join(each, ""), gap(F.lit(len(samples) - 1) - F.element_at("c", -1)["i"]))
    said = F.flatten(F.transform("c", lambda x: F.split(x["gt"], "[|/]")))
    acs = F.transform(F.sequence(F.lit(1), F.size(F.split("alt", ","))), lambda k: F.size(F.filter("said", lambda a: a == k.cast("string"))))
    out = cells.select(*site, genotypes.alias("genotypes"), F.explode(F.array(said)).alias("said")).withColumn("acs", F.explode(F.array(acs)))
    an = 2 * len(samples)
    info = F.concat(F.lit("AC="), F.array_join(F.col("acs").cast("array<string>"), ","), F.lit(f";AN={an};AF="), F.array_join(F.transform("acs", lambda c: F.format_string("%.6f", c / an)), ","))
    if "extra" in site:
        info = F.concat(info, F.when(F.coalesce("extra", F.lit("")).isin("", "."), "").otherwise(F.concat(F.lit(";"), F.col("extra"))))
    fields = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", F.lit("100"), F.lit("PASS"), info, F.lit("GT"))
    return out.select("chrom", "pos", F.concat(fields, F.col("genotypes")).alias("value"))


def write_cohort_vcf(calls: DataFrame, samples: list[str], path: str, run: int = 50_000_000) -> None:
    """The cohort as gzipped VCF files, a folder for each chromosome and ``run`` of bases, each file sorted and whole with its header.

    No task holds more than a run of one chromosome. ``read_multi_sample`` reads them.
    """
    lines = cohort_lines(calls, samples).withColumn("run", F.floor((F.col("pos") - 1) / run))
    head = "\n".join(x for x in HEADER.split("\n") if not x.startswith("##FORMAT") or "ID=GT" in x) + "\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(samples)
    runs = calls.select("chrom", F.floor((F.col("pos") - 1) / run).alias("run")).distinct()
    contig = F.replace(F.lit(head), F.lit("\n#CHROM"), F.concat(F.lit("\n##contig=<ID="), F.col("chrom"), F.lit(">\n#CHROM")))
    whole = lines.unionByName(runs.select("chrom", F.lit(0).cast("long").alias("pos"), contig.alias("value"), "run"))
    sorted_runs = whole.repartition("chrom", "run").sortWithinPartitions("chrom", "run", "pos", "value")
    sorted_runs.select(F.col("chrom").alias("contig"), "run", "value").write.partitionBy("contig", "run").option("compression", "gzip").text(path)


def bed_lines(records: DataFrame, *fields: str) -> DataFrame:
    """BED4 rows of variant records: chrom, start, end, payload."""
    return records.select("chrom", (F.col("pos") - 1).alias("start"), bed_end(F.col("pos"), F.col("ref"), F.col("sv_end")).cast("long").alias("end"), payload(**{f: F.col(f) for f in fields}).alias("payload"))


def write_bed(rows: DataFrame, path: str) -> None:
    from ..functions.variant import chrom_order

    rows.orderBy(chrom_order(F.col("chrom")), "chrom", "start").write.option("sep", "\t").csv(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Ancestry BED: person, chrom, start, end, hap1_pop, hap2_pop; comments and malformed rows are left out."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).withColumn("person", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.bed)?(\.gz)?$", 1))
    wide = lines.filter(~F.col("value").startswith("#")).withColumn("f", f).filter(F.size("f") >= 5)
    rows = wide.select("person", F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("long").alias("start"), F.col("f")[2].try_cast("long").alias("end"), F.col("f")[3].alias("hap1_pop"), F.col("f")[4].alias("hap2_pop"))
    return rows.filter("start is not null and end is not null")


def read_fasta(spark: SparkSession, path: str, block: int = 4096) -> DataFrame:
    """FASTA to blocks: chrom, block (number), seq (``block`` bases, fewer at the end)."""

    text = spark.read.option("lineSep", ">").text(path).filter("length(value) > 0")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", ""))
    whole = text.select(name.alias("chrom"), seq.alias("all"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("all") / block) - 1, F.lit(0))), lambda i: F.struct(i.alias("block"), F.expr("all").substr((i * block + 1).cast("int"), F.lit(block)).alias("seq")))
    return whole.select("chrom", F.explode(cut).alias("b")).select("chrom", "b.block", "b.seq")


def with_base(records: DataFrame, fasta: DataFrame, at: str, name: str, block: int = 4096) -> DataFrame:
    """Add the reference base at 1-based ``at``: N outside, and for anything but A, C, G, T."""
    where = F.floor((F.col(at) - 1) / block)
    joined = records.withColumn("_block", where).join(fasta.withColumnRenamed("block", "_block"), ["chrom", "_block"], "left")
    base = F.col("seq").substr(((F.col(at) - 1) % block + 1).cast("int"), F.lit(1))
    return joined.withColumn(name, F.when(base.isin(*"ACGT"), base).otherwise("N")).drop("_block", "seq")
