"""Variant-shaped views of the benchmark tables; integer arithmetic only, so any SQL engine gives the same rows."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHROM = "CASE WHEN {k} % 25 < 22 THEN CAST({k} % 25 + 1 AS STRING) WHEN {k} % 25 = 22 THEN 'X' WHEN {k} % 25 = 23 THEN 'Y' ELSE 'MT' END"
ALT = """CASE WHEN {k} % 40 = 7 THEN '<DEL>' WHEN {k} % 40 = 17 THEN '<DUP>' WHEN {k} % 40 = 27 THEN '<INV>'
    WHEN {k} % 20 = 3 THEN concat(substr('ACGT', CAST({k} % 4 + 1 AS INT), 1), 'TT')
    WHEN {k} % 31 < 21 THEN substr('GTAC', CAST({k} % 4 + 1 AS INT), 1) ELSE substr('CATG', CAST({k} % 4 + 1 AS INT), 1) END"""
REF = "substr('ACGT', CAST({k} % 4 + 1 AS INT), 1)"
POS = "({k} * 7919) % 5000000 + 1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each call: file, sample, chrom, pos, id, ref, alt, gt, dp, gq, ad_ref, ad_alt, info (text), ord."""
    k = "l_partkey"
    q = "(CAST(floor(l_quantity) AS BIGINT) % 10)"
    base = table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey", "l_orderkey * 10 + l_linenumber AS ord", "l_linenumber", "l_returnflag AS file", "concat('P', CAST(l_suppkey % 100 AS STRING)) AS sample",
        CHROM.format(k=k) + " AS chrom", POS.format(k=k) + " AS pos", REF.format(k=k) + " AS ref", ALT.format(k=k) + " AS alt",
        f"CASE WHEN {q} <= 3 THEN '0|0' WHEN {q} <= 5 THEN '0|1' WHEN {q} = 6 THEN '1|0' WHEN {q} <= 8 THEN '1|1' ELSE './.' END AS gt",
        "CAST(floor(l_quantity) AS BIGINT) AS dp", "CAST(least(99, l_linenumber * 14) AS BIGINT) AS gq",
        "CASE WHEN l_partkey % 5 = 0 THEN concat('rs', CAST(l_partkey AS STRING)) ELSE '.' END AS id",
    )
    d = "CASE WHEN gt IN ('0|1', '1|0') THEN 1 WHEN gt = '1|1' THEN 2 ELSE 0 END"
    deep = base.selectExpr("*", f"{d} AS d", "CASE WHEN gt = '1|1' THEN 0L WHEN gt IN ('0|1', '1|0') THEN dp * (45 + l_linenumber) DIV 100 ELSE dp END AS ad_ref")
    info = """concat('AC=', CAST(d AS STRING), ';AN=2;AF=', CASE d WHEN 0 THEN '0.0' WHEN 1 THEN '0.5' ELSE '1.0' END,
        CASE WHEN l_partkey % 13 = 0 THEN ';CLNSIG=Pathogenic' ELSE '' END,
        CASE WHEN l_partkey % 29 = 0 THEN concat(';COSMIC_ID=COSV', CAST(l_partkey AS STRING)) ELSE '' END,
        CASE WHEN alt LIKE '<%' THEN concat(';SVTYPE=', substr(alt, 2, 3)) ELSE '' END, CASE WHEN l_partkey % 97 = 0 THEN ';HIGHLIGHT' ELSE '' END) AS info"""
    return deep.selectExpr("file", "sample", "chrom", "pos", "id", "ref", "alt", "gt", "dp", "gq", "ad_ref", "dp - ad_ref AS ad_alt", info, "ord", "l_partkey AS site")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, sex, lineage, super_pop: one row for each sample, from its first supplier."""
    supplier = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_nationkey", "s_suppkey % 100 AS n")
    first = supplier.groupBy("n").agg(F.min("s_suppkey").alias("s_suppkey"))
    placed = supplier.select("s_suppkey", "s_nationkey").join(first, "s_suppkey").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.selectExpr("concat('P', CAST(n AS STRING)) AS sample", "CASE WHEN s_suppkey % 2 = 0 THEN 'f' ELSE 'm' END AS sex", "s_suppkey % 10 AS lineage", "CASE r_name WHEN 'AFRICA' THEN 'AFR' WHEN 'AMERICA' THEN 'AMR' WHEN 'ASIA' THEN 'EAS' WHEN 'EUROPE' THEN 'EUR' ELSE 'SAS' END AS super_pop")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part: chrom, pos, id, ref, alt, and the key."""
    k = "p_partkey"
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS site", CHROM.format(k=k) + " AS chrom", POS.format(k=k) + " AS pos", REF.format(k=k) + " AS ref", ALT.format(k=k) + " AS alt", "CASE WHEN p_partkey % 5 = 0 THEN concat('rs', CAST(p_partkey AS STRING)) ELSE '.' END AS id")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation catalogue: a third of the rows hit a site, a third only its position, the rest miss; ALT may list several alleles."""
    k = "p_partkey"
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS ord", CHROM.format(k=k) + " AS chrom", f"CASE WHEN p_partkey % 3 = 2 THEN {POS.format(k=k)} + 1 ELSE {POS.format(k=k)} END AS pos",
        REF.format(k=k) + " AS ref", f"CASE WHEN p_size % 7 = 0 THEN 'A,G' WHEN p_size % 11 = 0 THEN '.' WHEN p_partkey % 3 = 1 THEN 'N' ELSE {ALT.format(k=k)} END AS alt",
        "CASE WHEN p_partkey % 4 = 0 THEN concat('rs', CAST(p_partkey AS STRING), ';x') WHEN p_partkey % 4 = 1 THEN CAST(p_partkey AS STRING) ELSE '.' END AS id",
        "CASE WHEN p_partkey % 8 = 2 THEN concat(CAST(p_partkey AS STRING), ',9') WHEN p_partkey % 8 = 3 THEN concat('rs', CAST(p_partkey AS STRING)) END AS info_rs",
        "CASE WHEN p_size % 5 = 0 THEN 'Pathogenic|Likely_pathogenic' WHEN p_size % 5 = 1 THEN 'Benign, Likely_benign' WHEN p_size % 5 = 2 THEN 'Pathogenic' ELSE 'Uncertain_significance' END AS clnsig",
        "concat('disease=', p_brand, '; type ', p_type) AS clndn", "p_size", "p_retailprice",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local ancestry of each person: chrom, start, end (0-based, half-open), hap1_pop, hap2_pop."""
    rn = F.row_number().over(Window.partitionBy(F.col("user_id") % 50).orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("rn", rn.cast("long"))
    return e.selectExpr(
        "user_id % 50 AS person", "CASE WHEN rn % 40 < 20 THEN '1' ELSE '2' END AS chrom", "(rn - 1) * 10000 AS start", "rn * 10000 - CASE WHEN event_id % 17 = 0 THEN 500 ELSE 0 END AS end",
        "CASE length(event_type) % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'SAS' ELSE 'AFR' END AS hap1_pop", "CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'SAS' ELSE 'AFR' END AS hap2_pop",
    )


def ref_base(pos):
    """The reference base at a position, by rule; N now and then."""
    return F.when(pos % 101 == 0, "N").otherwise(F.substring(F.lit("ACGT"), (pos % 4 + 1).cast("int"), F.lit(1)))


def fasta(spark: SparkSession, block: int = 4096, length: int = 5_000_100) -> DataFrame:
    """The sequence of ``ref_base`` as blocks of each chromosome, as ``read_fasta`` gives them. It repeats every 404 bases."""
    unit = "".join("N" if p % 101 == 0 else "ACGT"[p % 4] for p in range(404))
    chroms = F.explode(F.array(*[F.lit(str(c)) for c in (*range(1, 23), "X", "Y", "MT")])).alias("chrom")
    blocks = spark.range(-(-length // block)).withColumnRenamed("id", "block").select("block", chroms)
    # the first base of a block is at position block number * block + 1
    seq = F.substring(F.lit(unit * (block // 404 + 2)), ((F.col("block") * block + 1) % 404 + 1).cast("int"), F.lit(block))
    return blocks.select("chrom", "block", seq.alias("seq"))


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls as VCF text lines, some with two ALT alleles, some cut short; with the key of the call."""
    two = "site % 53 = 0"
    return calls(spark, sf_dir).selectExpr("ord", f"""CASE WHEN site % 211 = 0 THEN concat_ws('\t', chrom, CAST(pos AS STRING), id)
        ELSE concat_ws('\t', chrom, CAST(pos AS STRING), id, ref, CASE WHEN {two} THEN concat(alt, ',T') ELSE alt END, '.', 'PASS', info, 'GT:DP:GQ:AD',
            concat_ws(':', gt, CASE WHEN site % 61 = 0 THEN '.' ELSE CAST(dp AS STRING) END, CAST(gq AS STRING), concat(CAST(ad_ref AS STRING), ',', CAST(ad_alt AS STRING), CASE WHEN {two} THEN ',3' ELSE '' END))) END AS value""")
