"""Counts and ratios by sample, chromosome and cohort."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions import variant as V
from ..functions.annotation import info_flag, info_told, info_value


def count_if(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """Null where undefined."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def described(calls: DataFrame) -> DataFrame:
    """Calls with class, transition, and dosage; a lone '.' ALT is no variant."""
    return calls.filter("alt != '.'").withColumns({
        "class": V.variant_class(F.col("ref"), F.col("alt")), "is_ti": V.is_transition(F.col("ref"), F.col("alt")), "d": G.dosage(F.col("gt")),
    })


def counters() -> dict[str, Column]:
    snv = F.col("class") == "snv"
    return {
        "n_records": F.count("*"), "n_snv": count_if(snv), "n_indel": count_if(F.col("class") == "indel"), "n_sv": count_if(F.col("class") == "sv"),
        "n_ti": count_if(snv & F.col("is_ti")), "n_tv": count_if(snv & ~F.col("is_ti")), "n_het": count_if(F.col("d") == 1), "n_hom_alt": count_if(F.col("d") == 2),
        "n_hom_ref": count_if(F.col("d") == 0), "n_dropout": count_if(G.is_dropout(F.col("gt"))),
    }


def sample_summary(calls: DataFrame, build: str = "GRCh38") -> DataFrame:
    """One row for each sample: record classes, Ti/Tv, zygosity, singletons, overlays and sex-chromosome counters."""
    c, het = V.bare_chrom(F.col("chrom")), G.is_het(F.col("gt"))
    y, mt = c == "Y", c.isin("MT", "M")
    y_out = y & ~V.in_par(build, F.col("chrom"), F.col("pos"))
    out = described(calls).groupBy("sample").agg(
        *[v.alias(k) for k, v in counters().items()], count_if(info_value(F.col("info"), "AC") == "1").alias("n_singleton"),
        count_if(F.col("id").startswith("rs") | info_told(F.col("info"), "RS")).alias("n_rsid"), count_if(info_told(F.col("info"), "CLNSIG")).alias("n_clinvar"),
        count_if(info_told(F.col("info"), "COSMIC_ID")).alias("n_cosmic"), count_if(info_flag(F.col("info"), "HIGHLIGHT")).alias("n_highlight"),
        count_if(y).alias("n_y"), count_if(y_out).alias("n_y_non_par"), count_if(y_out & het).alias("n_y_non_par_het"), count_if(mt).alias("n_mt"), count_if(mt & het).alias("n_mt_het"),
    )
    return out.withColumns({"titv": ratio(F.col("n_ti"), F.col("n_tv")), "het_hom": ratio(F.col("n_het"), F.col("n_hom_alt"))})


def chrom_buckets(calls: DataFrame, *keys: str) -> DataFrame:
    return described(calls).groupBy(*keys).agg(*[v.alias(k) for k, v in counters().items()])


def chrom_stats(calls: DataFrame) -> DataFrame:
    out = chrom_buckets(calls, "chrom")
    return out.withColumn("titv", ratio(F.col("n_ti"), F.col("n_tv"))).withColumn("ord", V.chrom_order(F.col("chrom")).cast("long"))


def cohort_titv(calls: DataFrame, low: float = 2.0, high: float = 2.2) -> DataFrame:
    """Ti/Tv over all, and whether it is in the band expected of a genome."""
    one = described(calls).agg(counters()["n_ti"].alias("n_ti"), counters()["n_tv"].alias("n_tv"))
    return one.withColumn("titv", ratio(F.col("n_ti"), F.col("n_tv"))).withColumn("in_band", F.coalesce(F.col("titv").between(low, high), F.lit(False)))


def titv_pairs(pairs: DataFrame, *keys: str) -> DataFrame:
    """Ti/Tv of (ref, alt) pairs, where only changes between single bases count."""
    sound = V.is_base_change(F.col("ref"), F.col("alt"))
    ti = V.is_transition(F.col("ref"), F.col("alt"))
    out = pairs.groupBy(*keys).agg(count_if(sound & ti).alias("n_ti"), count_if(sound & ~ti).alias("n_tv"))
    return out.withColumn("titv", ratio(F.col("n_ti"), F.col("n_tv")))


def cohort_rollup(calls: DataFrame) -> DataFrame:
    """Totals by file and chromosome, by file, and over all, in one pass."""
    c = counters()
    out = described(calls).rollup("file", "chrom").agg(c["n_records"].alias("n_records"), c["n_het"].alias("n_het"), c["n_hom_alt"].alias("n_hom_alt"), F.grouping_id().cast("long").alias("level"))
    return out.withColumn("het_hom", ratio(F.col("n_het"), F.col("n_hom_alt")))


def histogram(values: DataFrame, value: str, bins: int) -> DataFrame:
    """``bins`` equal bins on [0, 1], the last one closed on both sides; empty ones are there with 0."""
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("long")
    counted = values.filter(F.col(value).between(0, 1)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    spine = values.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return spine.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def af_histogram(calls: DataFrame, bins: int = 10) -> DataFrame:
    af = F.split(info_value(F.col("info"), "AF"), ",")[0].try_cast("double")
    return histogram(calls.select(af.alias("af")).filter("af is not null"), "af", bins)


def indel_lengths(calls: DataFrame) -> DataFrame:
    own = calls.filter(V.variant_class(F.col("ref"), F.col("alt")) == "indel")
    return own.groupBy((F.length("alt") - F.length("ref")).cast("long").alias("len")).agg(F.count("*").alias("n"))


def sv_types(calls: DataFrame) -> DataFrame:
    own = calls.filter(V.is_symbolic(F.col("alt")))
    return own.groupBy(F.coalesce(info_value(F.col("info"), "SVTYPE"), F.lit("OTHER")).alias("svtype")).agg(F.count("*").alias("n"))


def region_density(calls: DataFrame, width: int = 1_000_000) -> DataFrame:
    return calls.groupBy("chrom", F.floor((F.col("pos") - 1) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def density_summary(density: DataFrame) -> DataFrame:
    spread = F.coalesce(F.stddev_samp("n"), F.lit(0.0)) / F.avg("n")
    return density.groupBy("chrom").agg(F.count("*").alias("bins"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("max"), F.round(spread, 6).alias("cv"))


def overlay_density(calls: DataFrame) -> DataFrame:
    """How many records carry each overlay; an rs number counts in the ID column or in INFO/RS."""
    tests = {"rsid": F.col("id").startswith("rs") | info_told(F.col("info"), "RS"), "clinvar": info_told(F.col("info"), "CLNSIG"), "cosmic": info_told(F.col("info"), "COSMIC_ID")}
    one = calls.agg(F.count("*").alias("total"), *[count_if(t).alias(k) for k, t in tests.items()])
    long = one.select("total", F.expr("stack(3, 'rsid', rsid, 'clinvar', clinvar, 'cosmic', cosmic) as (overlay, n)"))
    return long.select("overlay", "n", "total", ratio(F.col("n"), F.col("total")).alias("fraction"))


def quality_metrics(calls: DataFrame, cap: int | None = None) -> DataFrame:
    """n, mean, median, sd, p10 and p90 of depth, quality and the reference share of heterozygous calls; of the first ``cap`` records of a sample."""
    if cap:
        order = Window.partitionBy("sample").orderBy(V.chrom_order(F.col("chrom")), "chrom", "pos", "ord", "dp", "gt")
        calls = calls.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= cap)
    both = F.col("ad_ref") + F.col("ad_alt")
    share = F.when((G.dosage(F.col("gt")) == 1) & (both > 0), F.col("ad_ref") / both)
    wide = calls.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("v")) for n, v in (("dp", F.col("dp")), ("gq", F.col("gq")), ("ad_ref_fraction", share))])).alias("x"))
    q = F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = wide.select("x.metric", "x.v").filter("v is not null").groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"), q.alias("q"))
    return out.select("metric", "n", "mean", "sd", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(["p10", "median", "p90"])])


def substitution_types(calls: DataFrame) -> DataFrame:
    return calls.filter(V.is_base_change(F.col("ref"), F.col("alt"))).groupBy("ref", "alt").agg(F.count("*").alias("n"))


def sfs(allele_counts: DataFrame) -> DataFrame:
    """Sites by allele count, ALT alleles apart (column ``acs``, an array)."""
    return allele_counts.select(F.explode("acs").alias("ac")).filter("ac > 0").groupBy("ac").agg(F.count("*").alias("n_sites"))


def singleton_fraction(spectrum: DataFrame) -> DataFrame:
    return spectrum.agg(count_sum("n_sites", F.col("ac") == 1).alias("n_singleton"), F.sum("n_sites").alias("n_total")).withColumn("fraction", ratio(F.col("n_singleton"), F.col("n_total")))


def count_sum(value: str, test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0)).cast("long")


def allele_counts(calls: DataFrame, *keys: str) -> DataFrame:
    """AC, AN and AF from genotypes: called alleles and ALT alleles among them."""
    a = G.alleles(F.col("gt"))
    called = F.size(F.filter(a, lambda x: x != "."))
    alt = F.size(F.filter(a, lambda x: ~x.isin(".", "0")))
    out = calls.groupBy(*keys).agg(F.sum(alt).cast("long").alias("ac"), F.sum(called).cast("long").alias("an"))
    return out.withColumn("af", ratio(F.col("ac"), F.col("an")))


def sex_gates(calls: DataFrame, people: DataFrame, build: str | None = "GRCh38") -> DataFrame:
    """Three gates: no heterozygous call of a male on Y outside the PAR, no Y record of a female, no heterozygous MT call."""
    each = sample_summary(calls, build or "GRCh38").select("sample", "n_y", "n_y_non_par", "n_y_non_par_het", "n_mt", "n_mt_het").join(people.select("sample", "sex"), "sample", "left")
    s = lambda c, test: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long")
    m, f, any_ = F.col("sex") == "m", F.col("sex") == "f", F.lit(True)
    one = each.agg(s("n_y_non_par", m).alias("a"), s("n_y_non_par_het", m).alias("b"), count_if(f).alias("c"), s("n_y", f).alias("d"), s("n_mt", any_).alias("e"), s("n_mt_het", any_).alias("g"))
    long = one.selectExpr("stack(3, 'y_het_in_males', a, b, 'female_y_absence', c, d, 'mt_no_heterozygous', e, g) as (gate, seen, wrong)")
    skip = F.col("seen") == 0
    if build is None:
        skip = skip | (F.col("gate") == "y_het_in_males")
    return long.withColumn("status", F.when(skip, "skipped").when(F.col("wrong") == 0, "pass").otherwise("fail"))
