"""From cohort calls to one person's records: ploidy, mirrored PAR, MT lineages, noise, truth tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import annotation as A
from ..functions import draws
from ..functions import genotype as G
from ..functions import variant as V


def person_records(calls: DataFrame) -> DataFrame:
    """Records without homozygous reference calls, except on MT; missing calls stay."""
    return calls.filter(~G.is_hom_ref(F.col("gt")) | F.col("chrom").isin(V.MT))


def haploid_records(calls: DataFrame, people: DataFrame, build: str = "GRCh38") -> DataFrame:
    """One allele where the ploidy is 1, no row where it is 0; AC, AN and AF of the record."""
    p = calls.join(people.select("sample", "sex"), "sample").withColumn("ploidy", V.ploidy(build, F.col("chrom"), F.col("pos"), F.col("sex"))).filter("ploidy > 0")
    p = p.withColumn("gt", F.when(F.col("ploidy") == 1, G.alleles(F.col("gt"))[0]).otherwise(F.col("gt")))
    ac = F.size(F.filter(G.alleles(F.col("gt")), lambda a: ~a.isin(".", "0")))
    return p.withColumns({"ac": ac.cast("long"), "an": F.col("ploidy").cast("long"), "af": F.round(ac / F.col("ploidy"), 1)})


def par_mirror(calls: DataFrame, people: DataFrame, build: str = "GRCh38") -> DataFrame:
    """Males' chrX PAR records also at their chrY positions, in place of any there; structural variants aren't mirrored."""
    own = calls.join(people.select("sample", "sex"), "sample")
    par = V.in_par(build, F.col("chrom"), F.col("pos"))
    kept = own.filter(~((F.col("sex") == "m") & (F.col("chrom") == "Y") & par))
    new = own.filter((F.col("sex") == "m") & (F.col("chrom") == "X") & par & ~V.is_symbolic(F.col("alt")))
    mirrored = new.withColumn("pos", V.par_x_to_y(build, F.col("pos"))).withColumn("chrom", F.lit("Y"))
    return kept.unionByName(mirrored)


def mt_calls(sites: DataFrame, people: DataFrame, seed: int = 1) -> DataFrame:
    """MT genotypes that all people of a lineage share: carried if the lineage's draw at the site is below its frequency (0.1 where unknown)."""
    mt = sites.filter(F.col("chrom").isin(V.MT)).select("chrom", "pos", "ref", "alt", F.coalesce("af", F.lit(0.1)).alias("af"))
    lineages = people.select("lineage").distinct()
    drawn = mt.crossJoin(F.broadcast(lineages)).withColumn("gt", F.when(draws.uniform(seed, "mt", F.col("lineage"), F.col("pos")) < F.col("af"), "1").otherwise("0"))
    return people.select("sample", "lineage").join(drawn, "lineage").select("sample", "lineage", "chrom", "pos", "ref", "alt", "gt")


def carriers(calls: DataFrame, keys: tuple[str, ...] = ("site", "ord")) -> DataFrame:
    """Non-reference haplotypes only: ``keys``, hap (2 i and 2 i + 1 of person i), allele."""
    person = F.substring("sample", 2, 10).cast("long")
    a = F.posexplode(F.transform(G.alleles(F.col("gt")), lambda x: x.try_cast("int"))).alias("h", "allele")
    return calls.select(*keys, person.alias("person"), a).filter("allele > 0").select(*keys, (F.col("person") * 2 + F.col("h")).alias("hap"), "allele")


def numbered(calls: DataFrame) -> DataFrame:
    """Add ``twin``, from 1: which of the calls of the same site, ord and sample a call is. Those of equal genotypes may take each other's."""
    return calls.withColumn("twin", F.row_number().over(Window.partitionBy("site", "ord", "sample").orderBy("gt")))


def dense(sparse: DataFrame, spine: DataFrame, keys: tuple[str, ...] = ("site", "ord")) -> DataFrame:
    """Phased genotypes of ``spine`` (``keys``, person) from carriers; absent haplotypes are reference. ``keys`` and the person must tell calls apart."""
    even = F.col("hap") % 2 == 0
    own = sparse.groupBy(*keys, F.floor(F.col("hap") / 2).alias("person")).agg(F.max(F.when(even, F.col("allele"))).alias("a"), F.max(F.when(~even, F.col("allele"))).alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return spine.join(own, [*keys, "person"], "left").select(*keys, "person", F.concat(zero("a"), F.lit("|"), zero("b")).alias("gt"))


def with_noise(calls: DataFrame, seed: int, flip: float = 0.001, dropout: float = 0.0005) -> DataFrame:
    """Sequencing noise: a call drops out, else may flip by the table; haploid calls never flip. Adds noise (null, 'dropout' or 'flip')."""
    u = lambda stream: draws.uniform(seed, stream, F.col("sample"), F.col("ord"))
    gt, v = F.col("gt"), u("to")
    flipped = (
        F.when(gt == "0|0", F.when(v < 0.7, "0|1").otherwise("1|1")).when(gt.isin("0|1", "1|0"), F.when(v < 0.5, "0|0").otherwise("1|1")).when(gt == "1|1", F.when(v < 0.7, "0|1").otherwise("0|0"))
    )
    noise = F.when(u("dropout") < dropout, "dropout").when((u("flip") < flip) & flipped.isNotNull(), "flip")
    out = calls.withColumn("noise", noise).withColumn("true_gt", gt)
    gone = F.col("noise") == "dropout"
    new = F.when(gone, "./.").when(F.col("noise") == "flip", flipped).otherwise(gt)
    out = out.withColumn("gt", new)
    for c in ("dp", "gq", "ad_ref", "ad_alt"):
        out = out.withColumn(c, F.when(gone, F.lit(0).cast("long")).otherwise(F.col(c)))
    return out.withColumn("gq", F.when(F.col("noise") == "flip", G.genotype_quality(F.col("gt"), F.col("dp"), F.col("ad_ref"), F.col("ad_alt")).cast("long")).otherwise(F.col("gq")))


def false_discovery(noisy: DataFrame) -> DataFrame:
    s = lambda x: F.coalesce(F.sum(F.when(F.col("noise") == x, 1)), F.lit(0)).cast("long")
    one = noisy.agg(s("flip").alias("flipped"), s("dropout").alias("dropped"), F.count("*").alias("total"))
    return one.withColumn("fdr", F.round((F.col("flipped") + F.col("dropped")) / F.col("total"), 6))


def golden_bed(calls: DataFrame) -> DataFrame:
    """BED4 of true variants that are members of a category, with what is known of them."""
    info = F.col("info")
    known = {key.lower(): A.info_value(info, key) for key in ("CLNSIG", "CLNDN", "COSMIC_ID", "COSMIC_GENE", "SVTYPE", "SVLEN")}
    category = A.golden_category(A.info_flag(info, "HIGHLIGHT"), known["clnsig"], known["cosmic_id"], known["svtype"], F.col("id"))
    end = V.bed_end(F.col("pos"), F.col("ref"), A.info_value(info, "END").try_cast("long"))
    own = calls.withColumn("flag", category).filter("flag is not null")
    text = A.payload(flag=F.col("flag"), id=F.when(F.col("id") == "", ".").otherwise(F.coalesce("id", F.lit("."))), ref=F.col("ref"), alt=F.col("alt"), gt=F.col("gt"), **known)
    return own.select("sample", "chrom", (F.col("pos") - 1).alias("start"), end.cast("long").alias("end"), text.alias("payload"))


def noise_bed(noisy: DataFrame) -> DataFrame:
    own = noisy.filter("noise is not null")
    text = A.payload(flag=F.upper("noise"), id=F.when(F.col("id") == "", ".").otherwise(F.coalesce("id", F.lit("."))), ref=F.col("ref"), alt=F.col("alt"), truth_gt=F.col("true_gt"), called_gt=F.col("gt"))
    end = V.bed_end(F.col("pos"), F.col("ref"), A.info_value(F.col("info"), "END").try_cast("long"))
    return own.select("sample", "chrom", (F.col("pos") - 1).alias("start"), end.cast("long").alias("end"), text.alias("payload"))
