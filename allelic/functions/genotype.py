"""Genotype strings. Several dosage rules are in use; each has its own name."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = r"[|/]"


def alleles(gt: Column) -> Column:
    return F.split(gt, SEPARATOR)


def is_dropout(gt: Column) -> Column:
    return gt.contains(".")


def dosage(gt: Column) -> Column:
    """Alleles that aren't the reference, of two called ones; null for missing, haploid and malformed calls."""
    a = alleles(gt)
    one, two = a[0].try_cast("int"), F.get(a, F.lit(1)).try_cast("int")
    called = ~is_dropout(gt) & (F.size(a) == 2)
    return F.when(called, (one > 0).cast("int") + (two > 0).cast("int"))


def is_het(gt: Column) -> Column:
    a = alleles(gt)
    return ~is_dropout(gt) & (F.size(a) == 2) & (a[0] != F.get(a, F.lit(1)))


def strict_dosage(gt: Column) -> Column:
    """Only plain biallelic diploid calls count."""
    return F.when(gt.isin("0|0", "0/0"), 0).when(gt.isin("0|1", "1|0", "0/1", "1/0"), 1).when(gt.isin("1|1", "1/1"), 2)


def first_alt_dosage(gt: Column) -> Column:
    """Alleles equal to 1; missing alleles count as none."""
    return F.size(F.filter(alleles(gt), lambda a: a == "1"))


def ones_dosage(gt: Column) -> Column:
    """Characters ``1``, as a plain text count has it."""
    return F.length(gt) - F.length(F.replace(gt, F.lit("1"), F.lit("")))


def alt_dosages(gt: Column, n_alts: Column) -> Column:
    """Count of each ALT allele in a phased call."""
    return F.transform(F.sequence(F.lit(1), n_alts), lambda k: F.size(F.filter(F.split(gt, r"\|"), lambda a: a == k.cast("string"))))


def total_alt_dosage(gt: Column) -> Column:
    return F.size(F.filter(alleles(gt), lambda a: a.try_cast("int") >= 1))


def is_hom_ref(gt: Column) -> Column:
    return gt.isin("", "0|0", "0/0")


def quality_alleles(gt: Column) -> Column:
    """Two allele numbers: a haploid k counts as (k, k), anything malformed as (0, 0)."""
    a = alleles(gt)
    one, two = a[0].try_cast("int"), F.get(a, F.lit(1)).try_cast("int")
    return F.when((F.size(a) == 1) & one.isNotNull(), F.array(one, one)).when((F.size(a) == 2) & one.isNotNull() & two.isNotNull(), F.array(one, two)).otherwise(F.array(F.lit(0), F.lit(0)))


def genotype_quality(gt: Column, dp: Column, ad_ref: Column, ad_alt: Column) -> Column:
    """Phred-like quality from allelic depths; 0 without depth."""
    a = quality_alleles(gt)
    both = ad_ref + ad_alt
    balance = 1 - 2 * F.abs(F.try_divide(ad_ref.cast("double"), both) - 0.5)
    own = F.when(a[0] == 0, ad_ref).otherwise(ad_alt)
    support = F.when(a[0] == a[1], own / dp).otherwise(F.coalesce(balance, F.lit(0.0)) * both / dp)
    phred = F.least(-10 * F.log10(F.greatest(1 - support, F.lit(1e-10))), 60 * F.log10(dp.cast("double")))
    return F.when(dp > 0, F.least(F.greatest(F.bround(phred + 1e-9, 0), F.lit(0.0)), F.lit(99.0)).cast("int")).otherwise(0)
