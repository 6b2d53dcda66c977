"""Alleles, chromosomes, ploidy and mutation channels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pseudo-autosomal regions by build, (X from, X to, Y from, Y to), 1-based and inclusive.
PAR = {
    "GRCh37": [(60001, 2699520, 10001, 2649520), (154931044, 155260560, 59034050, 59363566)],
    "GRCh38": [(10001, 2781479, 10001, 2781479), (155701383, 156030895, 56887903, 57217415)],
}
MT = ["MT", "M", "chrMT", "chrM"]
HUMAN = [*map(str, range(1, 23)), "X", "Y", "M", "MT"]


def is_symbolic(alt: Column) -> Column:
    return alt.startswith("<") & alt.endswith(">")


def variant_class(ref: Column, alt: Column) -> Column:
    return F.when(is_symbolic(alt), "sv").when((F.length(ref) == 1) & (F.length(alt) == 1), "snv").otherwise("indel")


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")


def is_base_change(ref: Column, alt: Column) -> Column:
    """Two different single bases."""
    return F.upper(ref).isin(*"ACGT") & F.upper(alt).isin(*"ACGT") & (F.upper(ref) != F.upper(alt))


def bare_chrom(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def chrom_order(chrom: Column) -> Column:
    """1-22, X, Y, MT as numbers; others, which sort by name after them, as 1000."""
    c = bare_chrom(chrom)
    return F.when(c.rlike("^[0-9]+$") & c.try_cast("int").between(1, 22), c.try_cast("int")).when(c == "X", 23).when(c == "Y", 24).when(c.isin("MT", "M"), 25).otherwise(1000)


def is_human(chrom: Column) -> Column:
    return bare_chrom(chrom).isin(HUMAN)


def in_par(build: str, chrom: Column, pos: Column) -> Column:
    c = bare_chrom(chrom)
    test = F.lit(False)
    for x0, x1, y0, y1 in PAR[build]:
        test = test | ((c == "X") & pos.between(x0, x1)) | ((c == "Y") & pos.between(y0, y1))
    return test


def par_x_to_y(build: str, pos: Column) -> Column:
    out = None
    for x0, x1, y0, _ in PAR[build]:
        inside, there = pos.between(x0, x1), pos - x0 + y0
        out = F.when(inside, there) if out is None else out.when(inside, there)
    return out


def ploidy(build: str, chrom: Column, pos: Column, sex: Column) -> Column:
    c = bare_chrom(chrom)
    male = F.when(in_par(build, chrom, pos), 2).otherwise(1)
    checked = F.when(sex.isin("m", "f"), sex).otherwise(F.raise_error(F.concat(F.lit("unknown sex: "), F.coalesce(sex, F.lit("null")))))
    return F.when(c.isin("MT", "M"), 1).when(c == "X", F.when(checked == "f", 2).otherwise(male)).when(c == "Y", F.when(checked == "f", 0).otherwise(male)).otherwise(2)


def complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def channel(left: Column, ref: Column, alt: Column, right: Column) -> Column:
    """``L[R>A]R`` with a pyrimidine REF; null where a base isn't A, C, G or T."""
    purine = ref.isin("A", "G")
    name = F.when(purine, F.concat(complement(right), F.lit("["), complement(ref), F.lit(">"), complement(alt), F.lit("]"), complement(left))).otherwise(F.concat(left, F.lit("["), ref, F.lit(">"), alt, F.lit("]"), right))
    sound = F.lit(True)
    for base in (left, ref, alt, right):
        sound = sound & base.isin(*"ACGT")
    return F.when(sound & (ref != alt), name)


def channel_index(name: Column) -> Column:
    """Substitution * 16 + left * 4 + right, in the order C>A, C>G, C>T, T>A, T>C, T>G and ACGT."""
    substitution = (F.instr(F.lit("C>A C>G C>T T>A T>C T>G"), F.substring(name, 3, 3)) - 1) / 4
    base = lambda at: F.instr(F.lit("ACGT"), F.substring(name, at, 1)) - 1
    return (substitution * 16 + base(1) * 4 + base(7)).cast("int")


def all_channels() -> list[str]:
    return [f"{a}[{s}]{b}" for s in ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G") for a in "ACGT" for b in "ACGT"]


def bed_end(pos: Column, ref: Column, sv_end: Column) -> Column:
    return F.coalesce(sv_end, pos - 1 + F.greatest(F.lit(1), F.length(ref)))
