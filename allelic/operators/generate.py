"""Seeded generators. Every draw is a function of (seed, stream, key): any partitioning gives the same table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import genotype as G
from ..functions import variant as V

#: Structural variants and their weights, ancestry fractions, and the reads' law.
SV_WEIGHTS = {"DEL": 0.5, "DUP": 0.3, "INV": 0.2}
ANCESTRY = {"EUR": 0.6, "SAS": 0.25, "AFR": 0.15}
SV_SHORT, SV_LONG, CIPOS = 50, 10_000, 50
DEPTH, DEPTH_SD, LEAST_DEPTH, HET_REF_SHARE = 30, 3, 5, 0.525
PULSE_GENERATIONS, RECOMBINATION = 20, 1e-8
#: The mixing step and the bits of a chunk's seed, and the overlap: share of the chunk, least, most.
SEED_STEP, SEED_BITS = 0x9E3779B9, 0x7FFFFFFF
OVERLAP, LEAST_OVERLAP, MOST_OVERLAP = 0.1, 500_000, 5_000_000


def ordered_rank(rows: DataFrame, keys: list[str], part: Column, order: list[str], name: str = "rn") -> DataFrame:
    """A gapless rank from 1 within ``keys`` by (part, order).

    ``part`` must not fall as the order rises: it cuts a key into runs that are sorted apart, and the counts of
    the runs before become offsets, so a key that holds most rows isn't sorted in one task.
    """
    cut = rows.withColumn("_part", part)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return cut.withColumn("_own", own).join(offsets, [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_before", "_own", "_part")


def bump(rows: DataFrame, keys: list[str], pos: str, ties: list[str], run: int = 1_000_000) -> DataFrame:
    """Strictly ascending positions: each at its own place or the next free one after its predecessor.

    That is the largest of (position - rank) so far, plus the rank. Runs of ``run`` places are worked on apart; what
    the runs before reach comes from one row for each run.
    """
    parts = Window.partitionBy(*keys, "_part").orderBy(pos, *ties)
    cut = rows.withColumn("_part", F.floor(F.col(pos) / run)).withColumn("_own", F.row_number().over(parts).cast("long"))
    cut = cut.withColumn("_most", F.max(F.col(pos) - F.col("_own")).over(parts.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut.groupBy(*keys, "_part").agg(F.max("_own").alias("_n"), F.max("_most").alias("_m")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = runs.select(*keys, "_part", "_before", F.max(F.col("_m") - F.col("_before")).over(before).alias("_reached"))
    new = F.greatest(F.col("_most"), F.col("_reached") + F.col("_before")) + F.col("_own")
    return cut.join(runs, [*keys, "_part"]).withColumn("new_pos", new).drop("_part", "_own", "_most", "_before", "_reached")


def suffix_min(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The least ``value`` from each row to the last of its key: a running one from the end, as a frame that looks ahead goes over the rest of the key for each row."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("min_ahead", F.min(value).over(w))


def slices(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Contiguous slices whose sizes differ by one at most, larger ones first."""
    return rows.withColumn("slice", F.ntile(n).over(Window.orderBy(*order)).cast("long"))


def sfs_weights(spark: SparkSession, haplotypes: int, alpha: float = 2.0) -> DataFrame:
    """Allele counts k = 1 .. haplotypes - 1 with chances as 1 / k^alpha: k, low, high (cumulated)."""
    rows, total = [], sum(k**-alpha for k in range(1, haplotypes))
    run = 0.0
    for k in range(1, haplotypes):
        rows.append((k, run / total, (run + k**-alpha) / total))
        run += k**-alpha
    rows[-1] = (rows[-1][0], rows[-1][1], 1.0)
    return spark.createDataFrame(rows, "k long, low double, high double")


def by_chance(rows: DataFrame, table: DataFrame, lines: int, draw: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each row with the line of ``table`` (.., low, high) in which its draw, from 0 to below 1, falls; of its ``keys``, where each has lines of its own.

    Both meet by the step of 1 / ``lines`` that they are in, so a row is held against the lines of its step only.
    """
    step = lambda x: F.floor(x * lines)
    told = table.withColumn("_step", F.explode(F.sequence(step(F.col("low")), step(F.least("high", F.lit(1.0))))))
    met = rows.withColumn("_u", draw).withColumn("_step", step(F.col("_u"))).join(told, [*keys, "_step"])
    return met.filter((F.col("_u") >= F.col("low")) & (F.col("_u") < F.col("high"))).drop("_step", "_u", "low", "high")


def draw_allele_counts(sites: DataFrame, haplotypes: int, seed: int) -> DataFrame:
    found = by_chance(sites, sfs_weights(sites.sparkSession, haplotypes), haplotypes, draws.uniform(seed, "sfs", F.col("site")))
    return found.select("site", F.col("k").alias("ac"))


def titv_alt(sites: DataFrame, seed: int, ratio: float = 2.1) -> DataFrame:
    """An ALT base for each REF: the transition with chance ratio / (ratio + 1), else one of two transversions."""
    ref = F.col("ref")
    ti = F.translate(ref, "ACGT", "GTAC")
    u, v = draws.uniform(seed, "titv", F.col("site")), draws.uniform(seed, "tv", F.col("site"))
    tv = F.when(v < 0.5, F.translate(ref, "ACGT", "CATG")).otherwise(F.translate(ref, "ACGT", "TGCA"))
    return sites.withColumn("new_alt", F.when(u < ratio / (ratio + 1), ti).otherwise(tv))


def haplotype_slots(counts: DataFrame, haplotypes: int, seed: int) -> DataFrame:
    """Exactly ``ac`` distinct haplotypes of each site: the first by hash order. (site, ac) to (site, hap).

    The haplotypes of a site are put in order within its row, so only sites are moved: they are dealt out, since a small table of them is a lot of work.
    """
    dealt = counts.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "site")
    each = F.transform(F.sequence(F.lit(0), F.lit(haplotypes - 1)), lambda h: F.struct(draws.order_key(seed, "slot", F.col("site"), h).alias("key"), h.cast("long").alias("hap")))
    first = F.slice(F.sort_array(each), F.lit(1), F.greatest(F.col("ac"), F.lit(0)).cast("int"))
    return dealt.select("site", F.explode(first).alias("slot")).select("site", "slot.hap")


def hwe_genotypes(cells: DataFrame, af: str, seed: int) -> DataFrame:
    """Two independent draws of the ALT allele."""
    one = lambda h: F.when(draws.uniform(seed, h, F.col("sample"), F.col("site")) < F.col(af), "1").otherwise("0")
    return cells.withColumn("gt", F.concat(one("h1"), F.lit("|"), one("h2")))


def draw_multi_allele_counts(sites: DataFrame, haplotypes: int, seed: int, alpha: float = 2.0, attempts: int = 50) -> DataFrame:
    """Counts of several ALT alleles, (site, n_alts) to (site, acs); at least one haplotype stays REF.

    Each count is drawn for itself. A draw that adds up to too many is repeated, ``attempts`` times in all; then
    the largest counts, the first of equals, shrink one by one until they fit, none below 1.
    """
    if haplotypes < 2:
        raise ValueError("fewer than 2 haplotypes")
    weights = [k**-alpha for k in range(1, haplotypes)]
    highs = F.array(*[F.lit(sum(weights[:k]) / sum(weights)) for k in range(1, haplotypes - 1)], F.lit(1.0))
    most, total = haplotypes - 1, lambda acs: F.aggregate(acs, F.lit(0).cast("long"), lambda x, y: x + y)

    alts = F.when(F.col("n_alts") < 1, F.raise_error(F.lit("a site without ALT"))).otherwise(F.col("n_alts")).cast("int")

    def draw(i):
        us = F.transform(F.sequence(F.lit(1), alts), lambda alt: draws.uniform(seed, "sfs", F.col("site"), i, alt))
        return F.transform(us, lambda u: (F.size(F.filter(highs, lambda h: h <= u)) + 1).cast("long"))

    # CASE is lazy: nothing is drawn any more once a draw fits
    drawn = F.aggregate(F.sequence(F.lit(1), F.lit(attempts - 1)), draw(F.lit(0)), lambda acs, i: F.when(total(acs) <= most, acs).otherwise(draw(i))) if attempts > 1 else draw(F.lit(0))
    out = sites.withColumn("acs", drawn)
    # where shrinking ends: all counts capped at a level, the first of those at the level one lower
    levels = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(most).cast("long")), lambda x: total(F.transform("acs", lambda c: F.least(c, x))) >= most)
    out = out.withColumn("_level", F.when(total(F.col("acs")) > most, levels[0]))
    out = out.withColumn("_over", total(F.transform("acs", lambda c: F.least(c, F.col("_level")))) - most)
    at = F.transform("acs", lambda c, i: F.size(F.filter(F.slice("acs", 1, i + 1), lambda x: x >= F.col("_level"))))  # how many have been at the level
    shrunk = F.transform(F.arrays_zip(F.col("acs").alias("c"), at.alias("n")), lambda x: F.greatest(F.lit(1).cast("long"), F.least(x["c"], F.col("_level")) - F.when((x["c"] >= F.col("_level")) & (x["n"] <= F.col("_over")), 1).otherwise(0)))
    return out.select("site", F.when(F.col("_level").isNull(), F.col("acs")).otherwise(shrunk).alias("acs"))


def multi_haplotype_slots(counts: DataFrame, haplotypes: int, seed: int) -> DataFrame:
    """Exactly ``acs[k - 1]`` distinct haplotypes for each ALT allele k of a site, in hash order. (site, acs) to (site, hap, allele)."""
    ends = F.transform("acs", lambda c, i: F.aggregate(F.slice("acs", 1, i + 1), F.lit(0).cast("long"), lambda x, y: x + y))
    told = counts.select("site", ends.alias("ends"))
    last = F.when(F.element_at("ends", -1) > haplotypes, F.raise_error(F.lit("more ALT alleles than haplotypes"))).otherwise(F.element_at("ends", -1))
    wide = told.withColumn("last", last).withColumn("hap", F.explode(F.sequence(F.lit(0), F.lit(haplotypes - 1)))).withColumn("hap", F.col("hap").cast("long"))
    order = Window.partitionBy("site").orderBy(draws.order_key(seed, "slot", F.col("site"), F.col("hap")), "hap")
    taken = wide.withColumn("rn", F.row_number().over(order)).filter("rn <= last")
    return taken.select("site", "hap", (F.size(F.filter("ends", lambda e: e < F.col("rn"))) + 1).cast("long").alias("allele"))


def multi_hwe_genotypes(cells: DataFrame, afs: str, seed: int) -> DataFrame:
    """Two independent draws among REF and the ALT alleles of the array ``afs``; REF has what they leave."""
    highs = F.transform(afs, lambda f, i: F.aggregate(F.slice(afs, 1, i + 1), F.lit(0.0), lambda x, y: x + y))
    one = lambda h: F.array_position(F.transform(highs, lambda high: draws.uniform(seed, h, F.col("sample"), F.col("site")) < high), F.lit(True)).cast("string")
    return cells.withColumn("gt", F.concat(one("h1"), F.lit("|"), one("h2")))


def sample_ids(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Distinct ids: HG or NA and seven digits, by a bijection of the row number."""
    i = (F.col("id") * 7_368_787 + seed * 104_729) % 19_800_000
    return spark.range(n).select(F.col("id").alias("i"), F.concat(F.when(i % 2 == 0, "HG").otherwise("NA"), F.lpad(F.floor(i / 2).cast("string"), 7, "0")).alias("sample"))


def sex_and_lineage(samples: DataFrame, seed: int, male: float = 0.5, lineages: int | None = None) -> DataFrame:
    """Sex and MT lineage from independent streams; a lineage for every ten samples where no number is given."""
    lineages = lineages or max(1, samples.count() // 10)
    sex = F.when(draws.uniform(seed, "sex", F.col("sample")) < male, "m").otherwise("f")
    return samples.withColumns({"sex": sex, "lineage": F.floor(draws.uniform(seed, "lineage", F.col("sample")) * lineages).cast("long")})


def sample_depths(samples: DataFrame, seed: int) -> DataFrame:
    """Mean depth of each sample: normal around DEPTH, LEAST_DEPTH at least. Adds ``mean_depth``."""
    u, v = draws.uniform(seed, "depth", F.col("sample")), draws.uniform(seed, "depth2", F.col("sample"))
    z = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
    return samples.withColumn("mean_depth", F.greatest(F.lit(float(LEAST_DEPTH)), DEPTH + DEPTH_SD * z))


#: No draw of 32 bits lies farther out: a mean depth is below 51, and its Poisson draw below this.
MOST_READS = 150


def depth_table(samples: DataFrame) -> DataFrame:
    """Poisson chances of each sample's ``mean_depth``: sample, dp_new, low, high (cumulated)."""
    log_factorial = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(MOST_READS + 1)])
    each = samples.select("sample", "mean_depth", F.posexplode(log_factorial).alias("k", "f")).withColumn("p", F.exp(F.col("k") * F.log("mean_depth") - F.col("mean_depth") - F.col("f")))
    high = F.sum("p").over(Window.partitionBy("sample").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    out = each.withColumn("high", F.when(F.col("k") == MOST_READS, 2.0).otherwise(high))
    low = F.coalesce(F.lag("high").over(Window.partitionBy("sample").orderBy("k")), F.lit(0.0))
    return out.select("sample", F.col("k").cast("long").alias("dp_new"), low.alias("low"), "high").filter("low < high")


def read_shares(spark: SparkSession) -> DataFrame:
    """Binomial chances of how many of ``dp_new`` reads show a call's first allele, by its share: dp_new, share, first, low, high (cumulated).

    A table of fixed size: depths up to MOST_READS and four shares, 1 where both alleles are the same.
    """
    lf, out = [math.lgamma(k + 1) for k in range(MOST_READS + 1)], []
    for n in range(MOST_READS + 1):
        out.append((n, 1.0, n, 0.0, 2.0))
        for p in (HET_REF_SHARE, 1 - HET_REF_SHARE, 0.5):
            high = 0.0
            for k in range(n + 1):
                low, high = high, high + math.exp(lf[n] - lf[k] - lf[n - k] + k * math.log(p) + (n - k) * math.log(1 - p))
                if low < 1:
                    out.append((n, p, k, low, 2.0 if k == n else high))
    return spark.createDataFrame(out, "dp_new long, share double, first long, low double, high double").filter("low < high")


def read_depths(calls: DataFrame, seed: int) -> DataFrame:
    """Depth and allelic depths of each call: adds dp_new, ad_new (an array, REF first), ref_new and alt_new (of the first ALT).

    A sample's depth is Poisson around its own mean. The alleles of a heterozygous call share the reads binomially:
    REF gets a little more than half, two ALT alleles half each. Alleles that the record lacks and malformed calls count
    as REF; AD adds up to DP. Both draws are by inverse CDF.
    """
    table = depth_table(sample_depths(calls.select("sample").distinct(), seed))
    out = by_chance(calls, table, DEPTH, draws.uniform(seed, "dp", F.col("sample"), F.col("ord")), ("sample",))
    # a generator ends what the optimizer may fold into one expression, so calls are parsed once
    out = out.withColumn("_c", F.explode(F.array(F.struct((F.size(F.split("alt", ",")) + 1).alias("n"), G.quality_alleles(F.col("gt")).alias("pair")))))
    known = lambda i: F.when(F.col("_c.pair")[i].between(0, F.col("_c.n") - 1), F.col("_c.pair")[i]).otherwise(0)
    a, b = known(0), known(1)
    out = out.withColumn("share", F.when(a == b, 1.0).when(a == 0, HET_REF_SHARE).when(b == 0, 1 - HET_REF_SHARE).otherwise(0.5))
    out = by_chance(out, F.broadcast(read_shares(calls.sparkSession)), DEPTH, draws.uniform(seed, "reads", F.col("sample"), F.col("ord")), ("dp_new", "share"))
    reads = F.transform(F.sequence(F.lit(0), F.col("_c.n") - 1), lambda i: F.when(i == a, F.col("first")).when(i == b, F.col("dp_new") - F.col("first")).otherwise(0).cast("long"))
    out = out.withColumn("ad_new", reads).drop("_c", "share", "first")
    return out.withColumn("ref_new", F.col("ad_new")[0]).withColumn("alt_new", F.col("ad_new")[1])


def structural_variants(people: DataFrame, each: int, span: int, seed: int) -> DataFrame:
    """``each`` variants a person: type, log-uniform length, position, genotype, confidence interval."""
    rows = people.select("sample").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    u = lambda stream: draws.uniform(seed, stream, F.col("sample"), F.col("i"))
    length = F.floor(F.exp(math.log(SV_SHORT) + u("len") * (math.log(SV_LONG) - math.log(SV_SHORT))) + 1e-9).cast("long")
    out = rows.withColumns({"svtype": draws.pick(u("type"), SV_WEIGHTS), "len": length, "pos": (F.floor(u("pos") * (span - SV_LONG)) + 1).cast("long"), "gt": F.when(u("gt") < 0.8, "0|1").otherwise("1|1")})
    return out.select("sample", F.col("i").cast("long").alias("i"), "svtype", "pos", (F.col("pos") + F.col("len")).alias("end"), F.when(F.col("svtype") == "DEL", -F.col("len")).otherwise(F.col("len")).alias("svlen"), "gt", F.lit(-CIPOS).cast("long").alias("cipos_lo"), F.lit(CIPOS).cast("long").alias("cipos_hi"))


def poisson_highs(mean: float) -> list[float]:
    """Cumulated Poisson chances, until no draw of 32 bits lies beyond."""
    run, p, out = 0.0, math.exp(-mean), []
    while run < 1 - 2**-33 and len(out) < 10 * mean + 50:
        run += p
        out.append(run)
        p *= mean / len(out)
    return [*out[:-1], 1.0]


def ancestry(people: DataFrame, span: int, seed: int, generations: float = PULSE_GENERATIONS, recombination: float = RECOMBINATION, fractions: dict[str, float] = ANCESTRY) -> DataFrame:
    """Ancestry tracts of each haplotype after one pulse of mixing: sample, hap, start, end, pop.

    Crossovers since the pulse are a Poisson process: their number is drawn, then a place for each, so tracts are
    exponential. Each tract is of one population, by ``fractions``, which must add up to 1; neighbours may be of the same.
    """
    if abs(sum(fractions.values()) - 1) > 1e-6:
        raise ValueError("ancestry fractions don't add up to 1")
    highs = F.array(*map(F.lit, poisson_highs(generations * recombination * span)))
    haps = people.select("sample").withColumn("hap", F.explode(F.array(F.lit(1), F.lit(2))))
    crossovers = F.size(F.filter(highs, lambda h: h <= draws.uniform(seed, "crossovers", F.col("sample"), F.col("hap"))))
    cuts = haps.withColumn("i", F.explode(F.sequence(F.lit(0), crossovers)))
    at = F.when(F.col("i") == 0, 0).otherwise(F.floor(draws.uniform(seed, "cut", F.col("sample"), F.col("hap"), F.col("i")) * span)).cast("long")
    cuts = cuts.withColumn("start", at).groupBy("sample", "hap", "start").agg(F.min("i").alias("i"))
    w = Window.partitionBy("sample", "hap").orderBy("start")
    pop = draws.pick(draws.uniform(seed, "pop", F.col("sample"), F.col("hap"), F.col("i")), fractions)
    return cuts.withColumn("end", F.coalesce(F.lead("start").over(w), F.lit(span).cast("long"))).select("sample", F.col("hap").cast("long").alias("hap"), "start", "end", pop.alias("pop"))


def highlighted_variant(people: DataFrame, candidates: DataFrame, seed: int, build: str = "GRCh38") -> DataFrame:
    """One candidate (ord, chrom, pos, ref, alt) for each person (sample, sex), with a genotype.

    Uniform over the candidates that a person of that sex has a copy of, without MT and the pseudo-autosomal part of Y.
    The draw is a number among these, so people meet candidates in an equi-join. A person for whom none is left is an error.
    """
    both = candidates.withColumn("sex", F.explode(F.array(F.lit("m"), F.lit("f"))))
    c, p = F.col("chrom"), F.col("pos")
    fits = (V.ploidy(build, c, p, F.col("sex")) > 0) & ~c.isin(V.MT) & ~((V.bare_chrom(c) == "Y") & V.in_par(build, c, p))
    numbered = ordered_rank(both.filter(fits), ["sex"], F.floor(F.col("ord") / 4096), ["ord", "chrom", "pos", "ref", "alt"], "n")
    there = numbered.groupBy("sex").agg(F.max("n").alias("most"))
    told = people.select("sample", "sex").join(F.broadcast(there), "sex", "left")  # a row for each sex
    lost = F.raise_error(F.concat(F.lit("no candidate is left for sex "), F.coalesce("sex", F.lit("null"))))
    n = F.when(F.col("most").isNull(), lost).otherwise(F.floor(draws.uniform(seed, "highlight", F.col("sample")) * F.col("most")) + 1)
    gt = F.when(draws.uniform(seed, "hgt", F.col("sample")) < 0.7, "0|1").otherwise("1|1")
    return told.withColumn("n", n).join(numbered, ["sex", "n"]).select("sample", "ord", "chrom", "pos", "ref", "alt", gt.alias("gt"))


def chunks(contigs: DataFrame, size: int) -> DataFrame:
    """Chunks of ``size`` bases of each contig (chrom, length, seed): chrom, chunk, start, end, worked_end, chunk_seed.

    A chunk is worked on past its end by the overlap, but for the last; places from ``end`` on belong to the next chunk.
    Its seed comes from the contig's and its number alone, so a resumed run draws the same.
    """
    overlap = max(LEAST_OVERLAP, min(MOST_OVERLAP, int(size * OVERLAP)))
    each = contigs.filter("length > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))))
    start, end = F.col("chunk") * size, F.least((F.col("chunk") + 1) * size, F.col("length"))
    mixed = (F.col("seed") + F.col("chunk") * SEED_STEP).bitwiseAND(SEED_BITS)
    last = end >= F.col("length")
    return each.select("chrom", "chunk", start.alias("start"), end.alias("end"), F.when(last, end).otherwise(end + overlap).alias("worked_end"), F.when(mixed == 0, 1).otherwise(mixed).alias("chunk_seed"))


def picked_ref(sites: DataFrame, base: str | None, seed: int) -> DataFrame:
    """Add ``new_ref``: the reference base in column ``base``, a drawn one where that is N or there is none."""
    drawn = F.substring(F.lit("ACGT"), (F.floor(draws.uniform(seed, "ref", F.col("site")) * 4) + 1).cast("int"), F.lit(1))
    return sites.withColumn("new_ref", F.when(F.col(base).isin(*"ACGT"), F.col(base)).otherwise(drawn) if base else drawn)


def mosaic_haplotypes(spark: SparkSession, haplotypes: int, sites: int, founders: int, switch: float, seed: int) -> DataFrame:
    """Haplotypes that copy from founders and now and then switch: linkage that decays with distance. (hap, site, allele)"""
    h = spark.range(haplotypes).select(F.col("id").alias("hap")).crossJoin(spark.range(sites).select(F.col("id").alias("site")))
    jump = (F.col("site") == 0) | (draws.uniform(seed, "switch", F.col("hap"), F.col("site")) < switch)
    w = Window.partitionBy("hap").orderBy("site").rowsBetween(Window.unboundedPreceding, 0)
    own = h.withColumn("since", F.max(F.when(jump, F.col("site"))).over(w))
    founder = F.floor(draws.uniform(seed, "founder", F.col("hap"), F.col("since")) * founders)
    return own.withColumn("founder", founder).select("hap", "site", (draws.uniform(seed, "allele", F.col("founder"), F.col("site")) < 0.3).cast("int").alias("allele"))
