"""Genotype matrix in coordinate form: relatedness, inbreeding, linkage, principal components."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digests
from ..functions import genotype as G

#: Distance bins of the decay of linkage, in base pairs.
LD_BINS = [(100, 500), (500, 1000), (1000, 2000), (2000, 5000), (5000, 10000), (10000, 20000), (20000, 50000), (50000, 100000), (100000, 200000), (200000, 500000)]


def genotype_matrix(calls: DataFrame, rule=G.dosage) -> DataFrame:
    """(sample, chrom, pos, dosage) of called cells; of repeated ones the greatest."""
    return calls.select("sample", "chrom", "pos", rule(F.col("gt")).cast("long").alias("dosage")).groupBy("sample", "chrom", "pos").agg(F.max("dosage").alias("dosage")).filter("dosage is not null")


def first_sites(matrix: DataFrame, most: int) -> DataFrame:
    """The first ``most`` distinct sites of each sample, in order of chrom and pos."""
    order = Window.partitionBy("sample").orderBy("chrom", "pos")
    return matrix.withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= most).drop("r")


def f_statistic(matrix: DataFrame) -> DataFrame:
    """Observed and expected heterozygosity of each sample, and F = 1 - observed / expected."""
    freq = matrix.groupBy("chrom", "pos").agg((F.sum("dosage") / (2 * F.count("*"))).alias("p"))
    both = matrix.join(freq, ["chrom", "pos"])
    out = both.groupBy("sample").agg(F.count("*").alias("n_sites"), F.sum((F.col("dosage") == 1).cast("long")).alias("obs_het"), F.round(F.sum(2 * F.col("p") * (1 - F.col("p"))), 6).alias("exp_het"))
    return out.withColumn("f", F.round(1 - F.try_divide(F.col("obs_het"), F.col("exp_het")), 6))


#: Samples of a word, words that are compared in one unrolled expression at most, and buckets that cover the longest distance.
WORD, UNROLLED, BUCKETS = 64, 4, 4


def called_cells(calls: DataFrame, rule=G.dosage) -> DataFrame:
    """(sample, chrom, pos, dosage) of called cells, repeated ones too, for what takes the greatest of these itself."""
    return calls.select("sample", "chrom", "pos", rule(F.col("gt")).cast("long").alias("dosage")).filter("dosage is not null")


def site_planes(matrix: DataFrame, ploidy: int = 2) -> tuple[DataFrame, int]:
    """A row for each site, and how many words a plane has: chrom, pos, and planes w0 .. w<ploidy>, arrays of words with a bit for each sample.

    Plane 0 has the samples called at the site, plane k those with a dosage of k or more. The bits of repeated cells
    are joined by OR, so the greatest dosage holds. The driver numbers the samples.
    """
    spark, kind = matrix.sparkSession, matrix.schema["sample"].dataType.simpleString()
    known = matrix.filter("sample is not null and chrom is not null and pos is not null and dosage is not null")
    names = sorted(r[0] for r in known.select("sample").distinct().collect())
    index = spark.createDataFrame(list(zip(names, range(len(names)))), f"sample {kind}, _at int")
    words = max(1, -(-len(names) // WORD))
    d = F.when(F.col("dosage").between(0, ploidy), F.col("dosage")).otherwise(F.raise_error(F.lit("a dosage beyond the ploidy")).cast("long"))
    # narrow rows go to their site's task, where the words are made
    dealt = known.join(F.broadcast(index), "sample").select("chrom", "pos", "_at", d.alias("d")).repartition("chrom", "pos")
    bit = F.expr(f"shiftleft(1L, _at % {WORD})")
    if words <= UNROLLED:
        # words that can't be null keep the pairs' code short enough to be compiled
        zero = F.lit(0).cast("long")
        word = lambda k, w: F.coalesce(F.bit_or(F.when((F.floor(F.col("_at") / WORD) == w) & (F.col("d") >= k), bit).otherwise(zero)), zero).alias(f"w{k}_{w}")
        return dealt.groupBy("chrom", "pos").agg(*[word(k, w) for k in range(ploidy + 1) for w in range(words)]), words
    each = dealt.groupBy("chrom", "pos", F.floor(F.col("_at") / WORD).cast("int").alias("_w")).agg(*[F.bit_or(F.when(F.col("d") >= k, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(ploidy + 1)])
    held = each.groupBy("chrom", "pos").agg(F.map_from_entries(F.collect_list(F.struct("_w", F.struct(*[f"b{k}" for k in range(ploidy + 1)])))).alias("m"))
    all_words = F.sequence(F.lit(0), F.lit(words - 1))
    plane = lambda k: F.transform(all_words, lambda w: F.coalesce(F.try_element_at(F.col("m"), w)[f"b{k}"], F.lit(0).cast("long"))).alias(f"w{k}")
    return held.select("chrom", "pos", *[plane(k) for k in range(ploidy + 1)]), words


def site_pairs(planes: DataFrame, longest: int, shortest: int) -> DataFrame:
    """Pairs of sites of a chromosome from ``shortest`` up to ``longest`` base pairs apart: chrom, p1, p2, and the columns of both, those of the second with a ``y``.

    The distance is cut into BUCKETS; a site meets its own bucket and as many before it in a hash join, so no pair far outside the band is formed.
    """
    step, own = -(-longest // BUCKETS), [c for c in planes.columns if c not in ("chrom", "pos")]
    at = F.floor(F.col("pos") / step)
    left = planes.select("chrom", at.alias("bucket"), F.col("pos").alias("p1"), *own)
    right = planes.select("chrom", F.explode(F.sequence(at - BUCKETS, at)).alias("bucket"), F.col("pos").alias("p2"), *[F.col(c).alias(f"y{c}") for c in own])
    gap = F.col("p2") - F.col("p1")
    return right.join(left.hint("shuffle_hash"), ["chrom", "bucket"]).filter((gap >= shortest) & (gap < longest)).drop("bucket")


def pair_sums(pairs: DataFrame, words: int, ploidy: int = 2) -> DataFrame:
    """n, sx, sy, sxx, syy, sxy of the samples called at both sites, from bits that two planes share; pairs of fewer than 4 are left out."""
    up = range(1, ploidy + 1)

    def shared(k: int, m: int) -> Column:
        if words <= UNROLLED:
            return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"w{k}_{w}").bitwiseAND(F.col(f"yw{m}_{w}"))) for w in range(words)]).cast("long")
        return F.aggregate(F.zip_with(f"w{k}", f"yw{m}", lambda a, b: F.bit_count(a.bitwiseAND(b)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)

    met = pairs.withColumn("n", shared(0, 0)).filter("n >= 4")
    told = met.select("chrom", "p1", "p2", "n", *[shared(k, 0).alias(f"x{k}") for k in up], *[shared(0, k).alias(f"y{k}") for k in up], reduce(lambda a, b: a + b, [shared(k, m) for k in up for m in up]).alias("sxy"))
    total = lambda c, weight: reduce(lambda a, b: a + b, [F.col(f"{c}{k}") * F.lit(weight(k)) for k in up])
    one, square = (lambda k: 1), (lambda k: 2 * k - 1)
    return told.select("chrom", "p1", "p2", "n", total("x", one).alias("sx"), total("y", one).alias("sy"), total("x", square).alias("sxx"), total("y", square).alias("syy"), "sxy")


def pair_r2(matrix: DataFrame, longest: int = 500_000, shortest: int = 100) -> DataFrame:
    """r squared of site pairs of a chromosome from ``shortest`` up to ``longest`` base pairs apart, over samples called at both; null without variance.

    Cells of a site are gathered to bits of samples first, so a pair of sites is one row of the join, whatever the number
    of samples, and pairs are never moved. Dosages are 0 to 2; of repeated cells the greatest counts. Sums are integers, so their order doesn't matter.
    """
    planes, words = site_planes(matrix)
    return r2_of(pair_sums(site_pairs(planes, longest, shortest), words))


def r2_of(s: DataFrame) -> DataFrame:
    cov = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double")
    var = ((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))).cast("double")
    return s.select("chrom", "p1", "p2", "n", F.try_divide(cov * cov, var).alias("r2"))


def ld_bin() -> Column:
    """The number of the distance bin of a pair."""
    at = None
    for i, (low, high) in enumerate(LD_BINS):
        test = (F.col("p2") - F.col("p1") >= low) & (F.col("p2") - F.col("p1") < high)
        at = F.when(test, i) if at is None else at.when(test, i)
    return at.cast("long")


#: First sites of a bucket that are hashed with all that may follow them in one row.
DEALT = 256


def low_pairs(planes: DataFrame, start: str, limits: list[int]) -> DataFrame:
    """(chrom, p1, p2) of the pairs of LD_BINS whose md5 of ``start``:chrom:p1:p2 begins with four bytes below their bin's limit.

    Places alone are dealt into buckets, those of first sites in runs of DEALT; Python workers hash a run's pairs by numpy and hand on the few low ones.
    """
    spark, step = planes.sparkSession, -(-LD_BINS[-1][1] // BUCKETS)
    at = F.floor(F.col("pos") / step)
    first = planes.select("chrom", at.alias("bucket"), "pos").groupBy("chrom", "bucket").agg(F.sort_array(F.collect_list("pos")).alias("p1"))
    second = planes.select("chrom", F.explode(F.sequence(at - BUCKETS, at)).alias("bucket"), "pos").groupBy("chrom", "bucket").agg(F.collect_list("pos").alias("p2"))
    # a site's bucket and as many after it hold all that may follow it
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("p1") - 1) / DEALT).cast("int")), lambda i: F.slice("p1", i * DEALT + 1, DEALT))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = first.join(second, ["chrom", "bucket"]).select("chrom", F.explode(runs).alias("p1"), "p2").repartition(parts)
    return dealt.mapInArrow(partial(digests.low_sites, start=start, bins=LD_BINS, limits=limits), "chrom string, p1 long, p2 long")


def sampled_pairs(matrix: DataFrame, most: int, key: Column, longest: int = 500_000, shortest: int = 100, ample: int = 20, start: str | None = None) -> DataFrame:
    """Of each distance bin the ``most`` pairs with an r squared that are first by ``key``, an md5 of chrom, p1 and p2.

    Only pairs whose key is below a limit are summed up and ranked. The limit is set by how many pairs the bin is
    expected to have, to leave ``ample`` times as many as asked; a bin that is left with too few takes a higher one, all pairs in the end.
    ``start``: what ``key`` has before chrom, p1 and p2; where it is given, and the distances are those of LD_BINS, keys are hashed many at once.
    """
    planes, words = site_planes(matrix)
    planes = planes.persist()
    fast = start is not None and (shortest, longest) == (LD_BINS[0][0], LD_BINS[-1][1])
    near = site_pairs(planes, longest, shortest).withColumn("bin", ld_bin())
    spans = [(r["n"], max(1, r["high"] - r["low"])) for r in planes.groupBy("chrom").agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high")).collect()]
    shares = [min(1.0, ample * most / max(1.0, sum(n * n * (high - low) / span for n, span in spans))) for low, high in LD_BINS]
    todo, parts = list(range(len(LD_BINS))), []
    while todo:
        if fast:
            low = low_pairs(planes, start, [0 if i not in todo else int(share * 2**32) if share < 1 else 2**32 for i, share in enumerate(shares)])
            own = [c for c in planes.columns if c not in ("chrom", "pos")]
            met = low.join(planes.withColumnRenamed("pos", "p1"), ["chrom", "p1"]).join(planes.select("chrom", F.col("pos").alias("p2"), *[F.col(c).alias(f"y{c}") for c in own]), ["chrom", "p2"])
        else:
            limit = F.lit("g")  # beyond any hexadecimal digit
            for i, share in enumerate(shares):
                if share < 1:
                    limit = F.when(F.col("bin") == i, f"{int(share * 2**32):08x}").otherwise(limit)
            met = near.filter(F.col("bin").isin(todo) & (key < limit))
        drawn = r2_of(pair_sums(met, words)).filter("r2 is not null").withColumn("bin", ld_bin()).persist()
        found = {r["bin"]: r["count"] for r in drawn.groupBy("bin").count().collect()}
        few = [i for i in todo if shares[i] < 1 and found.get(i, 0) < most]
        parts.append(drawn.filter(~F.col("bin").isin(few)) if few else drawn)
        shares = [min(1.0, share * 16) if i in few else share for i, share in enumerate(shares)]
        todo = few
    drawn = reduce(DataFrame.unionByName, parts)
    return drawn.withColumn("rn", F.row_number().over(Window.partitionBy("bin").orderBy(key))).filter(F.col("rn") <= most).drop("bin", "rn")


def ld_decay(pairs: DataFrame) -> DataFrame:
    """Mean r squared and pairs for each distance bin."""
    return pairs.filter("r2 is not null").groupBy(ld_bin().alias("bin")).agg(F.count("*").alias("pairs"), F.round(F.avg("r2"), 6).alias("mean_r2"))


def gram(matrix: DataFrame) -> DataFrame:
    """Inner products of samples over centred dosages: s1 <= s2, g, n. A missing call is the site's mean, so 0, and needs no row."""
    mean = matrix.groupBy("chrom", "pos").agg(F.avg("dosage").alias("mean"))
    centred = matrix.join(mean, ["chrom", "pos"]).withColumn("c", F.col("dosage") - F.col("mean")).select("chrom", "pos", "sample", "c")
    other = centred.select("chrom", "pos", F.col("sample").alias("s2"), F.col("c").alias("c2"))
    both = centred.withColumnRenamed("sample", "s1").join(other, ["chrom", "pos"]).filter("s1 <= s2")
    return both.groupBy("s1", "s2").agg(F.sum(F.col("c") * F.col("c2")).alias("g"), F.count("*").alias("n"))


def pca(matrix: DataFrame, k: int = 2) -> DataFrame:
    """Scores of each sample on the first ``k`` components and their share of variance, as mean-imputed PCA gives them.

    The cluster makes the Gram matrix; the driver solves it, samples by samples. No component
    where fewer than ``k`` sites vary.
    """
    rows = gram(matrix).collect()
    names = sorted({r["s1"] for r in rows})
    at = {s: i for i, s in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    for r in rows:
        g[at[r["s1"]], at[r["s2"]]] = g[at[r["s2"]], at[r["s1"]]] = r["g"]
    values, vectors = np.linalg.eigh(g) if names else (np.zeros(0), np.zeros((0, 0)))
    first = np.argsort(-values)[:k]
    total = float(np.trace(g))
    out = []
    if len(first) == k and total > 1e-9 and values[first[-1]] > 1e-9:
        for i, s in enumerate(names):
            for c, j in enumerate(first):
                out.append((s, c + 1, float(vectors[i, j] * np.sqrt(values[j])), float(values[j] / total)))
    return matrix.sparkSession.createDataFrame(out, "sample string, component int, score double, explained double")


def pca_gates(matrix: DataFrame, samples: int = 3, sites: int = 10) -> DataFrame:
    """Whether a PCA makes sense: enough samples, enough sites, enough of them that vary."""
    each = matrix.groupBy("chrom", "pos").agg((F.min("dosage") != F.max("dosage")).cast("long").alias("varies"))
    one = each.agg(F.count("*").alias("n_sites"), F.coalesce(F.sum("varies"), F.lit(0)).cast("long").alias("n_varying")).crossJoin(matrix.agg(F.countDistinct("sample").alias("n_samples")))
    return one.withColumn("status", F.when(F.col("n_samples") < samples, "too_few_samples").when(F.col("n_sites") < sites, "too_few_variants").when(F.col("n_varying") < sites, "too_few_after_pruning").otherwise("ok"))
