"""Sites with several ALT alleles: counts, slots and genotypes against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from allelic.operators import generate

SEED = 5


def md5(*key):
    return hashlib.md5(":".join(map(str, (SEED, *key))).encode()).hexdigest()


def uniform(*key):
    return int(md5(*key)[:8], 16) / 2**32


def counts(site, n_alts, haplotypes, attempts):
    weights = [k**-2.0 for k in range(1, haplotypes)]
    for i in range(attempts):
        us = [uniform("sfs", site, i, alt) for alt in range(1, n_alts + 1)]
        out = [next(k for k in range(1, haplotypes) if k == haplotypes - 1 or u < sum(weights[:k]) / sum(weights)) for u in us]
        if sum(out) < haplotypes:
            return out, i
    while sum(out) >= haplotypes and max(out) > 1:
        out[out.index(max(out))] -= 1
    return out, attempts


def test_a_site_needs_an_alt(spark):
    with pytest.raises(Exception, match="a site without ALT"):
        generate.draw_multi_allele_counts(spark.createDataFrame([(0, 0)], "site long, n_alts int"), 8, SEED).collect()


@pytest.mark.parametrize("haplotypes, attempts", [(200, 50), (8, 50), (8, 2), (8, 1)])
def test_counts(spark, haplotypes, attempts):
    sites = spark.range(300).select(F.col("id").alias("site"), (F.col("id") % 5 + 1).alias("n_alts"))
    got = {r["site"]: r["acs"] for r in generate.draw_multi_allele_counts(sites, haplotypes, SEED, attempts=attempts).collect()}
    want = {s: counts(s, s % 5 + 1, haplotypes, attempts) for s in range(300)}
    assert got == {s: acs for s, (acs, _) in want.items()}
    assert haplotypes > 8 or any(i for _, i in want.values())  # some are drawn again, or shrunk


def test_slots(spark):
    given = [(0, [3, 1, 2]), (1, [1]), (2, [4, 4]), (3, [1, 6])]
    got = generate.multi_haplotype_slots(spark.createDataFrame(given, "site long, acs array<long>"), 8, SEED).collect()
    want = set()
    for site, acs in given:
        haps = sorted(range(8), key=lambda h: md5("slot", site, h))
        want.update((site, haps.pop(0), k) for k, ac in enumerate(acs, 1) for _ in range(ac))
    assert len(got) == len(want) and {(r["site"], r["hap"], r["allele"]) for r in got} == want
    with pytest.raises(Exception, match="more ALT alleles than haplotypes"):
        generate.multi_haplotype_slots(spark.createDataFrame([(0, [5, 4])], "site long, acs array<long>"), 8, SEED).collect()


def test_genotypes(spark):
    afs = {0: [0.2, 0.5], 1: [0.0], 2: [0.3, 0.3, 0.4], 3: [0.1]}
    cells = spark.createDataFrame([(f"P{p}", s, a) for p in range(50) for s, a in afs.items()], "sample string, site long, afs array<double>")

    def one(h, sample, site):
        run, u = 0.0, uniform(h, sample, site)
        for k, f in enumerate(afs[site], 1):
            run += f
            if u < run:
                return k
        return 0

    for r in generate.multi_hwe_genotypes(cells, "afs", SEED).collect():
        assert r["gt"] == f"{one('h1', r['sample'], r['site'])}|{one('h2', r['sample'], r['site'])}"
