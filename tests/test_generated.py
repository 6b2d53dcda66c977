"""Generators over whole tables, against plain Python."""

import hashlib
import os
from pathlib import Path

import pytest

from allelic.plans.catalogue import QUERIES
from allelic.plans.generated import SEED

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def md5(*key):
    return hashlib.md5(":".join(map(str, (SEED, *key))).encode()).hexdigest()


def uniform(*key):
    return int(md5(*key)[:8], 16) / 2**32


@pytest.fixture(scope="module")
def sites(spark):
    return sorted(r[0] for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey").collect())


def test_every_site_gets_slots(spark, sites):
    total, want = sum(k**-2.0 for k in range(1, 200)), set()
    for site in sites:
        u, run, ac = uniform("sfs", site), 0.0, 0
        while ac == 0 or u >= run / total and ac < 199:
            ac += 1
            run += ac**-2.0
        want.update((site, hap) for hap in sorted(range(200), key=lambda h: md5("slot", site, h))[:ac])
    got = [tuple(r) for r in QUERIES["haplotype_slots"](spark, str(DATA)).select("site", "hap").collect()]
    assert len(got) == len(want) and set(got) == want
    assert {site for site, _ in got} == set(sites)


def test_every_site_gets_genotypes(spark, sites):
    got = {(r["sample"], r["site"]): r["gt"] for r in QUERIES["hwe_gt_draw"](spark, str(DATA)).collect()}
    samples = sorted({sample for sample, _ in got})
    assert samples == sorted({f"P{r[0] % 100}" for r in spark.read.parquet(f"{DATA}/supplier.parquet").select("s_suppkey").collect()})
    one = lambda h, sample, site: "1" if uniform(h, sample, site) < site % 100 / 100 else "0"
    assert got == {(p, s): f"{one('h1', p, s)}|{one('h2', p, s)}" for p in samples for s in sites}
