"""Seeded generators and order-dependent operators."""

from pyspark.sql import functions as F

from ..functions import draws
from ..operators import catalogue as C
from ..operators import generate as G
from ..sources import adapters as D
from ..sources import vcf
from ..streaming import emit
from .base import BASE, CALLS, CATALOGUE, PEOPLE, SITES, md5, par, plan, uniform
from .variants import HAS, PLAIN, WANTED

SEED = 11


@plan(f"""WITH {PEOPLE}, r AS (SELECT sample, i FROM people, (SELECT unnest(range(5)) AS i)), u AS (SELECT *, {uniform(SEED, 'type', 'sample', 'i')} AS ut,
        CAST(floor(exp(ln(50) + {uniform(SEED, 'len', 'sample', 'i')} * (ln(10000) - ln(50))) + 1e-9) AS BIGINT) AS len, CAST(floor({uniform(SEED, 'pos', 'sample', 'i')} * (5000000 - 10000)) + 1 AS BIGINT) AS pos, {uniform(SEED, 'gt', 'sample', 'i')} AS ug FROM r)
    SELECT sample, i, CASE WHEN ut < 0.5 THEN 'DEL' WHEN ut < 0.8 THEN 'DUP' ELSE 'INV' END AS svtype, pos, pos + len AS "end", CASE WHEN ut < 0.5 THEN -len ELSE len END AS svlen, CASE WHEN ug < 0.8 THEN '0|1' ELSE '1|1' END AS gt, CAST(-50 AS BIGINT) AS cipos_lo, CAST(50 AS BIGINT) AS cipos_hi FROM u""")
def sv_generate(spark, sf_dir):
    return G.structural_variants(D.people(spark, sf_dir), 5, 5_000_000, SEED)


WEIGHTS = "w AS (SELECT k, sum(1.0::DOUBLE / (k * k)) OVER (ORDER BY k) / (SELECT sum(1.0::DOUBLE / (k * k)) FROM range(1, 200) t(k)) AS high FROM range(1, 200) t(k))"
DRAWN = f"{WEIGHTS}, dr AS (SELECT site, coalesce((SELECT min(k) FROM w WHERE u + 1e-12 < high), 199) AS ac FROM (SELECT site, {uniform(SEED, 'sfs', 'site')} AS u FROM sites))"


@plan(f"WITH {SITES}, {DRAWN} SELECT site, ac FROM dr")
def sfs_draw(spark, sf_dir):
    return G.draw_allele_counts(D.sites(spark, sf_dir), 200, SEED)


@plan(f"""WITH {SITES} SELECT site, ref, CASE WHEN {uniform(SEED, 'titv', 'site')} < 2.1::DOUBLE / 3.1::DOUBLE THEN translate(ref, 'ACGT', 'GTAC') WHEN {uniform(SEED, 'tv', 'site')} < 0.5 THEN translate(ref, 'ACGT', 'CATG') ELSE translate(ref, 'ACGT', 'TGCA') END AS new_alt FROM sites""")
def titv_draw(spark, sf_dir):
    return G.titv_alt(D.sites(spark, sf_dir), SEED).select("site", "ref", "new_alt")


@plan(f"""WITH {SITES}, {DRAWN}, h AS (SELECT site, ac, hap, row_number() OVER (PARTITION BY site ORDER BY {md5(SEED, 'slot', 'site', 'hap')}, hap) AS rn FROM dr, (SELECT unnest(range(200)) AS hap)) SELECT site, hap FROM h WHERE rn <= ac""")
def haplotype_slots(spark, sf_dir):
    return G.haplotype_slots(G.draw_allele_counts(D.sites(spark, sf_dir), 200, SEED), 200, SEED)


@plan("""SELECT i, CASE WHEN x % 2 = 0 THEN 'HG' ELSE 'NA' END || lpad(CAST(x // 2 AS VARCHAR), 7, '0') AS sample FROM (SELECT i, (i * 7368787 + 11 * 104729) % 19800000 AS x FROM range(5000) t(i))""")
def sample_ids(spark, sf_dir):
    return G.sample_ids(spark, 5000, SEED)


@plan(f"WITH {PEOPLE} SELECT sample, CASE WHEN {uniform(SEED, 'sex', 'sample')} < 0.5 THEN 'm' ELSE 'f' END AS sex, CAST(floor({uniform(SEED, 'lineage', 'sample')} * greatest(1, (SELECT count(*) FROM people) // 10)) AS BIGINT) AS lineage FROM people")
def sex_lineage_draw(spark, sf_dir):
    return G.sex_and_lineage(D.people(spark, sf_dir).select("sample"), SEED)


@plan(f"""WITH {PEOPLE}, {SITES} SELECT sample, site, CASE WHEN {uniform(SEED, 'h1', 'sample', 'site')} < (site % 100) / 100.0::DOUBLE THEN '1' ELSE '0' END || '|' || CASE WHEN {uniform(SEED, 'h2', 'sample', 'site')} < (site % 100) / 100.0::DOUBLE THEN '1' ELSE '0' END AS gt
    FROM people, sites""")
def hwe_gt_draw(spark, sf_dir):
    s = D.sites(spark, sf_dir).select("site", (F.col("site") % 100 / 100.0).alias("af"))
    cells = s.crossJoin(F.broadcast(D.people(spark, sf_dir).select("sample")))  # a hundred people at most
    return G.hwe_genotypes(cells, "af", SEED).select("sample", "site", "gt")


def multi_alt_counts(spark, sf_dir):
    """Counts of the catalogue's entries, which list one ALT or several; a ``.`` is none."""
    alts = F.size(F.filter(F.split("alt", ","), lambda a: a != "."))
    entries = D.catalogue(spark, sf_dir).select(F.col("ord").alias("site"), alts.alias("n_alts")).filter("n_alts > 0")
    return G.draw_multi_allele_counts(entries, 200, SEED)


@plan()
def multi_alt_slots(spark, sf_dir):
    return G.multi_haplotype_slots(multi_alt_counts(spark, sf_dir), 200, SEED)


@plan()
def multi_alt_genotypes(spark, sf_dir):
    s = multi_alt_counts(spark, sf_dir).select("site", F.transform("acs", lambda c: c / 200.0).alias("afs"))
    cells = s.crossJoin(F.broadcast(D.people(spark, sf_dir).select("sample")))  # a hundred people at most
    return G.multi_hwe_genotypes(cells, "afs", SEED).select("sample", "site", "gt")


@plan(f"""WITH {CALLS}, l AS (SELECT sample, greatest(5.0::DOUBLE, 30 + 3 * sqrt(-2 * ln(1 - {uniform(SEED, 'depth', 'sample')})) * cos(2 * pi() * {uniform(SEED, 'depth2', 'sample')})) AS mean FROM (SELECT DISTINCT sample FROM calls)),
    h AS (SELECT sample, k, CASE WHEN k = 150 THEN 2.0 ELSE sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY sample ORDER BY k) END AS high FROM l, range(0, 151) t(k)),
    b AS (SELECT sample, k, coalesce(lag(high) OVER (PARTITION BY sample ORDER BY k), 0) AS low, high FROM h),
    d AS (SELECT sample, ord, gt, {uniform(SEED, 'dp', 'sample', 'ord')} AS u FROM calls), e AS (SELECT d.sample, ord, gt, k AS dp FROM d JOIN b ON b.sample = d.sample AND u >= low AND u < high),
    bn AS (SELECT n, p, k, CASE WHEN k = n THEN 2.0 ELSE sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))) OVER (PARTITION BY n, p ORDER BY k) END AS high
        FROM range(0, 151) n(n), (VALUES (0.525::DOUBLE), (1 - 0.525::DOUBLE)) p(p), range(0, 151) k(k) WHERE k <= n),
    bl AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY n, p ORDER BY k), 0) AS low FROM bn),
    g AS (SELECT *, {uniform(SEED, 'reads', 'sample', 'ord')} AS v, CASE gt WHEN '0|1' THEN 0.525::DOUBLE WHEN '1|0' THEN 1 - 0.525::DOUBLE END AS share FROM e),
    x AS (SELECT sample, ord, gt, dp, coalesce(bl.k, CASE gt WHEN '1|1' THEN 0 ELSE dp END) AS first FROM g LEFT JOIN bl ON bl.n = dp AND bl.p = share AND v >= low AND v < high)
    SELECT sample, ord, dp, CASE WHEN gt = '1|0' THEN dp - first ELSE first END::BIGINT AS ad_ref, CASE WHEN gt = '1|0' THEN first ELSE dp - first END::BIGINT AS ad_alt FROM x""")
def dp_ad_draw(spark, sf_dir):
    out = G.read_depths(D.calls(spark, sf_dir), SEED)
    return out.select("sample", "ord", F.col("dp_new").alias("dp"), F.col("ref_new").alias("ad_ref"), F.col("alt_new").alias("ad_alt"))


@plan(f"""WITH {CALLS}, b AS (SELECT ord, chrom, pos // 1000 AS p FROM calls), r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY p, ord) AS rn FROM b)
    SELECT ord, chrom, p, max(p - rn) OVER (PARTITION BY chrom ORDER BY p, ord ROWS UNBOUNDED PRECEDING) + rn AS new_pos FROM r""")
def position_bump(spark, sf_dir):
    rows = D.calls(spark, sf_dir).select("ord", "chrom", F.floor(F.col("pos") / 1000).alias("p"))
    return G.bump(rows, ["chrom"], "p", ["ord"])


@plan(f"WITH {CALLS} SELECT sample, ord, pos, min(pos) OVER (PARTITION BY sample ORDER BY ord, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS min_ahead FROM calls")
def suffix_min(spark, sf_dir):
    return G.suffix_min(D.calls(spark, sf_dir).select("sample", "ord", "pos"), ["sample"], ["ord", "pos"], "pos")


@plan(f"WITH {PEOPLE} SELECT sample, ntile(7) OVER (ORDER BY sample) AS slice FROM people")
def slices_ntile(spark, sf_dir):
    return G.slices(D.people(spark, sf_dir).select("sample"), ["sample"], 7)


SPAN = 100_000_000


@plan(f"""WITH {PEOPLE}, n AS (SELECT sample, hap, len(list_filter({G.poisson_highs(20 * 1e-8 * SPAN)}, lambda h: h <= {uniform(SEED, 'crossovers', 'sample', 'hap')})) AS n FROM people, (VALUES (1), (2)) h(hap)),
    c AS (SELECT sample, hap, i, CASE WHEN i = 0 THEN 0 ELSE CAST(floor({uniform(SEED, 'cut', 'sample', 'hap', 'i')} * {SPAN}) AS BIGINT) END AS "start" FROM (SELECT sample, hap, unnest(range(n + 1)) AS i FROM n)),
    d AS (SELECT sample, hap, "start", min(i) AS i FROM c GROUP BY 1, 2, 3), p AS (SELECT *, {uniform(SEED, 'pop', 'sample', 'hap', 'i')} AS u FROM d)
    SELECT sample, CAST(hap AS BIGINT) AS hap, "start", coalesce(lead("start") OVER (PARTITION BY sample, hap ORDER BY "start"), {SPAN}) AS "end", CASE WHEN u < 0.6::DOUBLE THEN 'EUR' WHEN u < 0.85::DOUBLE THEN 'SAS' ELSE 'AFR' END AS pop FROM p""")
def ancestry_segments_generate(spark, sf_dir):
    return G.ancestry(D.people(spark, sf_dir), SPAN, SEED)


CANDIDATES = f"ca AS (SELECT ord, chrom, pos, ref, alt FROM cat WHERE {HAS} AND {PLAIN} AND alt NOT LIKE '%,%')"


@plan(f"WITH {CATALOGUE}, {CANDIDATES} SELECT * FROM ca")
def highlighted_candidates(spark, sf_dir):
    return C.highlighted(D.catalogue(spark, sf_dir), WANTED).select("ord", "chrom", "pos", "ref", "alt")


@plan(f"""WITH {CATALOGUE}, {CANDIDATES}, {PEOPLE}, k AS (SELECT *, row_number() OVER (PARTITION BY sex ORDER BY ord) AS n, count(*) OVER (PARTITION BY sex) AS most
        FROM ca, (VALUES ('m'), ('f')) s(sex) WHERE chrom <> 'MT' AND NOT (chrom = 'Y' AND (sex = 'f' OR {par()}))),
    t AS (SELECT DISTINCT sex, most FROM k), p AS (SELECT sample, sex, CAST(floor({uniform(SEED, 'highlight', 'sample')} * most) AS BIGINT) + 1 AS n, {uniform(SEED, 'hgt', 'sample')} AS u FROM people JOIN t USING (sex))
    SELECT sample, ord, chrom, pos, ref, alt, CASE WHEN u < 0.7 THEN '0|1' ELSE '1|1' END AS gt FROM p JOIN k USING (sex, n)""")
def highlighted_variant(spark, sf_dir):
    return G.highlighted_variant(D.people(spark, sf_dir), highlighted_candidates(spark, sf_dir), SEED)


@plan(f"""WITH {CALLS}, c AS (SELECT chrom, max(pos) AS length, count(*) AS seed FROM calls GROUP BY chrom), k AS (SELECT *, unnest(range((length - 1) // 600000 + 1)) AS chunk FROM c),
    m AS (SELECT *, (seed + chunk * 2654435769) & 2147483647 AS s, least((chunk + 1) * 600000, length) AS e FROM k)
    SELECT chrom, chunk, chunk * 600000 AS "start", e AS "end", CASE WHEN e >= length THEN e ELSE e + 500000 END AS worked_end, CASE WHEN s = 0 THEN 1 ELSE s END AS chunk_seed FROM m""")
def chunk_plan(spark, sf_dir):
    contigs = D.calls(spark, sf_dir).groupBy("chrom").agg(F.max("pos").alias("length"), F.count("*").alias("seed"))
    return G.chunks(contigs, 600_000)


@plan(f"""WITH {SITES}, b AS (SELECT site, {BASE.format(p='pos')} AS base, CAST(floor({uniform(SEED, 'ref', 'site')} * 4) AS INTEGER) + 1 AS i FROM sites)
    SELECT site, base, CASE WHEN base = 'N' THEN substr('ACGT', i, 1) ELSE base END AS new_ref FROM b""")
def ref_pick(spark, sf_dir):
    own = vcf.with_base(D.sites(spark, sf_dir).select("site", "chrom", "pos"), D.fasta(spark), "pos", "base")
    return G.picked_ref(own, "base", SEED).select("site", "base", "new_ref")


@plan()
def mosaic_haplotypes(spark, sf_dir):
    return G.mosaic_haplotypes(spark, 40, 200, 8, 0.05, SEED)


@plan(f"WITH {SITES} SELECT site, chrom, pos FROM sites")
def streaming_ordered_emit(spark, sf_dir):
    """Sites streamed in from three files and emitted in order; all of them, once."""
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or f"file://{tempfile.mkdtemp()}"
    path = f"{root.rstrip('/')}/emit-{uuid.uuid4().hex}"
    s = D.sites(spark, sf_dir).select("site", "chrom", "pos")
    s.repartitionByRange(3, draws.order_key(SEED, "arrive", F.col("site"))).write.parquet(f"{path}/in")
    emit.ordered_emit(spark, f"{path}/in", s.schema, f"{path}/out", f"{path}/checkpoint", slack=5_000_000)
    return spark.read.parquet(f"{path}/out").select("site", "chrom", "pos")
