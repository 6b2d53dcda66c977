"""Cohort statistics."""

from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions import variant as V
from ..functions.annotation import info_flag, info_told, info_value
from ..operators import matrix as M
from ..operators import segments as S
from ..operators import summary as A
from ..sources import adapters as D
from ..sources import vcf
from .base import BASE, CALLS, COUNTERS, ORD, PEOPLE, SEGMENTS, SITES, par, plan

RATIO = "round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 6)"
TITV = RATIO.format(a="n_ti", b="n_tv")


@plan(f"""WITH {CALLS}, s AS (SELECT sample, {COUNTERS}, count(*) FILTER (dd = 1) AS n_singleton, count(*) FILTER (id LIKE 'rs%') AS n_rsid, count(*) FILTER (has_clnsig) AS n_clinvar,
    count(*) FILTER (has_cosmic) AS n_cosmic, count(*) FILTER (is_high) AS n_highlight, count(*) FILTER (chrom = 'Y') AS n_y, count(*) FILTER (chrom = 'Y' AND NOT {par()}) AS n_y_non_par,
    count(*) FILTER (chrom = 'Y' AND NOT {par()} AND d = 1) AS n_y_non_par_het, count(*) FILTER (chrom = 'MT') AS n_mt, count(*) FILTER (chrom = 'MT' AND d = 1) AS n_mt_het FROM calls GROUP BY sample)
    SELECT *, {TITV} AS titv, {RATIO.format(a="n_het", b="n_hom_alt")} AS het_hom FROM s""")
def sample_summary(spark, sf_dir):
    return A.sample_summary(D.calls(spark, sf_dir))


@plan(f"""WITH {CALLS}, r AS (SELECT *, unnest(CASE WHEN site % 53 = 0 THEN [0, 1] ELSE [0] END) AS i FROM calls WHERE site % 211 <> 0)
    SELECT ord, chrom, pos, id, ref, CAST(i AS INTEGER) AS i, CASE WHEN i = 1 THEN 'T' ELSE alt END AS alt, gt, CASE WHEN site % 61 = 0 THEN 0 ELSE dp END AS dp, gq, ad_ref,
        CASE WHEN i = 1 THEN 3 ELSE ad_alt END AS ad_alt, CAST(dd AS VARCHAR) AS ac, CASE dd WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS af, is_high AS highlighted, has_clnsig FROM r""")
def scan_records_split_alt(spark, sf_dir):
    out = vcf.parse_records(D.vcf_lines(spark, sf_dir))
    t = F.col("info_text")
    return out.select("ord", "chrom", "pos", "id", "ref", F.col("i").cast("int").alias("i"), "alt", "gt", "dp", "gq", "ad_ref", "ad_alt", info_value(t, "AC").alias("ac"), info_value(t, "AF").try_cast("double").alias("af"), info_flag(t, "HIGHLIGHT").alias("highlighted"), info_told(t, "CLNSIG").alias("has_clnsig"))


@plan(f"WITH {CALLS} SELECT class AS variant_class, is_ti, count(*) AS n FROM calls GROUP BY ALL")
def classify_variants(spark, sf_dir):
    c = D.calls(spark, sf_dir)
    return c.groupBy(V.variant_class(F.col("ref"), F.col("alt")).alias("variant_class"), V.is_transition(F.col("ref"), F.col("alt")).alias("is_ti")).agg(F.count("*").alias("n"))


GTS = "['0|0','0/1','1|0','1|1','1|2','./.','.|1','0','1','2|2','10|0','11|1','0/0','1/1','']"


@plan(f"""WITH {CALLS}, g AS (SELECT ord, ({GTS})[ord % 15 + 1] AS gt FROM calls), a AS (SELECT *, string_split(replace(gt, '/', '|'), '|') AS al FROM g),
    b AS (SELECT *, CASE WHEN NOT contains(gt, '.') AND len(al) = 2 THEN CAST(al[1] <> '0' AS BIGINT) + CAST(al[2] <> '0' AS BIGINT) END AS d FROM a)
    SELECT gt, count(*) AS n, sum(d)::BIGINT AS dosage, count(*) FILTER (NOT contains(gt, '.') AND len(al) = 2 AND al[1] <> al[2]) AS het, count(*) FILTER (contains(gt, '.')) AS dropout,
        sum(CASE WHEN gt IN ('0|0', '0/0') THEN 0 WHEN gt IN ('0|1', '1|0', '0/1', '1/0') THEN 1 WHEN gt IN ('1|1', '1/1') THEN 2 END)::BIGINT AS strict, sum(length(gt) - length(replace(gt, '1', '')))::BIGINT AS ones,
        sum(len(list_filter(al, lambda x: x = '1')))::BIGINT AS first_alt, sum(len(list_filter(al, lambda x: TRY_CAST(x AS INTEGER) >= 1)))::BIGINT AS total_alt,
        sum(len(list_filter(string_split(gt, '|'), lambda x: x = '1')))::BIGINT AS alt_1, sum(len(list_filter(string_split(gt, '|'), lambda x: x = '2')))::BIGINT AS alt_2 FROM b GROUP BY gt""")
def gt_dosage_variants(spark, sf_dir):
    names = ["0|0", "0/1", "1|0", "1|1", "1|2", "./.", ".|1", "0", "1", "2|2", "10|0", "11|1", "0/0", "1/1", ""]
    c = D.calls(spark, sf_dir).select(F.element_at(F.array(*map(F.lit, names)), (F.col("ord") % 15 + 1).cast("int")).alias("gt"))
    gt, long = F.col("gt"), lambda x: F.sum(x).cast("long")
    each = G.alt_dosages(gt, F.lit(2))
    return c.groupBy("gt").agg(F.count("*").alias("n"), long(G.dosage(gt)).alias("dosage"), A.count_if(G.is_het(gt)).alias("het"), A.count_if(G.is_dropout(gt)).alias("dropout"), long(G.strict_dosage(gt)).alias("strict"), long(G.ones_dosage(gt)).alias("ones"), long(G.first_alt_dosage(gt)).alias("first_alt"), long(G.total_alt_dosage(gt)).alias("total_alt"), long(each[0]).alias("alt_1"), long(each[1]).alias("alt_2"))


@plan(f"WITH {CALLS} SELECT sample, chrom, {COUNTERS} FROM calls GROUP BY sample, chrom")
def sample_chrom_buckets(spark, sf_dir):
    return A.chrom_buckets(D.calls(spark, sf_dir), "sample", "chrom")


@plan(f"WITH {CALLS}, s AS (SELECT {COUNTERS} FROM calls) SELECT n_ti, n_tv, {TITV} AS titv, coalesce({TITV} BETWEEN 2.0 AND 2.2, false) AS in_band FROM s")
def cohort_titv(spark, sf_dir):
    return A.cohort_titv(D.calls(spark, sf_dir))


@plan(f"""WITH {CALLS}, s AS (SELECT file, count(*) FILTER (length(alt) = 1 AND is_ti) AS n_ti, count(*) FILTER (length(alt) = 1 AND NOT is_ti AND ref <> alt) AS n_tv FROM calls GROUP BY file) SELECT *, {TITV} AS titv FROM s""")
def titv_pairs(spark, sf_dir):
    return A.titv_pairs(D.calls(spark, sf_dir), "file")


@plan(f"WITH {CALLS}, s AS (SELECT chrom, {COUNTERS} FROM calls GROUP BY chrom) SELECT *, {TITV} AS titv, {ORD.format(c='chrom')} AS ord FROM s")
def chrom_stats(spark, sf_dir):
    return A.chrom_stats(D.calls(spark, sf_dir))


@plan(f"""WITH {CALLS} SELECT file, chrom, count(*) AS n_records, count(*) FILTER (d = 1) AS n_het, count(*) FILTER (d = 2) AS n_hom_alt, CAST(grouping(file, chrom) AS BIGINT) AS level,
    {RATIO.format(a="count(*) FILTER (d = 1)", b="count(*) FILTER (d = 2)")} AS het_hom FROM calls GROUP BY ROLLUP (file, chrom)""")
def cohort_rollup(spark, sf_dir):
    return A.cohort_rollup(D.calls(spark, sf_dir))


@plan(f"WITH {CALLS}, h AS (SELECT least(CAST(floor(af * 10) AS BIGINT), 9) AS bin, count(*) AS n FROM calls GROUP BY 1) SELECT r.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN h USING (bin)")
def af_histogram(spark, sf_dir):
    return A.af_histogram(D.calls(spark, sf_dir))


DELETIONS = f"SELECT substr('ACGT', p_partkey % 4 + 1, 1) || substr('GGGGG', 1, p_size % 5 + 1) AS ref, substr('ACGT', p_partkey % 4 + 1, 1) AS alt FROM part WHERE p_partkey % 20 = 11"


@plan(f"WITH {CALLS}, x AS (SELECT ref, alt FROM calls WHERE class = 'indel' UNION ALL {DELETIONS}) SELECT CAST(length(alt) - length(ref) AS BIGINT) AS len, count(*) AS n FROM x GROUP BY 1")
def indel_length_hist(spark, sf_dir):
    parts = D.table(spark, sf_dir, "part").filter("p_partkey % 20 = 11")
    gone = parts.selectExpr("concat(substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1), substr('GGGGG', 1, p_size % 5 + 1)) AS ref", "substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS alt")
    return A.indel_lengths(D.calls(spark, sf_dir).select("ref", "alt").unionByName(gone))


@plan(f"WITH {CALLS} SELECT substr(alt, 2, 3) AS svtype, count(*) AS n FROM calls WHERE is_sv GROUP BY 1")
def sv_type_counts(spark, sf_dir):
    return A.sv_types(D.calls(spark, sf_dir))


@plan(f"WITH {CALLS} SELECT chrom, CAST((pos - 1) // 1000000 AS BIGINT) AS bin, count(*) AS n FROM calls GROUP BY 1, 2")
def region_density(spark, sf_dir):
    return A.region_density(D.calls(spark, sf_dir))


@plan(f"""WITH {CALLS}, r AS (SELECT chrom, (pos - 1) // 1000000 AS bin, count(*) AS n FROM calls GROUP BY 1, 2)
    SELECT chrom, count(*) AS bins, round(avg(n), 6) AS mean, max(n) AS max, round(coalesce(stddev_samp(n), 0) / avg(n), 6) AS cv FROM r GROUP BY chrom""")
def region_density_cv(spark, sf_dir):
    return A.density_summary(A.region_density(D.calls(spark, sf_dir)))


OVERLAYS = f"""o AS (SELECT 'rsid' AS overlay, count(*) FILTER (id LIKE 'rs%') AS n, count(*) AS total FROM calls UNION ALL SELECT 'clinvar', count(*) FILTER (has_clnsig), count(*) FROM calls
    UNION ALL SELECT 'cosmic', count(*) FILTER (has_cosmic), count(*) FROM calls)"""


@plan(f"WITH {CALLS}, {OVERLAYS} SELECT overlay, n, total, {RATIO.format(a='n', b='total')} AS fraction FROM o")
def overlay_density(spark, sf_dir):
    return A.overlay_density(D.calls(spark, sf_dir))


@plan(f"""WITH {CALLS}, {OVERLAYS}, q(overlay, requested) AS (VALUES ('rsid', 0.2::DOUBLE), ('clinvar', 0.01::DOUBLE), ('custom', 0.5::DOUBLE))
    SELECT coalesce(o.overlay, q.overlay) AS overlay, requested, {RATIO.format(a='n', b='total')} AS realised FROM o FULL JOIN q ON o.overlay = q.overlay""")
def overlay_requested_vs_realised(spark, sf_dir):
    wanted = spark.createDataFrame([("rsid", 0.2), ("clinvar", 0.01), ("custom", 0.5)], "overlay string, requested double")
    return A.overlay_density(D.calls(spark, sf_dir)).join(wanted, "overlay", "full_outer").select("overlay", "requested", F.col("fraction").alias("realised"))


def quality_sql(source: str) -> str:
    return f"""m AS (SELECT 'dp' AS metric, CAST(dp AS DOUBLE) AS v FROM {source} UNION ALL SELECT 'gq', gq FROM {source} UNION ALL
        SELECT 'ad_ref_fraction', CAST(ad_ref AS DOUBLE) / (ad_ref + ad_alt) FROM {source} WHERE d = 1 AND ad_ref + ad_alt > 0)
        SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90 FROM m GROUP BY metric"""


@plan(f"WITH {CALLS}, {quality_sql('calls')}")
def quality_metrics(spark, sf_dir):
    return A.quality_metrics(D.calls(spark, sf_dir))


@plan(f"WITH {CALLS}, f AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY {ORD.format(c='chrom')}, chrom, pos, ord, dp, gt) AS rn FROM calls), g AS (SELECT * FROM f WHERE rn <= 50), {quality_sql('g')}")
def quality_metrics_first_n(spark, sf_dir):
    return A.quality_metrics(D.calls(spark, sf_dir), cap=50)


@plan(f"""WITH {CALLS}, s AS (SELECT ord, gt, dp, CASE WHEN gt = './.' OR gt = '0|0' THEN CAST(ad_ref AS DOUBLE) / dp WHEN gt = '1|1' THEN CAST(ad_alt AS DOUBLE) / dp
        ELSE (1 - 2 * abs(CAST(ad_ref AS DOUBLE) / (ad_ref + ad_alt) - 0.5)) * (ad_ref + ad_alt) / dp END AS support FROM calls WHERE dp > 0)
    SELECT ord, CAST(least(greatest(round_even(least(-10 * log10(greatest(1 - support, 1e-10)), 60 * log10(dp)) + 1e-9, 0), 0), 99) AS BIGINT) AS gq_new FROM s""")
def gq_from_ad(spark, sf_dir):
    return D.calls(spark, sf_dir).filter("dp > 0").select("ord", G.genotype_quality(F.col("gt"), F.col("dp"), F.col("ad_ref"), F.col("ad_alt")).cast("long").alias("gq_new"))


GM = "gm AS (SELECT sample, chrom, pos, max(d) AS dosage FROM calls WHERE d IS NOT NULL GROUP BY ALL)"


@plan(f"WITH {CALLS}, {GM} SELECT sample, chrom, pos, CAST(dosage AS BIGINT) AS dosage FROM gm")
def genotype_matrix_coo(spark, sf_dir):
    return M.genotype_matrix(D.calls(spark, sf_dir))


@plan(f"WITH {CALLS}, {GM}, r AS (SELECT *, dense_rank() OVER (PARTITION BY sample ORDER BY chrom, pos) AS r FROM gm) SELECT sample, chrom, pos, CAST(dosage AS BIGINT) AS dosage FROM r WHERE r <= 20")
def matrix_first_n_sites(spark, sf_dir):
    return M.first_sites(M.genotype_matrix(D.calls(spark, sf_dir), G.strict_dosage), 20)


FST = f"""{GM}, p AS (SELECT chrom, pos, CAST(sum(dosage) AS DOUBLE) / (2 * count(*)) AS p FROM gm GROUP BY 1, 2),
    f0 AS (SELECT sample, count(*) AS n_sites, count(*) FILTER (dosage = 1) AS obs_het, round(sum(2 * p * (1 - p)), 6) AS exp_het FROM gm JOIN p USING (chrom, pos) GROUP BY sample),
    f AS (SELECT *, round(1 - obs_het / nullif(exp_het, 0), 6) AS f FROM f0)"""


@plan(f"WITH {CALLS}, {FST} SELECT * FROM f")
def f_statistic(spark, sf_dir):
    return M.f_statistic(M.genotype_matrix(D.calls(spark, sf_dir)))


@plan(f"WITH {CALLS}, {FST} SELECT count(f) AS n, round(avg(f), 6) AS mean, round(median(f), 6) AS median FROM f")
def f_statistic_cohort(spark, sf_dir):
    return M.f_statistic(M.genotype_matrix(D.calls(spark, sf_dir))).agg(F.count("f").alias("n"), F.round(F.avg("f"), 6).alias("mean"), F.round(F.median("f"), 6).alias("median"))


@plan(f"WITH {CALLS}, {FST} SELECT chrom, count(*) AS n_sites, round(sum(2 * p * (1 - p)), 6) AS exp_het FROM p GROUP BY chrom")
def expected_het(spark, sf_dir):
    m = M.genotype_matrix(D.calls(spark, sf_dir)).groupBy("chrom", "pos").agg((F.sum("dosage") / (2 * F.count("*"))).alias("p"))
    return m.groupBy("chrom").agg(F.count("*").alias("n_sites"), F.round(F.sum(2 * F.col("p") * (1 - F.col("p"))), 6).alias("exp_het"))


LD = f"""{GM}, lp AS (SELECT a.chrom, a.pos AS p1, b.pos AS p2, count(*) AS n, sum(a.dosage) AS sx, sum(b.dosage) AS sy, sum(a.dosage * a.dosage) AS sxx, sum(b.dosage * b.dosage) AS syy, sum(a.dosage * b.dosage) AS sxy
    FROM gm a JOIN gm b ON a.chrom = b.chrom AND a.sample = b.sample AND b.pos - a.pos >= 100 AND b.pos - a.pos < 500000 GROUP BY 1, 2, 3 HAVING count(*) >= 4),
    ld AS (SELECT chrom, p1, p2, n, CAST((n * sxy - sx * sy) * (n * sxy - sx * sy) AS DOUBLE) / nullif(CAST((n * sxx - sx * sx) * (n * syy - sy * sy) AS DOUBLE), 0) AS r2 FROM lp)"""
BINS = "CASE " + " ".join(f"WHEN p2 - p1 >= {a} AND p2 - p1 < {b} THEN {i}" for i, (a, b) in enumerate(M.LD_BINS)) + " END"


@plan(f"WITH {CALLS}, {LD} SELECT chrom, p1, p2, n, round(r2, 6) AS r2 FROM ld")
def ld_pairs_r2(spark, sf_dir):
    return M.pair_r2(M.called_cells(D.calls(spark, sf_dir))).withColumn("r2", F.round("r2", 6))


@plan(f"WITH {CALLS}, {LD} SELECT CAST({BINS} AS BIGINT) AS bin, count(*) AS pairs, round(avg(r2), 6) AS mean_r2 FROM ld WHERE r2 IS NOT NULL GROUP BY 1")
def ld_decay(spark, sf_dir):
    return M.ld_decay(M.pair_r2(M.called_cells(D.calls(spark, sf_dir))))


@plan(f"""WITH {CALLS}, {LD}, q AS (SELECT *, {BINS} AS bin FROM ld WHERE r2 IS NOT NULL), s AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('7:ld:' || chrom || ':' || CAST(p1 AS VARCHAR) || ':' || CAST(p2 AS VARCHAR))) AS rn FROM q)
    SELECT CAST(bin AS BIGINT) AS bin, count(*) AS pairs, round(avg(r2), 6) AS mean_r2 FROM s WHERE rn <= 200 GROUP BY 1""")
def ld_decay_sampled(spark, sf_dir):
    """Of each bin 200 pairs, drawn by hash order, as the sampled form of the statistic asks."""
    from ..functions import draws

    key = draws.order_key(7, "ld", F.col("chrom"), F.col("p1"), F.col("p2"))
    return M.ld_decay(M.sampled_pairs(M.called_cells(D.calls(spark, sf_dir)), 200, key, start="7:ld"))


@plan(f"""WITH {CALLS}, {GM}, mu AS (SELECT chrom, pos, avg(dosage) AS mean FROM gm GROUP BY 1, 2), c AS (SELECT chrom, pos, sample, dosage - mean AS c FROM gm JOIN mu USING (chrom, pos))
    SELECT a.sample AS s1, b.sample AS s2, round(sum(a.c * b.c), 4) + 0.0 AS g, count(*) AS n FROM c a JOIN c b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample <= b.sample GROUP BY 1, 2""")
def pca_gram(spark, sf_dir):
    return M.gram(M.genotype_matrix(D.calls(spark, sf_dir))).withColumn("g", F.round("g", 4) + F.lit(0.0))


@plan(f"""WITH {CALLS}, {GM}, e AS (SELECT chrom, pos, min(dosage) <> max(dosage) AS v FROM gm GROUP BY 1, 2), o AS (SELECT count(*) AS n_sites, count(*) FILTER (v) AS n_varying FROM e)
    SELECT n_sites, n_varying, (SELECT count(DISTINCT sample) FROM gm) AS n_samples, CASE WHEN n_sites < 10 THEN 'too_few_variants' WHEN n_varying < 10 THEN 'too_few_after_pruning' ELSE 'ok' END AS status FROM o""")
def pca_gate_status(spark, sf_dir):
    return M.pca_gates(M.genotype_matrix(D.calls(spark, sf_dir), G.strict_dosage))


@plan()
def pca_scores(spark, sf_dir):
    out = M.pca(M.genotype_matrix(D.calls(spark, sf_dir)))
    return out.select("sample", "component", F.round(F.abs("score"), 4).alias("abs_score"), F.round("explained", 6).alias("explained"))


HAPS = """h AS (SELECT person, chrom, "start", "end", 1 AS hap, hap1_pop AS pop FROM segments UNION ALL SELECT person, chrom, "start", "end", 2, hap2_pop FROM segments),
    l AS (SELECT *, coalesce(lag(chrom) OVER w = chrom AND lag(pop) OVER w = pop, false) AS same FROM h WINDOW w AS (PARTITION BY person, hap ORDER BY chrom, "start")),
    i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY person, hap ORDER BY chrom, "start" ROWS UNBOUNDED PRECEDING) AS island FROM l),
    tr AS (SELECT person, CAST(hap AS INTEGER) AS hap, CAST(island AS BIGINT) AS island, min(chrom) AS chrom, min(pop) AS pop, min("start") AS "start", max("end") AS "end" FROM i GROUP BY 1, 2, 3)"""


@plan(f"WITH {SEGMENTS}, {HAPS} SELECT * FROM tr")
def ancestry_tracts(spark, sf_dir):
    return S.tracts(D.segments(spark, sf_dir))


@plan(f"""WITH {SEGMENTS}, {HAPS} SELECT pop, count(*) AS n, round(avg("end" - "start"), 6) AS mean, CAST(floor(median("end" - "start")) AS BIGINT) AS median FROM tr GROUP BY pop""")
def tract_stats(spark, sf_dir):
    return S.tract_stats(S.tracts(D.segments(spark, sf_dir)))


@plan(f"""WITH {SEGMENTS}, l AS (SELECT *, coalesce(lag("end") OVER w = "start" AND lag(hap1_pop) OVER w = hap1_pop AND lag(hap2_pop) OVER w = hap2_pop, false) AS same FROM segments WINDOW w AS (PARTITION BY person, chrom ORDER BY "start")),
    i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY person, chrom ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS island FROM l)
    SELECT person, chrom, min("start") AS "start", max("end") AS "end", min(hap1_pop) AS hap1_pop, min(hap2_pop) AS hap2_pop FROM i GROUP BY person, chrom, island""")
def segment_merge(spark, sf_dir):
    return S.merge_adjacent(D.segments(spark, sf_dir))


@plan(f"""WITH {SEGMENTS}, a AS (SELECT person, chrom, "start" AS s, "end" AS e, hap1_pop AS p FROM segments), b AS (SELECT person, chrom, "start" + 3000 AS s, "end" + 7000 AS e, hap2_pop AS p FROM segments)
    SELECT a.person, a.chrom, greatest(a.s, b.s) AS "start", least(a.e, b.e) AS "end", a.p AS hap1_pop, b.p AS hap2_pop FROM a JOIN b ON a.person = b.person AND a.chrom = b.chrom AND a.s < b.e AND b.s < a.e""")
def segment_intersect(spark, sf_dir):
    s = D.segments(spark, sf_dir)
    a = s.select("person", "chrom", "start", "end", F.col("hap1_pop").alias("pop"))
    b = s.select("person", "chrom", (F.col("start") + 3000).alias("start"), (F.col("end") + 7000).alias("end"), F.col("hap2_pop").alias("pop"))
    return S.intersect(a, b)


FRACTIONS = """fr AS (SELECT person, pop, sum(bp)::BIGINT AS bp FROM (SELECT person, hap1_pop AS pop, "end" - "start" AS bp FROM segments UNION ALL SELECT person, hap2_pop, "end" - "start" FROM segments
        UNION ALL SELECT DISTINCT person, p, 0 FROM segments, (VALUES ('EUR'), ('SAS'), ('AFR')) x(p)) GROUP BY 1, 2),
    fx AS (SELECT person, pop, bp, round(CAST(bp AS DOUBLE) / sum(bp) OVER (PARTITION BY person), 6) AS fraction FROM fr)"""


@plan(f"WITH {SEGMENTS}, {FRACTIONS} SELECT * FROM fx")
def ancestry_fractions(spark, sf_dir):
    return S.ancestry_fractions(D.segments(spark, sf_dir))


@plan(f"WITH {SEGMENTS}, {FRACTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY bp DESC, pop) AS rn FROM fx) SELECT person, pop || '-dominant' AS label FROM r WHERE rn = 1")
def dominant_ancestry(spark, sf_dir):
    return S.dominant(S.ancestry_fractions(D.segments(spark, sf_dir)))


AC = "ac AS (SELECT chrom, pos, ref, alt, sum(dd)::BIGINT AS ac, (2 * count(d))::BIGINT AS an FROM calls GROUP BY ALL)"


@plan(f"WITH {CALLS}, {AC} SELECT ac, count(*) AS n_sites FROM ac WHERE ac > 0 GROUP BY ac")
def sfs_histogram(spark, sf_dir):
    return A.sfs(A.allele_counts(D.calls(spark, sf_dir), "chrom", "pos", "ref", "alt").select(F.array("ac").alias("acs")))


@plan(f"WITH {CALLS}, {AC}, s AS (SELECT count(*) FILTER (ac = 1) AS n_singleton, count(*) AS n_total FROM ac WHERE ac > 0) SELECT *, {RATIO.format(a='n_singleton', b='n_total')} AS fraction FROM s")
def singleton_fraction(spark, sf_dir):
    return A.singleton_fraction(sfs_histogram(spark, sf_dir))


@plan(f"""WITH {SITES}, f AS (SELECT *, {BASE.format(p='pos - 1')} AS l, {BASE.format(p='pos + 1')} AS r FROM sites WHERE length(alt) = 1),
    g AS (SELECT CASE WHEN l = 'N' OR r = 'N' THEN NULL WHEN ref IN ('A', 'G') THEN translate(r, 'ACGT', 'TGCA') || '[' || translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA') || ']' || translate(l, 'ACGT', 'TGCA')
        ELSE l || '[' || ref || '>' || alt || ']' || r END AS channel FROM f),
    dims AS (SELECT a || '[' || s || ']' || b AS channel, si * 16 + (instr('ACGT', a) - 1) * 4 + instr('ACGT', b) - 1 AS i
        FROM (VALUES ('A'), ('C'), ('G'), ('T')) x(a), (VALUES ('A'), ('C'), ('G'), ('T')) y(b), (VALUES ('C>A', 0), ('C>G', 1), ('C>T', 2), ('T>A', 3), ('T>C', 4), ('T>G', 5)) z(s, si)),
    n AS (SELECT channel, count(*) AS n FROM g WHERE channel IS NOT NULL GROUP BY 1)
    SELECT d.channel, CAST(d.i AS INTEGER) AS i, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS fraction, (SELECT count(*) FROM g WHERE channel IS NULL) AS n_excluded FROM dims d LEFT JOIN n USING (channel)""")
def mutation_spectrum_96(spark, sf_dir):
    from pyspark.sql import Window

    s = D.sites(spark, sf_dir).filter("length(alt) = 1")
    name = V.channel(D.ref_base(F.col("pos") - 1), F.col("ref"), F.col("alt"), D.ref_base(F.col("pos") + 1))
    counted = s.groupBy(name.alias("channel")).agg(F.count("*").alias("n"))
    dims = spark.createDataFrame([(c,) for c in V.all_channels()], "channel string")
    out = dims.join(F.broadcast(counted), "channel", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    excluded = counted.filter("channel is null").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_excluded"))
    return out.crossJoin(F.broadcast(excluded)).select("channel", V.channel_index(F.col("channel")).alias("i"), "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("fraction"), "n_excluded")


@plan(f"WITH {CALLS} SELECT file, count(*) AS n, count(*) FILTER (ref <> {BASE.format(p='pos')}) AS mismatched FROM calls GROUP BY file")
def ref_check(spark, sf_dir):
    """Records by file whose REF isn't the reference's base, which comes from the sequence."""
    met = vcf.with_base(D.calls(spark, sf_dir).select("file", "chrom", "pos", "ref"), D.fasta(spark), "pos", "base")
    return met.groupBy("file").agg(F.count("*").alias("n"), A.count_if(F.col("ref") != F.col("base")).alias("mismatched"))


@plan(f"WITH {SITES} SELECT site, {BASE.format(p='pos - 1')} AS l, {BASE.format(p='pos + 1')} AS r FROM sites WHERE length(alt) = 1 AND pos > 1")
def flank_lookup(spark, sf_dir):
    """The bases beside each SNV, from the sequence."""
    s = D.sites(spark, sf_dir).filter("length(alt) = 1 AND pos > 1").select("site", "chrom", F.col("pos") - 1, F.col("pos") + 1).toDF("site", "chrom", "before", "after")
    left = vcf.with_base(s, D.fasta(spark), "before", "l")
    return vcf.with_base(left, D.fasta(spark), "after", "r").select("site", "l", "r")


@plan(f"""WITH {CALLS}, {PEOPLE}, s AS (SELECT coalesce(sum(CASE WHEN sex = 'm' THEN ny END), 0) AS a, coalesce(sum(CASE WHEN sex = 'm' THEN nyh END), 0) AS b, count(DISTINCT CASE WHEN sex = 'f' THEN c.sample END) AS c,
        coalesce(sum(CASE WHEN sex = 'f' THEN nya END), 0) AS d, sum(nmt) AS e, sum(nmth) AS g FROM (SELECT sample, CASE WHEN chrom = 'Y' AND NOT {par()} THEN 1 ELSE 0 END AS ny, CASE WHEN chrom = 'Y' AND NOT {par()} AND d = 1 THEN 1 ELSE 0 END AS nyh,
        CASE WHEN chrom = 'Y' THEN 1 ELSE 0 END AS nya, CASE WHEN chrom = 'MT' THEN 1 ELSE 0 END AS nmt, CASE WHEN chrom = 'MT' AND d = 1 THEN 1 ELSE 0 END AS nmth FROM calls) c LEFT JOIN people USING (sample)),
    l AS (SELECT 'y_het_in_males' AS gate, a AS seen, b AS wrong FROM s UNION ALL SELECT 'female_y_absence', c, d FROM s UNION ALL SELECT 'mt_no_heterozygous', e, g FROM s)
    SELECT gate, seen::BIGINT AS seen, wrong::BIGINT AS wrong, CASE WHEN seen = 0 THEN 'skipped' WHEN wrong = 0 THEN 'pass' ELSE 'fail' END AS status FROM l""")
def sex_chrom_gates(spark, sf_dir):
    return A.sex_gates(D.calls(spark, sf_dir), D.people(spark, sf_dir))


@plan(f"WITH {CALLS} SELECT ref, alt, count(*) AS n FROM calls WHERE length(alt) = 1 AND ref <> alt GROUP BY ref, alt")
def stats_substitution_types(spark, sf_dir):
    return A.substitution_types(D.calls(spark, sf_dir))


@plan(f"WITH {CALLS}, s AS (SELECT file, sample, {COUNTERS} FROM calls GROUP BY file, sample) SELECT *, {TITV} AS titv FROM s")
def stats_per_sample(spark, sf_dir):
    out = A.chrom_buckets(D.calls(spark, sf_dir), "file", "sample")
    return out.withColumn("titv", A.ratio(F.col("n_ti"), F.col("n_tv")))


