"""Catalogues, overlays, ploidy, persons, noise, truth, scans and quality control."""

from pyspark.sql import functions as F

from ..functions import annotation as N
from ..functions import genotype as G
from ..functions import variant as V
from ..operators import catalogue as C
from ..operators import person as P
from ..operators import scan as S
from ..operators import summary as A
from ..sources import adapters as D
from .base import CALLS, CATALOGUE, ORD, PEOPLE, SITES, md5, par, plan, uniform

WANTED = ["Pathogenic", "Likely_pathogenic"]
HAS = "(contains(clnsig, 'athogenic'))"
SPLIT = "SELECT * REPLACE (unnest(string_split(alt, ',')) AS alt)"
PLAIN = "length(ref) <= 50 AND length(alt) <= 50 AND alt NOT LIKE '<%' AND alt NOT IN ('.', '')"
CLEAN = "translate(clnsig, ';= ', ',__') AS clnsig, translate(clndn, ';= ', ',__') AS clndn"


@plan(f"""WITH {SITES}, {CATALOGUE}, k AS (SELECT chrom, pos, ref, alt, max(ord) AS ord FROM cat GROUP BY ALL), l AS (SELECT cat.* FROM cat JOIN k USING (chrom, pos, ref, alt, ord))
    SELECT s.site, s.chrom, s.pos, s.ref, s.alt, CASE WHEN s.id = '.' AND l.id IS NOT NULL AND l.id <> '.' THEN l.id ELSE s.id END AS id, l.clnsig, l.ord IS NOT NULL AS annotated FROM sites s LEFT JOIN l ON s.chrom = l.chrom AND s.pos = l.pos AND s.ref = l.ref AND s.alt = l.alt""")
def annotate_catalogue(spark, sf_dir):
    return C.annotate(D.sites(spark, sf_dir), D.catalogue(spark, sf_dir))


@plan(f"WITH {SITES}, {CATALOGUE}, k AS (SELECT DISTINCT chrom, pos, ref, alt FROM cat) SELECT s.chrom, count(*) AS n_sites, count(k.pos) AS n_annotated FROM sites s LEFT JOIN k USING (chrom, pos, ref, alt) GROUP BY s.chrom")
def annotation_count(spark, sf_dir):
    return annotate_catalogue(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n_sites"), A.count_if(F.col("annotated")).alias("n_annotated"))


@plan(f"WITH {CATALOGUE}, x AS ({SPLIT} FROM cat WHERE {HAS}) SELECT ord, chrom, pos, ref, alt, {CLEAN} FROM x WHERE {PLAIN}")
def catalogue_filtered(spark, sf_dir):
    return C.load(D.catalogue(spark, sf_dir), WANTED).select("ord", "chrom", "pos", "ref", "alt", "clnsig", "clndn")


@plan(f"WITH {CATALOGUE}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos, ord) AS rn FROM cat), x AS ({SPLIT} FROM r WHERE rn <= 20 AND {HAS}) SELECT ord, chrom, pos, ref, alt, {CLEAN} FROM x WHERE {PLAIN}")
def catalogue_first_n(spark, sf_dir):
    return C.load(D.catalogue(spark, sf_dir), WANTED, most=20).select("ord", "chrom", "pos", "ref", "alt", "clnsig", "clndn")


@plan(f"""WITH {CATALOGUE}, i AS (SELECT *, coalesce(CASE WHEN id LIKE 'rs%' THEN string_split(id, ';')[1] WHEN regexp_full_match(id, '[0-9]+') THEN 'rs' || id END,
        CASE WHEN info_rs LIKE 'rs%' THEN string_split(info_rs, ',')[1] WHEN info_rs IS NOT NULL THEN 'rs' || string_split(info_rs, ',')[1] END) AS rsid FROM cat),
    x AS ({SPLIT} FROM i WHERE rsid IS NOT NULL) SELECT chrom, pos, ref, alt, rsid, ord FROM x WHERE {PLAIN}""")
def rsid_pool(spark, sf_dir):
    return C.rsid_pool(D.catalogue(spark, sf_dir))


@plan(f"""WITH {CATALOGUE}, f AS (SELECT *, p_size % 3 AS source, p_size / 50.0 AS af FROM cat), g AS (SELECT * FROM f WHERE af >= 0.2 AND {PLAIN}),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {md5(5, 'background', 'chrom', 'pos', 'ord')}, ord) AS rn FROM g) SELECT CAST(source AS BIGINT) AS source, ord, chrom, pos FROM r WHERE rn <= 40""")
def background_pool(spark, sf_dir):
    rows = D.catalogue(spark, sf_dir).withColumns({"source": (F.col("p_size") % 3).cast("long"), "af": F.col("p_size") / 50.0})
    return C.background_pool(rows, "source", "af", 0.2, 40, seed=5).select("source", "ord", "chrom", "pos")


def overlay_cte(name: str, pool: str, density: float, reserved: str | None = None) -> str:
    free = f"SELECT site, chrom FROM sites {f'WHERE site NOT IN (SELECT site FROM {reserved})' if reserved else ''}"
    return f"""{name}_n AS (SELECT chrom, pos, min(ord) AS ord FROM {pool} WHERE (chrom, pos) NOT IN (SELECT (chrom, pos) FROM sites) GROUP BY 1, 2),
        {name}_u AS (SELECT n.chrom, n.pos, n.ord, min(struct_pack(ref := p.ref, alt := p.alt, tag := p.tag)) AS r FROM {name}_n n JOIN {pool} p ON p.chrom = n.chrom AND p.pos = n.pos AND p.ord = n.ord GROUP BY 1, 2, 3),
        {name}_b AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY {md5(3, name, 'pos', 'ord')}, pos, ord) AS rn FROM {name}_u),
        {name}_a AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY {md5(3, name, 'site')}, site) AS rn FROM ({free})),
        {name}_t AS (SELECT chrom, greatest(1, floor(count(*) * {density} + 0.5)) AS target FROM sites GROUP BY chrom),
        {name} AS (SELECT a.site, a.chrom, b.pos, b.r.ref AS ref, b.r.alt AS alt, b.r.tag AS tag FROM {name}_a a JOIN {name}_b b ON a.chrom = b.chrom AND a.rn = b.rn JOIN {name}_t t ON t.chrom = a.chrom WHERE a.rn <= t.target)"""


POOLS = f"""pc AS (SELECT ord, chrom, pos, ref, alt, clnsig AS tag FROM ({SPLIT} FROM cat WHERE {HAS}) WHERE {PLAIN}),
    pr AS (SELECT ord, chrom, pos, ref, alt, 'rs' || CAST(ord AS VARCHAR) AS tag FROM ({SPLIT} FROM cat WHERE ord % 4 = 0) WHERE {PLAIN}),
    pk AS (SELECT ord, chrom, pos, ref, alt, 'COSV' || CAST(ord AS VARCHAR) AS tag FROM ({SPLIT} FROM cat WHERE ord % 7 = 0) WHERE {PLAIN})"""


def pools(spark, sf_dir):
    own = C.split_alts(D.catalogue(spark, sf_dir)).filter(N.short_plain_alleles(F.col("ref"), F.col("alt")))
    cut = lambda test, tag: own.filter(test).select("ord", "chrom", "pos", "ref", "alt", tag.alias("tag"))
    number = F.col("ord").cast("string")
    return cut(N.has_term(F.col("clnsig"), WANTED), F.col("clnsig")), cut(F.col("ord") % 4 == 0, F.concat(F.lit("rs"), number)), cut(F.col("ord") % 7 == 0, F.concat(F.lit("COSV"), number))


@plan(f"WITH {SITES}, {CATALOGUE}, {POOLS}, {overlay_cte('clinvar', 'pc', 0.1)} SELECT * FROM clinvar")
def overlay_plan_clinvar(spark, sf_dir):
    return C.plan_overlay(D.sites(spark, sf_dir), pools(spark, sf_dir)[0], 0.1, 3, "clinvar")


@plan(f"""WITH {SITES}, {CATALOGUE}, {POOLS}, {overlay_cte('clinvar', 'pc', 0.01)}, {overlay_cte('rsid', 'pr', 0.2, 'clinvar')}, taken AS (SELECT site FROM clinvar UNION ALL SELECT site FROM rsid), {overlay_cte('cosmic', 'pk', 0.005, 'taken')}
    SELECT *, 'clinvar' AS overlay FROM clinvar UNION ALL SELECT *, 'rsid' FROM rsid UNION ALL SELECT *, 'cosmic' FROM cosmic""")
def overlay_plan_chain(spark, sf_dir):
    c, r, k = pools(spark, sf_dir)
    return C.plan_chain(D.sites(spark, sf_dir), [("clinvar", c, 0.01), ("rsid", r, 0.2), ("cosmic", k, 0.005)], seed=3)


@plan(f"WITH {CALLS} SELECT chrom, {par()} AS in_par, count(*) AS n FROM calls GROUP BY 1, 2")
def par_lookup(spark, sf_dir):
    return D.calls(spark, sf_dir).groupBy("chrom", V.in_par("GRCh38", F.col("chrom"), F.col("pos")).alias("in_par")).agg(F.count("*").alias("n"))


@plan(f"""WITH {SITES} SELECT site, pos, CASE WHEN pos BETWEEN 60001 AND 2699520 THEN pos - 60001 + 10001 WHEN pos BETWEEN 154931044 AND 155260560 THEN pos - 154931044 + 59034050 END AS y_pos FROM sites WHERE chrom = 'X'""")
def par_translate(spark, sf_dir):
    return D.sites(spark, sf_dir).filter("chrom = 'X'").select("site", "pos", V.par_x_to_y("GRCh37", F.col("pos")).alias("y_pos"))


PLOIDY = f"CASE WHEN chrom = 'MT' THEN 1 WHEN chrom = 'X' THEN CASE WHEN sex = 'f' OR {par()} THEN 2 ELSE 1 END WHEN chrom = 'Y' THEN CASE WHEN sex = 'f' THEN 0 WHEN {par()} THEN 2 ELSE 1 END ELSE 2 END"


@plan(f"WITH {CALLS}, {PEOPLE} SELECT sex, chrom, CAST({PLOIDY} AS INTEGER) AS ploidy, count(*) AS n FROM calls JOIN people USING (sample) GROUP BY ALL")
def ploidy_matrix(spark, sf_dir):
    c = D.calls(spark, sf_dir).join(D.people(spark, sf_dir), "sample")
    return c.groupBy("sex", "chrom", V.ploidy("GRCh38", F.col("chrom"), F.col("pos"), F.col("sex")).alias("ploidy")).agg(F.count("*").alias("n"))


@plan(f"""WITH {CALLS}, {PEOPLE}, p AS (SELECT ord, chrom, pos, {PLOIDY} AS ploidy, calls.gt FROM calls JOIN people USING (sample)), q AS (SELECT *, CASE WHEN ploidy = 1 THEN string_split_regex(gt, '[|/]')[1] ELSE gt END AS g FROM p WHERE ploidy > 0),
    r AS (SELECT *, len(list_filter(string_split_regex(g, '[|/]'), lambda x: x NOT IN ('.', '0'))) AS ac FROM q)
    SELECT ord, chrom, pos, g AS gt, CAST(ac AS BIGINT) AS ac, CAST(ploidy AS BIGINT) AS an, round(CAST(ac AS DOUBLE) / ploidy, 1) AS af FROM r""")
def person_haploid_records(spark, sf_dir):
    return P.haploid_records(D.calls(spark, sf_dir), D.people(spark, sf_dir)).select("ord", "chrom", "pos", "gt", "ac", "an", "af")


@plan(f"""WITH {CALLS}, {PEOPLE}, c AS (SELECT ord, chrom, pos, alt, sex FROM calls JOIN people USING (sample)) SELECT ord, chrom, pos FROM c WHERE NOT (sex = 'm' AND chrom = 'Y' AND {par()})
    UNION ALL SELECT ord, 'Y', CASE WHEN pos BETWEEN 10001 AND 2781479 THEN pos ELSE pos - 155701383 + 56887903 END FROM c WHERE sex = 'm' AND chrom = 'X' AND {par()} AND alt NOT LIKE '<%'""")
def par_mirror(spark, sf_dir):
    return P.par_mirror(D.calls(spark, sf_dir), D.people(spark, sf_dir)).select("ord", "chrom", "pos")


@plan(f"""WITH {SITES}, {PEOPLE}, s AS (SELECT chrom, pos, ref, alt, CASE WHEN site % 3 = 0 THEN NULL ELSE (site % 10) / 10.0 END AS af FROM sites WHERE chrom = 'MT')
    SELECT sample, lineage, chrom, pos, ref, alt, CASE WHEN {uniform(1, 'mt', 'lineage', 'pos')} < coalesce(af, 0.1) THEN '1' ELSE '0' END AS gt FROM people, s""")
def mt_lineage_calls(spark, sf_dir):
    s = D.sites(spark, sf_dir).withColumn("af", F.when(F.col("site") % 3 != 0, F.col("site") % 10 / 10.0))
    return P.mt_calls(s, D.people(spark, sf_dir))


@plan(f"WITH {CALLS} SELECT sample, ord, chrom, pos, gt FROM calls WHERE gt <> '0|0' OR chrom = 'MT'")
def person_records(spark, sf_dir):
    return P.person_records(D.calls(spark, sf_dir)).select("sample", "ord", "chrom", "pos", "gt")


@plan(f"""WITH {CALLS}, n AS (SELECT *, CAST(substr(sample, 2) AS BIGINT) AS person FROM calls) SELECT site, ord, person * 2 AS hap, 1 AS allele FROM n WHERE gt IN ('1|0', '1|1') UNION ALL SELECT site, ord, person * 2 + 1, 1 FROM n WHERE gt IN ('0|1', '1|1')""")
def carriers_sparse(spark, sf_dir):
    return P.carriers(D.calls(spark, sf_dir))


@plan(f"WITH {CALLS} SELECT site, ord, CAST(substr(sample, 2) AS BIGINT) AS person, CASE WHEN gt = './.' THEN '0|0' ELSE gt END AS gt FROM calls")
def dense_roundtrip(spark, sf_dir):
    c, keys = P.numbered(D.calls(spark, sf_dir).select("site", "ord", "sample", "gt")), ("site", "ord", "twin")
    return P.dense(P.carriers(c, keys), c.select(*keys, F.substring("sample", 2, 10).cast("long").alias("person")), keys).drop("twin")


@plan(f"""WITH {CALLS}, g AS (SELECT *, CASE WHEN is_high THEN 'HIGHLIGHTED' WHEN has_clnsig THEN 'CLINVAR' WHEN has_cosmic THEN 'COSMIC' WHEN is_sv THEN 'SV' WHEN id LIKE 'rs%' THEN 'RSID' END AS flag FROM calls WHERE gt <> '0|0')
    SELECT sample, chrom, pos - 1 AS "start", pos - 1 + length(ref) AS "end", 'flag=' || flag || ';id=' || id || ';ref=' || ref || ';alt=' || alt || ';gt=' || gt || CASE WHEN has_clnsig THEN ';clnsig=Pathogenic' ELSE '' END
        || CASE WHEN has_cosmic THEN ';cosmic_id=COSV' || CAST(site AS VARCHAR) ELSE '' END || CASE WHEN is_sv THEN ';svtype=' || substr(alt, 2, 3) ELSE '' END AS payload FROM g WHERE flag IS NOT NULL""")
def golden_bed(spark, sf_dir):
    return P.golden_bed(D.calls(spark, sf_dir).filter("gt != '0|0'"))


NOISE = f"""u AS (SELECT *, CASE WHEN {uniform(9, 'dropout', 'sample', 'ord')} < 0.01 THEN 'dropout' WHEN {uniform(9, 'flip', 'sample', 'ord')} < 0.02 AND gt <> './.' THEN 'flip' END AS noise, {uniform(9, 'to', 'sample', 'ord')} AS v FROM calls),
    noisy AS (SELECT *, CASE WHEN noise = 'dropout' THEN './.' WHEN noise = 'flip' THEN CASE WHEN gt = '0|0' THEN CASE WHEN v < 0.7 THEN '0|1' ELSE '1|1' END WHEN gt = '1|1' THEN CASE WHEN v < 0.7 THEN '0|1' ELSE '0|0' END
        ELSE CASE WHEN v < 0.5 THEN '0|0' ELSE '1|1' END END ELSE gt END AS new_gt FROM u)"""


def noisy(spark, sf_dir):
    return P.with_noise(D.calls(spark, sf_dir), seed=9, flip=0.02, dropout=0.01)


@plan(f"WITH {CALLS}, {NOISE} SELECT sample, ord, gt AS true_gt, new_gt AS gt, noise, CASE WHEN noise = 'dropout' THEN 0 ELSE dp END AS dp FROM noisy")
def noise_model(spark, sf_dir):
    return noisy(spark, sf_dir).select("sample", "ord", "true_gt", "gt", "noise", "dp")


@plan(f"""WITH {CALLS}, {NOISE} SELECT sample, chrom, pos - 1 AS "start", pos - 1 + length(ref) AS "end", 'flag=' || upper(noise) || ';id=' || id || ';ref=' || ref || ';alt=' || alt || ';truth_gt=' || gt || ';called_gt=' || new_gt AS payload FROM noisy WHERE noise IS NOT NULL""")
def noise_bed(spark, sf_dir):
    return P.noise_bed(noisy(spark, sf_dir))


@plan(f"WITH {CALLS}, {NOISE}, s AS (SELECT count(*) FILTER (noise = 'flip') AS flipped, count(*) FILTER (noise = 'dropout') AS dropped, count(*) AS total FROM noisy) SELECT *, round(CAST(flipped + dropped AS DOUBLE) / total, 6) AS fdr FROM s")
def realised_fdr(spark, sf_dir):
    return P.false_discovery(noisy(spark, sf_dir))


#: Wanted variants, so that every status comes up: name, chrom, pos, ref, alt, least and most frequency.
ROWS = [("in_range", "chr6", 39596, "C", "T", 0.0, 1.0), ("other_alt", "6", 39596, "C", "G", 0.0, 1.0), ("no_record", "15", 4999999, "A", "G", 0.0, 1.0), ("no_chrom", "chr99", 1, "A", "G", 0.0, 1.0),
        ("below", "6", 39596, "C", "T", 0.9, 1.0), ("above", "6", 39596, "C", "T", 0.0, 0.01), ("second", "7", 47515, "G", "A", 0.05, 0.9)]
TARGETS = "targets(name, t_chrom, t_pos, t_ref, t_alt, min_af, max_af) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{d}', '{e}', {f}::DOUBLE, {g}::DOUBLE)" for a, b, c, d, e, f, g in ROWS) + ")"
SCAN = f"""{TARGETS}, b AS (SELECT *, regexp_replace(t_chrom, '^chr', '') AS bare FROM targets), m AS (SELECT c.*, b.name, c.ref = b.t_ref AND c.alt = b.t_alt AS same FROM calls c JOIN b ON c.chrom = b.bare AND c.pos = b.t_pos),
    f AS (SELECT file, name, count(*) AS n_there, count(*) FILTER (same) AS n_same, arg_min(af, ord) FILTER (same) AS told, sum(CASE WHEN same THEN dd END) AS ac, sum(CASE WHEN same AND d IS NOT NULL THEN 2 WHEN same THEN 0 END) AS an,
        count(*) FILTER (same AND dd = 1) AS n_het, count(*) FILTER (same AND dd = 2) AS n_hom, count(*) FILTER (same AND dd >= 1) AS n_carriers FROM m GROUP BY 1, 2),
    x AS (SELECT n.file, b.name, h.chrom, f.* EXCLUDE (file, name), b.min_af, b.max_af, round(coalesce(told, CAST(ac AS DOUBLE) / nullif(an, 0)), 6) AS af FROM (SELECT DISTINCT file FROM calls) n CROSS JOIN b
        LEFT JOIN (SELECT DISTINCT file, chrom FROM calls) h ON h.file = n.file AND h.chrom = b.bare LEFT JOIN f ON f.file = n.file AND f.name = b.name),
    sc AS (SELECT file, name, CASE WHEN chrom IS NULL THEN 'not_applicable' WHEN n_there IS NULL THEN 'position_empty' WHEN n_same = 0 THEN 'absent' WHEN af IS NULL THEN 'present_af_unknown' WHEN af < min_af THEN 'present_below_threshold'
        WHEN af > max_af THEN 'present_above_threshold' ELSE 'present_in_range' END AS status, af, coalesce(n_same, 0) AS n_same, coalesce(n_carriers, 0) AS n_carriers, coalesce(n_het, 0) AS n_het, coalesce(n_hom, 0) AS n_hom FROM x),
    ca AS (SELECT name, file, sample, id AS variant_id, chrom, pos, ref, alt, gt AS genotype, CAST(dd AS BIGINT) AS alt_dosage FROM m WHERE same AND dd >= 1)"""
REPORT = "count(*) AS n_rows, count(DISTINCT sample) AS n_samples, count(*) FILTER (alt_dosage = 1) AS n_het, count(*) FILTER (alt_dosage = 2) AS n_hom, count(DISTINCT file) AS n_files, count(*) FILTER (alt_dosage = 1) + 2 * count(*) FILTER (alt_dosage = 2) AS alleles"


def targets(spark):
    return spark.createDataFrame(ROWS, "name string, t_chrom string, t_pos long, t_ref string, t_alt string, min_af double, max_af double")


@plan(f"WITH {CALLS}, {SCAN} SELECT * FROM sc")
def variant_scan(spark, sf_dir):
    return S.variant_scan(D.calls(spark, sf_dir), targets(spark))


@plan(f"WITH {CALLS}, {SCAN} SELECT status, count(*) AS n FROM sc GROUP BY status")
def variant_status_counts(spark, sf_dir):
    return S.status_counts(variant_scan(spark, sf_dir))


@plan(f"WITH {CALLS}, {SCAN} SELECT * FROM ca")
def carriers(spark, sf_dir):
    return S.carriers(D.calls(spark, sf_dir), targets(spark))


@plan(f"WITH {CALLS}, {SCAN} SELECT {REPORT} FROM ca")
def carrier_report(spark, sf_dir):
    return S.carrier_report(carriers(spark, sf_dir))


@plan(f"WITH {CALLS}, {SCAN} SELECT file, {REPORT} FROM ca GROUP BY file")
def carrier_per_file(spark, sf_dir):
    return S.carrier_report(carriers(spark, sf_dir).withColumnRenamed("file", "f").withColumn("file", F.col("f")), "f").withColumnRenamed("f", "file")


@plan(f"WITH {CALLS}, {SCAN}, {PEOPLE} SELECT super_pop, count(*) AS n FROM ca LEFT JOIN people USING (sample) GROUP BY 1")
def carriers_by_super_pop(spark, sf_dir):
    return carriers(spark, sf_dir).join(D.people(spark, sf_dir), "sample", "left").groupBy("super_pop").agg(F.count("*").alias("n"))


ACAN = "sum(dd)::BIGINT AS ac, (2 * count(d))::BIGINT AS an, round(CAST(sum(dd) AS DOUBLE) / nullif(2 * count(d), 0), 6) AS af"


@plan(f"WITH {CALLS}, {PEOPLE} SELECT chrom, pos, super_pop, {ACAN} FROM calls JOIN people USING (sample) GROUP BY 1, 2, 3")
def pop_af(spark, sf_dir):
    c = D.calls(spark, sf_dir).join(D.people(spark, sf_dir).select("sample", "super_pop"), "sample")
    return A.allele_counts(c, "chrom", "pos", "super_pop")


@plan(f"WITH {CALLS} SELECT chrom, pos, ref, alt, {ACAN} FROM calls GROUP BY 1, 2, 3, 4")
def ac_an_af_recompute(spark, sf_dir):
    return A.allele_counts(D.calls(spark, sf_dir), "chrom", "pos", "ref", "alt")


@plan(f"WITH {CALLS}, n AS (SELECT 2 * count(DISTINCT sample) AS an FROM calls) SELECT chrom, pos, ref, alt, 'AC=' || CAST(sum(dd) AS VARCHAR) || ';AN=' || CAST(an AS VARCHAR) AS info, round(CAST(sum(dd) AS DOUBLE) / an, 6) AS af FROM calls, n GROUP BY chrom, pos, ref, alt, an")
def cohort_info(spark, sf_dir):
    c = D.calls(spark, sf_dir)
    size = c.agg((2 * F.countDistinct("sample")).alias("an"))
    out = A.allele_counts(c, "chrom", "pos", "ref", "alt").drop("an", "af").crossJoin(F.broadcast(size))
    return out.select("chrom", "pos", "ref", "alt", F.concat(F.lit("AC="), F.col("ac").cast("string"), F.lit(";AN="), F.col("an").cast("string")).alias("info"), A.ratio(F.col("ac"), F.col("an")).alias("af"))


@plan(f"WITH {CALLS} SELECT sample, ord, gt, CAST(dd AS BIGINT) AS dosage FROM calls WHERE chrom = '6' AND pos BETWEEN 39596 AND 39596 AND ref = 'C'")
def single_variant_extract(spark, sf_dir):
    return D.calls(spark, sf_dir).filter("chrom = '6' AND pos BETWEEN 39596 AND 39596 AND ref = 'C'").select("sample", "ord", "gt", G.first_alt_dosage(F.col("gt")).cast("long").alias("dosage"))


@plan(f"WITH {CALLS} SELECT 'chr' || chrom AS label, count(*) AS n, count(DISTINCT file) AS files FROM calls GROUP BY 1")
def union_files(spark, sf_dir):
    c = D.calls(spark, sf_dir).select("file", "chrom")
    parts = [c.filter(F.col("file") == f) for f in ("A", "N", "R")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy(F.concat(F.lit("chr"), V.bare_chrom(F.col("chrom"))).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@plan(f"""WITH {CALLS}, w(chrom, length) AS (VALUES ('chr1', 4000000), ('2', 9000000), ('chrX', 100), ('99', 5)), t AS (SELECT chrom AS c, max(pos) AS there_length FROM calls GROUP BY 1)
    SELECT w.chrom, CAST(length AS BIGINT) AS length, there_length, CASE WHEN there_length IS NULL THEN 'missing' WHEN there_length < length THEN 'too_short' ELSE 'ok' END AS status FROM w LEFT JOIN t ON t.c = regexp_replace(w.chrom, '^chr', '')""")
def contig_coverage_check(spark, sf_dir):
    wanted = spark.createDataFrame([("chr1", 4000000), ("2", 9000000), ("chrX", 100), ("99", 5)], "chrom string, length long")
    return S.contig_coverage(wanted, D.calls(spark, sf_dir).groupBy("chrom").agg(F.max("pos").alias("there_length")))


def qc_files(spark, sf_dir):
    """One made-up file for each part, whose fields vary so that every rule comes up."""
    p, k = D.table(spark, sf_dir, "part"), F.col("p_partkey")
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return p.select(
        k.alias("file"), (k % 17 != 0).alias("exists"), F.when(k % 19 == 0, 0).otherwise(k).cast("long").alias("size_bytes"), (k % 5 != 0).alias("indexed"), (k % 23 != 0).alias("header_ok"), (k % 29 != 0).alias("chrom_line"),
        F.when(k % 7 == 0, strings()).otherwise(strings("P1", "P2")).alias("samples"), F.when(k % 3 == 0, "hs37d5.fa").when(k % 3 == 1, "GRCh38_full").otherwise("mm10").alias("reference"),
        F.when(k % 4 == 0, strings("AC", "AN")).when(k % 4 == 1, strings("AF")).otherwise(strings("DP")).alias("info_ids"), (k % 11 != 0).alias("has_gt"),
        F.when(k % 13 == 0, strings()).when(k % 13 == 1, strings("scaffold")).when(k % 13 == 2, strings("chr1", "scaffold")).otherwise(strings("1", "X")).alias("contigs"), F.when(k % 31 == 0, 0).otherwise(k).cast("long").alias("n_variants"),
        F.when(k % 2 == 0, strings("1")).otherwise(strings()).alias("overlong"),
    )


QC = """q0 AS (SELECT p_partkey AS k, p_partkey % 17 = 0 AS gone, p_partkey % 17 <> 0 AND p_partkey % 19 = 0 AS empty FROM part), q1 AS (SELECT *, NOT gone AND NOT empty AS there, NOT gone AND NOT empty AND k % 23 <> 0 AS readable FROM q0),
    q2 AS (SELECT *, list_filter([CASE WHEN gone THEN 'file does not exist' END, CASE WHEN empty THEN 'file is empty' END, CASE WHEN there AND k % 5 = 0 THEN 'missing tabix index' END, CASE WHEN there AND k % 23 = 0 THEN 'cannot read header' END,
        CASE WHEN readable AND k % 29 = 0 THEN 'header has no #CHROM line' END, CASE WHEN readable AND k % 29 <> 0 AND k % 7 = 0 THEN '#CHROM line has no sample columns' END, CASE WHEN readable AND k % 13 = 0 THEN 'no contigs found in index' END,
        CASE WHEN readable AND k % 31 = 0 THEN 'file contains zero variant records' END], lambda x: x IS NOT NULL) AS errors FROM q1),
    q3 AS (SELECT *, list_filter([CASE WHEN readable AND k % 3 = 2 THEN 'reference does not match any recognised human build' END, CASE WHEN readable AND k % 13 = 1 THEN 'no indexed contigs match human chromosome names' END,
        CASE WHEN readable AND k % 13 = 2 THEN 'non-human contigs: scaffold' END, CASE WHEN readable AND k % 11 = 0 THEN 'header does not declare FORMAT=GT' END, CASE WHEN readable AND k % 4 >= 2 THEN 'header declares neither AF nor AC+AN' END,
        CASE WHEN readable AND k % 13 <> 0 AND len(errors) = 0 AND k % 2 = 0 THEN 'positions past 300 Mb: 1' END], lambda x: x IS NOT NULL) AS warnings, CASE WHEN readable THEN CASE k % 3 WHEN 0 THEN 'GRCh37' WHEN 1 THEN 'GRCh38' END END AS reference_build FROM q2)"""


@plan(f"WITH {QC} SELECT k AS file, array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings, len(errors) = 0 AS pass, reference_build FROM q3")
def qc_rules(spark, sf_dir):
    return S.qc(qc_files(spark, sf_dir)).select("file", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "pass", "reference_build")


@plan(f"WITH {QC} SELECT count(*) AS total, count(*) FILTER (len(errors) = 0) AS passed, count(*) FILTER (len(errors) > 0) AS failed, count(*) FILTER (len(warnings) > 0) AS with_warnings, count(*) FILTER (len(errors) = 0 AND len(warnings) > 0) AS passed_with_warnings FROM q3")
def qc_report(spark, sf_dir):
    return S.qc_report(S.qc(qc_files(spark, sf_dir)))


@plan(f"WITH {CALLS} SELECT file, chrom, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, CAST(max(CASE WHEN pos > 300000000 THEN 1 ELSE 0 END) AS BIGINT) AS overlong FROM calls GROUP BY 1, 2")
def qc_contigs(spark, sf_dir):
    return S.contig_stats(D.calls(spark, sf_dir))


META = """me AS (SELECT file, count(*) AS n_variants, array_to_string(list_sort(list(DISTINCT chrom)), ',') AS contigs, count(DISTINCT sample) AS n_samples, md5(array_to_string(list_sort(list(DISTINCT sample)), chr(10))) AS sample_hash,
    'cohort_phase3_v5_20130502.' || lower(file) || '.vcf.gz' AS file_name, 'phase3_v5_20130502' AS pipeline_tag, '20130502' AS date_stamp FROM calls GROUP BY file)"""


@plan(f"WITH {CALLS}, {META} SELECT * FROM me")
def inspect_metadata(spark, sf_dir):
    named = F.concat(F.lit("cohort_phase3_v5_20130502."), F.lower("file"), F.lit(".vcf.gz"))
    return S.metadata(D.calls(spark, sf_dir).withColumn("file_name", named))


@plan(f"""WITH {CALLS}, {META}, c AS (SELECT DISTINCT unnest(string_split(contigs, ',')) AS c FROM me) SELECT count(*) AS files, sum(n_variants)::BIGINT AS n_variants, false AS partial,
    (SELECT string_agg(c, ',' ORDER BY length(c), c) FROM c) AS contigs, count(DISTINCT sample_hash) AS sample_sets FROM me""")
def metadata_report(spark, sf_dir):
    return S.metadata_report(inspect_metadata(spark, sf_dir))


@plan(f"WITH {CALLS} SELECT ord, {ORD.format(c='chrom')} AS o, chrom || ' ' || CAST(pos AS VARCHAR) || ' ' || id || ' ' || ref || ' ' || alt || ' ' || gt AS line FROM calls")
def contig_sorted_export(spark, sf_dir):
    c = D.calls(spark, sf_dir).withColumn("o", V.chrom_order(F.col("chrom")).cast("long"))
    return c.orderBy("o", "pos", "ord").select("ord", "o", F.concat_ws(" ", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", "gt").alias("line"))


@plan(f"WITH {CATALOGUE} SELECT ord, translate(clndn, ';= ', ',__') AS clean, ('category=' || p_size || ';text=' || translate(clndn, ';', ',')) AS payload, string_split_regex(clnsig, '[|,] ?')[1] AS first_term, CASE WHEN p_retailprice < 1024 THEN printf('%.1f B', p_retailprice) ELSE printf('%.1f KB', p_retailprice / 1024) END AS size FROM cat")
def text_fields(spark, sf_dir):
    c = D.catalogue(spark, sf_dir)
    return c.select("ord", N.sanitised(F.col("clndn")).alias("clean"), N.payload(category=F.col("p_size"), text=F.col("clndn")).alias("payload"), N.terms(F.col("clnsig"))[0].alias("first_term"), N.human_size(F.col("p_retailprice")).alias("size"))
