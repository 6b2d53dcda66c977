"""Edge cases of single operators on hand-built rows."""

import hashlib
import json
import math
import shutil

import pytest
from pyspark.sql import functions as F

from allelic.functions import annotation as N
from allelic.functions import draws
from allelic.functions import genotype as G
from allelic.functions import variant as V
from allelic.operators import catalogue, generate, matrix, person, report, scan, segments, summary
from allelic.plans.catalogue import QUERIES
from allelic.sources import vcf
from allelic.streaming import emit


def column(spark, kind, values, expr):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_dosage(spark):
    gts = ["0|0", "0/0", "0|1", "1|0", "1|1", "1|2", "./.", ".|.", "./1", "1", "0"]
    gt = F.col("gt")
    assert column(spark, "gt string", ["a|0", "0|", "|1", "2/0", "0|1|1"], G.dosage(gt)) == [None, None, None, 1, None]
    assert column(spark, "gt string", gts, G.dosage(gt)) == [0, 0, 1, 1, 2, 2, None, None, None, None, None]
    assert column(spark, "gt string", gts, G.is_het(gt)) == [False, False, True, True, False, True, False, False, False, False, False]
    assert column(spark, "gt string", gts, G.is_dropout(gt)) == [False] * 6 + [True] * 3 + [False] * 2
    assert column(spark, "gt string", gts, G.strict_dosage(gt)) == [0, 0, 1, 1, 2, None, None, None, None, None, None]
    assert column(spark, "gt string", ["10|0", "11|1", "0|1"], G.ones_dosage(gt)) == [1, 3, 1]
    assert column(spark, "gt string", ["10|0", "1/1", ".|1"], G.first_alt_dosage(gt)) == [0, 2, 1]
    assert column(spark, "gt string", ["1|2", "0|0", "2|2"], G.alt_dosages(gt, F.lit(2))) == [[1, 1], [0, 0], [0, 2]]


def test_variant_class(spark):
    pairs = [("A", "G"), ("A", "AGT"), ("ACGT", "A"), ("A", "<DEL>"), ("A", "<DUP>"), ("A", "<INV>"), ("A", "<INS>"), ("A", ".")]
    assert column(spark, "ref string, alt string", pairs, V.variant_class(F.col("ref"), F.col("alt"))) == ["snv", "indel", "indel", "sv", "sv", "sv", "sv", "snv"]
    assert column(spark, "ref string, alt string", [("a", "G"), ("C", "T"), ("A", "C")], V.is_transition(F.col("ref"), F.col("alt"))) == [True, True, False]


def test_info(spark):
    infos = ["", ".", "AC=1", "AC=1;AN=2;AF=0.5", "HIGHLIGHT;AC=1", "RS=.", None]
    m = N.info_map(F.col("info"))
    assert [len(x) for x in column(spark, "info string", infos, m)] == [0, 0, 1, 3, 2, 1, 0]
    assert column(spark, "info string", infos, N.info_present(m, "HIGHLIGHT")) == [False] * 4 + [True] + [False] * 2
    assert column(spark, "info string", infos, N.info_present(m, "RS")) == [False] * 7


def test_info_with_repeated_keys(spark):
    infos = ["A=1;B=2;A=3", "A;A=x=y;A", "RS=.", "XA=5", None, "B=1;A="]
    m, info = N.info_map(F.col("info")), F.col("info")
    assert [dict(x) for x in column(spark, "info string", infos, m)] == [{"B": "2", "A": "3"}, {"A": None}, {"RS": "."}, {"XA": "5"}, {}, {"B": "1", "A": ""}]
    assert column(spark, "info string", infos, N.info_flag(info, "A")) == [True, True, False, False, False, True]
    assert column(spark, "info string", [infos[0], *infos[2:]], N.info_value(info, "A")) == ["3", None, None, None, ""]
    for key in ("A", "RS", "B"):
        assert column(spark, "info string", infos, N.info_told(info, key)) == column(spark, "info string", infos, N.info_present(m, key))


def test_parsing_of_awkward_lines(spark):
    line = lambda *f: ("\t".join(f),)
    rows = [
        line("1", "7", ".", "A", "G,T", ".", "PASS", "AC=1;AC=2", "GT:AD:GT", "0|1:3,4,5:1|1"), line("1", "x", ".", "A", "G", ".", ".", ".", "GT", "0|1"),
        line("1", "9", ".", "A", "G", ".", ".", ".", "GT:DP:AD", "0|1"), line("1", "9", ".", "A"), line("#CHROM"),
    ]
    got = vcf.parse_records(spark.createDataFrame(rows, "value string")).orderBy("pos", "i").collect()
    assert [(r["pos"], r["alt"], r["gt"], r["dp"], r["ad_ref"], r["ad_alt"]) for r in got] == [(7, "G", "1|1", 0, 3, 4), (7, "T", "1|1", 0, 3, 5), (9, "G", "0|1", 0, 0, 0)]
    assert got[0]["info"] == {"AC": "2"} and got[2]["info"] == {}


def test_truth_rows(spark):
    rows = [
        (1, ".", "A", "G", "0|1", "CLNSIG=."), (2, "rs2", "AC", "G", "0|1", "CLNSIG=.;CLNDN=a"), (3, ".", "A", "<DEL>", "1|1", "SVTYPE=DEL;SVLEN=-50;END=53"),
        (4, ".", "A", "G", "0|1", "HIGHLIGHT;CLNSIG=Benign"), (5, "", "A", "G", "0|1", "COSMIC_ID=C1;COSMIC_GENE=X"),
    ]
    calls = spark.createDataFrame([("s", "1", *r) for r in rows], "sample string, chrom string, pos long, id string, ref string, alt string, gt string, info string")
    assert [tuple(r)[2:] for r in person.golden_bed(calls).orderBy("start").collect()] == [
        (1, 3, "flag=RSID;id=rs2;ref=AC;alt=G;gt=0|1;clnsig=.;clndn=a"), (2, 53, "flag=SV;id=.;ref=A;alt=<DEL>;gt=1|1;svtype=DEL;svlen=-50"),
        (3, 4, "flag=HIGHLIGHTED;id=.;ref=A;alt=G;gt=0|1;clnsig=Benign"), (4, 5, "flag=COSMIC;id=.;ref=A;alt=G;gt=0|1;cosmic_id=C1;cosmic_gene=X"),
    ]
    assert column(spark, "x string", ["a;b\tc"], N.payload(k=F.col("x"))) == ["k=a,b c"]
    assert column(spark, "x string", ["hs38DH.fa", "x"], N.genome_build(F.col("x"))) == ["GRCh38", None]


def test_rs_ids(spark):
    pairs = [("rs5;x", None), ("77", None), (".", "12,13"), (".", "rs9"), (".", None), ("abc", ".")]
    assert column(spark, "id string, rs string", pairs, N.rs_id(F.col("id"), F.col("rs"))) == ["rs5", "rs77", "rs12", "rs9", None, None]


def test_ploidy_and_par(spark):
    rows = [("1", 5, "m"), ("chrX", 10001, "m"), ("X", 3000000, "m"), ("X", 3000000, "f"), ("Y", 3000000, "f"), ("Y", 56887903, "m"), ("Y", 3000000, "m"), ("MT", 1, "f")]
    assert column(spark, "c string, p long, s string", rows, V.ploidy("GRCh38", F.col("c"), F.col("p"), F.col("s"))) == [2, 2, 1, 2, 0, 2, 1, 1]
    assert column(spark, "p long", [10001, 2781479, 2781480, 155701383, 156030895], V.par_x_to_y("GRCh38", F.col("p"))) == [10001, 2781479, None, 56887903, 57217415]
    with pytest.raises(Exception, match="unknown sex"):
        column(spark, "c string, p long, s string", [("X", 5, "q")], V.ploidy("GRCh38", F.col("c"), F.col("p"), F.col("s")))


def test_channels(spark):
    rows = [("A", "C", "T", "G"), ("A", "G", "A", "T"), ("N", "C", "T", "G"), ("A", "C", "C", "G")]
    name = V.channel(*[F.col(c) for c in "lrat"])
    assert column(spark, "l string, r string, a string, t string", rows, name) == ["A[C>T]G", "A[C>T]T", None, None]
    every = V.all_channels()
    assert len(set(every)) == 96 and sorted(column(spark, "c string", every, V.channel_index(F.col("c")))) == list(range(96))


def test_genotype_quality(spark):
    def want(gt, ref, alt):
        dp = ref + alt
        if not dp:
            return 0
        a, b = gt
        s = ((ref, alt)[a]) / dp if a == b else (1 - 2 * abs(ref / dp - 0.5))
        return max(0, min(99, round(min(-10 * math.log10(max(1 - s, 1e-10)), 60 * math.log10(dp)) + 1e-9)))

    rows = [("0|0", 30, 0), ("0|0", 29, 1), ("1|1", 2, 28), ("0|1", 15, 15), ("1|0", 10, 20), ("0|1", 0, 0), ("0/1", 1, 0)]
    got = column(spark, "gt string, r long, a long", rows, G.genotype_quality(F.col("gt"), F.col("r") + F.col("a"), F.col("r"), F.col("a")))
    assert got == [want([int(x) for x in g.replace("/", "|").split("|")], r, a) for g, r, a in rows]


def grid(spark, rows):
    cells = [(f"s{i}", "1", j, d) for i, row in enumerate(rows) for j, d in enumerate(row) if d is not None]
    return spark.createDataFrame(cells, "sample string, chrom string, pos long, dosage long")


def test_f_statistic(spark):
    got = matrix.f_statistic(grid(spark, [[1, 1, 0, 2], [1, 0, 2, 1], [0, 2, 1, 1], [2, 1, 1, 0]])).collect()
    assert {(r["obs_het"], r["exp_het"], r["f"]) for r in got} == {(2, 2.0, 0.0)}
    assert {r["f"] for r in matrix.f_statistic(grid(spark, [[0] * 4, [0] * 4, [2] * 4, [2] * 4])).collect()} == {1.0}
    assert {r["f"] for r in matrix.f_statistic(grid(spark, [[0] * 4, [0] * 4])).collect()} == {None}


def test_r2(spark):
    x = [0, 1, 2, 0, 1, 2, 0, 1]
    columns = {0: x, 200: [2 - v for v in x], 400: [1] * 8, 900000: x}
    cells = [(f"s{i}", "1", p, d) for p, c in columns.items() for i, d in enumerate(c)]
    got = {(r["p1"], r["p2"]): r["r2"] for r in matrix.pair_r2(spark.createDataFrame(cells, "sample string, chrom string, pos long, dosage long")).collect()}
    assert got == {(0, 200): 1.0, (0, 400): None, (200, 400): None}


def test_pca(spark):
    got = matrix.pca(grid(spark, [[0] * 5 + [2] * 5] * 4 + [[2] * 5 + [0] * 5] * 3 + [[2] * 4 + [1] + [0] * 5])).collect()
    first = {r["sample"]: r for r in got if r["component"] == 1}
    assert first["s0"]["explained"] > 0.95 and first["s0"]["score"] * first["s5"]["score"] < 0
    assert matrix.pca(grid(spark, [[1] * 5] * 4)).count() == 0
    status = lambda rows: matrix.pca_gates(grid(spark, rows)).first()["status"]
    assert status([[0, 1]]) == "too_few_samples" and status([[0], [1], [2]]) == "too_few_variants"
    assert status([[1] * 20] * 4) == "too_few_after_pruning" and status([[0] * 12, [1] * 12, [2] * 12]) == "ok"


def test_tracts(spark):
    kind = "person int, chrom string, start long, end long, hap1_pop string, hap2_pop string"
    one = spark.createDataFrame([(1, "22", 0, 10**6, "EUR", "EUR"), (1, "22", 10**6, 2 * 10**6, "EUR", "SAS")], kind)
    stats = {r["pop"]: r for r in segments.tract_stats(segments.tracts(one)).collect()}
    assert stats["EUR"]["n"] == 2 and stats["SAS"]["n"] == 1 and stats["SAS"]["mean"] == 1e6
    two = spark.createDataFrame([(1, "1", 0, 5, "EUR", "EUR"), (1, "22", 0, 5, "EUR", "EUR")], kind)
    assert segments.tract_stats(segments.tracts(two)).first()["n"] == 4


def test_quantiles(spark):
    calls = spark.createDataFrame([("s", "1", i, i, "0|0", i, 9, i, 0) for i in range(1, 11)], "sample string, chrom string, pos long, ord long, gt string, dp long, gq long, ad_ref long, ad_alt long")
    r = {x["metric"]: x for x in summary.quality_metrics(calls).collect()}["dp"]
    assert (r["p10"], r["median"], r["p90"]) == (1.9, 5.5, 9.1)


SITE = ("f", "15", 28365618, "A", "G")


@pytest.mark.parametrize("gts, alt, low, high, want", [
    (["1|1"] * 4 + ["0|0"] * 16, "G", 0.0, 1.0, "present_in_range"), (["1|1"] * 4, "C", 0.0, 1.0, "absent"), (["1|1"] * 20, "G", 0.0, 0.5, "present_above_threshold"),
    (["0|1"] + ["0|0"] * 19, "G", 0.05, 1.0, "present_below_threshold"), (["./."] * 5, "G", 0.0, 1.0, "present_af_unknown"),
])
def test_scan_status(spark, gts, alt, low, high, want):
    rows = [(SITE[0], SITE[1], SITE[2], SITE[3], alt, gt) for gt in gts] + [("g", "22", 5, "A", "G", "0|1"), ("h", "15", 5, "A", "G", "0|1")]
    calls = spark.createDataFrame(rows, "file string, chrom string, pos long, ref string, alt string, gt string").withColumns({"sample": F.lit("s"), "id": F.lit(".")})
    target = spark.createDataFrame([("t", "chr15", SITE[2], "A", "G", low, high)], "name string, t_chrom string, t_pos long, t_ref string, t_alt string, min_af double, max_af double")
    got = {r["file"]: r["status"] for r in scan.variant_scan(calls, target).collect()}
    assert got == {"f": want, "g": "not_applicable", "h": "position_empty"}


def test_scan_takes_told_frequency(spark):
    rows = [("f", 1, "0|1", "AC=9;AF=0.7"), ("f", 2, "0|0", "AF=0.1"), ("g", 1, "0|1", "AF=."), ("g", 2, "0|0", "AF=0.1"), ("h", 1, "1|1", None)]
    calls = spark.createDataFrame(rows, "file string, ord long, gt string, info string").selectExpr("*", "'15' AS chrom", "7L AS pos", "'A' AS ref", "'G' AS alt", "'s' AS sample", "'.' AS id")
    target = spark.createDataFrame([("t", "15", 7, "A", "G", 0.3, 0.9)], "name string, t_chrom string, t_pos long, t_ref string, t_alt string, min_af double, max_af double")
    got = {r["file"]: (r["af"], r["status"]) for r in scan.variant_scan(calls, target).collect()}
    assert got == {"f": (0.7, "present_in_range"), "g": (0.25, "present_below_threshold"), "h": (1.0, "present_above_threshold")}


def test_file_tags(spark):
    calls = spark.createDataFrame([("f", "s", "1", "x_phase3_v5.20130502.vcf.gz"), ("g", "s", "1", "plain.vcf")], "file string, sample string, chrom string, file_name string")
    got = {r["file"]: (r["pipeline_tag"], r["date_stamp"]) for r in scan.metadata(calls).collect()}
    assert got == {"f": ("phase3_v5", "20130502"), "g": ("", "")}


def test_chromosome_spec():
    assert scan.parse_chromosomes("1-3,5,X,2") == ["1", "2", "3", "5", "X"]
    with pytest.raises(ValueError):
        scan.parse_chromosomes("99")


def test_annotation_keeps_ids_and_takes_the_last(spark):
    sites = spark.createDataFrame([(1, "1", 5, "A", "G", "."), (2, "1", 6, "A", "G", "rs1")], "site long, chrom string, pos long, ref string, alt string, id string")
    cat = spark.createDataFrame([(1, "1", 5, "A", "G", "x", "Benign"), (2, "1", 5, "A", "G", "y", "Pathogenic"), (3, "1", 6, "A", "G", "z", "Benign")], "ord long, chrom string, pos long, ref string, alt string, id string, clnsig string")
    got = {r["site"]: (r["id"], r["clnsig"]) for r in catalogue.annotate(sites, cat).collect()}
    assert got == {1: ("y", "Pathogenic"), 2: ("rs1", "Benign")}


def test_draws(spark):
    u = [r[0] for r in spark.range(20000).select(draws.uniform(1, "t", F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.01
    sites = spark.range(6000).select(F.col("id").alias("site"), F.lit("A").alias("ref"))
    ti = generate.titv_alt(sites, 3).filter("new_alt = 'G'").count()
    assert 1.9 < ti / (6000 - ti) < 2.3
    counts = generate.draw_allele_counts(sites, 20, 3)
    assert counts.count() == 6000
    slots = generate.haplotype_slots(counts.limit(200), 20, 3).groupBy("site").count().join(counts, "site")
    assert slots.filter("`count` != ac").count() == 0
    ids = generate.sample_ids(spark, 3000, 1)
    assert ids.select("sample").distinct().count() == 3000


def test_bump_is_the_sequential_rule(spark):
    positions = [5, 5, 5, 6, 20, 20, 7, 8, 8]
    rows = spark.createDataFrame([("1", p, i) for i, p in enumerate(positions)], "chrom string, pos long, i long")
    got = [r["new_pos"] for r in generate.bump(rows, ["chrom"], "pos", ["i"]).orderBy("pos", "i").collect()]
    want, last = [], -1
    for p in sorted(positions):
        last = max(p, last + 1)
        want.append(last)
    assert got == want
    for run in (1, 3, 8):
        assert [r["new_pos"] for r in generate.bump(rows, ["chrom"], "pos", ["i"], run=run).orderBy("pos", "i").collect()] == want


def test_linkage_decays(spark):
    haps = generate.mosaic_haplotypes(spark, 80, 120, 6, 0.05, 2)
    cells = haps.select(F.concat(F.lit("s"), F.col("hap")).alias("sample"), F.lit("1").alias("chrom"), (F.col("site") * 1000).alias("pos"), F.col("allele").cast("long").alias("dosage"))
    bins = {r["bin"]: r["mean_r2"] for r in matrix.ld_decay(matrix.pair_r2(cells)).collect()}
    assert bins[min(bins)] > 2 * bins[max(bins)]


def test_vcf_round_trip(spark, tmp_path):
    kind = "sample string, chrom string, pos long, id string, ref string, alt string, gt string, dp long, gq long, ad_ref long, ad_alt long, info string"
    rows = [("P1", "2", 7, "rs1", "A", "G", "0|1", 10, 40, 5, 5, "AC=1"), ("P1", "10", 3, ".", "A", "<DEL>", "1|1", 8, 30, 0, 8, "SVTYPE=DEL;HIGHLIGHT"), ("P2", "X", 9, ".", "C", "T", "1", 6, 20, 0, 6, "AC=1")]
    calls = spark.createDataFrame(rows, kind)
    vcf.write_vcf(calls, f"{tmp_path}/v")
    back = vcf.read_vcf(spark, f"{tmp_path}/v/*/*.gz")
    names = [c.split()[0] for c in kind.split(", ")[:-1]]
    assert sorted(tuple(r) for r in back.select(*names).collect()) == sorted(r[:-1] for r in rows)
    assert {tuple(r["samples"]) for r in vcf.read_header(spark, f"{tmp_path}/v/*/*.gz").collect()} == {("P1",), ("P2",)}
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/v/sample=P1").collect()]
    assert lines[0].startswith("##") and [x.split("\t")[0] for x in lines if not x.startswith("#")] == ["2", "10"]


def test_multi_sample_and_bed_and_fasta(spark, tmp_path):
    (tmp_path / "m.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n1\t5\t.\tA\tG\t.\t.\tAC=1\tGT:DP\t0|1:3\t1|1:2\n1\t6\t.\tA\tG\t.\t.\t.\tGT\t0|1\n")
    assert sorted((r["sample"], r["pos"], r["gt"]) for r in vcf.read_multi_sample(spark, f"{tmp_path}/m.vcf").collect()) == [("A", 5, "0|1"), ("B", 5, "1|1")]
    (tmp_path / "p1.bed").write_text("#c\n1\t0\t5\tEUR\tSAS\nbad\n1\tx\t5\tEUR\tSAS\n")
    assert [tuple(r) for r in vcf.read_bed(spark, f"{tmp_path}/p1.bed").collect()] == [("p1", "1", 0, 5, "EUR", "SAS")]
    (tmp_path / "r.fa").write_text(">1 first\nACGTN\nacgt\n>2\nGG\n")
    fasta = vcf.read_fasta(spark, f"{tmp_path}/r.fa", block=4)
    rows = spark.createDataFrame([("1", p) for p in (1, 4, 5, 9, 10)] + [("2", 2), ("3", 1)], "chrom string, pos long")
    assert {(r["chrom"], r["pos"]): r["b"] for r in vcf.with_base(rows, fasta, "pos", "b", block=4).collect()} == {("1", 1): "A", ("1", 4): "T", ("1", 5): "N", ("1", 9): "T", ("1", 10): "N", ("2", 2): "G", ("3", 1): "N"}
    bed = spark.createDataFrame([("1", 10, "AT", None, "a;b"), ("X", 3, "A", 50, None)], "chrom string, pos long, ref string, sv_end long, k string")
    assert sorted(tuple(r) for r in vcf.bed_lines(bed, "k").collect()) == [("1", 9, 11, "k=a,b"), ("X", 2, 50, ".")]


def test_reports(spark):
    from allelic.sources import adapters

    d = "/root/testdata/sf0.001"
    parts = report.validation(adapters.calls(spark, d), adapters.people(spark, d), ld=False)
    assert json.loads(report.to_json(parts))["cohort"]["n_ti"] > 0
    assert "## Samples" in report.markdown("Validation", parts)
    target = spark.createDataFrame([("t", "chr6", 39596, "C", "T", 0.0, 1.0)], "name string, t_chrom string, t_pos long, t_ref string, t_alt string, min_af double, max_af double")
    assert "present_in_range" in report.scan_reports(adapters.calls(spark, d), target)["variants"]
    assert report.finite({"a": [math.inf, 1.0], "b": math.nan}) == {"a": [None, 1.0], "b": None}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(c, p) for c in "12" for p in range(0, 400, 3)], "chrom string, pos long")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    told = emit.ordered_emit(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/c", slack=400)
    assert len(told) == 4 and sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("chrom", "pos").collect())) == sorted(map(tuple, rows.collect()))


def test_stream_killed_before_the_rest(spark, tmp_path):
    rows = spark.createDataFrame([(c, p) for c in "12" for p in range(0, 400, 3)], "chrom string, pos long")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")

    def run():
        return emit.ordered_emit(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/c", slack=400)

    last = max(t["batch"] for t in run())
    shutil.rmtree(f"{tmp_path}/out/batch={last + 1:06d}")
    assert run() == []
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("chrom", "pos").collect())) == sorted(map(tuple, rows.collect()))


def test_suffix_min_goes_over_each_key_once(spark):
    given = [(k, o, (o * 7919 + k * 31) % 1009 if o % 11 else None) for k in (1, 2) for o in range(500)]
    out = generate.suffix_min(spark.createDataFrame(given, "k long, o long, v long"), ["k"], ["o", "v"], "v")
    left = {k: [v for j, o, v in given if j == k] for k in (1, 2)}
    want = {(k, o): min((v for v in left[k][o:] if v is not None), default=None) for k, o, _ in given}
    assert {(r["k"], r["o"]): r["min_ahead"] for r in out.collect()} == want
    # a frame that ends at the key's last row is worked out anew for each row
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()


def test_haplotype_slots_move_no_haplotypes(spark):
    counts = spark.createDataFrame([(s, ac) for s, ac in ((1, 3), (2, 0), (3, 9), (4, 1), (5, None))], "site long, ac long")
    out = generate.haplotype_slots(counts, 9, 3)
    order = lambda s: sorted(range(9), key=lambda h: hashlib.md5(f"3:slot:{s}:{h}".encode()).hexdigest())
    assert sorted(map(tuple, out.select("site", "hap").collect())) == sorted((s, h) for s, ac in ((1, 3), (3, 9), (4, 1)) for h in order(s)[:ac])
    # no window: a row for each haplotype of a site is made only after the last exchange
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("Generate") < plan.index("Exchange")


def test_dense_keeps_calls_of_one_key_apart(spark, tmp_path):
    quantity = {"0|0": 1.0, "0|1": 4.0, "1|0": 6.0, "1|1": 7.0, "./.": 9.0}
    given = [(1, "0|1"), (1, "1|0"), (1, "./."), (2, "1|1"), (2, "0|0"), (2, "1|1"), (3, "1|0"), (4, "0|0"), (4, "0|0")]
    rows = [(o, 5, 7, 1, quantity[gt], "A") for o, gt in given]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["dense_roundtrip"](spark, str(tmp_path)).select("site", "ord", "person", "gt").collect()
    assert sorted(map(tuple, got)) == sorted((5, o * 10 + 1, 7, "0|0" if gt == "./." else gt) for o, gt in given)


@pytest.mark.parametrize("samples", [5, 150, 300])
def test_r2_gathers_samples_of_a_site(spark, samples):
    dosage = {(i, p): d for i in range(samples) for p in range(0, 900, 150) if (d := (i * 31 + p * (i % 7 + 1)) % 4) < 3}
    cells = [(f"s{i}", "1", p, d) for (i, p), d in dosage.items()] + [(f"s{i}", "1", p, 0) for i, p in dosage]
    want = {}
    for a in range(0, 900, 150):
        for b in range(a + 150, min(a + 450, 900), 150):
            xy = [(dosage[i, a], dosage[i, b]) for i in range(samples) if (i, a) in dosage and (i, b) in dosage]
            if len(xy) >= 4:
                n, sx, sy = len(xy), sum(x for x, _ in xy), sum(y for _, y in xy)
                cov, vx, vy = n * sum(x * y for x, y in xy) - sx * sy, n * sum(x * x for x, _ in xy) - sx * sx, n * sum(y * y for _, y in xy) - sy * sy
                want[a, b] = (n, cov * cov / (vx * vy) if vx * vy else None)
    out = matrix.pair_r2(spark.createDataFrame(cells, "sample string, chrom string, pos long, dosage long"), longest=450)
    assert {(r["p1"], r["p2"]): (r["n"], r["r2"]) for r in out.collect()} == want
    # pairs stay where they meet
    assert "p2" not in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)


def test_sampled_pairs_are_the_first_by_key(spark):
    cells = spark.createDataFrame([(f"s{i}", "1", p * 50, (i * 7 + p * (i % 5 + 1)) % 3) for i in range(8) for p in range(60)], "sample string, chrom string, pos long, dosage long")
    key = draws.order_key(7, "ld", F.col("chrom"), F.col("p1"), F.col("p2"))
    pairs = [tuple(r) for r in matrix.pair_r2(cells).withColumn("bin", matrix.ld_bin()).filter("r2 is not null").select("bin", key, "p1", "p2").collect()]
    want = {x for i in {p[0] for p in pairs} for x in sorted(p for p in pairs if p[0] == i)[:10]}
    for ample in (20, 1):  # with 1, limits have to rise
        out = matrix.sampled_pairs(cells, 10, key, ample=ample)
        assert {tuple(r) for r in out.select(matrix.ld_bin(), key, "p1", "p2").collect()} == want


def test_sampled_pairs_hashed_many_at_once(spark):
    places = {"1": [1, 9, *range(50, 3000, 50), 99_990, 100_050, 499_000, 500_001, 1_000_100], "HLA*" + "x" * 50: range(50, 1500, 50)}
    cells = spark.createDataFrame([(f"s{i}", c, p, (i * 7 + p * (i % 5 + 1)) % 3) for i in range(8) for c, ps in places.items() for p in ps], "sample string, chrom string, pos long, dosage long")
    key = draws.order_key(7, "ld", F.col("chrom"), F.col("p1"), F.col("p2"))
    rows = lambda start, ample: {tuple(r) for r in matrix.sampled_pairs(cells, 10, key, ample=ample, start=start).collect()}
    for ample in (20, 1):
        assert rows("7:ld", ample) == rows(None, 20)
