"""Reports, carriers, spectra, manifests, the cohort's VCF, and settings."""

import json

import pytest
from pyspark.errors import PySparkException

from allelic import config
from allelic.operators import generate
from allelic.sources import sidecars, vcf


def files(folder, pattern):
    return [p.read_text() for p in sorted(folder.glob(pattern))]


def test_reports_are_read_in_order(spark, tmp_path):
    for name, parts in {"b": {"file": "b.vcf", "pass": False, "errors": ["x"], "checks": {"n_variants": 3}}, "a": {"file": "a.vcf", "pass": True, "warnings": ["w"]}}.items():
        (tmp_path / f"{name}.qc.json").write_text(json.dumps(parts, indent=2))
    (tmp_path / "c.meta.json").write_text(json.dumps({"file": "c.vcf", "n_samples": 4}))
    rows = sidecars.read_reports(spark, str(tmp_path), "qc").collect()
    assert [(r["file"], r["pass"], r["errors"], r["warnings"]) for r in rows] == [("a.vcf", True, None, ["w"]), ("b.vcf", False, ["x"], None)]
    assert rows[1]["checks"] == {"n_variants": "3"}
    assert [(r["file"], r["n_samples"]) for r in sidecars.read_reports(spark, str(tmp_path), "meta").collect()] == [("c.vcf", 4)]
    assert sidecars.read_reports(spark, str(tmp_path), "variant").count() == 0


def test_carriers_round_trip(spark, tmp_path):
    kind = "file string, sample string, variant_id string, chrom string, pos long, ref string, alt string, genotype string, alt_dosage long"
    rows = [("f1", "P2", "rs1", "6", 7, "A", "G", "0|1", 1), ("f1", "P1", ".", "6", 7, "A", "G", "1|1", 2)]
    (tmp_path / "in").mkdir()
    for name, own in (("some", rows), ("none", [])):
        sidecars.write_carriers(spark.createDataFrame(own, kind), f"{tmp_path}/{name}")
        text = "".join(files(tmp_path / name, "part-*"))
        assert text.startswith("\t".join(sidecars.CARRIERS) + "\n") and text.count("\n") == len(own) + 1
        (tmp_path / "in" / f"{name}.carriers.tsv").write_text(text)
    (tmp_path / "in" / "odd.carriers.tsv").write_text("\t".join(sidecars.CARRIERS) + "\nshort\tline\n\nf2\tP3\t.\t6\t?\tA\tG\t0|1\tx\textra\n")
    (tmp_path / "in" / "other.tsv").write_text("a\tb\tc\td\te\tf\tg\th\ti\n")
    got = sorted(map(tuple, sidecars.read_carriers(spark, f"{tmp_path}/in").collect()))
    assert got == sorted([*rows, ("f2", "P3", ".", "6", None, "A", "G", "0|1", None)])


def test_spectrum_and_genotype_table(spark, tmp_path):
    sidecars.write_spectrum(spark.createDataFrame([(10, 1), (2, 5)], "ac long, n_sites long"), f"{tmp_path}/s")
    assert files(tmp_path / "s", "part-*") == ["ac\tn_sites\n2\t5\n10\t1\n"]
    sidecars.write_genotype_table(spark.createDataFrame([("B", "1|1"), ("A", "0|1"), ("C", "./.")], "sample string, gt string"), f"{tmp_path}/g")
    assert files(tmp_path / "g", "part-*") == ["sample\tGT\talt_dosage\nA\t0|1\t1\nB\t1|1\t2\nC\t./.\t0\n"]


def test_ancestry_files(spark, tmp_path):
    rows = [("p1", "10", 0, 5, "EUR", "SAS"), ("p1", "2", 7, 9, "AFR", "AFR"), ("p1", "2", 0, 7, "EUR", "EUR"), ("p2", "X", 0, 4, "SAS", "EUR")]
    sidecars.write_ancestry(spark.createDataFrame(rows, "person string, chrom string, start long, end long, hap1_pop string, hap2_pop string"), f"{tmp_path}/a")
    assert files(tmp_path / "a" / "person=p1", "part-*") == ["2\t0\t7\tEUR\tEUR\n2\t7\t9\tAFR\tAFR\n10\t0\t5\tEUR\tSAS\n"]
    back = vcf.read_bed(spark, f"{tmp_path}/a/*/part-*").drop("person")
    assert sorted(map(tuple, back.collect())) == sorted(r[1:] for r in rows)


def test_manifest(spark, tmp_path):
    people = spark.createDataFrame([("B", "f", 1), ("A", "m", 0)], "sample string, sex string, lineage long")
    made = sidecars.manifest(people, "GRCh38", "both", ["1"], 7, ["c1"], {"A": "a.vcf"}, errors={"flipped": 2})
    sidecars.write_manifest(spark, made, f"{tmp_path}/m")
    assert sidecars.read_manifest(spark, f"{tmp_path}/m") == made
    assert made["samples"] == ["A", "B"] and made["sex"] == ["m", "f"] and made["people"][0]["file"] == "a.vcf" and made["people"][1]["file"] is None
    assert "people" not in sidecars.manifest(people, "GRCh38", "cohort", ["1"], 7)
    assert sidecars.read_manifest(spark, f"{tmp_path}/none") is None
    with pytest.raises(ValueError):
        sidecars.manifest(people, "GRCh38", "other", [], 7)


def test_cohort_vcf_round_trip(spark, tmp_path):
    kind = "sample string, chrom string, pos long, id string, ref string, alt string, extra string, gt string"
    rows = [
        ("S1", "2", 70, "rs1", "A", "G", None, "0|1"), ("S4", "2", 70, "rs1", "A", "G", None, "1|1"), ("S4", "2", 70, "rs1", "A", "G", None, "0|1"), ("other", "2", 70, "rs1", "A", "G", None, "1|1"),
        ("S2", "2", 9, ".", "A", "C,T", "CLNSIG=x", "1|2"), ("S3", "2", 9, ".", "A", "C,T", "CLNSIG=x", "2|0"), ("S1", "10", 1005, ".", "C", "T", ".", "0|0"), ("S1", "10", 5, ".", "C", "T", ".", "1|0"),
    ]
    samples = ["S1", "S2", "S3", "S4", "S5"]
    calls = spark.createDataFrame(rows, kind)
    vcf.write_cohort_vcf(calls, samples, f"{tmp_path}/c", run=1000)
    text = [r["value"] for r in spark.read.text(f"{tmp_path}/c/contig=2/run=0").collect()]
    assert text[0].startswith("##fileformat") and text[-3].split("\t")[9:] == samples and "##contig=<ID=2>" in text
    assert text[-2] == "2\t9\t.\tA\tC,T\t100\tPASS\tAC=1,2;AN=10;AF=0.100000,0.200000;CLNSIG=x\tGT\t./.\t1|2\t2|0\t./.\t./."
    assert text[-1] == "2\t70\trs1\tA\tG\t100\tPASS\tAC=3;AN=10;AF=0.300000\tGT\t0|1\t./.\t./.\t1|1\t./."
    assert sorted(p.name for p in (tmp_path / "c" / "contig=10").iterdir()) == ["run=0", "run=1"]
    back = vcf.read_multi_sample(spark, f"{tmp_path}/c/*/*/*.gz")
    assert back.count() == 4 * len(samples)
    assert {(r["sample"], r["pos"], r["gt"]) for r in back.filter("gt != './.'").collect()} == {("S1", 70, "0|1"), ("S4", 70, "1|1"), ("S2", 9, "1|2"), ("S3", 9, "2|0"), ("S1", 1005, "0|0"), ("S1", 5, "1|0")}


def test_settings(tmp_path):
    values, origin = config.resolve({"schema_version": 1, "cohort": {"n": 5, "seed": 3}, "overlays": {"rsid": {"density": 0.5}}}, {"cohort.n": 7})
    assert values["cohort.n"] == 7 and values["overlays.rsid.density"] == 0.5 and values["admixture.eur_frac"] == 0.6
    assert config.provenance(values, origin) == ["cohort.n = 7 (explicit)", "cohort.seed = 3 (config)", "overlays.rsid.density = 0.5 (config)"]
    assert config.resolve()[0]["output.mode"] == "per-person"
    bad = {"schema_version": 2, "cohort": {"n": 0, "build": "hg1", "chromosomes": "99", "male_fraction": True, "nope": 1}, "admixture": {"enabled": True, "eur_frac": 0.5}, "structural_variants": {"length_min": 9, "length_max": 8}, "what": {}, "overlays": {"clinvar": {"inject_density": float("nan")}}, "legacy_background": {"sfs_alpha": 0}}
    with pytest.raises(config.ConfigError) as e:
        config.resolve(bad, {"no.such": 1})
    assert {line.split(":")[0] for line in str(e.value).split("\n")} == {
        "schema_version", "cohort.n", "cohort.build", "cohort.chromosomes", "cohort.male_fraction", "cohort.nope", "admixture", "structural_variants", "what", "overlays.clinvar.inject_density", "legacy_background.sfs_alpha", "no.such",
    }
    (tmp_path / "c.json").write_text('{"schema_version": 1, "output": {"mode": "both"}}')
    assert config.load(f"{tmp_path}/c.json")[0]["output.mode"] == "both"
    (tmp_path / "bad.json").write_text("[1")
    with pytest.raises(config.ConfigError):
        config.load(f"{tmp_path}/bad.json")


def test_depths_follow_each_sample(spark):
    calls = spark.range(6000).selectExpr("concat('S', id % 3) AS sample", "id AS ord", "CASE id % 5 WHEN 0 THEN 'C,T' ELSE 'C' END AS alt", "CASE id % 5 WHEN 0 THEN '1|2' WHEN 1 THEN '0|1' WHEN 2 THEN '1|1' WHEN 3 THEN '1' ELSE './.' END AS gt")
    rows = generate.read_depths(calls, 5).collect()
    assert len(rows) == 6000 and all(sum(r["ad_new"]) == r["dp_new"] and len(r["ad_new"]) == 2 + (r["ord"] % 5 == 0) for r in rows)
    assert all(r["ad_new"][0] == {0: 0, 2: 0, 3: 0, 4: r["dp_new"]}[r["ord"] % 5] for r in rows if r["ord"] % 5 != 1)
    share = lambda k, i: sum(r["ad_new"][i] for r in rows if r["ord"] % 5 == k) / sum(r["dp_new"] for r in rows if r["ord"] % 5 == k)
    assert abs(share(1, 0) - 0.525) < 0.01 and abs(share(0, 1) - 0.5) < 0.01
    means = {r["sample"]: r["mean_depth"] for r in generate.sample_depths(calls.select("sample").distinct(), 5).collect()}
    for sample, mean in means.items():
        own = [r["dp_new"] for r in rows if r["sample"] == sample]
        assert abs(sum(own) / len(own) - mean) < 0.5 and 0.8 * mean < sum((x - mean) ** 2 for x in own) / len(own) < 1.2 * mean


def test_chunks(spark):
    contigs = spark.createDataFrame([("1", 25_000_000, 0), ("2", 10_000_000, 5), ("3", 0, 1)], "chrom string, length long, seed long")
    got = [tuple(r) for r in generate.chunks(contigs, 10_000_000).orderBy("chrom", "chunk").collect()]
    step = lambda seed, k: (seed + k * 0x9E3779B9) & 0x7FFFFFFF or 1
    assert got == [
        ("1", 0, 0, 10_000_000, 11_000_000, 1), ("1", 1, 10_000_000, 20_000_000, 21_000_000, step(0, 1)), ("1", 2, 20_000_000, 25_000_000, 25_000_000, step(0, 2)), ("2", 0, 0, 10_000_000, 10_000_000, 5),
    ]


def test_highlighted_by_ploidy(spark):
    people = spark.createDataFrame([(f"P{i}", "mf"[i % 2]) for i in range(400)], "sample string, sex string")
    kind = "ord long, chrom string, pos long, ref string, alt string"
    rows = [(1, "1", 5, "A", "G"), (2, "Y", 20_000, "A", "G"), (3, "Y", 20_000_000, "A", "G"), (4, "MT", 7, "A", "G"), (5, "X", 9, "A", "G")]
    got = generate.highlighted_variant(people, spark.createDataFrame(rows, kind), 3).join(people, "sample").collect()
    assert len(got) == 400 and {(r["sex"], r["ord"]) for r in got} == {("m", 1), ("m", 3), ("m", 5), ("f", 1), ("f", 5)}
    assert 90 < sum(r["ord"] == 1 for r in got if r["sex"] == "f") < 110 + 20
    with pytest.raises(PySparkException, match="no candidate is left for sex f"):
        generate.highlighted_variant(people, spark.createDataFrame(rows[2:4], kind), 3).collect()


def test_tracts_after_a_pulse(spark):
    people = spark.createDataFrame([(f"P{i}",) for i in range(300)], "sample string")
    rows = generate.ancestry(people, 100_000_000, 4).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        by.setdefault((r["sample"], r["hap"]), []).append(r)
    assert len(by) == 600 and all(x[0]["start"] == 0 and x[-1]["end"] == 100_000_000 and all(a["end"] == b["start"] for a, b in zip(x, x[1:])) for x in by.values())
    cuts = [len(x) - 1 for x in by.values()]
    assert abs(sum(cuts) / 600 - 20) < 0.8 and 15 < sum((c - 20) ** 2 for c in cuts) / 600 < 25
    assert abs(sum(r["pop"] == "EUR" for r in rows) / len(rows) - 0.6) < 0.02
    with pytest.raises(ValueError):
        generate.ancestry(people, 10, 4, fractions={"EUR": 0.5})


def test_drawn_ref_fills_unknown_bases(spark):
    sites = spark.range(400).selectExpr("id AS site", "CASE WHEN id % 2 = 0 THEN 'N' ELSE 'G' END AS base")
    with_base = {r["site"]: r["new_ref"] for r in generate.picked_ref(sites, "base", 1).collect()}
    alone = {r["site"]: r["new_ref"] for r in generate.picked_ref(sites, None, 1).collect()}
    assert all(with_base[i] == ("G" if i % 2 else alone[i]) for i in range(400)) and set(alone.values()) == set("ACGT")
