"""Reports: small aggregates as JSON and Markdown."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame

from . import matrix, scan, summary


def finite(value):
    """Nested values with null for NaN and infinity."""
    if isinstance(value, dict):
        return {k: finite(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [finite(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


def validation(calls: DataFrame, people: DataFrame | None = None, build: str = "GRCh38", ld: bool = True) -> dict:
    """The summary of a batch of calls; every part is an aggregate of bounded size."""
    g = matrix.genotype_matrix(calls)
    out = {
        "cohort": rows(summary.cohort_titv(calls))[0], "samples": rows(summary.sample_summary(calls, build), "sample"), "chromosomes": rows(summary.chrom_stats(calls), "ord", "chrom"),
        "af_histogram": rows(summary.af_histogram(calls), "bin"), "indel_lengths": rows(summary.indel_lengths(calls), "len"), "sv_types": rows(summary.sv_types(calls), "svtype"),
        "overlay_density": rows(summary.overlay_density(calls), "overlay"), "density": rows(summary.density_summary(summary.region_density(calls)), "chrom"),
        "quality": rows(summary.quality_metrics(calls), "metric"), "f_statistic": rows(matrix.f_statistic(g), "sample"), "pca": rows(matrix.pca(g), "sample", "component"),
    }
    if people is not None:
        out["sex_gates"] = rows(summary.sex_gates(calls, people, build), "gate")
    if ld:
        out["ld_decay"] = rows(matrix.ld_decay(matrix.pair_r2(g)), "bin")
    return finite(out)


def table(records: list[dict]) -> str:
    if not records:
        return "none\n"
    names = list(records[0])
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(show(r[n]) for n in names) + " |" for r in records)]) + "\n"


def markdown(title: str, parts: dict) -> str:
    sections = [f"## {k.replace('_', ' ').capitalize()}\n\n{table(v if isinstance(v, list) else [v])}" for k, v in parts.items()]
    return f"# {title}\n\n" + "\n".join(sections)


def scan_reports(calls: DataFrame, targets: DataFrame, checked: DataFrame | None = None, preview: int = 10) -> dict[str, str]:
    """The variant, carrier, metadata and, given checked files, QC reports as Markdown."""
    found, people = scan.variant_scan(calls, targets), scan.carriers(calls, targets)
    out = {
        "variants": markdown("Variant report", {"status": rows(scan.status_counts(found)), "files": rows(found, "file", "name")}),
        "carriers": markdown("Carrier report", {"total": rows(scan.carrier_report(people)), "by_file": rows(scan.carrier_report(people, "file"), "file"), "first": rows(people.orderBy("name", "file", "sample").limit(preview))}),
        "metadata": markdown("Metadata report", {"total": rows(scan.metadata_report(scan.metadata(calls))), "files": rows(scan.metadata(calls), "file")}),
    }
    if checked is not None:
        out["qc"] = markdown("QC report", {"total": rows(scan.qc_report(checked)), "files": rows(checked.select("file", "pass", "errors", "warnings"), "file")})
    return out


def to_json(parts: dict) -> str:
    return json.dumps(finite(parts), indent=2, default=str)


def multiqc(checked: DataFrame) -> str:
    """A table for a report collector: one entry for each file."""
    data = {r["file"]: {"pass": r["pass"], "errors": len(r["errors"]), "warnings": len(r["warnings"])} for r in checked.collect()}
    return json.dumps({"id": "variant_file_qc", "section_name": "Variant file QC", "plot_type": "table", "data": data})
