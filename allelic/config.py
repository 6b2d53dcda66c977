"""Settings of a run: strict sections, all faults told at once, and who set what."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from .operators.scan import parse_chromosomes

VERSION = 1


@dataclass(frozen=True)
class Field:
    kind: type
    default: object
    least: float | None = None
    most: float | None = None
    among: tuple[str, ...] = ()
    optional: bool = False
    above: float | None = None

    def fault(self, value) -> str | None:
        if value is None:
            return None if self.optional else "must not be empty"
        whole = isinstance(value, int) and not isinstance(value, bool)
        sound = whole or isinstance(value, float) and value == value and abs(value) != float("inf") if self.kind is float else whole if self.kind is int else isinstance(value, self.kind)
        if not sound:
            return f"must be {self.kind.__name__}, not {value!r}"
        if self.least is not None and value < self.least:
            return f"must be {self.least} or more, not {value}"
        if self.above is not None and value <= self.above:
            return f"must be more than {self.above}, not {value}"
        if self.most is not None and value > self.most:
            return f"must be {self.most} or less, not {value}"
        return f"must be one of {', '.join(self.among)}, not {value}" if self.among and value not in self.among else None


def share(default: float) -> Field:
    return Field(float, default, 0, 1)


#: Sections, settings, defaults and bounds.
SECTIONS: dict[str, dict[str, Field]] = {
    "cohort": {
        "n": Field(int, 10, 1), "build": Field(str, "GRCh38", among=("GRCh37", "GRCh38")), "seed": Field(int, None, optional=True), "chromosomes": Field(str, "22"), "chr_length_mb": Field(float, 5.0, 0),
        "reference_fasta": Field(str, None, optional=True), "male_fraction": share(0.5), "mt_lineages": Field(int, 0, 0),
    },
    "simulation": {"rec_rate": Field(float, 1e-8, 0), "mu": Field(float, 1.29e-8, 0)},
    "overlays.clinvar": {"inject_density": share(0.01), "sig_filter": Field(str, "Pathogenic,Likely_pathogenic,Pathogenic/Likely_pathogenic")},
    "overlays.rsid": {"density": share(0.2), "vcf": Field(str, None, optional=True)},
    "overlays.cosmic": {"enabled": Field(bool, False), "vcf": Field(str, None, optional=True), "inject_density": share(0.005)},
    "structural_variants": {"per_person": Field(int, 3, 0), "length_min": Field(int, 50, 1), "length_max": Field(int, 10_000, 1)},
    "sequencing_errors": {"gt_flip_rate": share(0.001), "dropout_rate": share(0.0005)},
    "performance": {"chr_chunk_mb": Field(float, 0.0, 0)},
    "output": {"dir": Field(str, "./out"), "mode": Field(str, "per-person", among=("per-person", "cohort", "both"))},
    "admixture": {"enabled": Field(bool, False), "eur_frac": share(0.6), "sas_frac": share(0.25), "afr_frac": share(0.15)},
    "legacy_background": {"enabled": Field(bool, False), "n_background": Field(int, 500, 1), "af_min": share(0.05), "sfs_alpha": Field(float, 2.0, above=0)},
}


def known_chromosomes(v: dict) -> str | None:
    try:
        parse_chromosomes(v["cohort.chromosomes"])
    except ValueError as e:
        return str(e)


def whole_ancestry(v: dict) -> str | None:
    total = sum(v[f"admixture.{p}_frac"] for p in ("eur", "sas", "afr"))
    return f"fractions add up to {total}, not 1" if v["admixture.enabled"] and abs(total - 1) > 1e-6 else None


def ordered_lengths(v: dict) -> str | None:
    low, high = v["structural_variants.length_min"], v["structural_variants.length_max"]
    return f"length_max {high} is less than length_min {low}" if high < low else None


#: What settings must be together, each told under the section it belongs to.
TOGETHER: list[tuple[str, tuple[str, ...], Callable[[dict], str | None]]] = [
    ("cohort.chromosomes", ("cohort.chromosomes",), known_chromosomes),
    ("admixture", ("admixture.enabled", "admixture.eur_frac", "admixture.sas_frac", "admixture.afr_frac"), whole_ancestry),
    ("structural_variants", ("structural_variants.length_min", "structural_variants.length_max"), ordered_lengths),
]


class ConfigError(ValueError):
    """All faults of a configuration, one a line."""


def flatten(data: dict) -> tuple[dict, list[str]]:
    """Nested sections to dotted names, and what is unknown among them."""
    flat, faults = {}, []
    for name, section in data.items():
        if name == "overlays" and isinstance(section, dict):
            more, wrong = flatten({f"overlays.{k}": v for k, v in section.items()})
            flat.update(more)
            faults += wrong
        elif name not in SECTIONS:
            faults.append(f"{name}: unknown section")
        elif not isinstance(section, dict):
            faults.append(f"{name}: must hold settings")
        else:
            faults += [f"{name}.{k}: unknown setting" for k in section if k not in SECTIONS[name]]
            flat.update({f"{name}.{k}": v for k, v in section.items() if k in SECTIONS[name]})
    return flat, faults


def resolve(data: dict | None = None, explicit: dict | None = None) -> tuple[dict, dict[str, str]]:
    """Settings by dotted name and where each comes from: explicit ones first, then the file's, then defaults.

    ``data``: the parsed file, with ``schema_version``; ``explicit``: dotted names. Raises ConfigError with every fault.
    """
    faults, told = [], {}
    if data is not None:
        data = dict(data)
        version = data.pop("schema_version", None)
        if version != VERSION:
            faults.append(f"schema_version: must be {VERSION}, not {version}")
        told, wrong = flatten(data)
        faults += wrong
    fields = {f"{s}.{k}": f for s, section in SECTIONS.items() for k, f in section.items()}
    faults += [f"{k}: unknown setting" for k in explicit or {} if k not in fields]
    values, origin = {}, {}
    for name, field in fields.items():
        origin[name] = "explicit" if name in (explicit or {}) else "config" if name in told else "default"
        values[name] = explicit[name] if origin[name] == "explicit" else told.get(name, field.default)
    each = {k: fields[k].fault(v) for k, v in values.items()}
    faults += [f"{k}: {fault}" for k, fault in each.items() if fault]
    faults += [f"{where}: {fault}" for where, names, check in TOGETHER if not any(each[n] for n in names) and (fault := check(values))]
    if faults:
        raise ConfigError("\n".join(faults))
    return values, origin


def load(path: str, explicit: dict | None = None) -> tuple[dict, dict[str, str]]:
    """``resolve`` on a JSON file, or a YAML one where a YAML parser is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        if str(path).endswith(".json"):
            data = json.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text)
    except ImportError as e:
        raise ConfigError("no YAML parser is installed; give a JSON file") from e
    except Exception as e:
        raise ConfigError(f"{path} can't be parsed: {e}") from e
    if data is not None and not isinstance(data, dict):
        raise ConfigError(f"{path} must hold sections")
    return resolve(data or {}, explicit)


def provenance(values: dict, origin: dict[str, str]) -> list[str]:
    """A line for each setting that isn't the default."""
    return [f"{k} = {values[k]} ({origin[k]})" for k in values if origin[k] != "default"]
