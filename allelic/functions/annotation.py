"""INFO fields, catalogue ids and labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def info_map(info: Column) -> Column:
    """``k=v;flag`` as a map; a flag has a null value; '' and '.' give an empty map. Of a repeated key the last counts."""
    parts = F.split(info, ";")
    keys = F.transform(parts, lambda x: F.substring_index(x, "=", 1))
    # only lines that repeat a key take the longer way
    last = F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, i + 2, F.size(parts)), lambda y: F.substring_index(y, "=", 1) == F.substring_index(x, "=", 1)))
    sound = F.when(F.size(F.array_distinct(keys)) == F.size(keys), info).otherwise(F.array_join(last, ";"))
    return F.when(info.isNull() | info.isin("", "."), F.expr("map()").cast("map<string,string>")).otherwise(F.str_to_map(sound, F.lit(";"), F.lit("=")))


def info_value(info: Column, key: str) -> Column:
    """The last value of ``key`` in INFO text, null if there is none; no map is made."""
    found = F.concat(F.lit(";"), info)
    return F.when(found.contains(f";{key}="), F.regexp_extract(found, f".*;{key}=([^;]*)", 1))


def info_flag(info: Column, key: str) -> Column:
    """Whether INFO text has ``key``, as a flag or with a value."""
    found = F.concat(F.lit(";"), F.coalesce(info, F.lit("")), F.lit(";"))
    return found.contains(f";{key};") | found.contains(f";{key}=")


def info_told(info: Column, key: str) -> Column:
    """``info_present`` on INFO text."""
    return info_flag(info, key) & ~F.coalesce(info_value(info, key), F.lit("x")).isin("", ".")


def info_present(info: Column, key: str) -> Column:
    """Present as a flag, or with a value that says something."""
    return F.map_contains_key(info, key) & ~F.coalesce(info[key], F.lit("x")).isin("", ".")


def sanitised(value: Column) -> Column:
    return F.translate(value, ";= ", ",__")


def terms(value: Column) -> Column:
    """Labels joined by ``|`` or ``,``."""
    return F.transform(F.split(value, r"[|,]"), F.trim)


def has_term(value: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(terms(value), F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def rs_id(id_: Column, info_rs: Column) -> Column:
    """An rs number from the ID column, else from INFO/RS."""

    def norm(token: Column) -> Column:
        return F.when(token.startswith("rs"), token).when(token.rlike("^[0-9]+$"), F.concat(F.lit("rs"), token))

    first = F.split(id_, ";")[0]
    return F.coalesce(F.when(first.startswith("rs"), first), F.when(first.rlike("^[0-9]+$"), F.concat(F.lit("rs"), first)), norm(F.split(info_rs, ",")[0]))


def short_plain_alleles(ref: Column, alt: Column, longest: int = 50) -> Column:
    return (F.length(ref) <= longest) & (F.length(alt) <= longest) & ~alt.startswith("<") & ~alt.isin(".", "")


def golden_category(highlighted: Column, clnsig: Column, cosmic: Column, svtype: Column, id_: Column) -> Column:
    """Null for variants that are no members; an empty or ``.`` significance tells nothing."""
    said = lambda x: F.coalesce(x, F.lit("")) != ""
    return F.when(highlighted, "HIGHLIGHTED").when(said(clnsig) & (clnsig != "."), "CLINVAR").when(said(cosmic), "COSMIC").when(said(svtype), "SV").when(id_.startswith("rs"), "RSID")


def payload(**fields: Column) -> Column:
    """``k=v`` pairs joined by ``;``, nulls left out, tabs and line ends become spaces, semicolons commas; '.' if there are none."""
    pairs = [F.when(v.isNotNull(), F.concat(F.lit(k + "="), F.translate(v.cast("string"), "\t;\n", " , "))) for k, v in fields.items()]
    text = F.concat_ws(";", *pairs)
    return F.when(text == "", ".").otherwise(text)


def genome_build(reference: Column) -> Column:
    r = F.lower(reference)
    return F.when(r.rlike("grch37|b37|hs37d5|hg19"), "GRCh37").when(r.rlike("grch38|b38|hg38|hs38"), "GRCh38")


def human_size(n: Column) -> Column:
    out = None
    for i, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        small = n < 1024.0 ** (i + 1)
        text = F.concat(F.format_string("%.1f", n / 1024.0**i), F.lit(" " + unit))
        out = F.when(small, text) if out is None else out.when(small, text)
    return out.otherwise(F.concat(F.format_string("%.1f", n / 1024.0**4), F.lit(" TB")))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.when(seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf")), "?").otherwise(F.format_string("%dh %02dm %02ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))
