"""Annotation catalogues: loading rules, exact annotation, and planning of overlays onto sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import annotation as A
from ..functions import draws


def split_alts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("alt", F.explode(F.split("alt", ",")))


def first_rows(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` source rows of each chromosome, before ALT alleles are split."""
    order = Window.partitionBy("chrom").orderBy("pos", "ord")
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).drop("rn")


def load(rows: DataFrame, wanted: list[str], most: int | None = None) -> DataFrame:
    """Catalogue rows with a wanted label and short plain alleles, one for each ALT allele."""
    rows = first_rows(rows, most) if most else rows
    out = split_alts(rows.filter(A.has_term(F.col("clnsig"), wanted))).filter(A.short_plain_alleles(F.col("ref"), F.col("alt")))
    return out.withColumns({"clnsig": A.sanitised(F.col("clnsig")), "clndn": A.sanitised(F.col("clndn"))})


def highlighted(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Single-ALT rows with a wanted label, candidates to be highlighted."""
    return load(rows.filter(~F.col("alt").contains(",")), wanted)


def rsid_pool(rows: DataFrame) -> DataFrame:
    own = rows.withColumn("rsid", A.rs_id(F.col("id"), F.col("info_rs"))).filter("rsid is not null")
    return split_alts(own).filter(A.short_plain_alleles(F.col("ref"), F.col("alt"))).select("chrom", "pos", "ref", "alt", "rsid", "ord")


def background_pool(rows: DataFrame, source: str, af: str, least: float, k: int, seed: int) -> DataFrame:
    """At most ``k`` rows of each source with frequency of at least ``least``: a reservoir sample by hash order, the same in any partitioning."""
    own = rows.filter((F.col(af) >= least) & A.short_plain_alleles(F.col("ref"), F.col("alt")))
    order = Window.partitionBy(source).orderBy(draws.order_key(seed, "background", F.col("chrom"), F.col("pos"), F.col("ord")), "ord")
    return own.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn")


def annotate(sites: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Left join on chrom, pos, ref and alt; of catalogue duplicates the last wins; an id is set only where there is none."""
    last = catalogue.groupBy("chrom", "pos", "ref", "alt").agg(F.max(F.struct("ord", "clnsig", "id")).alias("c"))
    met = sites.join(last, ["chrom", "pos", "ref", "alt"], "left")
    blank = F.col("id").isin("", ".") & F.col("c").isNotNull() & ~F.coalesce(F.col("c.id"), F.lit(".")).isin("", ".")
    return met.withColumns({"id": F.when(blank, F.col("c.id")).otherwise(F.col("id")), "clnsig": F.col("c.clnsig"), "annotated": F.col("c").isNotNull()}).drop("c")


def plan_overlay(sites: DataFrame, pool: DataFrame, density: float, seed: int, stream: str, reserved: DataFrame | None = None) -> DataFrame:
    """Give pool records to shuffled free sites of their chromosome: site, chrom, pos (new), ref, alt, tag.

    Records at a position that a site holds already are left out, of records at one
    position one stays; sites that an earlier plan reserved aren't free. As many sites get a record as
    ``density`` says (one at least), while both last: rank k of the shuffled records meets rank k of the shuffled sites.
    """
    free = sites.select("site", "chrom").join(reserved.select("site"), "site", "left_anti") if reserved is not None else sites.select("site", "chrom")
    new = pool.join(sites.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_anti")
    new = new.groupBy("chrom", "pos").agg(F.min(F.struct("ord", "ref", "alt", "tag")).alias("r")).select("chrom", "pos", "r.*")
    rank = lambda *key: F.row_number().over(Window.partitionBy("chrom").orderBy(draws.order_key(seed, stream, *key), *key))
    per_chrom = sites.groupBy("chrom").agg(F.greatest(F.lit(1), F.floor(F.count("*") * density + 0.5)).alias("target"))
    a = free.withColumn("rn", rank(F.col("site")))
    b = new.withColumn("rn", rank(F.col("pos"), F.col("ord")))
    return a.join(b, ["chrom", "rn"]).join(F.broadcast(per_chrom), "chrom").filter("rn <= target").select("site", "chrom", "pos", "ref", "alt", "tag")


def plan_chain(sites: DataFrame, pools: list[tuple[str, DataFrame, float]], seed: int) -> DataFrame:
    """Overlays one after the other, each on sites that none before it took."""
    done = None
    for name, pool, density in pools:
        own = plan_overlay(sites, pool, density, seed, name, done).withColumn("overlay", F.lit(name))
        done = own if done is None else done.unionByName(own)
    return done
