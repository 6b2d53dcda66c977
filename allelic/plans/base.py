"""Registry of plans, and the SQL of the adapter views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def plan(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with DuckDB SQL for its rows."""

    def add(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


def chrom(k: str) -> str:
    return f"CASE WHEN {k} % 25 < 22 THEN CAST({k} % 25 + 1 AS VARCHAR) WHEN {k} % 25 = 22 THEN 'X' WHEN {k} % 25 = 23 THEN 'Y' ELSE 'MT' END"


def pos(k: str) -> str:
    return f"({k} * 7919) % 5000000 + 1"


def ref(k: str) -> str:
    return f"substr('ACGT', {k} % 4 + 1, 1)"


def alt(k: str) -> str:
    return f"""CASE WHEN {k} % 40 = 7 THEN '<DEL>' WHEN {k} % 40 = 17 THEN '<DUP>' WHEN {k} % 40 = 27 THEN '<INV>' WHEN {k} % 20 = 3 THEN substr('ACGT', {k} % 4 + 1, 1) || 'TT'
        WHEN {k} % 31 < 21 THEN substr('GTAC', {k} % 4 + 1, 1) ELSE substr('CATG', {k} % 4 + 1, 1) END"""


K = "l_partkey"
CALLS = f"""c0 AS (SELECT l_partkey AS site, l_orderkey * 10 + l_linenumber AS ord, l_linenumber, l_returnflag AS file, 'P' || CAST(l_suppkey % 100 AS VARCHAR) AS sample,
    {chrom(K)} AS chrom, {pos(K)} AS pos, {ref(K)} AS ref, {alt(K)} AS alt, CAST(floor(l_quantity) AS BIGINT) AS dp, CAST(least(99, l_linenumber * 14) AS BIGINT) AS gq,
    CASE WHEN CAST(floor(l_quantity) AS BIGINT) % 10 <= 3 THEN '0|0' WHEN CAST(floor(l_quantity) AS BIGINT) % 10 <= 5 THEN '0|1' WHEN CAST(floor(l_quantity) AS BIGINT) % 10 = 6 THEN '1|0'
        WHEN CAST(floor(l_quantity) AS BIGINT) % 10 <= 8 THEN '1|1' ELSE './.' END AS gt, CASE WHEN l_partkey % 5 = 0 THEN 'rs' || CAST(l_partkey AS VARCHAR) ELSE '.' END AS id FROM lineitem),
c1 AS (SELECT *, CASE WHEN gt IN ('0|1', '1|0') THEN 1 WHEN gt = '1|1' THEN 2 ELSE 0 END AS dd,
    CASE WHEN gt = '1|1' THEN 0 WHEN gt IN ('0|1', '1|0') THEN dp * (45 + l_linenumber) // 100 ELSE dp END AS ad_ref FROM c0),
calls AS (SELECT *, dp - ad_ref AS ad_alt, site % 13 = 0 AS has_clnsig, site % 29 = 0 AS has_cosmic, alt LIKE '<%' AS is_sv, site % 97 = 0 AS is_high, dd / 2.0 AS af,
    CASE WHEN gt = './.' THEN NULL ELSE dd END AS d, CASE WHEN alt LIKE '<%' THEN 'sv' WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' ELSE 'indel' END AS class,
    (ref || alt) IN ('AG', 'GA', 'CT', 'TC') AS is_ti FROM c1)"""
COUNTERS = """count(*) AS n_records, count(*) FILTER (class = 'snv') AS n_snv, count(*) FILTER (class = 'indel') AS n_indel, count(*) FILTER (class = 'sv') AS n_sv,
    count(*) FILTER (class = 'snv' AND is_ti) AS n_ti, count(*) FILTER (class = 'snv' AND NOT is_ti) AS n_tv, count(*) FILTER (d = 1) AS n_het, count(*) FILTER (d = 2) AS n_hom_alt,
    count(*) FILTER (d = 0) AS n_hom_ref, count(*) FILTER (gt = './.') AS n_dropout"""
PEOPLE = """people AS (SELECT 'P' || CAST(n AS VARCHAR) AS sample, CASE WHEN s_suppkey % 2 = 0 THEN 'f' ELSE 'm' END AS sex, s_suppkey % 10 AS lineage,
    CASE r_name WHEN 'AFRICA' THEN 'AFR' WHEN 'AMERICA' THEN 'AMR' WHEN 'ASIA' THEN 'EAS' WHEN 'EUROPE' THEN 'EUR' ELSE 'SAS' END AS super_pop
    FROM (SELECT s_suppkey, s_nationkey, s_suppkey % 100 AS n FROM supplier) s JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE s_suppkey = (SELECT min(t.s_suppkey) FROM supplier t WHERE t.s_suppkey % 100 = s.n))"""
P = "p_partkey"
SITES = f"""sites AS (SELECT p_partkey AS site, {chrom(P)} AS chrom, {pos(P)} AS pos, {ref(P)} AS ref, {alt(P)} AS alt, CASE WHEN p_partkey % 5 = 0 THEN 'rs' || CAST(p_partkey AS VARCHAR) ELSE '.' END AS id FROM part)"""
CATALOGUE = f"""cat AS (SELECT p_partkey AS ord, {chrom(P)} AS chrom, CASE WHEN p_partkey % 3 = 2 THEN {pos(P)} + 1 ELSE {pos(P)} END AS pos, {ref(P)} AS ref,
    CASE WHEN p_size % 7 = 0 THEN 'A,G' WHEN p_size % 11 = 0 THEN '.' WHEN p_partkey % 3 = 1 THEN 'N' ELSE {alt(P)} END AS alt,
    CASE WHEN p_partkey % 4 = 0 THEN 'rs' || CAST(p_partkey AS VARCHAR) || ';x' WHEN p_partkey % 4 = 1 THEN CAST(p_partkey AS VARCHAR) ELSE '.' END AS id,
    CASE WHEN p_partkey % 8 = 2 THEN CAST(p_partkey AS VARCHAR) || ',9' WHEN p_partkey % 8 = 3 THEN 'rs' || CAST(p_partkey AS VARCHAR) END AS info_rs,
    CASE WHEN p_size % 5 = 0 THEN 'Pathogenic|Likely_pathogenic' WHEN p_size % 5 = 1 THEN 'Benign, Likely_benign' WHEN p_size % 5 = 2 THEN 'Pathogenic' ELSE 'Uncertain_significance' END AS clnsig,
    'disease=' || p_brand || '; type ' || p_type AS clndn, p_size, p_retailprice FROM part)"""
SEGMENTS = """segments AS (SELECT person, CASE WHEN rn % 40 < 20 THEN '1' ELSE '2' END AS chrom, (rn - 1) * 10000 AS "start", rn * 10000 - CASE WHEN event_id % 17 = 0 THEN 500 ELSE 0 END AS "end",
    CASE length(event_type) % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'SAS' ELSE 'AFR' END AS hap1_pop, CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'SAS' ELSE 'AFR' END AS hap2_pop
    FROM (SELECT *, user_id % 50 AS person, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS rn FROM events))"""
ORD = "CASE WHEN {c} = 'X' THEN 23 WHEN {c} = 'Y' THEN 24 WHEN {c} = 'MT' THEN 25 ELSE CAST({c} AS BIGINT) END"
#: The reference base at a position, N now and then.
BASE = "CASE WHEN ({p}) % 101 = 0 THEN 'N' ELSE substr('ACGT', ({p}) % 4 + 1, 1) END"
#: GRCh38 pseudo-autosomal regions.
PAR = "(({c} = 'X' AND ({p} BETWEEN 10001 AND 2781479 OR {p} BETWEEN 155701383 AND 156030895)) OR ({c} = 'Y' AND ({p} BETWEEN 10001 AND 2781479 OR {p} BETWEEN 56887903 AND 57217415)))"
TARGETS = """targets(name, t_chrom, t_pos, t_ref, t_alt, min_af, max_af) AS (VALUES {rows})"""


def par(c: str = "chrom", p: str = "pos") -> str:
    return PAR.format(c=c, p=p)


def uniform(seed: int, stream: str, *key: str) -> str:
    return f"(CAST('0x' || substr({md5(seed, stream, *key)}, 1, 8) AS BIGINT) / 4294967296.0)"


def md5(seed: int, stream: str, *key: str) -> str:
    return f"md5('{seed}:{stream}:' || " + " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key) + ")"
