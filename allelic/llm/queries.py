"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import ann, exact_dedup, mixing, near_dedup, packing, preferences, quality, sharding, token_files, toxicity
from .common import BROADCAST_IDS, crc32_of_id, new_path, save, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), exact_dedup.DigestIndex(spark))


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc32_of_id("doc_id") % 5 == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 k and 2 k + 1 make pair k, the first chosen; spans are written begin-end, joined by commas."""
    c = table(spark, sf_dir, "conversations")
    turns = c.withColumns({"pair_id": F.floor(F.col("conv_id") / 2).cast("long"), "chosen": F.pmod("conv_id", F.lit(2)) == 0})
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return preferences.format_pairs(turns).withColumns({x: text(x) for x in ("chosen_spans", "rejected_spans")})


#: Weights of the languages, taken as domains, that the mixing query aims at.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, with their language as the domain. The ids of labels are few beside the texts, which stay in place unless there are over BROADCAST_IDS."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain"))
    ids = save(table(spark, sf_dir, "labels").select("doc_id").distinct(), "labelled-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def op7_mix_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), TARGETS)
    return out.select("doc_id", "n_tokens", *[F.round(F.col("p")[i], 6).alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))], F.round("rate", 6).alias("rate"), "copies")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc32_of_id("doc_id") % 4 == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, path, with_ids=False)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest is taken of the packed ids."""
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=0, length=2048)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {f.__name__: f for f in (op1_shard_documents, op2_exact_dedup, op3_nearest_vectors, op4_toxicity, op5_near_dedup, op6_preference_pairs, op7_mix_domains, op8_quality, op9_token_files, op10_best_fit_packing)}

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM n""",
    "op5_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS d, doc_id AS z FROM documents UNION SELECT e.b, r.z FROM r JOIN e ON e.a = r.d WHERE r.z < e.b),
        m AS (SELECT d, min(z) AS z FROM r GROUP BY d)
        SELECT t.doc_id, coalesce(c.n, 0) AS n_shingles, m.z AS component_id, t.doc_id = m.z AS kept
        FROM documents t JOIN m ON m.d = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id""",
    "op6_preference_pairs": r"""
        WITH g AS (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id,
                coalesce(list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, role, text) FILTER (conv_id % 2 = 0), []) AS c,
                coalesce(list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, role, text) FILTER (conv_id % 2 <> 0), []) AS r
            FROM conversations GROUP BY 1),
        f AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, greatest(len(c), len(r)) + 1), lambda i: coalesce(c[i] = r[i], false)), false), 0) - 1, len(c)) AS k FROM g),
        s AS (SELECT pair_id, k, c[1:k] AS p, c[k + 1:] AS c, r[k + 1:] AS r FROM f),
        w AS (SELECT *, list_transform(c, lambda t: length(t.role) + length(t.text) + 13) AS cl, list_transform(r, lambda t: length(t.role) + length(t.text) + 13) AS rl FROM s),
        o AS (SELECT *, list_transform(range(1, len(c) + 1), lambda i: coalesce(list_sum(cl[1:i]), 0)) AS ce, list_transform(range(1, len(r) + 1), lambda i: coalesce(list_sum(rl[1:i]), 0)) AS re FROM w)
        SELECT pair_id, CAST(k AS INTEGER) AS prefix_turns,
            array_to_string(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS prompt,
            array_to_string(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS chosen,
            array_to_string(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS rejected,
            array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: CAST(CAST(ce[i] AS BIGINT) - length(c[i].text) - 8 AS VARCHAR) || '-' || CAST(CAST(ce[i] AS BIGINT) AS VARCHAR)), ',') AS chosen_spans,
            array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: CAST(CAST(re[i] AS BIGINT) - length(r[i].text) - 8 AS VARCHAR) || '-' || CAST(CAST(re[i] AS BIGINT) AS VARCHAR)), ',') AS rejected_spans
        FROM o""",
}
