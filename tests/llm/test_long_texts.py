"""Mixing of texts that are far longer than what may be held as words at once."""

from pyspark.sql import functions as F

from allelic.llm import mixing

WORDS = {"de": "und der die das", "en": "and the of to"}
#: Many words, odd spaces where slices may end, one word over several slices, and spaces alone.
LONG = [WORDS["de"].replace(" ", " \n\t ") + f" {WORDS['de']} x" * 30_000, f"{WORDS['en']}\r\n" * 30_000 + "z" * 200_000 + " end", " " * 200_000]


def tables(spark):
    rows = [(i, t, None) for i, t in enumerate([*LONG, None, "", "the end"])] + [(0, LONG[0], None)]
    rows += [(100 + 2 * i + j, f"{WORDS[d]} {i}", d) for i in range(40) for j, d in enumerate(WORDS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string").repartition(3)
    return docs.select("doc_id", "text"), docs.filter("domain is not null or doc_id < 2").withColumn("domain", F.coalesce("domain", F.when(F.col("doc_id") == 0, "de").otherwise("en")))


def scored(spark):
    docs, labelled = tables(spark)
    return sorted((r["doc_id"], r["n_tokens"], tuple(r["p"])) for r in mixing.DomainModel(labelled, ["de", "en"]).posteriors(docs).collect())


def test_few_words_are_held_at_once(spark, monkeypatch):
    plain = mixing.words_of
    few = lambda *a: F.when(F.size(plain(*a)) > 40_000, F.raise_error(F.lit("too many words at once")).cast("array<string>")).otherwise(plain(*a))
    monkeypatch.setattr(mixing, "words_of", few)
    found = scored(spark)
    want = {r["doc_id"]: len((r["text"] or "").split()) for r in tables(spark)[0].collect()}
    assert [d for d, _, _ in found] == [0, *sorted(want)]
    assert all(n == want[d] for d, n, _ in found)
    monkeypatch.setattr(mixing, "words_of", plain)
    monkeypatch.setattr(mixing, "SLICE_CHARS", 1 << 30)
    assert found == scored(spark)


def test_few_rows_are_read_at_once(spark, monkeypatch):
    name, seen, model = "spark.sql.parquet.columnarReaderBatchSize", [], mixing.DomainModel
    monkeypatch.setattr(mixing, "DomainModel", lambda *a: seen.append(int(spark.conf.get(name))) or model(*a))
    before = spark.conf.get(name)
    docs, labelled = tables(spark)
    assert mixing.mix(docs, labelled, {"de": 1.0, "en": 1.0}).count() == docs.count()
    assert seen[0] <= 32 and spark.conf.get(name) == before
