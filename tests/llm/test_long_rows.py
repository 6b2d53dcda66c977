"""What tasks of the pipeline hold of long texts: few rows, no text beside its slices, and no deep recursion over mixed characters."""

import corpus_pipeline
from allelic.llm import mixing

NAMES = {"spark.sql.parquet.columnarReaderBatchSize": "4096", "parquet.page.size.row.check.min": "100"}


def model(spark):
    return mixing.DomainModel(spark.createDataFrame([(1, "und der", "de"), (2, "and the", "en")], "doc_id long, text string, domain string"), ["de", "en"])


def test_no_text_beside_its_slices(spark):
    docs = spark.createDataFrame([(7, "and der")], "doc_id long, text string")
    plan = model(spark).posteriors(docs)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    sliced = [x for x in plan if "Generate posexplode" in x]
    assert len(sliced) == 1 and "text#" not in sliced[0]


def test_long_texts_of_mixed_characters(spark):
    texts = ["ab \U0001f600 cd " * 20_000, "\U0001f600a" * 60_000, "z" * 200_000 + " \U0001f600"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert docs.select(mixing.slices_of().alias("s")).selectExpr("array_join(s, '') AS t").toPandas()["t"].tolist() == texts
    assert {r["doc_id"]: r["n_tokens"] for r in model(spark).posteriors(docs).collect()} == {i: len(t.split()) for i, t in enumerate(texts)}


def test_stages_hold_few_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    before = {k: spark.conf.get(k, None) for k in NAMES}
    try:
        for k, v in NAMES.items():
            spark.conf.set(k, v)
        assert corpus_pipeline.drop_copies(spark, docs, str(tmp_path)).count() == 1
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 32 and spark.conf.get("parquet.page.size.row.check.min") == "1"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
