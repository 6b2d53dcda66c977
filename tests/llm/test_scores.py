"""Search, classifiers, mixing, preference pairs and the pipeline against brute force or held-out truth."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from allelic.llm import ann, mixing, preferences, quality, toxicity
from allelic.llm.queries import QUERIES, tokenizer

from .helpers import TEXTS, brute_components, documents


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block int, chunk int")


def brute_neighbours(rows, k, every):
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, v in sound:
        if i % every == 0:
            out[i] = sorted(((float(v @ w), j) for j, w in sound if j != i), key=lambda x: (-x[0], x[1]))[:k]
    return out


def test_neighbours_are_exact_at_a_whole_share(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(1000 + i, [1.0] * 8) for i in range(45)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [float("inf")] * 8), (2080, [None] * 8), (2100, [1.0])]
    rows = [*rows[:-1], (None, [1.0] * 8), rows[-1]]
    got = defaultdict(list)
    for r in ann.neighbours(vectors(spark, [(i, v, 0, 7, 7) for i, v in rows]), reranked=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = brute_neighbours(rows[:-2], 20, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for _, j in got[q]] == [j for _, j in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12)


def test_neighbours_of_none(spark):
    assert ann.neighbours(vectors(spark, [])).count() == 0
    assert ann.neighbours(vectors(spark, [(0, [1.0, 2.0], 0, 0, 0)])).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(9000, 32))
    v[:2500] = rng.normal(size=32) * 3 + 0.05 * v[:2500]  # a third are close to each other
    rows = [(i, [float(x) for x in w]) for i, w in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))]
    index = ann.PermutationIndex(vectors(spark, [(i, w, 0, 0, 0) for i, w in rows]))
    assert sum(1 for _ in index.blocks.select("block").collect()) == 2
    got = defaultdict(set)
    for r in index.search(index.rows.filter("vec_id % 100 = 0"), 20).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = brute_neighbours(rows, 20, 100)
    assert sum(len(got[q] & {j for _, j in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_preference_model_orders_pairs():
    rng = np.random.default_rng(3)
    true = rng.normal(size=5)
    x, y = rng.normal(size=(4000, 5)), rng.normal(size=(4000, 5))
    wins = rng.random(4000) < 1 / (1 + np.exp(-(x - y) @ true))
    w = quality.fit_preferences(np.where(wins[:, None], x, y), np.where(wins[:, None], y, x))
    assert np.allclose(w, true, atol=0.2)


def corpus(spark, n=600):
    rng = random.Random(5)
    words = [f"wo{i}rd".replace("0", "a").replace("1", "e") for i in range(3000)]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 200))]
        toxic, bad = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["vermin", "filthiest", "dolt", "Vermins!"]))
        if bad:
            own = [w.upper() + "!!" for w in own] if i % 2 else [own[0]] * len(own)
        docs.append((i, " ".join(own)))
        labels.append((i, int(not bad), int(toxic and not (bad and i % 2 == 0))))
    docs += [(n, None), (n + 1, ""), (n + 2, "x " * 50_000), (n + 3, "   ")]
    labels.append((n, None, None))
    return documents(spark, [t for _, t in docs]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, held_out):
    rows = scored.join(labels, "doc_id").filter(f"{label} is not null").filter(held_out).select("predicted", label).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_quality(spark):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels.filter("doc_id % 4 != 2"))
    out = quality.score(docs, model)
    assert out.count() == docs.count() and out.filter("score is null or score < 0 or score > 1 or predicted != cast(score >= 0.7 as int)").count() == 0
    assert accuracy(out, labels, "quality", "doc_id % 4 = 2") > 0.95


def test_toxicity(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels.filter("doc_id % 5 != 0"))
    out = toxicity.score(docs, model)
    assert out.count() == docs.count() and out.filter("score is null or score < 0 or score > 1 or predicted != cast(score >= 0.5 as int)").count() == 0
    # a toxic row written over as one repeated word keeps no sign of it
    assert accuracy(out, labels, "toxic", "doc_id % 5 = 0") > 0.95


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)], [(0, 0, 1)]])
def test_classifiers_with_few_labels(spark, labels):
    docs = documents(spark, TEXTS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for kind in (quality, toxicity):
        assert kind.score(docs, kind.fit(docs, known)).filter("score between 0 and 1").count() == len(TEXTS)
    told = {t for *_, t in labels if t is not None}
    if len(told) == 1:  # then every text scores on the side of that label
        side = toxicity.score(docs, toxicity.fit(docs, known)).select("predicted").distinct().collect()
        assert [r[0] for r in side] == [told.pop()]
    empty = documents(spark, [])
    assert quality.score(empty, quality.fit(empty, known)).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, known)).count() == 0


def test_quality_is_the_optimum_of_plain_pairs(spark):
    docs, labels = corpus(spark)
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    pairs = sorted(([*quality.measure(t), known[i]] for i, t in rows if i in known), key=lambda x: (x[-1], *reversed(x[:-1])))
    x, y = np.array([p[:-1] for p in pairs]), np.array([p[-1] for p in pairs])
    order = np.lexsort(np.c_[x, y].T)
    x, y = x[order], y[order]
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    scaled = np.clip((x - mean) / spread, -8, 8)
    drawn = np.random.default_rng(11).integers(0, int(y.sum()), (quality.PAIRS, int((y == 0).sum())))
    d = scaled[y == 1][drawn].reshape(-1, x.shape[1]) - np.tile(scaled[y == 0], (quality.PAIRS, 1))
    w, step = np.zeros(x.shape[1]), 1 / (np.linalg.eigvalsh(d.T @ d)[-1] / 4 + 1)
    while np.abs(gradient := d.T @ (1 / (1 + np.exp(d @ w))) - w).max() > 1e-7:  # plain ascent, so many steps
        w = w + step * gradient
    z = lambda f: float(np.clip((f - mean) / spread, -8, 8) @ w)
    scores, share = [z(f) for f in x], float((y == 0).mean())
    cut = np.quantile(scores, [share * 0.98, share + (1 - share) * 0.005]).mean()
    want = {i: 1 / (1 + math.exp(-max(-30.0, min(30.0, z(np.array(quality.measure(t))) - cut + math.log(0.7 / 0.3))))) for i, t in rows}
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_linear_fit_is_the_optimum():
    rng = np.random.default_rng(12)
    n, features = 800, 30
    x = (rng.random((n, features)) < np.linspace(0.02, 0.4, features)).astype(float)
    target = 1 / (1 + np.exp(-(x @ rng.normal(size=features) * 2 - 1)))
    rows, columns = np.nonzero(x)
    w, bias = toxicity.fit_linear(rows, columns, n, features, target)
    full, both, penalty = np.c_[x, np.ones(n)], np.zeros(features + 1), np.r_[np.full(features, 2.0), 0.0]
    for _ in range(50):  # Newton's method on the dense table
        p = 1 / (1 + np.exp(-full @ both))
        both = both - np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty), full.T @ (p - target) + penalty * both)
    assert np.abs(np.r_[w, bias] - both).max() < 1e-3


@pytest.mark.parametrize("kind, label, of, query", [(quality, "quality", "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2", "op8_quality"), (toxicity, "toxic", "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0", "op4_toxicity")])
def test_scores_know_no_held_out_label_and_no_partitioning(spark, tmp_path, kind, label, of, query):
    docs, labels = corpus(spark, 300)
    turned = labels.withColumn(label, F.expr(f"case when {of} then 1 - {label} else {label} end"))
    assert turned.exceptAll(labels).count() > 20
    found = []
    for name, d, known in (("as", docs.coalesce(1), labels), ("turned", docs.repartition(5), turned.repartition(3))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        known.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = QUERIES[query](spark, f"{tmp_path}/{name}").collect()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % (4 if label == "quality" else 5) == (2 if label == "quality" else 0)) for r in rows)
        found.append({r["doc_id"]: r["score"] for r in rows})
    assert found[0].keys() == found[1].keys() and all(abs(found[0][i] - s) < 1e-9 for i, s in found[1].items())


def test_label_model_weighs_correlated_voters():
    rng = np.random.default_rng(7)
    y = rng.random(4000) < 0.3
    vote = lambda p: np.where(rng.random(4000) < p, np.where(y, 1, -1), np.where(y, -1, 1))
    weak = vote(0.6)
    votes = np.stack([vote(0.9), vote(0.85), *[weak] * 6], axis=1).astype(float)
    posterior = toxicity.label_model(votes, np.where(rng.random(4000) < 0.9, y, ~y).astype(float))
    assert ((posterior > 0.5) == y).mean() > 0.95


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def test_preferences(spark):
    rows = [
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes é"), (1, True, 2, "user", "more"), (1, True, 3, "assistant", "good"),
        (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "yes é"), (1, False, 5, "assistant", "bad"), (1, False, 5, "user", None),
        (2, True, 0, "user", "only"), (3, True, 0, "user", None), (3, False, 9, "user", ""), (4, False, 0, None, "x"), (None, True, 0, "user", "lost"), (5, True, 0, "user", "a"), (5, True, 0, "user", "a"), (5, False, 0, "user", "a"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "pair_id long, chosen boolean, turn long, role string, text string, prompt string")
    got = {r["pair_id"]: r for r in preferences.format_pairs(df).collect()}
    sides = defaultdict(lambda: ([], []))
    for pair, chosen, turn, role, text in rows:
        if pair is not None:
            sides[pair][not chosen].append((turn, role or "", text or ""))
    assert got.keys() == sides.keys()
    for pair, (c, r) in sides.items():
        c, r = ([x[1:] for x in sorted(s)] for s in (c, r))
        n = next((i for i, (a, b) in enumerate(zip(c, r, strict=False)) if a != b), min(len(c), len(r)))
        row = got[pair]
        assert (row["prefix_turns"], row["prompt"], row["chosen"], row["rejected"]) == (n, render(c[:n]), render(c[n:]), render(r[n:]))
        for text, spans, turns in ((row["chosen"], row["chosen_spans"], c[n:]), (row["rejected"], row["rejected_spans"], r[n:])):
            assert [text[s["begin"] : s["end"]] for s in spans] == [f"{t}<|end|>\n" for who, t in turns if who == "assistant"]
    assert preferences.format_pairs(df.limit(0)).count() == 0


def languages(spark):
    rng = random.Random(8)
    own = {d: [f"{d}{rng.randrange(60)}" for _ in range(60)] for d in ("de", "en", "fr")}
    rows = []
    for i in range(400):
        d = rng.choices(["de", "en", "fr"], [1, 7, 2])[0]
        other = rng.choice(list(own)) if i % 10 == 0 else d
        rows.append((" ".join(rng.choice(own[d] if rng.random() < 0.6 else own[other]) for _ in range(rng.randrange(3, 80))), d))
    texts = [t for t, _ in rows] + [None, "", "unknown words"]
    labelled = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(rows) if i % 3], "doc_id long, text string, domain string")
    return documents(spark, texts), labelled, texts


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_mix(spark, least):
    docs, labelled, texts = languages(spark)
    targets = {"de": 0.3, "en": 0.3, "fr": 0.4}
    rows = mixing.mix(docs, labelled, targets, least=least).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    n = np.array([r["n_tokens"] for r in rows], float)
    assert all(r["n_tokens"] == len((texts[r["doc_id"]] or "").split()) for r in rows)
    p, rate = np.array([r["p"] for r in rows]), np.array([r["rate"] for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= least).all()
    expected, share = (rate * n) @ p, np.array([0.3, 0.3, 0.4])
    total = n.sum() if not least else (n @ p / share).max()
    assert np.allclose(expected / total, share, atol=0.002)
    assert all(math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"]) for r in rows)


def test_mix_of_targets_out_of_reach_is_least_squares(spark):
    docs, labelled, _ = languages(spark)
    rows = mixing.mix(docs, labelled, {"de": 0.001, "en": 0.001, "fr": 0.998}, tokens=50_000).collect()
    n, p, rate = np.array([r["n_tokens"] for r in rows], float), np.array([r["p"] for r in rows]), np.array([r["rate"] for r in rows])
    gradient = p @ np.linalg.solve((p * n[:, None]).T @ p, (rate * n) @ p - 50_000 * np.array([0.001, 0.001, 0.998]))
    assert (np.abs(gradient[(rate > 1e-6) & (n > 0)]) < 0.01).all() and (gradient[(rate <= 1e-6) & (n > 0)] > -0.01).all()


def test_mix_of_nothing(spark):
    docs, labelled, _ = languages(spark)
    assert mixing.mix(docs.limit(0), labelled, {"de": 1.0, "en": 1.0}).count() == 0
    twice = docs.limit(5).union(docs.limit(5))
    assert mixing.mix(twice, labelled.limit(0), {"de": 1.0, "en": 1.0}).count() == 10


def test_pipeline(spark, tmp_path):
    docs, labels = corpus(spark, 240)
    rng = random.Random(9)
    base = [r["text"] for r in docs.filter("doc_id < 40").collect()]
    more = base[:20] + [t.replace(t.split()[0], "changed", 1) for t in base[20:] if len(t.split()) > 60]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(more)]
    table = spark.createDataFrame([(i, t, rng.choice(["de", "en", "es", "fr"]), "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name in ("quality", "exact dedup", "near dedup", "mixing"):
        at = stage[name](spark, at, str(tmp_path))
        assert at.columns == table.columns
        kept.append([(r["doc_id"], r["text"]) for r in at.collect()])
    good, once, apart, mixed = kept
    first = {}
    for i, t in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert sorted(i for i, _ in once) == sorted(first.values())
    names = brute_components(once, 5, 80)
    assert sorted(i for i, _ in apart) == sorted(d for d, (_, c) in names.items() if c == d)
    assert {i for i, _ in mixed} == {i for i, _ in apart}
    packed = corpus_pipeline.pack_sequences(spark, at, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, _ in mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
    assert tokenizer("word_bpe_49k.json")
