"""Sharding, exact dedup and near-dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from allelic.llm import exact_dedup, near_dedup, sharding

from .helpers import TEXTS, brute_components, documents


def test_free_space_gives_the_tightest_bin():
    rng, tree, bins = random.Random(1), sharding.FreeSpace(), []
    for i in range(500):
        bins.append((rng.randrange(1, 200), i))
        tree.put(*bins[-1])
        if rng.random() < 0.6:
            size = rng.randrange(1, 250)
            fit = min((b for b in bins if b[0] >= size), default=None)
            assert tree.take(size) == fit
            if fit:
                bins.remove(fit)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    sizes = Counter(rng.randrange(1, 60) for _ in range(400))
    runs, bins = sharding.plan(sizes.items(), 100)
    free = []
    for size in sorted(sizes.elements(), reverse=True):
        fit = min((f, i) for i, f in enumerate([*free, 10**6]) if f >= size)[1]
        if fit == len(free):
            free.append(100)
        free[fit] -= size
    assert bins == len(free)
    used = defaultdict(int)
    for size, first, after, bin_ in runs:
        used[bin_] += size * (after - first)
    assert sorted(used.values()) == sorted(100 - f for f in free)


@pytest.mark.parametrize("texts", [TEXTS * 3, [], ["same"] * 50 + ["other " * i for i in range(200)]])
def test_shards(spark, texts):
    docs = documents(spark, texts)
    got = sharding.shard(docs, shards=5).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    shards, slots = defaultdict(set), defaultdict(list)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode()) and 0 <= r["shard"] < 5
        shards[text].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_near_equal_beside_an_oversized_group(spark):
    texts = ["hot " * 50] * 400 + ["x" * (i % 97) for i in range(3000)]
    sizes = defaultdict(int)
    for r in sharding.shard(documents(spark, texts), shards=8).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8
    rest = sorted(sizes.values())[:-1]
    assert rest[-1] < 1.25 * rest[0]


def test_capacity(spark):
    sizes = defaultdict(int)
    for r in sharding.shard(documents(spark, ["x" * (i % 50) for i in range(500)]), capacity=3000).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= 3000


def spaced(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_dedup_in_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=3)
    first, second = TEXTS + TEXTS[:5], TEXTS[3:] + ["new", "new"]
    for batch, start, known in ((first, 0, []), (second, 100, first)):
        got = {r["doc_id"]: r for r in exact_dedup.dedup(documents(spark, batch, start), index).collect()}
        texts = [spaced(t) for t in batch]
        before = [spaced(t) for t in known]
        assert len(got) == len(batch)
        for i, t in enumerate(texts):
            r = got[start + i]
            keep = before.index(t) if t in before else start + texts.index(t)
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, texts.count(t), keep == start + i)
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert index.table().count() == len({spaced(t) for t in first + second})
    # another session would open it by its path
    spark.sql(f"DROP TABLE {index.name}")
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=3)
    assert not any(r["kept"] for r in exact_dedup.dedup(documents(spark, first, 500), again).collect())
    assert exact_dedup.dedup(documents(spark, []), again).count() == 0


def variants(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("words", [2, 5])
def test_near_groups(spark, words):
    rng = random.Random(words)
    texts = list(TEXTS)
    for edits in (3, 8, 16):  # around the threshold: links don't carry over
        texts += variants(rng, [f"b{edits}x{i}" for i in range(100)], 60, edits)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(100)] + ["a b", "a b", "b a", "x y z", "x y z w"]
    rng.shuffle(texts)
    docs = documents(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs, words).collect()}
    assert got == brute_components(enumerate(texts), words, 80)


def test_near_groups_of_little(spark):
    assert near_dedup.near_groups(documents(spark, [])).count() == 0
    got = near_dedup.near_groups(documents(spark, [None, "", "one text here", None])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(i, i, True) for i in range(4)]


def test_long_chain(spark):
    words = [f"c{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 300, 3)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(documents(spark, texts), 2).collect()}
    assert got == brute_components(enumerate(texts), 2, 80)
    assert {c for _, c in got.values()} == {0}


@pytest.mark.parametrize(("words", "percent", "members"), [(2, 80, 32), (2, 80, 1), (3, 60, 32)])
def test_near_groups_of_one_large_family(spark, monkeypatch, words, percent, members):
    """Copies of copies, many of them just below the threshold, in the same buckets: no link is lost, few pairs are formed."""
    rng = random.Random(words + percent)
    base = [f"b{i}" for i in range(120)]
    texts = [*variants(rng, base, 250, 24), *variants(rng, base + base[:30], 60, 20)]
    for parent in rng.sample(texts, 25):
        texts += variants(rng, parent.split(), 4, 5)
    texts += [" ".join(base[i : i + 100]) for i in range(20)] + TEXTS
    rng.shuffle(texts)
    formed = []
    left_over = near_dedup.left_over
    monkeypatch.setattr(near_dedup, "CORE_MEMBERS", members)
    monkeypatch.setattr(near_dedup, "left_over", lambda *a: formed.append(left_over(*a)) or formed[0])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(documents(spark, texts), words, percent).collect()}
    assert got == brute_components(enumerate(texts), words, percent)
    assert len({c for _, c in got.values()}) > 20
    assert members == 1 or formed[0].count() < 15 * len(texts)  # a core of one member fits badly
