"""Encoding, token files and packing against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from allelic.llm import packing, token_files
from allelic.llm.queries import tokenizer
from allelic.llm.tokens import Encoder

from .helpers import TEXTS, documents

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def plain(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_the_library(name):
    encoder, want = Encoder(tokenizer(name)), plain(name)
    rng = random.Random(3)
    signs = ["a", "B", "é", "Ö", "ß", "œ", "ı", " ", " ", "\n", "'s", "'", "12", "3", ".", ",", "!!", "_", "&%", "|", "\t", "²", "日", "é", "µ", " "]
    signs += ["<|", "<|endoftext|>", "\n\n", "  ", "'ll", "'S", "ž"]
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text in texts:
        assert encoder.encode(text).tolist() == want(text), text
    together = encoder.encode_all(pa.array(texts * 2, pa.string()))
    assert [x.tolist() for x in together] == [want(x) for x in texts * 2]


@pytest.mark.parametrize("name", FILES)
def test_common_texts_need_no_whole_path(name, monkeypatch):
    """Texts are cut together with their neighbours, so what ends one must not reach into the next."""
    encoder, want = Encoder(tokenizer(name)), plain(name)
    monkeypatch.setattr(encoder, "whole", None)
    rng = random.Random(5)
    signs = ["a", "Bc", "é", " ", " ", "\n", "'s", "'", "'re", "'t", "12", "3", ".", ",", "!!", "\n\n", "  "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(9))) for _ in range(4000)]
    assert [x.tolist() for x in encoder.encode_all(pa.array(texts))] == [want(x) for x in texts]


@pytest.mark.parametrize("name", FILES)
def test_strings_of_special_tokens_are_these_tokens(name):
    encoder, want = Encoder(tokenizer(name)), plain(name)
    for text in ("it's <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|startoftext|>", "a <| b"):
        assert encoder.encode(text).tolist() == want(text)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr("allelic.llm.tokens.CACHED_PIECES", 30)
    encoder, want = Encoder(tokenizer(FILES[0])), plain(FILES[0])
    for text in TEXTS:
        assert encoder.encode(text).tolist() == want(text)
    assert len(encoder.recent) <= 30 and len(encoder.older) <= 30


@pytest.mark.parametrize("counts", [[0, 5, 0], [1, 1], [2**i for i in range(40)], list(range(1, 3000)), [1] * 5000])
def test_codes(counts):
    counts = np.array(counts)
    lengths = token_files.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= token_files.LIMIT
    assert sum(2.0 ** -int(n) for n in lengths if n) <= 1
    used = np.flatnonzero(counts)
    ids = np.random.default_rng(1).choice(used, 3000).astype(np.uint32)
    codes = token_files.canonical_codes(lengths)
    bits, checkpoints = token_files.pack_bits(ids, lengths, codes)
    assert token_files.Decoder(lengths).decode(bits, checkpoints, len(ids)).tolist() == ids.tolist()


def test_lengths_are_optimal():
    import heapq

    counts = np.random.default_rng(5).integers(1, 1000, 300)
    heap, total = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        heapq.heappush(heap, (x := heapq.heappop(heap) + heapq.heappop(heap)))
        total += x
    assert int((token_files.code_lengths(counts).astype(int) * counts).sum()) == total


@pytest.mark.parametrize("texts", [TEXTS, [], TEXTS * 40])
def test_files(spark, tmp_path, texts, monkeypatch):
    docs = documents(spark, texts).repartition(3)
    token_files.write(docs, f"file://{tmp_path}/f", tokenizer(FILES[0]), 2)
    got = sorted(token_files.read(spark, f"file://{tmp_path}/f").collect())
    want, start = plain(FILES[0]), 0
    assert len(got) == len(texts)
    for r, text in zip(got, texts, strict=True):
        ids = np.array([*want(text), 2], "<u4")
        assert (r["start"], r["n_tokens"], bytes(r["ids"]), r["ids_crc32"]) == (start, len(ids), ids.tobytes(), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(200):
        length = rng.randrange(5, 60)
        counts = Counter(rng.randrange(1, length + 1) for _ in range(rng.randrange(200)))
        runs, used = packing.plan(counts, length)
        free = []
        for size in sorted(counts.elements(), reverse=True):
            fit = min((f, i) for i, f in enumerate([*free, 10**6]) if f >= size)[1]
            if fit == len(free):
                free.append(length)
            free[fit] -= size
        assert used == len(free)
        taken, ranks = defaultdict(list), defaultdict(list)
        for size, first, after, sequence, offset in runs:
            for i in range(after - first):
                taken[sequence + i].append((offset, size))
                ranks[size].append(first + i)
        assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
        for places in taken.values():
            at = 0
            for offset, size in sorted(places):
                assert offset == at
                at += size
            assert at <= length


@pytest.mark.parametrize("texts", [TEXTS, [], TEXTS * 20])
def test_pack(spark, texts):
    got = packing.pack(documents(spark, texts), tokenizer(FILES[1]), length=64).collect()
    want = plain(FILES[1])
    ids = {i: np.array([*want(t), 0], "<u4") for i, t in enumerate(texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], bytes(r["ids"])))
        assert r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: b"".join(p for _, _, p in sorted(x)) for d, x in pieces.items()} == {d: x.tobytes() for d, x in ids.items()}
    for x in pieces.values():
        assert [(p, s) for p, s, _ in sorted(x)] == [(i, 64 * i) for i in range(len(x))]
    for x in sequences.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 64
    assert not texts or len(sequences) <= 1.05 * sum(map(len, ids.values())) / 64 + 1
