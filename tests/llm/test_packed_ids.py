"""The packing query and stage produce the ids themselves."""

import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from allelic.llm import packing, queries

from .helpers import TEXTS, documents
from .test_tokens import plain


def held(rows):
    """Ids of each document, end to end, from the packed rows."""
    pieces, want = defaultdict(list), plain("word_bpe_49k.json")
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], bytes(r["ids"])))
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in pieces.items()} == {i: np.array([*want(t), 0], "<u4").tobytes() for i, t in enumerate(TEXTS)}


def test_the_pipeline_ends_with_ids(spark):
    held(corpus_pipeline.pack_sequences(spark, documents(spark), "").collect())


def test_the_query_digests_packed_ids(spark, tmp_path, monkeypatch):
    documents(spark).drop("rank", "digest").write.parquet(f"{tmp_path}/documents.parquet")
    made, pack = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **b: made.append(pack(*a, **b)) or made[0])
    out = queries.op10_best_fit_packing(spark, str(tmp_path))
    assert sorted(out.columns) == sorted(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    held(made[0].collect())
    key = lambda r: (r["doc_id"], r["piece"])
    assert {key(r): r["ids_crc32"] for r in out.collect()} == {key(r): zlib.crc32(r["ids"]) for r in made[0].collect()}
