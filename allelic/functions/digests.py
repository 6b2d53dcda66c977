"""First words of the md5 of many short keys at once, by numpy; sent to the executors by value."""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a message that fits one block, and keys that are hashed together: what is worked on stays in a core's cache.
ONE_BLOCK, TOGETHER = 55, 1 << 14


def first_words(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first four bytes of the md5 of ``n`` messages of one block, as big-endian numbers. ``words``: the block's 16 words, each one for all messages or an array."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps don't change the first word
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        if isinstance(words[g], np.ndarray):
            f += words[g]
            f += np.uint32(ADDED[i])
        else:
            f += np.uint32((ADDED[i] + words[g]) & 0xFFFFFFFF)
        f += a
        np.left_shift(f, np.uint32(TURNS[i]), out=t)
        f >>= np.uint32(32 - TURNS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(START[0])
    return b.byteswap()


def blocks(texts: list[bytes], at: int, end: bool) -> np.ndarray:
    """The 16 words of a block with each text (all of one length) at byte ``at``, and the block's end after it if ``end``: an array of 16 rows."""
    n = len(texts[0])
    raw = np.zeros((len(texts), 64), np.uint8)
    raw[:, at : at + n] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), n)
    if end:
        raw[:, at + n] = 0x80
        raw[:, 56], raw[:, 57] = (at + n) * 8 & 255, (at + n) * 8 >> 8
    return np.ascontiguousarray(raw.view("<u4").T)


def low_pairs(head: str, firsts: np.ndarray, seconds: np.ndarray, bins: list[tuple[int, int]], limits: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Of pairs (p1, p2) whose distance is in one of the ``bins`` (from low to before high), those for which the first word of md5(head p1:p2) is below the bin's limit: p1, and its p2."""
    seconds = np.sort(seconds)
    texts = [b"%d" % p for p in seconds.tolist()]
    sizes = np.array([len(x) for x in texts])
    lengths = np.unique(sizes).tolist()
    kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    held: dict[tuple[int, int], list[tuple]] = {}
    count: dict[tuple[int, int], int] = {}
    used: dict[tuple[int, int], list[int]] = {}
    # bins that follow one another and have a limit are taken together
    runs: list[tuple[list[int], list[int]]] = []
    for (low, high), limit in zip(bins, limits, strict=True):
        if limit and runs and runs[-1][0][-1] == low:
            runs[-1][0].append(high)
            runs[-1][1].append(limit)
        elif limit:
            runs.append(([low, high], [limit]))
    marks = [(np.array(edges), np.array(under, np.uint64)) for edges, under in runs]

    def tell(key: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
        parts, words = held.pop(key), kept[key][1]
        count[key] = 0
        n = sum(len(p2) for _, _, _, p2, _ in parts)
        told: list[np.ndarray | int] = []
        for g in range(16):
            if g in used[key] or any(w[g] for _, w, _, _, _ in parts):
                told.append(np.concatenate([words[g][a:b] | w[g] for _, w, (a, b), _, _ in parts]))
            else:
                told.append(0)
        low = first_words(told, n) < np.concatenate([x for *_, x in parts])
        at = 0
        for p1, _, _, p2, _ in parts:
            if (found := p2[low[at : at + len(p2)]]).size:
                yield p1, found
            at += len(p2)

    for p1 in firsts.tolist():
        start = f"{head}{p1}:".encode()
        own_words = blocks([start], 0, False)[:, 0] if len(start) < ONE_BLOCK else None
        for size in lengths:
            key = (len(start), size)
            if sum(key) > ONE_BLOCK:
                for p2 in seconds[sizes == size].tolist():
                    word = int.from_bytes(hashlib.md5(start + b"%d" % p2).digest()[:4], "big")
                    if any(low <= p2 - p1 < high and word < limit for (low, high), limit in zip(bins, limits, strict=True)):
                        yield p1, np.array([p2])
                continue
            if key not in kept:
                own = np.flatnonzero(sizes == size)
                kept[key] = seconds[own], blocks([texts[i] for i in own.tolist()], len(start), True)
                used[key] = np.flatnonzero(kept[key][1].any(axis=1)).tolist()
            places = kept[key][0]
            for edges, under in marks:
                cuts = np.searchsorted(places, p1 + edges)
                below = np.repeat(under, np.diff(cuts))
                first = int(cuts[0])
                for c in range(0, len(below), TOGETHER):
                    some = below[c : c + TOGETHER]
                    span = (first + c, first + c + len(some))
                    held.setdefault(key, []).append((p1, own_words, span, places[slice(*span)], some))
                    count[key] = count.get(key, 0) + len(some)
            if count.get(key, 0) >= TOGETHER:
                yield from tell(key)
    for key in list(held):
        yield from tell(key)


def low_sites(batches: Iterator[pa.RecordBatch], start: str, bins: list[tuple[int, int]], limits: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (chrom, p1, p2) of the low pairs of each row's chrom, array of first and array of second places; keys are ``start``:chrom:p1:p2."""
    for batch in batches:
        for chrom, firsts, seconds in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            found = list(low_pairs(f"{start}:{chrom}:", firsts.values.to_numpy(), seconds.values.to_numpy(), bins, limits))
            if found:
                p1 = np.repeat([p for p, _ in found], [len(x) for _, x in found])
                yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(p1), pa.string()), pa.array(p1, pa.int64()), pa.array(np.concatenate([x for _, x in found]), pa.int64())], ["chrom", "p1", "p2"])
