"""Encoding with a tokenizer file, fast: texts are cut into pieces by array operations, and each distinct piece meets the tokenizer once."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

from .common import as_bytes, once, slices

#: Pieces that a worker remembers in each of two generations, and the longest that it remembers: some 50 MB in all.
CACHED_PIECES, LONGEST_PIECE = 120_000, 48
#: Bytes of text that are cut at once; the arrays for it take about 15 times as much.
SLICE_BYTES = 1 << 21
#: Pre-tokenizers of the two public files, which ``starts`` follows within plain text.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What may follow an apostrophe in a piece of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, DIGIT, SIGN, BLANK, ODD = range(5)


def byte_kinds() -> np.ndarray:
    """Kinds of UTF-8 bytes. The letters of two bytes up to U+017F count; bytes of all else beyond printable ASCII and line ends are odd."""
    kinds = np.full(256, ODD, np.uint8)
    kinds[32:127] = SIGN
    kinds[[10, 32]] = BLANK
    kinds[48:58] = DIGIT
    for letters in (slice(65, 91), slice(97, 123), slice(0x80, 0xC0), slice(0xC3, 0xC6)):
        kinds[letters] = LETTER
    return kinds


KINDS = byte_kinds()
#: Of two-byte characters up to U+017F those that aren't letters, or change otherwise than alone when lower-cased: multiplication, division, dotted I.
ODD_PAIRS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}


def at_next(flags: np.ndarray) -> np.ndarray:
    return np.r_[flags[1:], False]


def starts(raw: np.ndarray, first: np.ndarray, word_level: bool) -> np.ndarray:
    """Where pieces begin, as flags. ``raw``: bytes of plain texts in a row; ``first``: flags of the texts' first bytes.

    Runs of letters, digits and signs are pieces (single digits, on the word level);
    an apostrophe that begins a run and one of ``CONTRACTIONS`` are one. On the byte
    level the last blank of a run before a text goes on stands alone, or if it is a space
    with what follows.
    """
    kind = KINDS[raw]
    out = first | np.r_[True, kind[1:] != kind[:-1]]
    if word_level:
        out |= kind == DIGIT
    else:
        last = (kind == BLANK) & at_next((kind != BLANK) & ~first)
        out |= last
        out[np.flatnonzero(last & (raw == 32)) + 1] = False
    marks = np.flatnonzero((raw == 39) & out)
    if len(marks):
        room = np.searchsorted(np.flatnonzero(first), marks, "right")
        ends = np.r_[np.flatnonzero(first), len(raw)][room]
        letters = np.r_[raw | 32 if word_level else raw, 0, 0]
        for tail in CONTRACTIONS:
            fits = marks + len(tail) < ends
            for i, letter in enumerate(tail, 1):
                fits &= letters[marks + i] == ord(letter)
            found = marks[fits]
            out[found + 1] = False
            after = found + 1 + len(tail)
            out[after[after < len(raw)]] = True
    return out


class Encoder:
    """``encode(text)`` and ``encode_all(texts)``: ids as the tokenizers library gives them with add_special_tokens=False.

    Texts of letters up to U+017F, digits, printable signs, spaces and line ends are cut
    into the pre-tokenizer's pieces; each distinct piece of a slice of texts goes once through the tokenizer's
    model or comes from a cache of bounded size. Texts with other characters or with what
    may be a special token, and tokenizers of another kind, take the library's whole path.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        split = [x.get("pattern", {}).get("Regex") for x in pre.get("pretokenizers", [])]
        self.word_level = WORD_LEVEL in split
        # the first two signs of special tokens, by which texts that may hold one are told
        self.marks = {x.content[:2].encode() for x in self.tokenizer.get_added_tokens_decoder().values()}
        told = all(len(m) == 2 and not m.isalnum() for m in self.marks)
        self.fast = told and (self.word_level or pre == BYTE_LEVEL and not kind.get("normalizer"))
        self.letters = byte_letters()
        self.mapped_space = chr(self.letters[32])
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.recent) + len(pieces) > CACHED_PIECES:
            self.older, self.recent = self.recent, {}
        out = list(map(self.recent.get, pieces))
        unmet = [i for i, x in enumerate(out) if x is None]
        met = list(map(self.older.get, [pieces[i] for i in unmet]))
        new = [i for i, x in zip(unmet, met, strict=True) if x is None]
        if new:
            texts = [pieces[i].decode() for i in new]
            if self.word_level:
                texts = [x.lower() for x in texts]
            mapped = [x.encode().decode("latin-1").translate(self.letters) if not x.isascii() or "\n" in x else x.replace(" ", self.mapped_space) for x in texts]
            found = list(map(self.model.tokenize, mapped))
            ends = (np.cumsum([len(x) for x in found]) * self.dtype.itemsize).tolist()
            ids = np.array([t.id for x in found for t in x], self.dtype).tobytes()
            own = iter([ids[a:b] for a, b in zip([0, *ends], ends)])
            met = [next(own) if x is None else x for x in met]
        for i, x in zip(unmet, met, strict=True):
            out[i] = x
        short = ((p, x) for p, x in zip([pieces[i] for i in unmet], met, strict=True) if len(p) <= LONGEST_PIECE)
        self.recent.update(islice(short, CACHED_PIECES - len(self.recent)))
        return out

    def odd(self, raw: np.ndarray) -> np.ndarray:
        """Places of bytes that need the library's whole path."""
        found = KINDS[raw] == ODD
        for a, b in (*ODD_PAIRS, *self.marks):
            found[:-1] |= (raw[:-1] == a) & (raw[1:] == b)
        return np.flatnonzero(found)

    def slice(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each of some texts, none of them null."""
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if ends[0] == ends[-1]:
            return [np.empty(0, self.dtype)] * len(texts)
        raw, ends = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(ends, self.odd(raw), "right") - 1] = True
        if whole.any():
            raw = raw[np.repeat(~whole, np.diff(ends))]
        sizes = np.where(whole, 0, np.diff(ends))
        ends = np.r_[0, np.cumsum(sizes)]
        begin = ends[:-1][sizes > 0]
        ids, text_ends = np.empty(0, self.dtype), np.zeros(len(ends), np.int64)
        if len(raw):
            first = np.zeros(len(raw), bool)
            first[begin] = True
            cut = np.flatnonzero(starts(raw, first, self.word_level)).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(np.r_[cut, np.int32(len(raw))].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
            if self.word_level:
                own = KINDS[raw[cut]] != BLANK
                pieces, cut = pieces.filter(pa.array(own)), cut[own]
            coded = pieces.dictionary_encode()
            known = self.of_pieces(as_bytes(coded.dictionary))
            flat = np.frombuffer(b"".join(known), self.dtype)
            n = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
            code = coded.indices.to_numpy(zero_copy_only=False)
            each = n[code]
            after = np.cumsum(each)
            ids = flat[np.repeat((np.cumsum(n) - n)[code] - after + each, each) + np.arange(int(after[-1]) if len(after) else 0)]
            text_ends = np.r_[0, after][np.searchsorted(cut, ends)]
        return [self.whole(texts[i].as_py()) if whole[i] else ids[text_ends[i] : text_ends[i + 1]] for i in range(len(texts))]

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in turn; a null counts as empty."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.fast:
            yield from (self.whole(x.as_py()) for x in texts)
            return
        for part in slices(texts, SLICE_BYTES):
            yield from self.slice(part)

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.string())))


def encoder(path: str) -> Encoder:
    """This process's encoder of a file: a worker that is used again keeps what it has learned."""
    return once(("encoder", path), lambda: Encoder(path))
