"""MinHash near-dedup: banded candidates, odd sketches to sift them, full sets to confirm them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, drop, join_groups, save, slices, small_batches, tidied

BANDS, ROWS = 32, 4
#: MinHash values of a document for its bands.
SAMPLES = BANDS * ROWS
#: An odd sketch folds one MinHash value from each of 2 ** BIN_BITS parts of the hash space into so many bits.
BIN_BITS, SKETCH_BITS = 10, 2048
#: Standard deviations below the wanted similarity at which a sketch still leads to a full comparison.
SIGMAS = 5
#: Bytes of text that are cut into words at once.
SLICE_BYTES = 1 << 20
#: Members of a group from which its core is made, about; the result doesn't depend on it.
CORE_MEMBERS = 32
#: ASCII white space between words.
BLANKS = [32, 9, 10, 11, 12, 13]
#: Ids broadcast to pick documents; beyond, they meet in a shuffle.
BROADCAST_IDS = 4_000_000

_random = np.random.default_rng(20240607)
MULTIPLIERS = (_random.integers(0, 2**31, SAMPLES, dtype=np.uint32) * 2 + 1)[:, None]
OFFSETS = _random.integers(0, 2**32, SAMPLES, dtype=np.uint32)[:, None]
LOWER = np.r_[0:65, 97:123, 91:256].astype(np.uint8)
IS_BLANK = np.isin(np.arange(256), BLANKS)
SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<long>, n_samples long, sketch array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.StringArray) -> list[np.ndarray]:
    """Hashes of the words of each of some texts without nulls; A-Z is lower-cased, ASCII white space splits."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if ends[0] == ends[-1]:
        return [np.empty(0, np.uint64)] * len(texts)
    raw, ends = LOWER[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]], ends - ends[0]
    blank = IS_BLANK[raw]
    begin = np.r_[True, blank[1:] != blank[:-1]]
    begin[ends[:-1][np.diff(ends) > 0]] = True
    cut = np.flatnonzero(begin).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(np.r_[cut, np.int32(len(raw))].astype(np.int32)), pa.py_buffer(raw)])
    word = ~blank[cut]
    coded = runs.filter(pa.array(word)).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh64_intdigest, as_bytes(coded.dictionary)), np.uint64, len(coded.dictionary))
    hashes = known[coded.indices.to_numpy(zero_copy_only=False)]
    at = np.searchsorted(cut[word], ends)
    return [hashes[i:j] for i, j in zip(at, at[1:])]


def all_shingles(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text in turn; a null has none."""
    for part in slices(texts.cast(pa.string()).fill_null(""), SLICE_BYTES):
        for h in word_hashes(part):
            n = min(words, len(h))
            out = h[: len(h) - n + 1].copy()
            for i in range(1, n):
                out = mixed(out) + h[i : len(h) - n + 1 + i]
            yield np.unique(mixed(out + np.uint64(n))) if n else h


def min_hashes(sets: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    low = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(least, (low[None, i : i + 2048] * MULTIPLIERS + OFFSETS).min(axis=1), out=least)
    return least


def odd_sketch(sets: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of samples, and their parity bitmap.

    The samples are the least hashes of equal parts of the hash space (one-permutation
    MinHash); each flips one bit, so equal samples cancel when two sketches are XORed.
    """
    part = sets >> np.uint64(64 - BIN_BITS)
    least = sets[np.r_[True, part[1:] != part[:-1]]] if len(sets) else sets
    bit = mixed(least) % np.uint64(SKETCH_BITS)
    parity = (np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return len(least), np.packbits(parity).view(np.int64)


def band_hashes(samples: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for column in samples.reshape(BANDS, ROWS).T:
        out = mixed(out) + column.astype(np.uint64)
    return mixed(out).view(np.int64)


def signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    kind, names = pa.list_(pa.int64()), ["doc_id", "n_shingles", "digest", "bands", "n_samples", "sketch"]
    for batch in tidied(batches):
        sets = all_shingles(batch.column(1), words)
        for at in range(0, len(batch), 256):
            ids = batch.column(0).slice(at, 256)
            n, digest, bands, n_samples, sketch = [], [], [], [], []
            for s in islice(sets, len(ids)):
                held, bits = odd_sketch(s)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band_hashes(min_hashes(s)) if len(s) else [])
                n_samples.append(held)
                sketch.append(bits)
            columns = [ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, kind), pa.array(n_samples, pa.int64()), pa.array(sketch, kind)]
            yield pa.RecordBatch.from_arrays(columns, names)


def full_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in tidied(batches):
        sets = all_shingles(batch.column(1), words)
        for at in range(0, len(batch), 64):
            ids = batch.column(0).slice(at, 64)
            found = [s.view(np.int64) for s in islice(sets, len(ids))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.int64()))], ["doc_id", "shingles"])


def differing(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def close(percent: int) -> Column:
    """Whether sizes and sketches (n_a, k_a, s_a; n_b, k_b, s_b) allow a similarity of ``percent``/100.

    The XOR's population count c tells how many samples differ, d = -bits / 2 * ln(1 - 2 c / bits), and so how
    many agree, (k_a + k_b - d) / 2. A wanted pair's agreeing samples are drawn without replacement from
    its union; from their mean go SIGMAS deviations of that draw and of the bitmap's collisions.
    """
    t, bits = percent / 100, float(SKETCH_BITS)
    c = F.least(differing("s_a", "s_b") / bits, F.lit(0.499))
    d = F.log(1 - 2 * c) * (-bits / 2)
    most, n = F.greatest("k_a", "k_b"), F.greatest("n_a", "n_b")
    spread = F.sqrt(1.3 * t * (1 - t) * most * (1 - most / n) + d * d / (2 * bits) * F.exp(4 * d / bits) + 1)
    sizes = F.least("n_a", "n_b") * 100 >= n * percent
    return sizes & ((F.col("k_a") + F.col("k_b") - d) / 2 >= t * most - SIGMAS * spread)


def ends(reps: DataFrame, name: str, *more: str) -> DataFrame:
    """Representatives as one end of a pair: name, n_name, k_name, s_name."""
    return reps.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("n_samples").alias(f"k_{name}"), F.col("sketch").alias(f"s_{name}"), *[F.col(m).alias(f"{m}_{name}") for m in more])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); a component is named by its smallest node.

    Each round maps a node to the label of its smallest neighbour's label and
    contracts the graph; edge and label tables live in the shared folder, never in
    the driver.
    """
    edges = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        near2 = save(near.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        if labels is None:
            labels = near2
        else:
            step = near2.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        to_a = near2.select(F.col("node").alias("a"), F.col("label").alias("la"))
        to_b = near2.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        left = edges.join(to_a, "a").join(to_b, "b").filter("la != lb")
        edges = save(left.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return save(labels.select("node", F.col("label").alias("component")), "components")


class Links:
    """Confirmed links between representatives, and the components they make."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> None:
        self.docs, self.reps, self.words, self.percent = docs, reps, words, percent
        self.links: DataFrame | None = None
        self.sets: DataFrame | None = None
        self.parts: DataFrame | None = None

    def sift(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose set sizes and odd sketches allow a link, with the count of differing bits."""
        both = pairs.join(ends(self.reps, "a"), "a").join(ends(self.reps, "b"), "b")
        return both.filter(close(self.percent)).select("a", "b", differing("s_a", "s_b").alias("differ"))

    def need_sets(self, ids: DataFrame) -> None:
        """Full sets of the documents ``ids`` (doc_id, each once) that have none yet."""
        if self.sets is not None:
            ids = ids.join(self.sets.select("doc_id"), "doc_id", "left_anti")
        ids = save(ids, "set-ids")
        few = ids.count() <= BROADCAST_IDS
        picked = self.docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        made = save(picked.dropDuplicates(["doc_id"]).mapInArrow(partial(full_sets, words=self.words), "doc_id long, shingles array<long>"), "sets")
        self.sets = made if self.sets is None else self.sets.union(made)

    def confirm(self, pairs: DataFrame) -> None:
        """Keep the pairs that link by their full sets; name the components anew."""
        self.need_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        a = self.sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s_a"))
        b = self.sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("s_b"))
        common = F.size(F.array_intersect("s_a", "s_b"))
        union = F.size("s_a") + F.size("s_b") - common
        new = save(pairs.select("a", "b").join(b, "b").join(a, "a").filter(common * 100 >= union * self.percent).select("a", "b"), "links")
        if self.links is not None and new.isEmpty():
            return
        self.links = new if self.links is None else self.links.union(new)
        self.parts = components(self.links)

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        if self.parts is None:
            return pairs
        a = self.parts.select(F.col("node").alias("a"), F.col("component").alias("c_a"))
        b = self.parts.select(F.col("node").alias("b"), F.col("component").alias("c_b"))
        named = pairs.join(a, "a", "left").join(b, "b", "left")
        return named.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Link documents (doc_id, text) whose word-shingle sets have a Jaccard similarity of at least ``percent``/100.

    Returns one row for each row: doc_id, n_shingles, component_id (the smallest
    doc_id that links reach), kept (it is its own component_id).

    Documents with equal sets are one class with one representative. Representatives
    that share a MinHash band (32 bands of 4 rows: a pair at 0.8 shares none with
    probability 5e-8) meet in a bucket. A bucket isn't expanded into pairs: each
    member is compared with one centre, drawn by hash for each bucket, first the
    centre of the closest odd sketch, then the others; buckets that then hold
    several components go through ``left_over``, which finds every link between them
    without forming the pairs of a bucket. So a large group of copies costs a few comparisons for each
    member, and no pair of a bucket that links is left in two components.

    Null and empty texts have an empty set and link with nothing, not even each
    other; fewer words than ``words`` make one shingle of the whole sequence. doc_id should be unique: rows
    that share one are taken for the same text where sets are compared. An empty table gives an
    empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(signatures, words=words), SIGNATURE), "near-rows")
    filled = rows.filter("n_shingles > 0")
    classes = save(filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "near-classes")
    reps = save(filled.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "bands", "n_samples", "sketch"), "near-reps")

    members = reps.select(F.col("doc_id").alias("b"), F.posexplode("bands").alias("band", "bucket"))
    drawn = F.min(F.struct(F.xxhash64("bucket", "b"), F.col("b").alias("a")))
    centres = members.groupBy("bucket").agg(F.count("*").alias("n"), drawn.alias("least")).filter("n > 1").select("bucket", F.col("least.a").alias("a"))
    buckets = save(members.join(centres, "bucket"), "near-buckets")

    links = Links(docs, reps, words, percent)
    stars = save(links.sift(buckets.filter("a != b").select("a", "b").distinct()), "near-stars")
    closest = stars.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("least")).select(F.col("least.a").alias("a"), "b")
    links.confirm(save(closest, "near-pairs"))
    links.confirm(save(links.apart(stars.join(closest, ["a", "b"], "left_anti").select("a", "b")), "near-pairs"))
    links.confirm(save(left_over(buckets, links), "near-pairs"))

    named = classes.join(links.parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component_id"))
    grouped = join_groups(filled.select("doc_id", "n_shingles", "digest"), save(named, "near-named"), "digest", "n")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    both = grouped.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    drop(buckets, stars)
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def left_over(buckets: DataFrame, links: Links) -> DataFrame:
    """Pairs (a, b) to confirm, so that every link inside a bucket is between documents of one component.

    Buckets whose members are in different components still, taken together where they
    share members, are groups, cut once more into ranges of set sizes that overlap. In a group, sets x
    become their differences d(x) from one core set, the shingles most members hold. A similarity of
    at least t means |d(x) ^ d(y)| = |x ^ y| <= (|x| + |y|) (1 - t) / (1 + t), or, with the weight
    w(x) = |d(x)| (1 + t) - |x| (1 - t), 2 (1 + t) |d(x) & d(y)| >= w(x) + w(y). So
    two documents link without a comparison if their weights add up to no more than 0, and
    then both link with the document z of least weight: one pair each. Any other
    link shares so many differences that the rarest of either, as many as ``prefix`` tells,
    have one in common: an exact inverted index on few and rare elements. Groups of any shape and size lose no
    link; a core that fits badly costs more comparisons and nothing else.
    """
    p = links.percent
    named = buckets.join(links.parts.select(F.col("node").alias("b"), "component"), "b", "left").select("bucket", "b", F.col("a").alias("centre"), F.coalesce("component", "b").alias("c"))
    named = save(named, "near-named-buckets")
    torn = named.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("bucket")
    groups = components(named.join(torn, "bucket", "left_semi").select(F.col("centre").alias("a"), "b"))

    parts = links.parts.select(F.col("node").alias("x"), F.col("component").alias("c"))
    sized = groups.select(F.col("node").alias("x"), F.col("component").alias("g")).join(links.reps.select(F.col("doc_id").alias("x"), F.col("n_shingles").alias("n")), "x")
    band = F.floor(F.log("n") / F.lit(-math.log(p / 100) * (1 + 1e-9)) if p < 100 else F.col("n"))
    placed = sized.join(parts, "x", "left").select("x", "n", F.coalesce("c", "x").alias("c"), "g", F.explode(F.array(band, band + 1) if p < 100 else F.array(band)).alias("band"))
    placed = save(placed.select("x", "n", "c", F.xxhash64("g", "band").alias("group")), "near-placed")
    torn = placed.groupBy("group").agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("group", "m")
    members = save(join_groups(placed, save(torn, "near-torn"), "group", "m"), "near-members")
    links.need_sets(members.select(F.col("x").alias("doc_id")).distinct())
    members = save(members.join(links.sets.select(F.col("doc_id").alias("x"), "shingles"), "x"), "near-members")

    drawn = members.filter(F.pmod(F.xxhash64("x"), F.greatest(F.lit(1), F.floor(F.col("m") / CORE_MEMBERS))) == 0)
    told = drawn.select("group", "m", F.explode("shingles").alias("e")).groupBy("group", "m", "e").agg(F.count("*").alias("k"))
    held = told.join(drawn.groupBy("group").agg(F.count("*").alias("drawn")), "group").filter("2 * k > drawn")
    cores = held.groupBy("group").agg(F.max("m").alias("m"), F.collect_list("e").alias("core"))
    bare = placed.select("group").distinct().join(cores.select("group"), "group", "left_anti").select("group", F.lit(0).alias("m"), F.array().cast("array<long>").alias("core"))
    cores = save(cores.unionByName(bare), "near-cores")
    differ = F.array_union(F.array_except("shingles", "core"), F.array_except("core", "shingles"))
    apart = join_groups(members.drop("m"), cores, "group", "m").select("group", "x", "n", "c", "m", differ.alias("d"))
    apart = save(apart.withColumn("w", F.size("d") * (100 + p) - F.col("n") * (100 - p)), "near-apart")
    least = apart.groupBy("group").agg(F.max("m").alias("m"), F.min(F.struct("w", F.col("x").alias("z"), F.col("c").alias("c_z"))).alias("least"))
    least = save(least.select("group", "m", F.col("least.w").alias("w_z"), F.col("least.z").alias("z"), F.col("least.c_z").alias("c_z")), "near-least")
    judged = join_groups(apart.drop("m"), least, "group", "m")
    main = (F.col("c") == F.col("c_z")) | (F.col("w") + F.col("w_z") <= 0)
    # the least weight of documents outside the main component
    other = F.greatest(F.col("w_z"), 1 - F.col("w_z"))

    def prefix(weight: Column) -> Column:
        """Of a document's rarest differences so many that any link to a document of at least ``weight`` shows in them."""
        return F.size("d") - F.ceil((F.col("w") + weight) / (2 * (100 + p))) + 1

    judged = judged.select("group", "x", "c", "z", "c_z", "w", "w_z", "d", main.alias("main"), prefix(other).alias("near"), prefix(F.col("w_z")).alias("far"))
    judged = save(judged, "near-judged")
    star = judged.filter("c <> c_z and w + w_z <= 0").select(F.least("x", "z").alias("a"), F.greatest("x", "z").alias("b"))

    few = judged.groupBy("group").agg(F.min("main").alias("all_main")).filter("not all_main").select("group")
    rows = save(judged.join(few, "group", "left_semi").select("group", "x", "c", "main", "near", "far", F.explode("d").alias("e")), "near-elements")
    often = rows.groupBy("group", "e").agg(F.count("*").alias("k"))
    order = Window.partitionBy("group", "x").orderBy("k", "e")
    listed = rows.join(often, ["group", "e"]).withColumn("place", F.row_number().over(order)).filter("k > 1 and place <= greatest(near, far)")
    listed = save(listed.select("group", "x", "c", "main", "near", "far", "place", "e"), "near-listed")
    ours = listed.filter("not main").select("group", "e", F.col("x").alias("a"), F.col("c").alias("c_a"), (F.col("place") <= F.col("near")).alias("near_a"))
    theirs = listed.filter("place <= near").select("group", "e", F.col("x").alias("b"), F.col("c").alias("c_b"), "main")
    met = ours.join(theirs, ["group", "e"]).filter("c_a <> c_b and (main or near_a and a < b)")
    pairs = links.sift(save(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-met"))
    return star.unionByName(pairs.select("a", "b")).distinct()
