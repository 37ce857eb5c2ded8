"""SimHash near-copies at a similarity of word shingles, each link verified exactly.

Fingerprints of the shingles are compared bit-sliced (:mod:`attestry.llm.simhash`),
and what lies within its radius is verified by the Jaccard similarity of the
sets of shingles. Fingerprints alone lose pairs near the limit, so the rest is
found exactly: under any one order of all shingles, two sets at the limit t
share a shingle among the first n - ceil(t n) + 1 of each, so texts that are
not connected yet meet by those and are verified as well. Shingles that are
common in a part of the texts come last in the order; this changes the cost and
not the result. In each bucket all texts are first held against one; pairs that
are connected by then need no check, all others are compared inside the bucket's
task by bit maps of their shingles. Bit maps, and counts of shingles by ranges
of the hash, bound what two sets can share: only pairs that may be at the limit
leave a task and meet with their sets, and none at the limit is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.simhash import RADIUS, SEED, fingerprint_links, fingerprint_of, shingle_hashes
from attestry.llm.text import slices
from attestry.operators.graph import connected_components
from attestry.runtime import arrow_rows, broadcast_if_small, hot_keys, join_split, saved

WIDTH = 5
SIMILARITY = 0.8
#: Texts of which common shingles are counted: one in so many.
COUNTED = 16
#: A shingle of so many counted texts is common; so many are broadcast (12 bytes each).
COMMON, MAX_COMMON = 8, 2_000_000
#: Pairs of one text that a task verifies with one copy of it.
SPAN = 256
#: Least and most ranges of the hash in which shingles are counted; a set has about half as many as shingles.
RANGES = (128, 1 << 15)
#: Least and most bits of the map of a set; it has some eight times as many as shingles.
BITS = (256, 2048)
#: Rows of a bucket that meet in one task, and rows that are compared with all of those at a time.
CHUNK, ROWS = 2048, 32
#: Rows of texts or sets that go to Python at once.
BATCH = 1024


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def prefix_size(n: int, limit: float) -> int:
    return n - math.ceil(limit * n - 1e-9) + 1 if n else 0


def _all_shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array(shingle_set(text, width).view(np.int64))], names=["h"])

    return run


def range_counts(own: np.ndarray) -> np.ndarray:
    """How many shingles of a set lie in each range of the hash, up to 255; the ranges are a power of two."""
    bits = min(max((len(own) // 2).bit_length(), RANGES[0].bit_length() - 1), RANGES[1].bit_length() - 1)
    return np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).clip(max=255).astype(np.uint8)


def most_shared(a: np.ndarray, b: np.ndarray) -> float:
    """Bound of what two sets share by their range counts; none where both counts of a range are full."""
    if len(a) < len(b):
        a, b = b, a
    full = a.reshape(len(b), -1) == 255
    least = np.minimum(a.reshape(len(b), -1).sum(axis=1, dtype=np.int64), b)
    return math.inf if (full.any(axis=1) | (b == 255)).any() else float(least.sum())


def bit_map(own: np.ndarray) -> np.ndarray:
    """A bit for each value of the low bits of the shingles, as bytes; the bits are a power of two."""
    bits = BITS[0]
    while bits < min(8 * len(own), BITS[1]):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(own & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def possible_pairs(n: np.ndarray, maps: list[bytes], limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j or i of the smaller map, of sets of sizes ``n`` that may reach the similarity by their bit maps.

    A bit that only one map has stands for a shingle that the other set lacks.
    """
    width = np.array([len(m) for m in maps])
    for w in np.unique(width):
        one = np.flatnonzero(width == w)
        x = np.stack([np.frombuffer(maps[i], np.uint64) for i in one])
        wide = np.flatnonzero(width == 2 * w)
        both, y = one, x
        if len(wide):  # a map of twice the bits folds to this one
            z = np.stack([np.frombuffer(maps[i], np.uint64) for i in wide])
            both, y = np.r_[one, wide], np.concatenate([x, z[:, : z.shape[1] // 2] | z[:, z.shape[1] // 2 :]])
        for at in range(0, len(one), ROWS):
            rows = np.arange(at, min(at + ROWS, len(one)))
            own, other = n[one[rows]][:, None], n[both][None, :]
            shared = np.bitwise_count(x[rows][:, None, :] & y[None]).sum(axis=2, dtype=np.int64)
            lacks = np.bitwise_count(x[rows]).sum(axis=1, dtype=np.int64)[:, None] - shared
            misses = np.bitwise_count(y).sum(axis=1, dtype=np.int64)[None, :] - shared
            most = np.minimum(own - lacks, other - misses)
            i, j = np.nonzero((most * (1 + limit) >= limit * (own + other) - 1e-6) & (np.arange(len(both))[None, :] > rows[:, None]))
            yield one[rows[i]], both[j]


def _bucket_pairs(limit: float):
    """(a, b, n, p, q) of the pairs of each bucket that may be at the limit and whose parts differ; batches are sorted by bucket."""

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        cls, n, part = (rows.column(c).to_numpy() for c in ("cls", "n", "part"))
        for i, j in possible_pairs(n, rows.column("bits").to_pylist(), limit):
            differ = part[i] != part[j]
            i, j = i[differ], j[differ]
            yield pa.record_batch([pa.array(x) for x in (cls[i], cls[j], (n[i] + n[j]).astype(np.int32), part[i], part[j])], names=["a", "b", "n", "p", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("h", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and tuple(key[a]) != last:
                    yield from pairs(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(key[a])
        if held:
            yield from pairs(held)

    return run


def _signs(common, width: int, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = common.value
        for batch in slices(batches):
            cls, prints, size, counts, bits, first = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, width)
                own = np.unique(hashes)
                cls.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                prints.append(fingerprint_of(hashes))
                size.append(len(own))
                counts.append(range_counts(own).tobytes())
                bits.append(bit_map(own).tobytes())
                weight = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.searchsorted(known, own).clip(max=len(known) - 1)
                    weight = np.where(known[at] == own, times[at], 0)
                first.append(own[np.lexsort((own, weight))[: prefix_size(len(own), limit)]].view(np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cls, prints)]
            rest = [pa.array(size, pa.int32()), pa.array(counts, pa.binary()), pa.array(bits, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), *signed, *rest], names=["key", "cls", "fp", "n", "counts", "bits", "first"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [shingle_set(x, width).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("cls"), pa.array(own, pa.binary())], names=["cls", "own"])

    return run


def _possible(limit: float):
    """Pairs (a, b, p, q) whose range counts allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # ``n`` is the sizes of both together.
            rows = zip(*(batch.column(c).to_pylist() for c in ("counts_a", "counts_b", "n")), strict=True)
            keep = pa.array([most_shared(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) * (1 + limit) >= limit * n - 1e-6 for x, y, n in rows], pa.bool_())
            yield pa.record_batch([batch.column(c).filter(keep) for c in "abpq"], names=list("abpq"))

    return run


def _verified(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = zip(*(batch.column(c).to_pylist() for c in ("own_a", "own_b")), strict=True)
            alike = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= limit - 1e-9 for x, y in sets]
            yield pa.record_batch([batch.column(c).filter(pa.array(alike, pa.bool_())) for c in "pq"], names=["p", "q"])

    return run


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are common in a part of the texts, and their counts there."""
    part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).select("text")
    part = part.mapInArrow(_all_shingles(width), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= COMMON)
    counted = part.orderBy(F.col("c").desc(), "h").limit(MAX_COMMON).toArrow()
    known = np.array(counted.column("h"), np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], np.array(counted.column("c"), np.int32)[order]


def near_copies(texts: DataFrame, key_col: str = "key", text_col: str = "text", width: int = WIDTH, limit: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(key, component): rows of one component are linked by pairs at the similarity.

    A key stands for one text. Words are as in SimHash; fewer than ``width``
    words make one shingle. Null texts count as empty, and all empty texts are
    copies of each other. Rows of an equal key and text repeat. An empty table
    gives no rows.
    """
    with arrow_rows(texts.sparkSession, BATCH):
        return _near_copies(texts.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")), width, limit, radius)


def _near_copies(texts: DataFrame, width: int, limit: float, radius: int) -> DataFrame:
    spark = texts.sparkSession
    kind = texts.schema["key"].dataType.simpleString()
    common = spark.sparkContext.broadcast(_common(texts, width))
    # Equal sets are one class (cls).
    signs = saved(texts.mapInArrow(_signs(common, width, limit), f"key {kind}, cls long, fp long, n int, counts binary, bits binary, first array<long>"))
    common.unpersist()
    counts = signs.groupBy("cls").agg(F.min("counts").alias("counts"))

    def alike(m: Column, n: Column) -> Column:
        return F.least(m, n) >= limit * F.greatest(m, n) - 1e-9

    def named(pairs: DataFrame) -> DataFrame:
        """(a, b, n, p, q) of pairs (x, y) of classes: both classes, the sum of their sizes, and their parts before any link."""
        open_ = pairs.filter((F.col("x.cls") != F.col("y.cls")) & alike(F.col("x.n"), F.col("y.n")))
        a, b = F.col("x.cls"), F.col("y.cls")
        return open_.select(a.alias("a"), b.alias("b"), (F.col("x.n") + F.col("y.n")).alias("n"), a.alias("p"), b.alias("q"))

    def links(pairs: DataFrame) -> DataFrame:
        """(p, q): parts of the pairs that reach the similarity."""
        one, other = (counts.select(F.col("cls").alias(c), F.col("counts").alias(f"counts_{c}")) for c in "ab")
        pairs = saved(pairs.distinct().join(one, "a").join(other, "b").mapInArrow(_possible(limit), "a long, b long, p long, q long"))
        used = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        # The texts are shuffled only for many keys.
        keys = broadcast_if_small(saved(signs.select("cls", "key").join(used, "cls").groupBy("cls").agg(F.min("key").alias("key"))))
        held = saved(texts.join(keys, "key").dropDuplicates(["cls"]).mapInArrow(_sets(width), "cls long, own binary"))
        # A set with many pairs is dealt to several tasks, each with a copy of it.
        many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPAN).cast("int").alias("s")).filter("s > 1")
        dealt = pairs.join(many, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("s", F.lit(1))).cast("int")).drop("s")
        one = held.select(F.col("cls").alias("a"), F.col("own").alias("own_a")).join(many, "a", "left")
        one = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1))).drop("s")
        both = dealt.join(held.select(F.col("cls").alias("b"), F.col("own").alias("own_b")), "b").join(one, ["a", "salt"])
        return saved(both.select("own_a", "own_b", "p", "q").mapInArrow(_verified(limit), "p long, q long").distinct())

    entry = F.struct("cls", "n")
    # Links of the fingerprints, and of what shares one.
    prints = saved(signs.groupBy("fp").agg(F.min(entry).alias("x")))
    linked = fingerprint_links(prints.select("fp"), radius).join(prints.select(F.col("fp").alias("a"), "x"), "a").join(prints.select(F.col("fp").alias("b"), F.col("x").alias("y")), "b")
    equal = join_split(signs.select("fp", entry.alias("y")), prints, "fp", hot_keys(signs, "fp"))
    # The exact rest: buckets of shingles in which several classes meet, each held against one of the bucket.
    rows = signs.select("cls", "n", F.explode("first").alias("h"))
    shared = broadcast_if_small(saved(rows.groupBy("h").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low < high").select("h")))
    rows = saved(rows.join(shared, "h", "left_semi").distinct().select("h", entry.alias("x")))
    centres = rows.groupBy("h").agg(F.min("x").alias("y"))
    met = linked.select("x", "y").union(equal.select("x", "y")).union(join_split(rows, centres, "h", hot_keys(rows, "h")).select("x", "y"))
    found = links(named(met))
    parts = connected_components(found, "p", "q")
    # Then all pairs of a bucket whose parts are not connected yet; a large bucket is dealt to several tasks.
    moved = parts.select(F.col("node").alias("cls"), "component")
    placed = rows.select("h", "x.*").join(moved, "cls", "left").withColumn("part", F.coalesce("component", "cls")).drop("component")
    mixed = placed.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("c")).filter("low < high").select("h", "c")
    maps = signs.groupBy("cls").agg(F.min("bits").alias("bits"))
    placed = placed.join(mixed, "h").withColumn("i", F.pmod(F.xxhash64("cls"), F.col("c")).cast("int"))
    other = F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, c - 1), x -> x != i)"))
    placed = placed.withColumn("other", F.explode(other)).select("h", "cls", "n", "part", F.least("i", "other").alias("i"), F.greatest("i", "other").alias("j")).join(maps, "cls")
    dealt = placed.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    more = links(dealt.mapInArrow(_bucket_pairs(limit), "a long, b long, n int, p long, q long"))
    parts = connected_components(found.union(more), "p", "q")
    all_ = signs.select("key", "cls").join(parts, F.col("cls") == F.col("node"), "left")
    return all_.select("key", F.coalesce("component", "cls").alias("component"))
