"""SimHash near-duplicates by bit-sliced comparison.

Equal fingerprints are collapsed first. Two fingerprints within the radius
agree on some of the blocks that 64 bits are cut into, so each distinct
fingerprint goes to one bucket for every choice of agreeing blocks. Inside a
bucket the fingerprints stand as vertical bit planes, 64 to a word; the
distances of a fingerprint to all others grow plane by plane in carry-save
counters of a few bits, and words of which all 64 lanes exceed the radius are
abandoned. A bucket gives a star for each component in it, not its pairs. A
large bucket is cut into chunks, and every two chunks meet in a task, so that
no group is unbounded and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.text import ASCII_LOWER, slices
from attestry.operators.graph import connected_components
from attestry.runtime import hot_keys, join_split, saved
from attestry.sources.tables import read_table

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Rows of a chunk; two chunks meet in one task.
CHUNK = 2048
#: Words of 64 lanes that are compared at a time.
SLAB = 1 << 20

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hash of each word shingle; none without words. Fewer words make one shingle."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k].tolist(), ends[k:].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles; 0 without words. Fewer words make one shingle."""
    return fingerprint_of(shingle_hashes(text, width, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes."""
    if not len(hashes):
        return 0
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long. A null text counts as empty."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_fingerprints, f"id {narrow.schema['id'].dataType.simpleString()}, fp long")


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of which every two fingerprints within the radius agree on one."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_lanes(values: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit-sliced distances inside each group of ``values`` (sorted by group).

    Returns (query, first, word, hits): for row ``query`` of a group that
    starts at row ``first``, ``hits`` has a bit for each of the 64 rows from
    ``first + 64 * word`` on that lie within the radius, itself excluded.
    """
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    count = np.diff(np.r_[first, len(groups)])
    words = (count + 63) // 64
    base = np.cumsum(words) - words
    of_row = np.repeat(np.arange(len(first)), count)
    place = np.arange(len(values)) - first[of_row]
    lanes = np.zeros(int(words.sum()) * 64, np.uint64)
    used = np.zeros(len(lanes), np.uint8)
    at = base[of_row] * 64 + place
    lanes[at], used[at] = values, 1
    idle = ~np.packbits(used, bitorder="little").view(np.uint64)
    per_row = words[of_row]
    query = np.repeat(np.arange(len(values)), per_row)
    word = np.arange(len(query)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    column = base[of_row][query] + word
    own = (place[query] // 64 == word).astype(np.uint64) << (place[query] % 64).astype(np.uint64)
    over = idle[column] | own
    counters = [np.zeros(len(query), np.uint64) for _ in range(radius.bit_length())]
    for k in range(64):
        bit = np.uint64(k)
        plane = np.packbits((lanes >> bit & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
        carry = plane[column] ^ (np.uint64(0) - (values[query] >> bit & np.uint64(1)))
        for i, counter in enumerate(counters):
            counters[i], carry = counter ^ carry, counter & carry
        over |= carry
        if k % 8 == 7:  # abandon words of which all lanes exceed the radius
            live = np.flatnonzero(over != FULL)
            if len(live) < len(over):
                query, word, column, over = query[live], word[live], column[live], over[live]
                counters = [c[live] for c in counters]
    above = np.zeros(len(query), np.uint64)  # counts that fit the counters but not the radius
    equal = np.full(len(query), FULL)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            above |= equal & counters[i]
            equal &= ~counters[i]
    hits = ~(over | above)
    live = np.flatnonzero(hits)
    return query[live], first[of_row[query[live]]], word[live], hits[live]


def stars(values: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (centre, other) that connect what is within the radius inside each group."""
    query, first, word, hits = near_lanes(values, groups, radius)
    centre, other = [], []
    for start, at in groupby(range(len(query)), key=lambda i: first[i]):
        at = np.array(list(at))
        rows, local = np.unique(query[at], return_inverse=True)  # every hit is mutual, so these are all ends
        near = np.zeros((len(rows), int(word[at].max()) + 1), np.uint64)
        near[local, word[at]] = hits[at]
        near = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little").view(bool)[:, rows - start]
        left = np.ones(len(rows), bool)
        while left.any():
            reached = np.zeros(len(rows), bool)
            reached[np.argmax(left)] = True
            edge = reached.copy()
            while edge.any():
                edge = near[edge].any(axis=0) & ~reached
                reached |= edge
            left &= ~reached
            members = values[rows[reached]]
            centre.append(np.full(len(members) - 1, members.min()))
            other.append(np.sort(members)[1:])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return join(centre), join(other)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by group; a slab holds whole groups."""

        def done(slab: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            a, b = stars(np.concatenate([f for _, f in slab]), np.concatenate([g for g, _ in slab]), radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: list[list] = []
        last, number, size = None, 0, 0
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1).astype(np.int64)
            if not len(key):
                continue
            new = np.r_[last is None or (key[0] != last).any(), (key[1:] != key[:-1]).any(axis=1)]
            ids, last = number + np.cumsum(new), key[-1]
            number = int(ids[-1])
            fps = batch.column(4).to_numpy().astype(np.int64).view(np.uint64)
            held.append((ids, fps))
            size += len(ids)
            if size >= SLAB // 64:  # keep the last group, it may go on
                ids, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(ids, number))
                for part in _slabs(ids[:cut], fps[:cut]):
                    yield done([part])
                held, size = [(ids[cut:], fps[cut:])], len(ids) - cut
        if held:
            ids, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            for part in _slabs(ids, fps):
                yield done([part])

    return run


def _slabs(ids: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cuts at group ends so that a slab compares about SLAB words."""
    if not len(ids):
        return
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    count = np.diff(np.r_[first, len(ids)])
    slab = np.cumsum(count * ((count + 63) // 64)) // SLAB
    cuts = first[np.flatnonzero(np.r_[True, slab[1:] != slab[:-1]])]
    for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
        yield ids[a:b], fps[a:b]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect the fingerprints ``fp`` within the radius.

    Every two fingerprints within the radius end in one connected part. More
    ``blocks`` make more but smaller buckets; by default their number follows
    the number of fingerprints, with the same result.
    """
    if blocks is None:
        n = distinct.count()
        blocks = radius + (1 if n < 1 << 24 else 2 if n < 1 << 30 else 3)
    chosen = F.array(*[F.lit(_signed(m)) for m in masks(radius, blocks)])
    rows = distinct.select("fp", F.posexplode(chosen).alias("m", "mask")).select("m", F.col("fp").bitwiseAND(F.col("mask")).alias("v"), "fp")
    large = rows.groupBy("m", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk)
    large = large.select("m", "v", F.ceil(F.col("n") / chunk).cast("int").alias("c"))
    rows = rows.join(large, ["m", "v"], "left").withColumn("c", F.coalesce("c", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    other = F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, c - 1), x -> x != i)"))
    rows = rows.withColumn("i", part).select("m", "v", "i", F.explode(other).alias("j"), "fp")
    rows = rows.select("m", "v", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")
    dealt = rows.repartition("m", "v", "i", "j").sortWithinPartitions("m", "v", "i", "j")
    return dealt.mapInArrow(_compare(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the least id that its links reach.

    Null and empty texts have fingerprint 0 and link like any other. Rows that
    repeat are linked by their equal fingerprints. The component is null only
    if no document in it has an id. An empty table gives no rows. Texts are
    hashed whole, however long, and columns other than the two named are not
    read.
    """
    prints = saved(fingerprints(docs, id_col, text_col))
    distinct = saved(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    links = saved(fingerprint_links(distinct.select("fp"), radius))
    joined = saved(connected_components(links).join(distinct, F.col("node") == F.col("fp")).select("fp", "component", "rep"))
    least = joined.groupBy("component").agg(F.min("rep").alias("least"))
    linked = join_split(joined, least, "component", hot_keys(joined, "component")).select("fp", "least")
    classes = distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component"))
    return join_split(prints, classes, "fp", hot_keys(prints, "fp")).select("id", "fp", "component")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document of the table."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}
