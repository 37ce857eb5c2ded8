"""Exact repeated-substring removal by hash refinement over anchors.

It stands in for prefix doubling, which ranks a string at every byte and so
moves many times the input (:func:`doubled_positions`; figures in README). Only
anchors are looked at: in each window of the full length the position whose
8-byte gram hashes lowest. Equal strings of the full length have their anchors
at equal places, so none is missed.

The full-length string that starts d bytes before its anchor p belongs to p
alone. For an anchor p a node [a, b] stands for the full-length strings that start
d bytes before p, a <= d <= b. They all hold its core, bytes p - a up to
p - b + length, and together they are its hull, bytes p - b up to
p - a + length. Nodes are grouped by core: a core that is alone is dropped.
Nodes with equal hulls repeat each other in all their strings and are done. The
other nodes are split, together with one witness of each hull in their group,
so cores grow and hulls shrink until both are one string. Strings are known by
a 128-bit hash of their bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.text import slices
from attestry.runtime import saved, shared_dir
from attestry.sources.tables import read_table

LENGTH = 400
GRAM = 8
#: Nodes into which an open node is split.
SPLIT = 15
#: A key with more than this part of the rows is dealt to several tasks, so at most so many are known to all.
HOT = 1000


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` consecutive values."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    fill = np.full(blocks * width, x[-1], x.dtype)
    fill[: len(x)] = x
    grid = fill.reshape(blocks, width)
    left = op.accumulate(grid, axis=1).reshape(-1)
    right = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions p that hash lowest (of equals the first) in some window of ``length`` bytes, and the
    least and greatest d for which p is that of the window that starts at p - d."""
    grams = len(data) - GRAM + 1
    width = length - GRAM + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none
    x = np.ndarray(grams, "<u8", data, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    least = (_sliding(x, width, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:], len(least)] - 1
    p = least[first]
    return p, p - last, p - first


def _rows_of(data: bytes, p: int, a: int, b: int, length: int) -> tuple[int, bytes] | None:
    """Hashes of core and hull, if the text holds the core."""
    n = len(data)
    if p < a or p - b + length > n:
        return None
    hull = data[max(0, p - b) : p - a + length]
    # Where the text cuts the hull short belongs to its identity.
    return xxhash.xxh3_64_intdigest(data[p - a : p - b + length]), xxhash.xxh3_128_digest(hull + b"%d:%d" % (max(0, b - p), max(0, p - a + length - n)))


_NAMES = ["id", "key", "n", "p", "a", "b", "lo", "hi", "core", "hull"]


def _hash_rows(length: int, nodes_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, found, cores, hulls = [], [], [], []
            rest = batch.column(4).to_pylist() if batch.num_columns > 4 else [None] * len(batch)
            if batch.num_columns > 4:  # keys may collide, ids tell
                rest = [jobs if a == b else () for jobs, a, b in zip(rest, batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            for i, (text, own) in enumerate(zip(batch.column(2).to_pylist(), rest, strict=True)):
                data = (text or "").encode()
                for p, a, b, lo, hi in nodes_of(data, own):
                    hashed = _rows_of(data, p, a, b, length)
                    if hashed:
                        row.append(i)
                        found.append((len(data), p, a, b, lo, hi))
                        cores.append(hashed[0])
                        hulls.append(hashed[1])
            taken = pa.array(row, pa.int32())
            numbers = np.array(found, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *(pa.array(numbers[:, k], pa.int32()) for k in range(6)), pa.array(np.array(cores, np.uint64).view(np.int64)), pa.array(hulls, pa.binary())], names=_NAMES)

    return run


def _roots(length: int):
    half = (length - GRAM) // 2

    def of(data: bytes, _) -> Iterator[tuple[int, int, int, int, int]]:
        for p, lo, hi in zip(*(x.tolist() for x in anchors(data, length)), strict=True):
            if lo <= half:
                yield p, 0, half, lo, hi
            if hi > half:
                yield p, half + 1, length - GRAM, lo, hi

    return of


def _children(split: int):
    def of(_, own) -> Iterator[tuple[int, int, int, int, int]]:
        for node in own:
            p, a, b, lo, hi = node["p"], node["a"], node["b"], node["lo"], node["hi"]
            step = -(-(b - a + 1) // split)
            for x in range(a, b + 1, step):
                if x <= hi and x + step > lo:
                    yield p, x, min(x + step - 1, b), lo, hi

    return of


def _hot(counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Keys that hold more than one row in HOT, at most HOT of them, with a number of salts ``s``."""
    fair = max(1, total // HOT)
    return F.broadcast(counted.filter(F.col("c") > fair).select(*keys, F.ceil(F.col("c") / fair).cast("int").alias("s")))


def _semi(rows: DataFrame, wanted: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Rows whose key is wanted; rows of a hot key go to several tasks, each with the key."""
    salts = F.coalesce("s", F.lit(1))
    left = rows.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int"))
    right = wanted.select(*keys).join(hot, keys, "left").select(*keys, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return left.join(right, [*keys, "salt"], "left_semi").select(*rows.columns)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, split: int = SPLIT) -> DataFrame:
    """(id, key, first, last): byte ranges that strings of ``length`` bytes with a second occurrence cover.

    ``docs`` has id, key (a hash of id and text) and text, best bucketed by key.
    """
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, key long, n int, p int, a int, b int, lo int, hi int, core long, hull binary"
    rows = saved(docs.mapInArrow(_hash_rows(length, _roots(length)), schema))
    same = ["a", "b", "core"]
    done, width = None, (length - GRAM) // 2 + 1
    while True:
        total = rows.count()
        twice = saved(rows.groupBy(same).agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
        hot = _hot(twice, same, total)
        nodes = saved(_semi(rows, twice, same, hot))
        hulls = nodes.groupBy(*same, "hull").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "key", "p", "lo", "hi")).alias("one"))
        hulls = saved(hulls)
        good = _semi(nodes, hulls.filter("c > 1"), [*same, "hull"], _hot(hulls, [*same, "hull"], total))
        ranges = good.select("id", "key", F.greatest(F.col("p") - F.col("b"), F.lit(0)).alias("first"), F.least(F.col("p") - F.col("a") + length, F.col("n")).alias("last"))
        done = ranges if done is None else done.unionByName(ranges)
        if width == 1:
            return done
        open_groups = hulls.groupBy(same).agg(F.count_if(F.col("c") == 1).alias("alone")).filter("alone > 0")
        # A lone hull is its own node; of each other hull one node is a witness.
        jobs = _semi(hulls, open_groups, same, hot).select("one.id", "one.key", F.struct("one.p", "a", "b", "one.lo", "one.hi").alias("job"))
        jobs = jobs.groupBy("key", "id").agg(F.collect_set("job").alias("jobs")).withColumnsRenamed({"id": "i", "key": "k"})
        both = docs.join(jobs, F.col("key") == F.col("k")).select("id", "key", "text", "i", "jobs")
        rows = saved(both.mapInArrow(_hash_rows(length, _children(split)), schema))
        width = -(-width // split)


def _all_positions(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = (text or "").encode()
                ranks = [xxhash.xxh3_64_intdigest(data[i : i + width]) for i in range(len(data) - width + 1)]
                at = pa.array(np.zeros(len(ranks), np.int32) + row)
                yield pa.record_batch([batch.column(0).take(at), pa.array(np.arange(len(ranks)), pa.int32()), pa.array(np.array(ranks, np.uint64).view(np.int64))], names=["doc", "p", "rank"])

    return run


def doubled_positions(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, p): bytes at which a string of ``length`` bytes starts that also starts elsewhere, by prefix doubling.

    ``docs`` has doc (a number of its own for each row) and text. Positions are
    ranked by their first bytes, as many as doubling leads to ``length`` from.
    In each round Spark sorts the pairs of the ranks at p and at p + width and
    ranks the pairs anew; a pair that is alone drops out. A row for every byte
    makes it costly, see README; :func:`repeated_ranges` finds the same.
    """
    width = length
    while width % 2 == 0 and width > 2 * GRAM:
        width //= 2
    ranks = docs.select("doc", "text").mapInArrow(_all_positions(width), "doc long, p int, rank long")
    twice = ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    ranks = saved(ranks.join(twice, "rank", "left_semi"))
    while width < length:
        after = ranks.select("doc", (F.col("p") - width).alias("p"), F.col("rank").alias("second"))
        pairs = saved(ranks.join(after, ["doc", "p"]))
        order = pairs.groupBy("rank", "second").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").orderBy("rank", "second")
        order = saved(order.select("rank", "second", F.monotonically_increasing_id().alias("new")))
        ranks = saved(pairs.join(order, ["rank", "second"]).select("doc", "p", F.col("new").alias("rank")))
        width *= 2
    return ranks.select("doc", "p")


def _cut(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        size, removed, spans, digest, kept = [], [], [], [], []
        for id_, text, ranges in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            data = (text or "").encode()
            parts, at, count = [], 0, 0
            for first, last in sorted((r["first"], r["last"]) for r in ranges or () if r["id"] == id_):
                if last <= at:
                    continue
                if first > at or not count:
                    parts.append(data[at:first])
                    count += 1
                at = last
            parts.append(data[at:])
            left = b"".join(parts)
            size.append(len(data))
            removed.append(len(data) - len(left))
            spans.append(count)
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left if with_bytes else None)
        yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, split: int = SPLIT, with_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row, in UTF-8 bytes.

    Every byte is removed that a string of ``length`` bytes covers which also
    starts elsewhere, in the same document or another. A null text counts as
    empty. Repeated rows are documents of their own and repeat each other. An
    empty table gives no rows. Texts may be of any length, and columns other
    than the two named are not read. The texts stay in a table whose files are
    in the shared folder.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Every round joins nodes to texts by key: bucketed once, the texts are not shuffled again.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"attestry_{uuid.uuid4().hex}"
    narrow.select("id", F.xxhash64("id", "text").alias("key"), "text").repartition(buckets, "key").write.bucketBy(buckets, "key").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    narrow = spark.table(table)
    ranges = repeated_ranges(narrow, length, split).distinct()
    ranges = ranges.groupBy("key").agg(F.collect_list(F.struct("id", "first", "last")).alias("ranges")).withColumnRenamed("key", "k")
    joined = narrow.join(ranges, F.col("key") == F.col("k"), "left").select("id", "text", "ranges")
    kind = narrow.schema["id"].dataType.simpleString()
    return joined.mapInArrow(lambda batches: _cut(batches, with_bytes), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document of the table without its repeated strings of 400 bytes."""
    found = remove_repeats(read_table(spark, sf_dir, "documents"), with_bytes=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
