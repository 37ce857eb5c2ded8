"""Best-fit packing by a configuration linear program.

A configuration is a multiset of lengths that fit one sequence. The program
"fewest sequences whose configurations cover the length histogram" is solved
by multiplicative weights: a length loses weight as it is covered, and a
knapsack dynamic program over the capacity finds configurations of the largest
weight. The solution is rounded and the program is solved again for what is
left. A last program, in which each piece also costs a price, so that few long
pieces go before many short ones, places the rest; best fit fills the gaps that
its rounding leaves. Only the histogram (one row for each
length) comes to the driver; pieces take their places by their rank among the
pieces of their length, which Spark finds from counts for each task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm.text import slices
from attestry.llm.tokens import WordTokens, tokenizer_path
from attestry.runtime import broadcast_if_small, saved
from attestry.sources.tables import read_table

CAPACITY = 2048
END = (0).to_bytes(4, "little")
#: Rounds of the program, pricings in a round, configurations from one pricing.
ROUNDS, PRICINGS, BATCH = 4, 60, 1024
#: Share of a length's count that one step covers, the rate of the weights, and
#: how far from the best a configuration of the same pricing may lie.
STEP, RATE, SLACK = 0.2, 1.0, 0.1
#: The same in the last program, rate and slack in tokens, and a piece's price in tokens.
LAST_STEP, LAST_RATE, LAST_SLACK, PRICE = 0.1, 10.0, 42.0, 20.0
#: Ranks in a bin in which pieces and slots meet.
RANKS = 256
#: Most room that a rounded configuration may leave.
ROOM = 16
#: Pieces of a rounded configuration, as a multiple of the mean number in a sequence.
MANY = 1.5


def _cutter(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, ranks = WordTokens.of(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            source, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = tokens.encode(text or "") + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    source.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    rank.append(int(ranks[n]))
                    ranks[n] += 1
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, rank)]
            yield pa.record_batch([batch.column(0).take(pa.array(source, pa.int32())), pa.array(piece, pa.int32()), *numbers, pa.array([task] * len(piece), pa.int32())], names=["id", "piece", "start", "length", "crc", "rank", "task"])
        tokens.clear()

    return cut


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, crc, rank, task): each document's ids and a final 0, cut at the capacity."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(_cutter(path or tokenizer_path(), capacity), f"id {kind}, piece int, start long, length long, crc long, rank long, task int")


def _knapsack(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity, and the length that was added last (0: none)."""
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(weights > 0)
    values = weights[lengths]
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        if n:
            worth = best[c - lengths[:n]] + values[:n]
            k = n - 1 - int(worth[::-1].argmax())  # of equal values the longest, which leaves the short ones for gaps
            if worth[k] > best[c - 1]:
                best[c], last[c] = worth[k], lengths[k]
                continue
        best[c] = best[c - 1]
    return best, last


def _filled(last: np.ndarray, capacity: int) -> list[int]:
    found = []
    while capacity > 0:
        if last[capacity]:
            found.append(int(last[capacity]))
            capacity -= found[-1]
        else:
            capacity -= 1
    return found


def fractional(counts: np.ndarray, capacity: int, last: bool = False) -> dict[tuple[int, ...], float]:
    """Configurations and how often each is used, nearly least in sum, that cover ``counts`` about once.

    In the last program coverage moves a length's weight by tokens, not by its
    share, and each piece costs the price.
    """
    present = np.flatnonzero(counts)
    if not len(present):
        return {}
    step, slack = (LAST_STEP, LAST_SLACK * capacity / CAPACITY) if last else (STEP, SLACK)
    covered = np.zeros(capacity + 1)
    used: dict[tuple[int, ...], float] = {}
    for _ in range(PRICINGS):
        weights = np.zeros(capacity + 1)
        ahead = covered[present] - covered[present].mean()
        if last:
            weights[present] = present * np.exp((-LAST_RATE * ahead / present).clip(-2, 2)) - PRICE * capacity / CAPACITY
        else:
            weights[present] = present / capacity * np.exp(-RATE * ahead.clip(-4, 4))
        best, added = _knapsack(weights, capacity)
        worth = weights[present] + best[capacity - present]
        least = worth.max() - slack if last else (1 - SLACK) * worth.max()
        taken = np.zeros(capacity + 1, bool)
        for k in np.lexsort((-present, -worth))[:BATCH]:
            length = int(present[k])
            if taken[length] or worth[k] < least:
                continue
            config = sorted([length, *_filled(added, capacity - length)], reverse=True)
            if taken[config].any():
                continue
            sizes, times = np.unique(config, return_counts=True)
            taken[sizes] = True
            amount = step * float(np.min(counts[sizes] / times))
            used[tuple(config)] = used.get(tuple(config), 0.0) + amount
            covered[sizes] += amount * times / counts[sizes]
    scale = max(np.median(covered[present]), step)
    return {config: amount / scale for config, amount in used.items()}


def _last_program(rest: np.ndarray, capacity: int, groups: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], int]:
    """``groups`` with all of ``rest``: the priced program, rounded down, fullest and longest first, then best fit."""
    rest, groups = rest.copy(), dict(groups)
    for config, amount in sorted(fractional(rest, capacity, last=True).items(), key=lambda x: (-sum(x[0]), len(x[0]), -x[1], x[0])):
        sizes, times = np.unique(config, return_counts=True)
        n = min(int(amount), int((rest[sizes] // times).min()))
        if n:
            groups[config] = groups.get(config, 0) + n
            rest[sizes] -= n * times
    return _best_fit(rest, capacity, groups)


def _best_fit(rest: np.ndarray, capacity: int, groups: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], int]:
    """Places ``rest`` by best fit decreasing, first in the room that ``groups`` leave."""
    open_bins: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for config, many in groups.items():
        open_bins[capacity - sum(config)][config] = many
    for length in range(capacity, 0, -1):
        n = int(rest[length])
        while n:
            free = next((c for c in range(length, capacity) if open_bins[c]), None)
            if free is None:
                each = capacity // length
                for k, many in ((each, n // each), (n % each, 1)):
                    if k and many:
                        at = open_bins[capacity - k * length]
                        at[(length,) * k] = at.get((length,) * k, 0) + many
                break
            config, many = open_bins[free].popitem()
            moved = min(n, many)
            if moved < many:
                open_bins[free][config] = many - moved
            at, new = open_bins[free - length], (*config, length)
            at[new] = at.get(new, 0) + moved
            n -= moved
    return {config: many for at in open_bins for config, many in at.items()}


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Groups (configuration, number of sequences) that hold exactly ``counts[length]`` pieces of each length.

    The last program may place what is left after any round; the round after
    which the fewest sequences are needed is taken, of equals the last.
    """
    rest = counts.astype(np.int64).copy()
    groups: dict[tuple[int, ...], int] = {}
    full = int(rest[capacity])
    rest[capacity] = 0
    packed = _last_program(rest, capacity, groups)
    for _ in range(ROUNDS):
        placed = 0
        # Configurations of many short pieces wait: those fill gaps best.
        most = int(MANY * capacity * rest.sum() / max(1, (rest * np.arange(capacity + 1)).sum())) + 1
        for config, amount in sorted(fractional(rest, capacity).items(), key=lambda x: (len(x[0]), -x[1], x[0])):
            if len(config) > most:
                break
            times = {k: config.count(k) for k in config}
            # What the rest no longer holds leaves room, which best fit uses.
            config = tuple(k for k in config if rest[k] >= times[k])
            if not config or sum(config) < capacity - ROOM:
                continue
            n = min(int(amount + 0.5), *(int(rest[k] // times[k]) for k in config))
            if n:
                groups[config] = groups.get(config, 0) + n
                for k in config:
                    rest[k] -= n
                placed += n
        if not placed:
            break
        now = _last_program(rest, capacity, groups)
        if sum(now.values()) <= sum(packed.values()):
            packed = now
    return [*packed.items(), *([((capacity,), full)] if full else [])]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (of :func:`pieces`, saved) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    counts = saved(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    taken = np.zeros(capacity + 1, np.int64)
    slots, first = [], 0
    for config, n in pack_histogram(histogram, capacity):
        offset = 0
        for length in config:
            slots.append((length, int(taken[length]), int(taken[length]) + n, first, offset))
            taken[length] += n
            offset += length
        first += n
    # Slots are dealt to bins of ranks, so that a piece meets only those near its own rank.
    slots = spark.createDataFrame(slots, "length long, low long, high long, first long, offset long")
    slots = slots.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / RANKS), F.floor((F.col("high") - 1) / RANKS))))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(counts.select("task", "length", before.alias("before")), ["task", "length"]).withColumn("at", F.col("before") + F.col("rank"))
    ranked = ranked.withColumn("bin", F.floor(F.col("at") / RANKS))
    placed = ranked.join(broadcast_if_small(saved(slots)), ["length", "bin"]).filter((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    return placed.select("id", "piece", "start", "length", "crc", (F.col("first") + F.col("at") - F.col("low")).alias("sequence_id"), "offset")


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, crc, sequence_id, offset) of every piece of every document.

    A null text counts as empty and gives one piece that holds the final 0.
    Repeated rows are packed as often as they occur; a null id stays null. An
    empty table gives no rows. Only documents above the capacity are cut,
    however long. Pieces of one length have places in any order. Columns other
    than the two named are not read.
    """
    return pack(saved(pieces(docs, id_col, text_col, path, capacity)), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document of the table in sequences of 2048 tokens."""
    packed = best_fit_packing(read_table(spark, sf_dir, "documents"))
    return packed.withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
