"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

The n-grams are words and word pairs. Any alignment at the score shares so many
n-grams with its item that it holds some of the item's rarest, by document
frequency in the corpus: these are the item's seeds. Documents are cut into
overlapping passages, and the seeds in a passage lead through an inverted index
to the items that it may hold; a passage meets no other item. What shares as
many n-grams as an alignment at the score must share is aligned word by word;
the score is the share of the item's best possible score.

The bound holds however a copy was edited, so no pair at the score is lost.
Items are worked in groups of a bounded number of words, each broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.text import ASCII_LOWER, slices
from attestry.runtime import saved
from attestry.sources.tables import read_table

MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
#: Words of the items that are searched for at once, about: what is broadcast.
GROUP_WORDS = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TRIM = b".,;:!?\"'()[]{}|"


def words(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z) without surrounding punctuation; what is nothing else is left out."""
    return [w for w in (x.strip(_TRIM) for x in (text or "").encode().translate(ASCII_LOWER).split()) if w]


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit polynomial hash of each word, over all bytes at once."""
    if not tokens:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    data = np.frombuffer(b"".join(tokens), np.uint8).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.uint64)
    x = (data * np.uint64(0x100000001B3) + place) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    total = np.add.reduceat(x ^ (x >> np.uint64(32)), starts)
    return (total ^ (total >> np.uint64(31))) * _MIX


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Signed hash of each run of ``n`` words."""
    if len(hashes) < n:
        return np.zeros(0, np.int64)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(30)
    return out.view(np.int64)


def needed(n_words: int, min_score: float) -> int:
    """Least alignment score that an item of ``n_words`` words asks for."""
    return max(1, math.ceil(min_score * MATCH * n_words - 1e-9))


class _Items:
    """Items as words and word pairs ("features"), and the index of their seeds.

    An alignment with m matches, c of them right after another, has a mismatch
    or gap before each of its other m - c - 1 later matches, so its score is at
    most m + c + 1, and at most 2m; its words in the document are at most 3m
    less the score. Neither m nor c exceeds what the passage and the item have
    in common. So of an item's 2n - 1 features at least ``low`` are shared, and
    of any 2n - low + t at least 1 + t.
    """

    def __init__(self, texts: list[str | None], min_score: float):
        tokens = [words(x) for x in texts]
        self.at = np.array([i for i, x in enumerate(tokens) if x], np.int64)
        hashes = [word_hashes(tokens[i]) for i in self.at]
        self.size = np.array([len(h) for h in hashes], np.int64)
        self.need = np.array([needed(n, min_score) for n in self.size.tolist()], np.int64)
        self.span = 3 * self.size - self.need
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.codes = [np.searchsorted(self.vocabulary, h) for h in hashes]
        pairs = [x[:-1] * len(self.vocabulary) + x[1:] for x in self.codes]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        features = [np.r_[x, len(self.vocabulary) + np.searchsorted(self.pairs, y)] for x, y in zip(self.codes, pairs, strict=True)]
        self.starts = np.cumsum([0, *map(len, features)])
        self.feature = np.concatenate(features) if features else np.zeros(0, np.int64)
        self.nth = np.concatenate([_nth(x) for x in features]) if features else np.zeros(0, np.int64)
        self.chunk = max(512, 4 * int(self.span.max())) if features else 0

    def index_seeds(self, df: np.ndarray) -> None:
        """Chooses each item's seeds by ``df``, the documents that hold each feature, and indexes them."""
        low = np.maximum(-(-self.need // MATCH), self.need - 1)
        spare = np.minimum(self.size // 4, low - 1)
        self.hits = 1 + spare
        owner = np.repeat(np.arange(len(self.size)), np.diff(self.starts))
        order = np.lexsort((self.feature, df[self.feature], owner))
        place = np.arange(len(order)) - self.starts[owner[order]]
        seeds = order[place < (2 * self.size - low + spare)[owner[order]]]
        seeds = seeds[np.argsort(self.feature[seeds], kind="stable")]
        self.posting, self.posting_nth = owner[seeds], self.nth[seeds]
        self.seeds, begin = np.unique(self.feature[seeds], return_index=True)
        self.begin = np.r_[begin, len(seeds)]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each word, -1 if no item has it."""
        code = np.searchsorted(self.vocabulary, hashes).clip(max=len(self.vocabulary) - 1)
        return np.where(self.vocabulary[code] == hashes, code, -1)

    def _pairs_of(self, code: np.ndarray) -> np.ndarray:
        """The feature of the pair from each word on, -1 if no item has it."""
        n, pair = len(self.vocabulary), np.full(len(code), -1)
        if len(self.pairs):
            at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
            both = code[at] * n + code[at + 1]
            place = np.searchsorted(self.pairs, both).clip(max=len(self.pairs) - 1)
            pair[at] = np.where(self.pairs[place] == both, n + place, -1)
        return pair

    def features(self, code: np.ndarray, pair: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The features in a run of words and how often each is there."""
        held = np.r_[code, (self._pairs_of(code) if pair is None else pair)[:-1]]
        return np.unique(held[held >= 0], return_counts=True)

    def _met(self, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Items of which enough seeds are among the features ``held``, as often as the item has them."""
        if not len(held) or not len(self.seeds):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.seeds, held).clip(max=len(self.seeds) - 1)
        is_seed = self.seeds[at] == held
        at, counts = at[is_seed], counts[is_seed]
        size = self.begin[at + 1] - self.begin[at]
        where = np.repeat(self.begin[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        where = where[self.posting_nth[where] <= np.repeat(counts, size)]
        item, hits = np.unique(self.posting[where], return_counts=True)
        return item[hits >= self.hits[item]]

    def _enough(self, held: np.ndarray, counts: np.ndarray, i: int) -> bool:
        if not len(held):
            return False
        own = slice(self.starts[i], self.starts[i + 1])
        at = np.searchsorted(held, self.feature[own]).clip(max=len(held) - 1)
        shared = (held[at] == self.feature[own]) & (counts[at] >= self.nth[own])
        m = int(shared[: self.size[i]].sum())
        return min(MATCH * m, int(shared.sum()) + 1) >= self.need[i]

    def candidates(self, code: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, end): passages that hold every sufficient alignment of the document, given by its words' codes."""
        if not len(self.at) or not len(code):
            return
        pair = self._pairs_of(code)
        step = self.chunk - int(self.span.max())
        for a in range(0, max(1, len(code) - self.chunk + step), step):
            b = min(a + self.chunk, len(code))
            held, counts = self.features(code[a:b], pair[a:b])
            for i in self._met(held, counts).tolist():
                if not self._enough(held, counts, i):
                    continue
                width, first, end = int(self.span[i]), -1, -1
                for x in range(a, max(a + 1, b - width), width):
                    y = min(x + 2 * width, b)
                    if not self._enough(*self.features(code[x:y], pair[x:y]), i):
                        continue
                    if first >= 0 and x > end:
                        yield i, first, end
                        first = -1
                    first, end = first if first >= 0 else x, y
                if first >= 0:
                    yield i, first, end


def _nth(features: np.ndarray) -> np.ndarray:
    """1 for the first place of each value, 2 for the second and so on."""
    order = np.argsort(features, kind="stable")
    ranked = features[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    out = np.empty(len(features), np.int64)
    out[order] = np.arange(len(features)) - np.repeat(first, np.diff(np.r_[first, len(features)])) + 1
    return out


def align(a: np.ndarray | list[bytes], b: np.ndarray | list[bytes]) -> tuple[int, int, int]:
    """Best local alignment of an item's words with a passage's, as codes or plain words: score, first and end word in the passage."""
    if not isinstance(b, np.ndarray):  # a list compares as a whole
        b = np.array(b, object)
    above = np.zeros(len(b) + 1, np.int64)
    above_from = np.arange(len(b) + 1)
    slope = -GAP * np.arange(len(b) + 1)
    best = (0, 0, 0)
    for x in a:
        row, start = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
        slant, down = above[:-1] + np.where(b == x, MATCH, MISMATCH), above[1:] + GAP
        take = np.where(slant >= down, slant, down)
        came = np.where(slant >= down, above_from[:-1], above_from[1:])
        live = take > 0
        row[1:][live], start[1:][live] = take[live], came[live]
        # A gap along the row: the running maximum of score plus distance.
        lifted = row + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(len(b) + 1), 0))
        row, start = np.where(top - slope > row, top - slope, row), np.where(top - slope > row, start[source], start)
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(start[k]), k)
        above, above_from = row, start
    return best


def _coded(shared):
    """Documents (id, text) as (id, codes): each word's code among the items' words, 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = shared.value
        for batch in slices(batches):
            codes = [items.known(word_hashes(words(text))).astype("<i4").tobytes() for text in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(codes, pa.binary())], names=["id", "codes"])

    return run


def _frequencies(shared):
    """(feature, n): how many of a task's documents hold each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = shared.value
        total = np.zeros(len(items.vocabulary) + len(items.pairs), np.int64)
        for batch in slices(batches):
            for codes in batch.column(0).to_pylist():
                total[items.features(np.frombuffer(codes, "<i4").astype(np.int64))[0]] += 1
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], names=["feature", "n"])

    return run


def _score(shared, names: pa.Array):
    """(id, item, score, first_word, end_word) of each passage that reaches the score of an item it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = shared.value
        for batch in slices(batches):
            rows = []
            for row, codes in enumerate(batch.column("codes").to_pylist()):
                code = np.frombuffer(codes, "<i4").astype(np.int64)
                for i, a, b in items.candidates(code):
                    s, first, end = align(items.codes[i], code[a:b])
                    if s >= items.need[i]:
                        rows.append((row, int(items.at[i]), s / (MATCH * int(items.size[i])), a + first, a + end))
            row, item, score, first, end = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch(
                [batch.column("id").take(pa.array(row, pa.int32())), names.take(pa.array(item, pa.int32())), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                names=["id", "item", "score", "first_word", "end_word"],
            )

    return run


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE, group_words: int = GROUP_WORDS) -> DataFrame:
    """(id, item, score, first_word, end_word): the best alignment of every document and item from the score on.

    Words are as in :func:`words`, compared by hashes of 64 bits. Every pair at
    the score is found, however its edits lie. Items and documents without
    words, null or empty, match nothing. Repeated rows of an id give one row
    for each item. Of passages with equal scores the first stands. Texts are
    searched whole, however long, and columns other than the four named are not
    read. Empty tables give no rows. Each group of items reads the documents
    once; their words' codes are written and read for the frequencies and the
    search.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter(F.col("text").isNotNull())
    kind, item_kind = (x.schema.fields[0].dataType.simpleString() for x in (docs, items))
    schema = f"id {kind}, item {item_kind}, score double, first_word long, end_word long"
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    groups = max(1, -(-total // group_words))
    scored = None
    for group in range(groups):
        table = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == group).toArrow()
        own = _Items(table.column("text").to_pylist(), min_score)
        if not len(own.at):
            continue
        bare = spark.sparkContext.broadcast(own)
        coded = saved(docs.mapInArrow(_coded(bare), f"id {kind}, codes binary"))
        counts = coded.select("codes").mapInArrow(_frequencies(bare), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
        df = np.zeros(len(own.vocabulary) + len(own.pairs), np.int64)  # as long as the group's features
        df[counts.column("feature").to_numpy()] = counts.column("n").to_numpy()
        own.index_seeds(df)
        found = coded.mapInArrow(_score(spark.sparkContext.broadcast(own), table.column("item").combine_chunks()), schema)
        scored = found if scored is None else scored.unionByName(found)
    if scored is None:
        return spark.createDataFrame([], schema)
    best = F.max_by(F.struct("first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("place")
    return scored.groupBy("id", "item").agg(F.max("score").alias("score"), best).select("id", "item", "score", "place.first_word", "place.end_word")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that each document of the table holds a copy of, with the passage."""
    found = leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLE_SQL: dict[str, str] = {}
