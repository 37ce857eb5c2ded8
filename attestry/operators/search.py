"""Inverted index in blocks and lexical search that skips blocks.

A task counts the terms of the documents it reads, some thousand at a time: such
a range of documents gives one block of postings for each of its terms, so the
tokens themselves are never shuffled. A block's head holds its documents, its
greatest term frequency and its least length, which bound what the term can add
to a score there. A search reads the heads first, scores the most promising
ranges of each query, and then only those whose bound reaches the score found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.operators.documents import top
from attestry.runtime import broadcast_if_small, saved, spread

#: Documents of a range and tokens at which it ends before, parts that a term's blocks are dealt to, and ranges that a query scores first.
RANGE_DOCS, RANGE_TOKENS, PARTS, FIRST = 1024, 1 << 20, 16, 4
#: Runs of letters and digits.
TERM = re.compile(r"[^\W_]+")
SCHEMA = "range long, term string, n long, total long, max_tf int, min_dl int, ids array<long>, tfs array<int>, dls array<int>"


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, term) for each distinct term of a query."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return queries.select(query_id, F.explode(words).alias("term")).distinct()


NAMES = ["range", "term", "n", "total", "max_tf", "min_dl", "ids", "tfs", "dls"]


def _range_blocks(number: int, terms: list[str], code: list[int], tf: list[int], ids: list[int], sizes: list[int], distinct: list[int]) -> Iterator[pa.RecordBatch]:
    """The blocks of one range of documents, and its row without a term: its documents and their tokens."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    whole = [number, None, len(ids), sum(sizes), None, None, [], [], []]
    yield pa.record_batch([pa.array([v], t) for v, t in zip(whole, types, strict=True)], names=NAMES)
    codes = np.array(code, np.int32)
    order = np.argsort(codes, kind="stable")
    held, dl = np.repeat(np.array(ids, np.int64), distinct)[order], np.repeat(np.array(sizes, np.int32), distinct)[order]
    tfs = np.array(tf, np.int32)[order]
    first = np.searchsorted(codes[order], np.arange(len(terms)))  # every code is there
    edges = pa.array(np.r_[first, len(order)].astype(np.int32))
    numbers = [np.diff(np.r_[first, len(order)]), np.add.reduceat(tfs.astype(np.int64), first), np.maximum.reduceat(tfs, first), np.minimum.reduceat(dl, first)]
    lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (held, tfs, dl)]
    yield pa.record_batch([pa.array(np.full(len(terms), number)), pa.array(terms, pa.string()), *map(pa.array, numbers), *lists], names=NAMES)


def _blocks(range_docs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, text) as blocks."""
    number, tokens = TaskContext.get().partitionId() << 32, 0
    codes: dict[str, int] = {}
    lists: tuple[list, ...] = ([], [], [], [], [])
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = Counter(TERM.findall(text.lower())) if text else None
            if not counts:
                continue
            code, tf, ids, sizes, distinct = lists
            code += [codes.setdefault(term, len(codes)) for term in counts]
            tf += counts.values()
            ids.append(i)
            sizes.append(counts.total())
            distinct.append(len(counts))
            tokens += sizes[-1]
            if len(ids) >= range_docs or tokens >= RANGE_TOKENS:
                yield from _range_blocks(number, list(codes), *lists)
                number, tokens, codes, lists = number + 1, 0, {}, ([], [], [], [], [])
    if lists[2]:
        yield from _range_blocks(number, list(codes), *lists)


class Postings:
    """An inverted index. Built by ``build``, kept with ``write`` and found again with ``open``."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text: str, range_docs: int = RANGE_DOCS) -> Postings:
        """Indexes every document; ids are whole numbers, and each row is one document. Texts without a term are in no range."""
        made = spread(docs.select(F.col(id_col).cast("long"), text)).mapInArrow(partial(_blocks, range_docs), SCHEMA)
        return cls(saved(made))

    def write(self, path: str) -> None:
        """Writes the index to a new folder: blocks of one term stand together, those of a frequent one in several parts."""
        self.blocks.repartition("term", F.pmod(F.col("range"), F.lit(PARTS))).sortWithinPartitions("term", "range").write.parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Postings:
        return cls(spark.read.schema(SCHEMA).parquet(path))

    def frequencies(self) -> DataFrame:
        """(term, df) from the heads of blocks alone."""
        return self.blocks.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))

    def rows(self, id_col: str) -> DataFrame:
        """(id, term, tf, df) for each document and term; frequencies meet blocks, not postings."""
        df = broadcast_if_small(saved(self.frequencies()))
        each = self.blocks.filter("term IS NOT NULL").join(df, "term")
        return each.select("term", "df", F.explode(F.arrays_zip("ids", "tfs")).alias("x")).select(F.col("x.ids").alias(id_col), "term", F.col("x.tfs").cast("long").alias("tf"), "df")

    def search(self, queries: DataFrame, query_id: str, id_col: str, text: str, k: int = 30, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """BM25 top ``k`` documents of each query; scores rounded to 6 places, of equals the least id."""
        total = self.blocks.filter("term IS NULL").agg(F.sum("n").alias("docs"), F.sum("total").alias("tokens")).first()
        docs, average = total["docs"] or 0, (total["tokens"] or 0) / (total["docs"] or 1)
        wanted = saved(query_terms(queries, query_id, text))
        asked = broadcast_if_small(saved(wanted.select("term").distinct()))
        held = self.blocks.join(asked, "term", "left_semi")
        heads = saved(held.select("term", "range", "n", "max_tf", "min_dl"))
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        idf = saved(df.select("term", F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))

        def gain(tf: str, dl: str) -> Column:
            return F.col("idf") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / average))

        weighed = wanted.join(broadcast_if_small(idf), "term")
        bounds = heads.join(weighed, "term").groupBy(query_id, "range").agg(F.sum(gain("max_tf", "min_dl")).alias("bound"))
        w = Window.partitionBy(query_id).orderBy(F.col("bound").desc(), "range")
        bounds = saved(bounds.withColumn("place", F.row_number().over(w)))

        def scored(ranges: DataFrame) -> DataFrame:
            terms = ranges.select(query_id, "range").join(weighed, query_id)
            met = held.select("term", "range", F.arrays_zip("ids", "tfs", "dls").alias("postings")).join(terms, ["term", "range"])
            each = met.select(query_id, "idf", F.explode("postings").alias("x")).select(query_id, F.col("x.ids").alias(id_col), "idf", F.col("x.tfs").alias("tf"), F.col("x.dls").alias("dl"))
            return each.groupBy(query_id, id_col).agg(F.round(F.sum(gain("tf", "dl")), 6).alias("score"))

        best = [F.col("score").desc(), id_col]
        first = saved(top(scored(bounds.filter(F.col("place") <= FIRST)), query_id, best, k))
        reached = first.filter(F.col("rank") == k).select(query_id, "score")
        open_ = bounds.filter(F.col("place") > FIRST).join(reached, query_id, "left").filter(F.col("score").isNull() | (F.col("bound") >= F.col("score") - 1e-6))
        return top(first.drop("rank").unionByName(scored(open_)), query_id, best, k)


def lexical(queries: DataFrame, docs: DataFrame, query_id: str, id_col: str, text: str, k: int = 30) -> DataFrame:
    """The search over an index made for it."""
    return Postings.build(docs, id_col, text).search(queries, query_id, id_col, text, k)
