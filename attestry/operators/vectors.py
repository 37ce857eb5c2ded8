"""Exact and approximate nearest vectors by cosine.

Vectors of length 1 stand in blocks of some thousand rows. Queries are dealt to
the blocks that they are to meet, and a task scores one block against its
queries as a matrix product; neither side passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators.documents import top
from attestry.runtime import broadcast_if_small, saved

#: Vectors of a block, and queries that meet one copy of it.
BLOCK, SHARE = 4096, 1 << 14
#: Vectors on which centres and codes are fitted at most, and queries on which the search is calibrated.
SAMPLE, CALIBRATION = 20_000, 128
#: Vectors of a cell, cells at most, dimensions of a piece of a code, and centres of a piece.
CELL, MOST_CELLS, PIECE, CENTRES = 256, 4096, 4, 256
#: Share of the calibration's neighbours that the probed cells, and the scored part of them, must hold.
WANTED = 0.98


def unit_rows(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, dims, v): vectors of length 1 as packed doubles. Rows without an id, without a length or with a null or endless component go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                if i is None or x is None:
                    continue
                x = np.asarray(x, np.float64)
                size = np.linalg.norm(x)
                if np.isfinite(size) and size > 0:
                    ids.append(i)
                    dims.append(len(x))
                    out.append((x / size).tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "dims", "v"])

    return df.select(F.col(id_col).cast("long"), vector).mapInArrow(run, "id long, dims int, v binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def blocks(rows: DataFrame) -> DataFrame:
    """(cell, dims, part, ids, block): ``rows`` (id, dims, v, cell) in blocks; a cell of many rows is dealt by id to several."""
    sizes = broadcast_if_small(saved(rows.groupBy("cell", "dims").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))))
    dealt = rows.join(sizes, ["cell", "dims"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    keys = ["cell", "dims", "part"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "id").select(*keys, "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held = None, [], []
        block = lambda: pa.record_batch([*(pa.array([x], pa.int32()) for x in key), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(held)])], names=[*keys, "ids", "block"])
        for batch in batches:
            for *own, i, v in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if own != key:
                    if held:
                        yield block()
                    key, ids, held = own, [], []
                ids.append(i)
                held.append(v)
        if held:
            yield block()

    return saved(dealt.mapInArrow(run, "cell int, dims int, part int, ids array<long>, block binary"))


def _met(index: DataFrame, asked: DataFrame, compare: Callable, schema: str) -> DataFrame:
    """What ``compare(ids, block, query_ids, queries)`` gives for each block and the queries (query_id, v, cell, dims) of its cell."""
    counts = broadcast_if_small(saved(asked.groupBy("cell", "dims").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))))
    keys = ["cell", "dims", "part", "share"]
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    held = index.join(counts, ["cell", "dims"]).withColumn("share", F.explode(F.expr("sequence(0, shares - 1)"))).select(*keys, F.lit(0).alias("kind"), "ids", "block", none("long", "query_id"), none("binary", "v"))
    parts = broadcast_if_small(saved(index.select("cell", "dims", "part")))
    each = asked.join(counts, ["cell", "dims"]).withColumn("share", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int")).join(parts, ["cell", "dims"])
    both = held.unionByName(each.select(*keys, F.lit(1).alias("kind"), none("array<long>", "ids"), none("binary", "block"), "query_id", "v"))
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "kind").drop("part", "share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = x = cell = None
        for batch in batches:
            kinds, dims = batch.column("kind").to_numpy(), batch.column("dims").to_numpy()
            cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if kinds[a] == 0:
                    cell = batch.column("cell")[b - 1].as_py()
                    ids = np.array(batch.column("ids")[b - 1].as_py(), np.int64)
                    x = np.frombuffer(batch.column("block")[b - 1].as_py(), np.float64).reshape(len(ids), int(dims[b - 1]))
                    continue
                for at in range(a, b, 256):
                    part = batch.slice(at, min(256, b - at))
                    yield compare(cell, ids, x, part.column("query_id").to_numpy(), _matrix(part.column("v"), x.shape[1]))

    return dealt.mapInArrow(run, schema)


def _best(asked: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each row of rounded scores, of equals the least ids; a query's own id is left out."""
    scores[asked[:, None] == ids[None, :]] = -np.inf
    low = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    q, i = np.nonzero((scores >= low[:, None]) & np.isfinite(scores))
    order = np.lexsort((ids[i], -scores[q, i], q))
    q, i = q[order], i[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, i = q[kept], i[kept]
    return pa.record_batch([pa.array(asked[q]), pa.array(ids[i]), pa.array(scores[q, i])], names=["query_id", "id", "score"])


FOUND = "query_id long, id long, score double"


def vector_top(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, k: int = 30) -> DataFrame:
    """The ``k`` nearest vectors of each query by exact cosine, rounded to 6 places; ids are whole numbers.

    Of equal scores the lesser id comes first. Vectors of another dimension,
    without length or null are not compared.
    """
    everywhere = F.lit(0).alias("cell")
    index = blocks(saved(unit_rows(vectors, id_col, vector)).select("*", everywhere))
    asked = saved(unit_rows(queries, id_col, vector)).select(F.col("id").alias("query_id"), "dims", "v", everywhere)
    near = _met(index, asked, lambda cell, ids, x, of, q: _best(of, ids, np.round(q @ x.T, 6), k), FOUND)
    return top(near, "query_id", [F.col("score").desc(), "id"], k).withColumnRenamed("id", id_col)


def centres_of(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from rows chosen with a fixed seed; a centre without rows stays."""
    centres = x[np.random.default_rng(7).choice(len(x), min(count, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, count: int | None = None) -> np.ndarray:
    """The nearest centre of each row; with ``count`` so many, in their order."""
    gap = (centres**2).sum(axis=1) - 2 * x @ centres.T
    return gap.argmin(axis=1) if count is None else np.argsort(gap, axis=1, kind="stable")[:, :count]


class CodeIndex:
    """Vectors in cells, and codes by which a task chooses what it scores. Built by ``of``."""

    def __init__(self, index: DataFrame, centres: np.ndarray, books: list[np.ndarray], dims: int, k: int):
        self.index, self.centres, self.books, self.dims, self.k = index, centres, books, dims, k
        self.probes, self.share = len(centres), 1.0

    @classmethod
    def of(cls, rows: DataFrame, dims: int, k: int) -> CodeIndex:
        """Indexes every row of ``rows`` (id, dims, v) of so many dimensions.

        Centres and code books are fitted on ``SAMPLE`` rows at most, drawn by
        the hash of the id. A code is the nearest centre of each piece of
        ``PIECE`` dimensions, a byte each.
        """
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0)
        x = _matrix(sample, dims)
        centres = centres_of(x, max(1, min(MOST_CELLS, n // CELL)))
        books = [centres_of(x[:, a : a + PIECE], CENTRES) for a in range(0, dims, PIECE)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = nearest(_matrix(batch.column("v"), dims), centres) if len(batch) else np.zeros(0)
                yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

        held = saved(rows.mapInArrow(run, "id long, dims int, v binary, cell int"))
        return cls(blocks(held), centres, books, dims, k)

    def visits(self, asked: DataFrame, probes: int) -> DataFrame:
        """(query_id, dims, v, cell): each query with the cells nearest to it."""
        centres, dims = self.centres, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    near = nearest(_matrix(batch.column("v"), dims), centres, probes)
                    rows = batch.take(pa.array(np.repeat(np.arange(len(batch)), near.shape[1])))
                    yield pa.record_batch([*rows.columns, pa.array(near.ravel().astype(np.int32))], names=["query_id", "dims", "v", "cell"])

        return asked.select(F.col("id").alias("query_id"), "dims", "v").mapInArrow(run, "query_id long, dims int, v binary, cell int")

    def _approximate(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """(vectors, queries) to scores of the vectors' codes: a table of each query's pieces, read by the codes."""
        books = self.books
        pieces = [slice(PIECE * p, PIECE * (p + 1)) for p in range(len(books))]
        last: list = [None, []]  # a task's block and its codes

        def run(x: np.ndarray, q: np.ndarray) -> np.ndarray:
            if last[0] is not x:
                last[:] = x, [nearest(x[:, p], book).astype(np.uint8) for p, book in zip(pieces, books, strict=True)]
            found = np.zeros((len(q), len(x)))
            for p, book, codes in zip(pieces, books, last[1], strict=True):
                found += (q[:, p] @ book.T)[:, codes]
            return found

        return run

    def calibrate(self, asked: DataFrame) -> None:
        """Sets ``probes`` and ``share`` by where the exact neighbours of up to ``CALIBRATION`` queries are found.

        ``probes`` cells hold WANTED of those neighbours, and so do the best
        ``share`` of a block by code. Each of those queries meets every row.
        """
        few = saved(asked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION))
        everywhere = few.select(F.col("id").alias("query_id"), "dims", "v")
        every = broadcast_if_small(saved(self.index.select("cell").distinct()))
        meet = saved(everywhere.crossJoin(every))  # CALIBRATION queries, MOST_CELLS cells
        k, centres, approximate = self.k, self.centres, self._approximate()
        exact = _met(self.index, meet, lambda cell, ids, x, of, q: _best(of, ids, np.round(q @ x.T, 6), k), FOUND)
        near: dict[int, set[int]] = {}
        for r in top(exact, "query_id", [F.col("score").desc(), "id"], k).select("query_id", "id").collect():  # CALIBRATION * k rows
            near.setdefault(r[0], set()).add(r[1])

        def ranks(cell, ids, x, of, q):
            out = []
            order = nearest(q, centres, len(centres))
            code = approximate(x, q)
            place = np.argsort(np.argsort(-code, axis=1, kind="stable"), axis=1, kind="stable")
            for r, query in enumerate(of.tolist()):
                at = np.flatnonzero(np.isin(ids, list(near.get(query, ()))))
                probe = int(np.flatnonzero(order[r] == cell)[0]) + 1
                out += [(probe, (place[r, i] + 1) / len(ids)) for i in at.tolist()]
            return pa.record_batch([pa.array([p for p, _ in out], pa.int32()), pa.array([s for _, s in out], pa.float64())], names=["probe", "share"])

        found = _met(self.index, meet, ranks, "probe int, share double").toPandas()
        if len(found):
            self.probes = int(np.quantile(found["probe"], WANTED, method="higher"))
            self.share = float(np.quantile(found["share"], WANTED, method="higher"))

    def search(self, asked: DataFrame) -> DataFrame:
        """(query_id, id, score): of each query's probed blocks the best by exact cosine among the best by code."""
        k, share, approximate = self.k, self.share, self._approximate()

        def compare(cell, ids, x, of, q):
            scores = np.full((len(q), len(ids)), -np.inf)
            most = min(len(ids), scored(len(ids), k, share))
            chosen = np.argpartition(-approximate(x, q), most - 1, axis=1)[:, :most]
            scores[np.arange(len(q))[:, None], chosen] = np.round(np.einsum("qd,qcd->qc", q, x[chosen]), 6)
            return _best(of, ids, scores, k)

        return _met(self.index, self.visits(asked, self.probes), compare, FOUND)

    def comparisons(self, asked: DataFrame) -> int:
        """Vectors that a search scores exactly, over all queries."""
        k, share = self.k, self.share
        sizes = self.index.groupBy("cell").agg(F.sum(F.least(F.size("ids").cast("long"), F.greatest(F.lit(k + 1).cast("long"), F.ceil(F.size("ids") * share)))).alias("n"))
        return self.visits(asked, self.probes).join(sizes, "cell").agg(F.sum("n")).first()[0] or 0


def scored(rows: int, k: int, share: float) -> int:
    """Rows of a block that a search scores exactly."""
    return max(k + 1, int(np.ceil(rows * share)))


def vector_ann(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, k: int = 10) -> DataFrame:
    """About the ``k`` nearest vectors of each query by cosine: at least nine tenths of them, as calibrated.

    Vectors meet queries of as many dimensions. What is returned is scored
    exactly; what may be missed are neighbours outside the probed cells or far
    down by their codes.
    """
    rows, asked, found = saved(unit_rows(vectors, id_col, vector)), saved(unit_rows(queries, id_col, vector)), None
    for (dims,) in asked.select("dims").distinct().orderBy("dims").collect():
        same = lambda df, n=dims: df.filter(F.col("dims") == n)
        index = CodeIndex.of(same(rows), dims, k)
        index.calibrate(same(asked))
        near = index.search(same(asked))
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = queries.sparkSession.createDataFrame([], FOUND)
    return top(found, "query_id", [F.col("score").desc(), "id"], k).withColumnRenamed("id", id_col)
