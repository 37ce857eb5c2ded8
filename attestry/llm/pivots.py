"""Exact top-k search by inner product with a pivot-distance index.

Every vector gets one further coordinate, sqrt(M - |v|^2) with M the greatest
squared length, so that the greatest inner products with a query are the least
distances from it (its own further coordinate is 0). A vector is keyed by its
nearest pivot and its distance from it; the sorted keys are cut into annuli of
a few hundred vectors, each stored as one block.

A query's distance from all vectors of an annulus is at least the gap between
its distance from the pivot and the annulus' range. Queries take annuli in the
order of that bound, in rounds that grow fourfold, and stop when the bound of
the next exceeds the distance of the k-th vector found; the triangle inequality
makes the rest needless. Scores are exact whole numbers; bounds have a margin
for rounding.

Equal vectors are searched for once, and of each only the k + 1 least ids can
be in a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.runtime import saved
from attestry.sources.tables import read_table

K = 20
#: Pivots, and vectors of a sample from which they are chosen.
PIVOTS, SAMPLE = 32, 4096
#: Vectors of an annulus at least, and annuli at most (more vectors make larger ones).
ANNULUS, MOST_ANNULI = 512, 1 << 18
#: Annuli that a query takes in the first round, and growth of the rounds.
FIRST, GROWTH = 2, 4
#: Queries that meet one copy of an annulus.
SHARE = 1 << 14
#: Relative margin of the bounds.
MARGIN = 1e-7
#: Whole numbers up to this are exact in a double.
EXACT = float(1 << 53)


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    most = np.abs(queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * max(queries.shape[1], 1)
    if most < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return (whole(queries) @ whole(vectors).T).astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dims)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before it."""
    chosen = [0]
    gap = np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        chosen.append(int(np.argmax(gap)))
    return sample[chosen]


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with their further coordinate."""
    rest = np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0.0))
    return np.hstack([x, rest[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1)


class PivotIndex:
    """Vectors of one number of dimensions in annuli around pivots. Built by ``of``."""

    def __init__(self, annuli: DataFrame, bounds: np.ndarray, pivots: np.ndarray, most: float, dims: int):
        self.annuli, self.bounds, self.pivots, self.most, self.dims = annuli, bounds, pivots, most, dims

    @classmethod
    def of(cls, classes: DataFrame, dims: int) -> PivotIndex:
        """Indexes every row of ``classes`` (v, ids): distinct vectors with their ids.

        Pivots come from ``SAMPLE`` vectors at most; they decide the cost alone.
        """
        n, most = classes.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
        most = most or 0.0
        if most >= 2.0**63:
            raise ValueError("inner products of these vectors exceed a long")
        sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()
        pivots = choose_pivots(lifted(_matrix(sample.column(0).combine_chunks(), dims), most), PIVOTS)
        rows = max(ANNULUS, -(-n // MOST_ANNULI))

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = distances(lifted(_matrix(batch.column(0), dims), most), pivots)
                near = d.argmin(axis=1)
                yield pa.record_batch([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), batch.column(0), batch.column(1)], names=["pivot", "distance", "v", "ids"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Runs of rows of one pivot, ordered by distance, as annuli."""
            held, size, pivot = [], 0, None

            def annulus() -> pa.RecordBatch:
                v = np.concatenate([_matrix(b.column(2), dims) for b in held])
                d = np.concatenate([b.column(1).to_numpy() for b in held])
                ids = [i for b in held for i in b.column(3).to_pylist()]
                blob = v.astype("<f8").tobytes()
                return pa.record_batch([pa.array([pivot], pa.int32()), pa.array([d[0]]), pa.array([d[-1]]), pa.array([len(d)], pa.int64()), pa.array([blob]), pa.array([ids], pa.list_(batch.column(3).type))], names=["pivot", "low", "high", "n", "block", "ids"])

            for batch in batches:
                own = batch.column(0).to_numpy()
                at = 0
                while at < len(batch):
                    if size and (own[at] != pivot or size >= rows):
                        yield annulus()
                        held, size = [], 0
                    pivot = own[at]
                    end = min(at + rows - size, at + int(np.searchsorted(own[at:], pivot, "right")))
                    held.append(batch.slice(at, end - at))
                    size += end - at
                    at = end
            if size:
                yield annulus()

        id_type = classes.schema["ids"].dataType.simpleString()
        near = saved(classes.select("v", "ids").mapInArrow(keyed, f"pivot int, distance double, v array<double>, ids {id_type}"))
        order = [F.col("pivot"), F.col("distance"), F.xxhash64("v")]
        dealt = near.repartitionByRange(*order).sortWithinPartitions("pivot", "distance")
        annuli = saved(dealt.mapInArrow(cut, f"pivot int, low double, high double, n long, block binary, ids array<{id_type}>"))
        # numbers follow (pivot, low, high) and, where all three are equal, the block itself
        listed = annuli.select("pivot", "low", "high", F.md5("block").alias("mark")).orderBy("pivot", "low", "high", "mark").toArrow()
        bounds = np.stack([np.asarray(listed.column(i), np.float64) for i in range(3)], axis=1)
        marks = pa.table([listed.column(3), pa.array(np.arange(len(listed), dtype=np.int32))], names=["mark", "annulus"])
        numbered = annuli.withColumn("mark", F.md5("block")).join(F.broadcast(annuli.sparkSession.createDataFrame(marks)), "mark").drop("mark", "pivot", "low", "high")
        return cls(saved(numbered), bounds, pivots, most, dims)

    def visits(self, queries: DataFrame, done: int, width: int) -> DataFrame:
        """(annulus, qid, v, least): each query's next annuli in the order of their bounds, as far as they can hold one of its k best.

        ``queries`` has qid, v and least, the k-th score so far (null: fewer).
        """
        bounds, pivots, most, dims = self.bounds, self.pivots, self.most, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, low, high = bounds[:, 0].astype(np.int64), bounds[:, 1], bounds[:, 2]
            step = max(1, (1 << 21) // max(len(of), 1))
            for whole in batches:
                for at in range(0, len(whole), step):
                    batch = whole.slice(at, step)
                    v = _matrix(batch.column("v"), dims)
                    to = distances(np.hstack([v, np.zeros((len(v), 1))]), pivots)[:, of]
                    bound = np.maximum(np.maximum(to - high, low - to), 0.0)
                    order = np.argsort(bound, axis=1, kind="stable")[:, done : done + width]
                    near = np.take_along_axis(bound, order, axis=1)
                    least = np.array([-np.inf if x is None else float(x) for x in batch.column("least").to_pylist()])
                    length = np.einsum("ij,ij->i", v, v)
                    reach = np.sqrt(np.maximum(length + most - 2 * least, 0.0)) + MARGIN * (1.0 + np.sqrt(length + most))
                    q, k = np.nonzero(near <= reach[:, None])
                    rows = batch.take(pa.array(q))
                    yield pa.record_batch([pa.array(order[q, k].astype(np.int32)), *(rows.column(c) for c in ("qid", "v", "least"))], names=["annulus", "qid", "v", "least"])

        kind = queries.schema["qid"].dataType.simpleString()
        return queries.select("qid", "v", "least").mapInArrow(run, f"annulus int, qid {kind}, v array<double>, least long")

    def compared(self, visits: DataFrame, k: int, id_type: str) -> DataFrame:
        """(qid, id, score): of each visit the k best rows, none below the query's k-th so far."""
        dims = self.dims
        kind = visits.schema["qid"].dataType.simpleString()
        counts = visits.groupBy("annulus").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
        counts = F.broadcast(saved(counts))  # one row for each annulus at most: MOST_ANNULI, pivots and tasks bound them
        none = lambda t, c: F.lit(None).cast(t).alias(c)
        blocks = self.annuli.join(counts, "annulus").select("annulus", F.explode(F.expr("sequence(0, shares - 1)")).alias("part"), F.lit(0).alias("kind"), "block", "ids", none(kind, "qid"), none("array<double>", "v"), none("long", "least"))
        asked = visits.join(counts, "annulus").select("annulus", F.pmod(F.xxhash64("qid"), F.col("shares")).cast("int").alias("part"), F.lit(1).alias("kind"), none("binary", "block"), none(f"array<array<{id_type}>>", "ids"), "qid", "v", "least")
        both = blocks.unionByName(asked).repartition("annulus", "part").sortWithinPartitions("annulus", "part", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = owner = ids = None
            for batch in batches:
                kinds = batch.column("kind").to_numpy()
                cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(batch)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part = batch.slice(a, b - a)
                    if not len(part):
                        continue
                    if kinds[a] == 0:
                        last = part.slice(len(part) - 1)
                        held = last.column("ids").flatten()
                        x = np.frombuffer(last.column("block")[0].as_py(), "<f8").reshape(len(held), dims)
                        owner = np.repeat(np.arange(len(x)), held.value_lengths().to_numpy())
                        ids = held.flatten()
                        continue
                    for c in range(0, len(part), 256):
                        few = part.slice(c, 256)
                        s = scores(_matrix(few.column("v"), dims), x)[:, owner]
                        low = np.array([np.iinfo(np.int64).min if v is None else v for v in few.column("least").to_pylist()], np.int64)
                        q, i = _best(s, ids.to_numpy(), low, k)
                        yield pa.record_batch([few.column("qid").take(pa.array(q)), ids.take(pa.array(i)), pa.array(s[q, i])], names=["qid", "id", "score"])

        return both.drop("part").mapInArrow(run, f"qid {kind}, id {id_type}, score long")


def _best(s: np.ndarray, ids: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row, of equals the least ids, none below ``low``."""
    if s.shape[1] > k:
        low = np.maximum(low, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
    q, i = np.nonzero(s >= low[:, None])
    order = np.lexsort((ids[i], -s[q, i], q))
    q, i = q[order], i[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], i[place < k]


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` greatest inner products of each query with the rows of ``vectors`` but itself.

    Both have id and v, an array of whole numbers as doubles; ``queries`` are
    rows of ``vectors``. Of equal scores the lesser id comes first. Rows
    without an id or a vector take no part; rows equal in id and vector are
    one, and of an id with several vectors each is a row of its own. Vectors
    meet those of as many dimensions. With fewer rows than ``k`` all are given.
    Ids are whole numbers; vectors so long that scores exceed a long are an error.
    """
    id_type = vectors.schema["id"].dataType.simpleString()
    rows = saved(vectors.select("id", "v").dropna().dropDuplicates(["id", "v"]))
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    classes = saved(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = saved(queries.select("id", "v").dropna().distinct().withColumn("qid", F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ","))))
    found = None
    for (dims,) in asked.select(F.size("v")).distinct().orderBy(F.size("v")).collect():
        index = PivotIndex.of(classes.filter(F.size("v") == dims), dims)
        distinct = asked.filter(F.size("v") == dims).select("qid", "v").distinct()
        distinct = saved(distinct.withColumn("least", F.lit(None).cast("long")))
        open_, best, done, width = distinct, None, 0, FIRST
        while done < len(index.bounds):
            visits = saved(index.visits(open_, done, width))
            if visits.isEmpty():
                break
            near = index.compared(visits, k + 1, id_type)
            best = saved(_top(near if best is None else best.drop("rank").unionByName(near), k + 1))
            reached = best.filter(F.col("rank") == k + 1).select("qid", F.col("score").alias("reached"))
            # a query that has no visit in this round has none in the next: bounds only grow
            going = visits.select("qid").distinct()
            open_ = saved(distinct.drop("least").join(going, "qid", "left_semi").join(reached, "qid", "left").withColumnRenamed("reached", "least"))
            done, width = done + width, width * GROWTH
        if best is not None:
            found = best if found is None else found.unionByName(best)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, id {id_type}, score long")
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best"))
    own = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    each = asked.select("qid", F.col("id").alias("query_id"), own.alias("own")).join(lists, "qid")
    mine = F.array_position(F.transform("best", lambda x: (x["id"] == F.col("query_id")) & (x["s"] == -F.col("own"))), True)
    others = F.filter("best", lambda x, i: i + 1 != F.col("mine"))
    listed = each.withColumn("mine", mine).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "x"))
    return listed.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), (-F.col("x.s")).alias("score"))


def scaled(vectors: DataFrame, id_col: str, vector: str, factor: int = 64) -> DataFrame:
    """(id, v): each component as floor(factor * x), x as double; vectors that are null or hold a null or a number without end go."""
    v = F.transform(vector, lambda x: F.lit(float(factor)) * x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & sound & F.col("id").isNotNull())
    return rows.select("id", F.transform("v", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x) + 0.0).alias("v"))


def op12_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest whole inner products of each vector whose id 20 divides, among all vectors of the table."""
    vectors = saved(scaled(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    found = top_k(vectors, vectors.filter(F.col("id") % 20 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {"op12_pivot_search": op12_pivot_search}
ORACLE_SQL = {
    "op12_pivot_search": """
    WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE) + 0.0) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
        FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """
}
