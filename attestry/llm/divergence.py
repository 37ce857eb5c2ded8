"""Divergence of the term use of sources, counted by length-bucketed packing.

Tasks count the terms of their documents as machine words: a term of up to 8
bytes is one uint64, one of up to 16 bytes two, which are radix-sorted and
run-counted in numpy. Longer terms go to separate buckets by length and are
sorted as bytes. What leaves a task is one row for each term, source and
language that a buffer of documents holds; Spark sums these.

Counts become parts of 10^9, p = 1 + floor(10^9 (n + 1) / (N + V)), and two
parts compare as floor((p - q)^2 / q). Sources are compared in blocks of terms
and blocks of sources, so that no task holds a language; terms that neither of
two sources uses differ alike and are only counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm.text import ASCII_LOWER, slices
from attestry.runtime import broadcast_if_small, saved
from attestry.sources.tables import read_table

#: Documents of its language that must hold a term, and ranks of the term part.
MIN_DOCS, TERM_RANKS = 3, 200
ONE = 1_000_000_000
#: Bytes of text that a task counts at a time; a longer text is counted alone.
BUFFER = 8 << 20
#: (term, source) rows of a block of terms, and sources of a block of sources.
BLOCK_ROWS, BLOCK_SOURCES = 1 << 18, 128

#: 1 for the bytes of terms: A-Z, a-z and those of other characters than ASCII.
_IN_TERM = np.zeros(256, np.uint8)
_IN_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows of uint64 words (most significant first), by digits of 16 bits from the last."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Terms of up to 8 * n_words bytes as big-endian words, filled up with zeros. ``text`` has 16 bytes to spare."""
    at = np.ndarray((len(text) - 7,), ">u8", text.data, strides=(1,))
    out = []
    for k in range(n_words):
        used = np.clip(sizes - 8 * k, 0, 8).astype(np.uint64)
        mask = np.where(used == 0, np.uint64(0), ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * np.maximum(used, 1)))
        out.append(at[starts + 8 * k].astype(np.uint64) & mask)
    return out


def _runs(new_term: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, rows, documents) of each run of one term and group; rows stand by term, group and document."""
    new_run = new_term | np.r_[True, group[1:] != group[:-1]]
    first = np.flatnonzero(new_run)
    new_doc = (new_run | np.r_[True, doc[1:] != doc[:-1]]).astype(np.int64)
    return first, np.diff(np.r_[first, len(group)]), np.add.reduceat(new_doc, first)


def count_terms(texts: list[bytes], groups: list[int]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, group, occurrences, documents), one part for each bucket of lengths. ``groups`` is in ascending order."""
    raw = b"\0".join(texts).translate(ASCII_LOWER) + bytes(24)
    text = np.frombuffer(raw, np.uint8)
    edge = np.diff(_IN_TERM[text], prepend=np.uint8(0), append=np.uint8(0)).view(np.int8)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = ends - starts
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    doc = np.searchsorted(begins, starts, "right") - 1
    group = np.asarray(groups)[doc]
    for n_words, low, high in ((1, 0, 8), (2, 8, 16)):
        own = np.flatnonzero((sizes > low) & (sizes <= high))
        if len(own):
            words = packed(text, starts[own], sizes[own], n_words)
            order = radix_order(words)
            words = [w[order] for w in words]
            new = np.r_[True, np.any([w[1:] != w[:-1] for w in words], axis=0)]
            first, n, docs = _runs(new, group[own][order], doc[own][order])
            shown = np.stack([w[first] for w in words], axis=1).astype(">u8")
            yield shown.view(f"S{8 * n_words}").ravel().tolist(), group[own][order][first], n, docs
    long = sizes > 16
    bucket = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for b in np.unique(bucket[long]):
        own = np.flatnonzero(long & (bucket == b))
        terms = np.array([raw[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        first, n, docs = _runs(np.r_[True, terms[1:] != terms[:-1]], group[own][order], doc[own][order])
        yield terms[first].tolist(), group[own][order][first], n, docs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (lang, source, text) as rows (lang, source, term, n, docs)."""

    def counted(held: list[tuple[str, str, bytes]]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda r: r[:2])
        names = sorted({r[:2] for r in held})
        code = {name: i for i, name in enumerate(names)}
        langs, sources = (pa.array([n[i] for n in names], pa.string()) for i in (0, 1))
        for terms, group, n, docs in count_terms([r[2] for r in held], [code[r[:2]] for r in held]):
            yield pa.record_batch([langs.take(pa.array(group)), sources.take(pa.array(group)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])

    held, size = [], 0
    for batch in slices(batches):
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.append((lang, source, text.encode()))
            size += len(held[-1][2])
            if size >= BUFFER:
                yield from counted(held)
                held, size = [], 0
    if held:
        yield from counted(held)


def _share(n: str | Column, total: str, size: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + size)) in whole numbers, in two steps that stay inside a long."""
    up, below = (F.col(n) if isinstance(n, str) else n) + 1, F.col(total) + F.col(size)
    high, rest = F.call_function("div", up * 100_000, below), (up * 100_000) % below
    return high * 10_000 + F.call_function("div", rest * 10_000, below) + 1


def _shares(n: np.ndarray, below: np.ndarray) -> np.ndarray:
    """As ``_share``, for ``below`` = N + V."""
    up = (n + 1) * 100_000
    return up // below * 10_000 + up % below * 10_000 // below + 1


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks (lang, chunk, i, j, source, total, size, term, n) as (lang, source, item, value, terms).

    A block has a row without a term for each of its sources and then one for
    each term of a source; blocks come one after the other. ``terms`` counts
    the block's terms, which the value is over.
    """

    def done(key: tuple, rows: dict[str, list]) -> pa.RecordBatch:
        heads = np.array([t is None for t in rows["term"]])
        of = np.array(rows["source"], object)
        at = {s: k for k, s in enumerate(of[heads])}
        terms = {t: k for k, t in enumerate(dict.fromkeys(t for t in rows["term"] if t is not None))}
        below = np.array([n for n, head in zip(rows["total"], heads, strict=True) if head], np.int64) + rows["size"][0]
        counts = np.zeros((len(at), len(terms)), np.int64)
        data = np.flatnonzero(~heads)
        counts[[at[of[k]] for k in data], [terms[rows["term"][k]] for k in data]] = [rows["n"][k] for k in data]
        side = np.array(rows["side"])[heads]
        names = list(at)
        shares = _shares(counts, np.maximum(below, 1)[:, None])
        a, b, value = [], [], []
        for k in range(len(names)):  # a source against all others of the two blocks of sources
            others = np.flatnonzero((side != side[k]) if key[2] != key[3] else np.arange(len(names)) != k)
            gap = shares[k] - shares[others]
            a += [names[k]] * len(others)
            b += [names[o] for o in others]
            value.append((gap * gap // shares[others]).sum(axis=1))
        columns = [pa.array([key[0]] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(np.concatenate(value) if value else np.zeros(0, np.int64)), pa.array(np.full(len(a), len(terms)))]
        return pa.record_batch(columns, names=["lang", "source", "item", "value", "terms"])

    key, rows = None, {}
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        keys = list(zip(columns["lang"], columns["chunk"], columns["i"], columns["j"], strict=True))
        cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            if keys[x] != key:
                if key is not None:
                    yield done(key, rows)
                key, rows = keys[x], {name: [] for name in columns}
            for name in columns:
                rows[name] += columns[name][x:y]
    if key is not None:
        yield done(key, rows)


class Divergence:
    """Counts of a corpus' terms by language and source, and what they show. Built by ``of``."""

    def __init__(self, groups: DataFrame, counts: DataFrame, kept: DataFrame, langs: DataFrame):
        self.groups, self.counts, self.kept, self.langs = groups, counts, kept, langs

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = MIN_DOCS) -> Divergence:
        """Counts ``docs`` (lang, source, text); nulls read as empty, and further columns are ignored.

        A repeated row is a document of its own. A text may be of any length; a
        term of any length is counted. An empty table has no groups.
        """
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        rows = docs.select(text("lang"), text("source"), text("text"))
        groups = rows.select("lang", "source").distinct()
        parts = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        counts = saved(parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
        kept = saved(kept)
        counts = saved(counts.drop("docs").join(kept, ["lang", "term"]))
        sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
        langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("size"))
        groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "rows", "lang_total", "size"])
        groups = saved(groups)
        blocks = groups.groupBy("lang").agg(F.ceil(F.sum("rows") / BLOCK_ROWS).cast("int").alias("chunks"), F.ceil(F.count(F.lit(1)) / BLOCK_SOURCES).cast("int").alias("blocks"))
        langs = saved(blocks.select("lang", F.greatest("chunks", F.lit(1)).alias("chunks"), "blocks"))
        return cls(groups, counts, kept, langs)

    def terms(self, ranks: int = TERM_RANKS) -> DataFrame:
        """(lang, source, item, value, rank): terms that a source uses more than its language, by their divergence."""
        known = broadcast_if_small(self.groups.select("lang", "source", "total", "lang_total", "size"))
        found = self.counts.join(known, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share("n", "total", "size").alias("p"), _share("lang_n", "lang_total", "size").alias("q"))
        gap = F.col("p") - F.col("q")
        value = F.call_function("div", gap * gap, F.col("q"))
        return ranked(found.filter("p > q").select("lang", "source", "item", value.alias("value"))).filter(F.col("rank") <= ranks)

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): each other source of a language with its divergence over all kept terms."""
        plan = broadcast_if_small(self.langs)
        dealt = lambda df: df.join(plan, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
        each = F.explode(F.expr("sequence(0, blocks - 1)"))
        meet = lambda df: df.withColumn("other", each).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        columns = ["lang", "chunk", "i", "j", "source", "total", "size", "term", "n", F.col("own").alias("side")]
        heads = meet(dealt(self.groups).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))))
        heads = heads.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(None).cast("long")}).select(*columns)
        rows = meet(dealt(self.counts).withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")))
        rows = rows.withColumns({"total": F.lit(None).cast("long"), "size": F.lit(None).cast("long")}).select(*columns)
        blocks = heads.unionByName(rows).repartition("lang", "chunk", "i", "j").sortWithinPartitions("lang", "chunk", "i", "j", "term", "source")
        parts = blocks.mapInArrow(_compare, "lang string, source string, item string, value long, terms long")
        found = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
        known = self.groups.select("lang", "source", "total", "size")
        a = broadcast_if_small(known.filter("size > 0"))
        b = broadcast_if_small(known.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total")))
        both = found.join(a, ["lang", "source"], "left").join(b, ["lang", "item"])
        p, q = _share(F.lit(0).cast("long"), "total", "size"), _share(F.lit(0).cast("long"), "item_total", "size")
        both = both.withColumns({"p": p, "q": q})
        idle = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")) * (F.col("size") - F.col("terms"))
        value = F.when(F.col("size").isNull(), F.lit(0).cast("long")).otherwise(F.col("value") + idle)
        return ranked(both.select("lang", "source", "item", value.alias("value")))


def ranked(df: DataFrame) -> DataFrame:
    """``df`` with its ``rank`` in each language and source: highest value first, of equals the least item by its bytes."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return df.withColumn("rank", F.row_number().over(order))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of the audit over the whole table of documents."""
    found = Divergence.of(read_table(spark, sf_dir, "documents"))
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", found.pairs()), ("term", found.terms()))]
    return parts[0].unionByName(parts[1])


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE_SQL = {
    "op13_source_divergence": r"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
    size AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS n, any_value(lang_n) AS lang_n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    g AS (SELECT lang, source, coalesce(any_value(total), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d)
        LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) GROUP BY ALL),
    dense AS (SELECT g.lang, g.source, kept.term, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + size.v) AS p
        FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
        FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    pq AS (SELECT lang, source, term AS item, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS p,
        1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + v) AS q FROM c JOIN g USING (lang, source) JOIN size USING (lang)),
    term AS (SELECT lang, source, item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM pq WHERE p > q),
    both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
    """
}
