"""Quality rules by cross-document line frequency.

Lines are normalised (outer and repeated spaces dropped, A-Z lower-cased, runs
of digits made one 0) and hashed together with their host. A line is counted
once for each distinct document of the host, and documents are told apart by
the hash of all their normalised lines: only equal ones count once.
Lines above the limit are removed, and a document of which too little is left
is rejected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.text import ASCII_LOWER, SPACES, intern_words, slices
from attestry.runtime import saved
from attestry.sources.tables import read_table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line goes when more documents of its host than this hold it.
LINE_MIN_DOCS = 20
LINE_SHARE = 0.001
#: A document is depleted when fewer words, or a smaller percentage, are left.
LEFT_WORDS = 20
LEFT_PERCENT = 30
#: Frequent lines are broadcast (8 bytes each) up to this many, joined beyond.
BROADCAST_LINES = 2_000_000

_DIGITS = re.compile(rb"[0-9]+")
_NO_HOST = b"\x1f"


def _line_key(host: bytes, line: bytes) -> int:
    """Signed 64-bit key of a host's normalised line."""
    norm = _DIGITS.sub(b"0", b" ".join(line.split()).translate(ASCII_LOWER))
    return int.from_bytes(hashlib.md5(host + b"\x1f" + norm).digest()[:8], "big") - (1 << 63)


def _host_bytes(host: str | None) -> bytes:
    return _NO_HOST if host is None else host.encode()


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        docs, lines = [], []
        for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = _host_bytes(host)
            keys = [_line_key(h, x) for x in (text or "").encode().split(b"\n") if x.split()]
            docs.append(hashlib.md5(np.array(keys, np.int64).tobytes()).digest())
            lines.append(sorted(set(keys)))
        yield pa.record_batch([batch.column(0), pa.array(docs, pa.binary()), pa.array(lines, pa.list_(pa.int64()))], names=["host", "doc", "lines"])


def frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = LINE_MIN_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """Keys of lines above the limit: (line, n_docs).

    The limit of a host is the larger of ``min_docs`` and ``share`` of its
    documents. A null host is a host of its own.
    """
    narrow = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    rows = narrow.mapInArrow(_line_rows, "host string, doc binary, lines array<long>").dropDuplicates(["host", "doc"])
    counts = rows.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = narrow.groupBy("host").agg(F.count(F.lit(1)).alias("n_host")).withColumnRenamed("host", "h")
    return counts.filter(F.col("n_docs") > min_docs).join(hosts, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n_docs") > share * F.col("n_host")).select("line", "n_docs")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = intern_words(words)
    key = ids[:n]
    for k in range(1, width):
        key = np.unique(key, return_inverse=True)[1] * (len(ids) + 1) + ids[k : k + n]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def _measure(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _stats(text: str | None) -> list:
    n, chars, symbols, dup, repeats = _measure(text)
    return [n, chars, symbols, dup, repeats, n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n]


def _without(text: str | None, host: str | None, gone) -> tuple[str | None, int, int]:
    """Text without the lines for which ``gone(keys)`` holds, lines removed, words left."""
    lines = (text or "").split("\n")
    raw = [x.encode() for x in lines]
    sizes = [len(x.split()) for x in raw]
    at = [i for i, n in enumerate(sizes) if n]
    h = _host_bytes(host)
    bad = {i for i, b in zip(at, gone([_line_key(h, raw[i]) for i in at]), strict=True) if b}
    if not bad:
        return text, 0, sum(sizes)
    return "\n".join(x for i, x in enumerate(lines) if i not in bad), len(bad), sum(n for i, n in enumerate(sizes) if i not in bad)


def _depleted(n_words: int, left: int) -> bool:
    return left < n_words and (left < LEFT_WORDS or 100 * left < LEFT_PERCENT * n_words)


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = LINE_MIN_DOCS, share: float = LINE_SHARE, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with the columns of STATS, ``n_lines_removed``, ``clean_text`` and ``kept``.

    A null text counts as empty and stays null in ``clean_text``; empty
    documents fail the base rules. Repeated rows and ties are judged alike, and
    texts are read whole, however long. A null host is a host of its own.
    Columns of ``docs`` with the names of the new ones are replaced. An empty
    table gives an empty result. ``kept`` is false if the base rules fail or
    the document is depleted.
    """
    spark = docs.sparkSession
    lines = saved(frequent_lines(docs, text_col, host_col, min_docs, share))
    new = [x.split()[0] for x in STATS.split(", ")] + ["n_lines_removed", "clean_text", "kept"]
    docs = docs.drop(*[c for c in new if c in docs.columns])
    if lines.count() <= broadcast_lines:
        shared = spark.sparkContext.broadcast(np.sort(np.array(lines.select("line").toArrow().column("line"), np.int64)))

        def gone(keys: list[int]) -> np.ndarray:
            table, keys = shared.value, np.array(keys, np.int64)
            if not len(table):
                return np.zeros(len(keys), bool)
            return table[np.searchsorted(table, keys).clip(max=len(table) - 1)] == keys

        source = docs
    else:
        # The lines of each document are joined to the frequent ones, and the
        # hits come back to the document as an array.
        row = F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit("\x1f")), F.coalesce(F.col(text_col), F.lit("")))
        source = docs.withColumn("__row", row)
        exploded = source.select("__row", F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")).dropDuplicates(["__row"]).mapInArrow(_keyed_lines, "__row long, line long")
        hits = exploded.join(lines.select("line"), "line").groupBy("__row").agg(F.collect_set("line").alias("__hits"))
        source = source.join(hits, "__row", "left")
        gone = None

    columns = docs.columns
    text_at, host_at = source.columns.index(text_col), source.columns.index(host_col)
    schema = T.StructType(docs.schema.fields[:])
    for name, kind in [x.split() for x in STATS.split(", ")] + [["n_lines_removed", "long"], ["clean_text", "string"], ["kept", "boolean"]]:
        schema = schema.add(name, kind)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, hosts = batch.column(text_at).to_pylist(), batch.column(host_at).cast(pa.string()).to_pylist()
            hits = [set(x or ()) for x in batch.column("__hits").to_pylist()] if gone is None else None
            out = []
            for i, (text, host) in enumerate(zip(texts, hosts, strict=True)):
                stats = _stats(text)
                clean, removed, left = _without(text, host, gone or (lambda keys, own=hits and hits[i]: [k in own for k in keys]))
                out.append([*stats, removed, clean, not stats[-1] and not _depleted(stats[0], left)])
            kept = [batch.column(c) for c in columns]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=[*columns, *new])

    return source.mapInArrow(judge, schema)


def _keyed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, keys = [], []
        for row, host, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            h = _host_bytes(host)
            own = {_line_key(h, x) for x in (text or "").encode().split(b"\n") if x.split()}
            rows += [row] * len(own)
            keys += own
        yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(keys, pa.int64())], names=["__row", "line"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document of the table."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = {
    "op5_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, chr(31)) AS host FROM documents
), w AS (
  SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1)
  GROUP BY rid
), lines AS (
  SELECT rid, host, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw
  FROM (SELECT w.rid, d.host, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM w JOIN d USING (rid))
), dups AS (
  SELECT rid, CAST(sum(c - 1) AS BIGINT) AS n_dup_lines
  FROM (SELECT rid, line, count(*) AS c FROM lines WHERE nw > 0 GROUP BY rid, line) GROUP BY rid
), normed AS (
  SELECT rid, host, pos, nw, regexp_replace(translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS norm
  FROM lines WHERE nw > 0
), whole AS (
  SELECT rid, sha256(string_agg(norm, chr(10) ORDER BY pos)) AS doc FROM normed GROUP BY rid
), freq AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc) AS n FROM normed JOIN whole USING (rid) GROUP BY host, norm)
  JOIN (SELECT host, count(*) AS h FROM d GROUP BY host) USING (host)
  WHERE n > {LINE_MIN_DOCS} AND n > {LINE_SHARE} * h
), leftover AS (
  SELECT rid, sum(nw) FILTER (WHERE f.norm IS NULL) AS n_left FROM normed n LEFT JOIN freq f ON n.host = f.host AND n.norm = f.norm GROUP BY rid
), s AS (
  SELECT d.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_left, 0) AS n_left
  FROM d JOIN w USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN leftover USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND NOT (n_left < n_words AND (n_left < {LEFT_WORDS} OR 100 * n_left < {LEFT_PERCENT} * n_words)) AS kept
FROM s
""",
}
QUERIES = {"op5_quality_rules": op5_quality_rules}
