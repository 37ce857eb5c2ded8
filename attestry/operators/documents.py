"""Documents: blobs, revisions, pages, chunks, index and lexical search (family K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.runtime import broadcast_if_small, saved

#: A line that is a heading: short and without a full stop.
HEADING = r"^[^.]{1,40}$"


def blobs(docs: DataFrame, text: str) -> DataFrame:
    """One row for each distinct content with the number of its origins."""
    return docs.groupBy(F.sha2(text, 256).alias("hash")).agg(F.count(F.lit(1)).alias("n_origins"), F.octet_length(F.first(text)).cast("long").alias("n_bytes"))


def exact_duplicates(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Each document of a repeated content with the least id of that content."""
    hashed = docs.select(id_col, F.sha2(text, 256).alias("hash"))
    kept = hashed.groupBy("hash").agg(F.min(id_col).alias("kept_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return hashed.join(kept, "hash").select(id_col, "kept_id", "copies")


def paginate(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Pages (lines) from 1."""
    return docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("page", "page_text")).withColumn("page", F.col("page") + 1)


def token_count(text: Column) -> Column:
    """Runs of other characters than spaces (recipe 1)."""
    return F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0b]+"), lambda w: w != ""))


def segments(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, page, line, segment, heading): lines with the number and the heading of the segment that they are in.

    A heading begins a segment; lines before the first are segment 0 without one.
    """
    lines = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("page", "line"))
    w = Window.partitionBy(id_col).orderBy("page")
    marked = lines.withColumn("h", F.col("line").rlike(HEADING))
    found = marked.withColumn("segment", F.sum(F.col("h").cast("long")).over(w)).withColumn("heading", F.last(F.when(F.col("h"), F.col("line")), ignorenulls=True).over(w))
    return found.select(id_col, F.col("page") + 1, "line", "segment", "heading").toDF(id_col, "page", "line", "segment", "heading")


def chunk(docs: DataFrame, id_col: str, text: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """(id, segment, heading, ordinal, first_token, n_tokens, chunk_text): windows of tokens with an overlap, never over the edge of a segment."""
    lines = segments(docs, id_col, text).groupBy(id_col, "segment").agg(F.max("heading").alias("heading"), F.array_sort(F.collect_list(F.struct("page", "line"))).alias("lines"))
    whole = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    words = lines.select(id_col, "segment", "heading", F.filter(F.split(whole, r"[ \t\n\r\f\x0b]+"), lambda w: w != "").alias("w"))
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - overlap) / step).cast("int") - 1))
    each = words.filter(F.size("w") > 0).withColumn("ordinal", F.explode(starts))
    part = F.slice("w", F.col("ordinal") * step + 1, size)
    return each.select(id_col, "segment", "heading", "ordinal", (F.col("ordinal") * step).alias("first_token"), F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("chunk_text"))


def chunk_violations(chunks: DataFrame, keys: list[str], size: int = 800, overlap: int = 100) -> DataFrame:
    """Chunks that do not follow the one before them, are empty or too long, or begin at another token than their ordinal says."""
    before = F.lag("ordinal").over(Window.partitionBy(*keys).orderBy("ordinal"))
    dense = F.col("ordinal") == F.coalesce(before + 1, F.lit(0))
    fits = F.col("n_tokens").between(1, size) & (F.col("first_token") == F.col("ordinal") * (size - overlap))
    return chunks.withColumn("dense", dense).filter(~F.col("dense") | ~fits)


def near_candidates(docs: DataFrame, id_col: str, text: str, bands: int = 8, rows: int = 4) -> DataFrame:
    """(id, rep): documents with one whose MinHash over three-word shingles equals theirs in a band; candidates for review.

    Equal texts and equal bands are one class each: a row leads to the least id
    of its band, so a group of copies gives as many rows as it has members.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 3), " ")))
    held = docs.select(id_col, words.alias("w")).filter(F.size("w") > 0).select(id_col, shingles.alias("s"))
    least = lambda seed: F.array_min(F.transform("s", lambda x: F.xxhash64(x, F.lit(seed))))
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[least(b * rows + r) for r in range(rows)]).alias("key")) for b in range(bands)])
    banded = saved(held.select(id_col, F.explode(keys).alias("k")).select(id_col, "k.*"))
    reps = banded.groupBy("band", "key").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return banded.join(reps, ["band", "key"]).filter(F.col(id_col) != F.col("rep")).select(id_col, "rep").distinct()


def select_context(ranked: DataFrame, query_id: str, order: list, tokens: str, most: int = 8, budget: int = 3000) -> DataFrame:
    """The first ``most`` rows of each query whose tokens together stay inside the budget, with ``place`` and ``used``."""
    w = Window.partitionBy(query_id).orderBy(*order)
    placed = ranked.withColumn("place", F.row_number().over(w)).withColumn("used", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.filter((F.col("place") <= most) & (F.col("used") <= budget))


def top(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def rank_fusion(*lists: DataFrame, query_id: str, id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists."""
    union = lists[0].select(query_id, id_col, "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select(query_id, id_col, "rank"))
    return union.groupBy(query_id, id_col).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))


def text_quality(text: Column) -> Column:
    """accepted, doubtful or rejected by the share of letters, digits and spaces."""
    n = F.length(text)
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""))
    return F.when(n == 0, "rejected").when(plain / n >= 0.9, "accepted").when(plain / n >= 0.6, "doubtful").otherwise("rejected")


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags dropped, spaces collapsed."""
    bare = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f\x0b]+", " "))


def lexical(queries: DataFrame, docs: DataFrame, query_id: str, id_col: str, text: str, k: int = 30) -> DataFrame:
    """See :func:`attestry.operators.search.lexical`."""
    from attestry.operators import search  # it imports this module

    return search.lexical(queries, docs, query_id, id_col, text, k)
