"""Queries on documents, chunks, search, versions and answers (family K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.operators import documents as K
from attestry.operators import joins as D
from attestry.operators import search as X
from attestry.operators import vectors as N
from attestry.operators import windows as W
from attestry.plans.fixtures import Registry

query = Registry()
SPACES = r"[ \t\n\r\f\x0b]+"
WORDS = r"[^ \t\n\r\f\x0b]+"
QUALITY = r"CASE WHEN length({t}) = 0 THEN 'rejected' WHEN length(regexp_replace({t}, '[^\p{{L}}\p{{N}}\s]', '', 'g')) / length({t}) >= 0.9 THEN 'accepted' WHEN length(regexp_replace({t}, '[^\p{{L}}\p{{N}}\s]', '', 'g')) / length({t}) >= 0.6 THEN 'doubtful' ELSE 'rejected' END"
LINES = "l AS (SELECT doc_id, CAST(page AS BIGINT) AS page, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents))"
SEGMENTS = rf"{LINES}, g AS (SELECT *, sum(CASE WHEN regexp_full_match(line, '[^.]{{1,40}}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS segment FROM l)"


@query("k2_revisions", "fx_checks", """SELECT source_id, check_id, row_number() OVER (PARTITION BY source_id ORDER BY checked_at, check_id) AS revision, lag(check_id) OVER (PARTITION BY source_id ORDER BY checked_at, check_id) AS supersedes FROM (
SELECT *, lag(content_hash) OVER (PARTITION BY source_id ORDER BY checked_at, check_id) AS p FROM fx_checks) WHERE p IS NULL OR p <> content_hash""")
def k2(checks):
    """New bytes under a known address make a revision, which supersedes the one before."""
    order = ["checked_at", "check_id"]
    w = Window.partitionBy("source_id").orderBy(*order)
    changed = W.changes(checks, "source_id", "content_hash", order)
    return changed.select("source_id", "check_id", F.row_number().over(w).alias("revision"), F.lag("check_id").over(w).alias("supersedes"))


@query("k5_ocr_candidates", "documents", f"WITH {LINES} SELECT doc_id, page, {QUALITY.format(t='line')} AS quality FROM l WHERE {QUALITY.format(t='line')} <> 'accepted'")
def k5(documents):
    """Pages whose text is empty or doubtful are read again."""
    pages = K.paginate(documents, "doc_id", "text")
    return pages.select("doc_id", F.col("page").cast("long").alias("page"), K.text_quality(F.col("page_text")).alias("quality")).filter("quality <> 'accepted'")


@query("k6_segments", "documents", f"WITH {SEGMENTS} SELECT doc_id, page, CAST(segment AS BIGINT) AS segment FROM g")
def k6(documents):
    return K.segments(documents, "doc_id", "text").select("doc_id", F.col("page").cast("long").alias("page"), "segment")


CHUNKS = rf"""{SEGMENTS}, h AS (SELECT doc_id, segment, max(CASE WHEN regexp_full_match(line, '[^.]{{1,40}}') THEN line END) AS heading, regexp_extract_all(string_agg(line, chr(10) ORDER BY page), '{WORDS}') AS w FROM g GROUP BY 1, 2),
o AS (SELECT doc_id, CAST(segment AS BIGINT) AS segment, heading, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - 100) / 700) AS BIGINT)))) AS ordinal FROM h WHERE len(w) > 0),
c AS (SELECT doc_id, segment, heading, ordinal, ordinal * 700 AS first_token, CAST(len(w[ordinal * 700 + 1 : ordinal * 700 + 800]) AS BIGINT) AS n_tokens, md5(array_to_string(w[ordinal * 700 + 1 : ordinal * 700 + 800], ' ')) AS chunk_md5 FROM o)"""


def _chunks(documents):
    found = K.chunk(documents, "doc_id", "text")
    return found.select("doc_id", "segment", "heading", *[F.col(c).cast("long").alias(c) for c in ("ordinal", "first_token", "n_tokens")], F.md5("chunk_text").alias("chunk_md5"))


@query("k7_chunk", "documents", f"WITH {CHUNKS} SELECT * FROM c")
def k7(documents):
    return _chunks(documents)


@query("k8_chunk_violations", "documents", f"WITH {CHUNKS}, d AS (SELECT *, CASE WHEN (doc_id + segment) % 9 = 4 THEN n_tokens + 700 ELSE n_tokens END AS n FROM c WHERE (doc_id + ordinal) % 7 <> 3) SELECT doc_id, segment, ordinal FROM (SELECT *, lag(ordinal) OVER (PARTITION BY doc_id, segment ORDER BY ordinal) AS p FROM d) WHERE ordinal <> coalesce(p + 1, 0) OR n NOT BETWEEN 1 AND 800")
def k8(documents):
    """The invariants, on chunks of which some are taken away and some lengthened."""
    odd = F.when((F.col("doc_id") + F.col("segment")) % 9 == 4, F.col("n_tokens") + 700).otherwise(F.col("n_tokens"))
    damaged = _chunks(documents).filter((F.col("doc_id") + F.col("ordinal")) % 7 != 3).withColumn("n_tokens", odd)
    return K.chunk_violations(damaged, ["doc_id", "segment"]).select("doc_id", "segment", "ordinal")


@query("k12_vector_ann", "embeddings")
def k12(embeddings):
    """Approximate neighbours of the stated queries; a test measures their recall against the exact ones."""
    return N.vector_ann(embeddings.filter("vec_id % 20 = 0"), embeddings, "vec_id", "embedding")


def _search_sql(docs: str) -> str:
    """The ranked lists and what is made of them, as common table expressions over the documents in scope."""
    return rf"""t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM {docs}) GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS dl FROM t GROUP BY 1), n AS (SELECT count(*) AS n, avg(dl) AS a FROM l), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark WHERE item_id % 20 = 0),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM q JOIN t USING (term) JOIN d USING (term) JOIN l USING (doc_id) CROSS JOIN n GROUP BY 1, 2),
lex AS (SELECT item_id, doc_id, r FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 30),
v AS (SELECT a.vec_id AS item_id, b.vec_id AS doc_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0) AND b.vec_id IN (SELECT doc_id FROM {docs})),
vec AS (SELECT item_id, doc_id, r FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM v) WHERE r <= 30),
fused AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM vec) GROUP BY 1, 2),
passages AS (SELECT item_id, doc_id, score, n, source FROM (SELECT f.*, source, len(regexp_extract_all(text, '{WORDS}')) AS n, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, f.doc_id) AS r FROM fused f JOIN {docs} x ON f.doc_id = x.doc_id) WHERE r = 1),
context AS (SELECT item_id, doc_id, source, place, used FROM (SELECT *, row_number() OVER w AS place, CAST(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM passages WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)) WHERE place <= 8 AND used <= 3000)"""


SEARCH = _search_sql("documents")


def _lists(benchmark, embeddings, documents):
    """The lexical and the vector list of each query; a document's vector has its id."""
    asked = benchmark.filter("item_id % 20 = 0")
    lexical = X.lexical(asked, documents, "item_id", "doc_id", "text")
    queries = embeddings.join(asked.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    scope = embeddings.join(documents.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = N.vector_top(queries, scope, "vec_id", "embedding").select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "rank")
    return lexical, near


def _fused(benchmark, embeddings, documents):
    return K.rank_fusion(*_lists(benchmark, embeddings, documents), query_id="item_id", id_col="doc_id")


def _passages(fused, documents):
    """One document for each text of a query's list."""
    texts = documents.select("doc_id", "source", F.sha2("text", 256).alias("hash"), K.token_count(F.col("text")).cast("long").alias("n_tokens"))
    return W.first_by(fused.join(texts, "doc_id"), ["item_id", "hash"], [F.col("score").desc(), "doc_id"]).drop("hash")


def _context(passages):
    return K.select_context(passages, "item_id", [F.col("score").desc(), "doc_id"], "n_tokens").select("item_id", "doc_id", "source", "place", "used")


@query("k13_rank_fusion", "benchmark embeddings documents", f"WITH {SEARCH} SELECT * FROM fused")
def k13(benchmark, embeddings, documents):
    return _fused(benchmark, embeddings, documents)


@query("k14_dedupe_passages", "benchmark embeddings documents", f"WITH {SEARCH} SELECT item_id, doc_id, score FROM passages")
def k14(benchmark, embeddings, documents):
    return _passages(_fused(benchmark, embeddings, documents), documents).select("item_id", "doc_id", "score")


@query("k15_select_context", "benchmark embeddings documents", f"WITH {SEARCH} SELECT item_id, doc_id, place, used FROM context")
def k15(benchmark, embeddings, documents):
    return _context(_passages(_fused(benchmark, embeddings, documents), documents)).drop("source")


@query("k16_hybrid_search", "benchmark embeddings documents", f"WITH scope AS (SELECT * FROM documents WHERE lang <> 'de'), {_search_sql('scope')} SELECT * FROM context")
def k16(benchmark, embeddings, documents):
    """Scope first, then both lists, fusion, one of equal passages, the context and its sources."""
    scope = documents.filter("lang <> 'de'")
    return _context(_passages(_fused(benchmark, embeddings, scope), scope))


@query("k17_lexical_only", "benchmark documents", f"WITH {SEARCH} SELECT item_id, doc_id, r AS rank, 'VECTORS_UNAVAILABLE' AS warning FROM lex".replace("FROM embeddings a JOIN embeddings b", "FROM embeddings a JOIN embeddings b"))
def k17(benchmark, documents):
    """Search without vectors says so."""
    found = X.lexical(benchmark.filter("item_id % 20 = 0"), documents, "item_id", "doc_id", "text")
    return found.select("item_id", "doc_id", "rank", F.lit("VECTORS_UNAVAILABLE").alias("warning"))


@query("k20_near_candidates", "documents")
def k20(documents):
    return K.near_candidates(documents, "doc_id", "text")


NUMBERS = "regexp_extract_all({t}, '[0-9]+')"


@query("k22_validate_claims", "conversations", f"""SELECT a.conv_id, a.turn, CASE WHEN q.turn IS NULL THEN 'not_retrieved' WHEN q.role = 'system' THEN 'out_of_scope' WHEN NOT list_has_all({NUMBERS.format(t='q.text')}, {NUMBERS.format(t='a.text')}) THEN 'numbers_differ' ELSE 'supported' END AS verdict
FROM conversations a LEFT JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE a.role = 'assistant'""")
def k22(conversations):
    """A claim cites the turn before it: it must be there, in scope, and hold the claim's numbers."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    cited = conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("q_role"), F.col("text").alias("q"))
    found = conversations.filter("role = 'assistant'").join(cited, ["conv_id", "turn"], "left")
    verdict = F.when(F.col("q_role").isNull(), "not_retrieved").when(F.col("q_role") == "system", "out_of_scope").when(F.size(F.array_except(numbers("text"), numbers("q"))) > 0, "numbers_differ").otherwise("supported")
    return found.select("conv_id", "turn", verdict.alias("verdict"))


@query("k23_answer_status", "fx_projects fx_observations", """SELECT project_id, CASE WHEN initiative_type = '1-URGENT' AND project_id % 7 = 0 THEN 'refused' WHEN n IS NULL THEN 'insufficient' WHEN v > 1 THEN 'conflict' WHEN date_precision = 'unknown' THEN 'needs_clarification' WHEN n < 3 THEN 'partial' ELSE 'answered' END AS status
FROM fx_projects LEFT JOIN (SELECT subject_id, count(*) AS n, count(DISTINCT value) AS v FROM fx_observations GROUP BY 1) ON project_id = subject_id""")
def k23(projects, obs):
    """The first of six statuses that fits."""
    seen = obs.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), (F.min("value") != F.max("value")).alias("differ"))
    found = projects.join(seen, F.col("project_id") == F.col("subject_id"), "left")
    refused = (F.col("initiative_type") == "1-URGENT") & (F.col("project_id") % 7 == 0)
    status = F.when(refused, "refused").when(F.col("n").isNull(), "insufficient").when(F.col("differ"), "conflict").when(F.col("date_precision") == "unknown", "needs_clarification").when(F.col("n") < 3, "partial").otherwise("answered")
    return found.select("project_id", status.alias("status"))


@query("k24_verify_hashes", "fx_revisions", "SELECT revision_id, hash AS stored, sha256(text || 'x') AS found FROM fx_revisions WHERE revision_id % 10 = 0")
def k24(revisions):
    """Stored hashes against a restored copy in which every tenth text is longer by a letter."""
    restored = F.when(F.col("revision_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return revisions.select("revision_id", F.col("hash").alias("stored"), F.sha2(restored, 256).alias("found")).filter("stored <> found")


@query("k25_topics", "documents labels", r"""WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc_id) AS n FROM t), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
g AS (SELECT doc_id, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln(n / df), 6) DESC, term) AS r FROM t JOIN d USING (term) CROSS JOIN n WHERE length(term) >= 4) WHERE r = 1)
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN source ELSE term END AS topic, CASE WHEN l.doc_id IS NOT NULL THEN 'official' ELSE 'generated' END AS method FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id LEFT JOIN g ON d.doc_id = g.doc_id""")
def k25(documents, labels):
    """An official label where there is one, else the term that sets the document apart most; the method stands beside it."""
    index = X.Postings.build(documents, "doc_id", "text")
    n = index.blocks.filter("term IS NULL").agg(F.sum("n")).first()[0] or 0
    rows = index.rows("doc_id").filter(F.length("term") >= 4)
    weight = F.round(F.col("tf") * F.log(n / F.col("df")), 6)
    best = rows.groupBy("doc_id").agg(F.min(F.struct((-weight).alias("w"), "term"))["term"].alias("term"))
    official = labels.filter("quality = 1").select("doc_id", F.lit(True).alias("official")).distinct()
    found = documents.join(official, "doc_id", "left").join(best, "doc_id", "left")
    return found.select("doc_id", F.when(F.col("official"), F.col("source")).otherwise(F.col("term")).alias("topic"), F.when(F.col("official"), "official").otherwise("generated").alias("method"))


@query("k26_norm_validity", "fx_memberships", "SELECT term_id, party FROM fx_memberships WHERE valid_from <= DATE '1998-01-01' AND (valid_to IS NULL OR DATE '1998-01-01' < valid_to)")
def k26(relations):
    """Relations in force on a day."""
    day = F.lit("1998-01-01").cast("date")
    return relations.filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))).select("term_id", "party")


@query("k27_transcript_at", "conversations", "SELECT conv_id, turn FROM conversations WHERE turn * 30 < 120 AND turn * 30 + 45 > 60")
def k27(conversations):
    """Segments that overlap the seconds 60 to 120; a turn lasts 45 from every half minute."""
    start = F.col("turn") * 30
    return conversations.filter((start < 120) & (start + 45 > 60)).select("conv_id", "turn")


@query("k28_versions_of", "fx_observations", "SELECT subject_id, stage, authority, min(effective_date) AS first_on, count(*) AS downloads, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY min(effective_date), stage, authority) AS BIGINT) AS version FROM fx_observations GROUP BY 1, 2, 3")
def k28(obs):
    """Versions of a project by stage and chamber; downloads of one are not versions."""
    found = obs.groupBy("subject_id", "stage", "authority").agg(F.min("effective_date").alias("first_on"), F.count(F.lit(1)).alias("downloads"))
    order = Window.partitionBy("subject_id").orderBy("first_on", "stage", "authority")
    return found.withColumn("version", F.row_number().over(order).cast("long"))


@query("k29_gazette_key", "fx_revisions", "SELECT sha256(document_id % 50 || '|' || (2000 + seq) || '|' || lang) AS gazette_key, count(*) AS issues FROM fx_revisions GROUP BY 1")
def k29(revisions):
    """Number, year and series name a gazette; how many rows claim to be it."""
    key = F.concat_ws("|", (F.col("document_id") % 50).cast("string"), (F.lit(2000) + F.col("seq")).cast("string"), "lang")
    return revisions.groupBy(F.sha2(key, 256).alias("gazette_key")).agg(F.count(F.lit(1)).alias("issues"))


@query("e47_extraction_report", "documents", rf"WITH {LINES} SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE {QUALITY.format(t='line')} <> 'accepted') AS ocr_pages, CAST(sum(length(line)) AS BIGINT) AS chars FROM l GROUP BY 1")
def e47(documents):
    pages = K.paginate(documents, "doc_id", "text")
    bad = K.text_quality(F.col("page_text")) != "accepted"
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(bad).alias("ocr_pages"), F.sum(F.length("page_text")).alias("chars"))


QUERIES, ORACLE_SQL = query.QUERIES, query.ORACLE_SQL
