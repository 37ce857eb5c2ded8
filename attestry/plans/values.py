"""Queries on single values and adapters (families H and J)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from attestry.functions import values as V
from attestry.operators import documents as K
from attestry.operators import search as X
from attestry.operators.metrics import fingerprint
from attestry.plans.fixtures import Registry

query = Registry()
DUCK_SPACES = r"[ \t\n\r\f\x0b]+"


@query("h3_norm_question", "conversations", rf"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(translate(lower(text), 'áéíóúüñ', 'aeiouun'), '[¿?¡!.,;:]+', ' ', 'g'), '{DUCK_SPACES}', ' ', 'g'))) AS question_md5 FROM conversations WHERE role = 'user'")
def h3(conversations):
    return conversations.filter("role = 'user'").select("conv_id", "turn", F.md5(V.norm_question(F.col("text"))).alias("question_md5"))


@query("h6_alert_fingerprint", "fx_alerts", "SELECT alert_id, sha256(rule || '|' || resource_id || '|' || severity) AS fingerprint FROM fx_alerts")
def h6(alerts):
    return alerts.select("alert_id", fingerprint("rule", "resource_id", "severity").alias("fingerprint"))


@query("h7_cache_key", "conversations", """SELECT conv_id, turn, sha256('{"corpus":"v1","question":"' || sha256(text) || '","reference_day":"2024-01-31","scope":"' || role || '"}') AS cache_key FROM conversations""")
def h7(conversations):
    key = V.cache_key(question=F.sha2("text", 256), scope=F.col("role"), corpus=F.lit("v1"), reference_day=F.lit("2024-01-31"))
    return conversations.select("conv_id", "turn", key.alias("cache_key"))


@query("h8_norm_vote", "lineitem", "SELECT l_orderkey, l_linenumber, l_returnflag AS raw, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'other' END AS vote FROM lineitem")
def h8(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("raw"), V.mapped(F.col("l_returnflag"), {"A": "yes", "N": "no"}, "other").alias("vote"))


@query("h9_norm_status", "orders", "SELECT o_orderkey, o_orderstatus AS raw, CASE WHEN o_custkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END WHEN o_orderstatus = 'F' THEN 'archived' END AS status FROM orders")
def h9(orders):
    """A small map by source and raw status; what it lacks stays null."""
    names = orders.sparkSession.createDataFrame([(0, "F", "finished"), (0, "O", "open"), (1, "F", "archived")], "source long, raw string, status string")
    found = orders.select("o_orderkey", (F.col("o_custkey") % 2).alias("source"), F.col("o_orderstatus").alias("raw"))
    return found.join(F.broadcast(names), ["source", "raw"], "left").select("o_orderkey", "raw", "status")


@query("h10_partial_date", "orders", """SELECT o_orderkey, text, CASE WHEN p = 'unknown' THEN NULL ELSE CAST(text || CASE p WHEN 'day' THEN '' WHEN 'month' THEN '-01' ELSE '-01-01' END AS DATE) END AS day, p AS precision FROM (
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE 'no date' END AS text,
CASE o_orderkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' ELSE 'unknown' END AS p FROM orders)""")
def h10(orders):
    kind = F.col("o_orderkey") % 4
    form = lambda f: F.date_format("o_orderdate", f)
    texts = orders.select("o_orderkey", F.when(kind == 0, form("yyyy-MM-dd")).when(kind == 1, form("yyyy-MM")).when(kind == 2, form("yyyy")).otherwise("no date").alias("text"))
    day, precision = V.partial_date(F.col("text"))
    return texts.select("o_orderkey", "text", day.alias("day"), precision.alias("precision"))


@query("h12_age_label", "events", "SELECT event_id, strftime(ts, '%Y-%m-%d') || ' (' || date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') || ' d)' AS label FROM events")
def h12(events):
    return events.select("event_id", V.age_label(F.col("ts"), "2024-01-31").alias("label"))


@query("h13_duration_ms", "events", "SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000 AS ms FROM events")
def h13(events):
    return events.select("event_id", V.millis(F.col("ts").cast("date"), F.col("ts")).alias("ms"))


@query("h15_citation", "documents", "SELECT doc_id, concat_ws(' | ', 'https://' || source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '#page=' || doc_id % 5 END, lang, 'rev ' || doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'p. ' || doc_id % 5 END) AS citation FROM documents")
def h15(documents):
    url = F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    page = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 5)
    return documents.select("doc_id", V.citation(url, F.col("lang"), F.col("doc_id"), page).alias("citation"))


@query("h16_locator", "events", """SELECT event_id, '{"event":' || event_id || ',"page":' || json_extract_string(props, '$.k') || '}' AS locator, CAST(json_extract_string(props, '$.k') AS BIGINT) AS page FROM events""")
def h16(events):
    made = events.select("event_id", V.locator(event=F.col("event_id"), page=F.from_json("props", "k long")["k"]).alias("locator"))
    return made.withColumn("page", F.from_json("locator", "event long, page long")["page"])


@query("h17_array_ops", "lineitem", "SELECT l_orderkey, len(list_distinct(list(l_suppkey))) AS n_sources, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS sources, list_has_any(list(l_suppkey), list(l_partkey)) AS overlap FROM lineitem GROUP BY 1")
def h17(lineitem):
    sets = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"), F.collect_set("l_partkey").alias("p"))
    return sets.select("l_orderkey", F.size("s").cast("long").alias("n_sources"), F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("sources"), F.arrays_overlap("s", "p").alias("overlap"))


@query("h18_merge_counters", "events", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counters FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def h18(events):
    """Counters of two halves of the events, merged by name."""
    counts = events.groupBy("user_id", "event_type", (F.col("event_id") % 2).alias("half")).agg(F.count(F.lit(1)).alias("n"))
    of = lambda half: F.map_from_entries(F.collect_list(F.when(F.col("half") == half, F.struct("event_type", "n"))))
    merged = counts.groupBy("user_id").agg(V.merge_counters(of(0), of(1)).alias("m"))
    shown = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return merged.select("user_id", F.array_join(shown, ",").alias("counters"))


@query("h23_sniff_mime", "documents pages events", """SELECT kind, count(*) AS n FROM (
SELECT CASE WHEN text = '' THEN 'application/x-empty' WHEN starts_with(lower(trim(text)), '<!doctype html') OR starts_with(lower(trim(text)), '<html') THEN 'text/html' WHEN starts_with(trim(text), '{') THEN 'application/json' ELSE 'text/plain' END AS kind
FROM (SELECT text FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT props FROM events)) GROUP BY 1""")
def h23(documents, pages, events):
    texts = documents.select("text").union(pages.select("html")).union(events.select("props"))
    return texts.groupBy(V.sniff_mime(F.col("text").cast("binary")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("h26_cost_estimate", "lineitem", "SELECT l_orderkey, CAST(sum(CAST(1.50 AS DECIMAL(18,2)) + CAST(l_quantity AS DECIMAL(18,2)) * CAST(0.25 AS DECIMAL(4,2)) + l_linenumber * CAST(0.10 AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS cost FROM lineitem GROUP BY 1")
def h26(lineitem):
    """A fixed part, storage by quantity and pages by line, in decimals."""
    cost = F.expr("CAST(1.50 AS DECIMAL(18,2)) + CAST(l_quantity AS DECIMAL(18,2)) * CAST(0.25 AS DECIMAL(4,2)) + l_linenumber * CAST(0.10 AS DECIMAL(4,2))")
    return lineitem.groupBy("l_orderkey").agg(F.sum(cost).cast("decimal(18,4)").alias("cost"))


@query("h27_telemetry_state", "customer events", """SELECT c_custkey, CASE WHEN l IS NULL THEN 'not_instrumented' WHEN epoch(TIMESTAMP '2024-01-31' - l) <= 86400 THEN 'fresh' WHEN epoch(TIMESTAMP '2024-01-31' - l) <= 259200 THEN 'stale' ELSE 'disconnected' END AS state
FROM customer LEFT JOIN (SELECT user_id, max(ts) AS l FROM events GROUP BY 1) ON c_custkey = user_id""")
def h27(customer, events):
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    found = customer.select("c_custkey").join(last, F.col("c_custkey") == F.col("user_id"), "left")
    return found.select("c_custkey", V.telemetry_state(F.col("last"), "2024-01-31 00:00:00", 86400, 259200).alias("state"))


def hash_embedder(dimensions: int = 64):
    """A deterministic embedder: signed counts of hashed words, of length 1."""

    def embed(texts: pd.Series) -> np.ndarray:
        from zlib import crc32

        out = np.zeros((len(texts), dimensions))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = crc32(word.encode())
                out[i, h % dimensions] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(df, id_col: str, text_col: str, embedder=None):
    """(id, embedding): vectors of an embedder that takes a batch of texts."""
    run = embedder or hash_embedder()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({id_col: frame[id_col], "embedding": list(run(frame[text_col]))})

    return df.select(id_col, text_col).mapInPandas(batches, f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<double>")


@query("j1_embed", "documents")
def j1(documents):
    return embed(documents, "doc_id", "text")


@query("j2_rerank", "benchmark documents", r"""WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS dl FROM t GROUP BY 1), n AS (SELECT count(*) AS n, avg(dl) AS a FROM l), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark WHERE item_id % 20 = 0),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM q JOIN t USING (term) JOIN d USING (term) JOIN l USING (doc_id) CROSS JOIN n GROUP BY 1, 2),
lex AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 30),
w AS (SELECT lex.item_id, lex.doc_id, list_distinct(regexp_extract_all(lower(b.text), '[^ \t\n\r\f\x0b]+')) AS a, list_distinct(regexp_extract_all(lower(x.text), '[^ \t\n\r\f\x0b]+')) AS b FROM lex JOIN benchmark b USING (item_id) JOIN documents x USING (doc_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(len(list_intersect(a, b)) / greatest(1, len(a)), 6) AS score FROM w)) WHERE rank <= 8""")
def j2(benchmark, documents):
    """Of the lexical hits the eight that share most words with the query, by a scorer that takes batches."""

    @F.pandas_udf("double")
    def overlap(query: pd.Series, text: pd.Series) -> pd.Series:
        sets = ((set(q.lower().split()), set((t or "").lower().split())) for q, t in zip(query, text, strict=True))
        return pd.Series([round(len(q & t) / max(1, len(q)), 6) for q, t in sets])

    asked = benchmark.filter("item_id % 20 = 0")
    hits = X.lexical(asked, documents, "item_id", "doc_id", "text").select("item_id", "doc_id")
    texts = documents.select("doc_id", "text")
    scored = hits.join(texts, "doc_id").join(asked.select("item_id", F.col("text").alias("q")), "item_id").select("item_id", "doc_id", overlap("q", "text").alias("score"))
    return K.top(scored, "item_id", [F.col("score").desc(), "doc_id"], 8)


@query("j3_chunk_function", "documents", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0b]+') AS w FROM documents), o AS (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - 100) / 700) AS BIGINT)))) AS ordinal FROM w WHERE len(w) > 0)
SELECT doc_id, ordinal, md5(array_to_string(w[ordinal * 700 + 1 : ordinal * 700 + 800], ' ')) AS chunk_md5 FROM o""")
def j3(documents):
    """The chunker as a function that SQL calls; its array is laid out as a table."""
    spark = documents.sparkSession
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION chunks(text STRING, size INT, overlap INT) RETURNS ARRAY<STRING>
        RETURN (SELECT transform(filter(sequence(0, greatest(0, CAST(ceil((size(w) - overlap) / (size - overlap)) AS INT) - 1)), i -> size(w) > 0), i -> array_join(slice(w, i * (size - overlap) + 1, size), ' '))
            FROM (SELECT filter(split(text, '[ \\t\\n\\r\\f\\x0b]+'), x -> x <> '') AS w))""")
    return spark.sql("SELECT doc_id, CAST(ordinal AS LONG) AS ordinal, md5(chunk) AS chunk_md5 FROM (SELECT doc_id, chunks(text, 800, 100) AS parts FROM {docs}) LATERAL VIEW posexplode(parts) c AS ordinal, chunk", docs=documents)


@query("j6_sql_functions", "customer lineitem", "SELECT 'name' AS kind, regexp_replace(translate(lower(trim(c_name)), 'áéíóúüñ', 'aeiouun'), '\\s+', ' ', 'g') AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'vote', CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'other' END, count(*) FROM lineitem GROUP BY 2")
def j6(customer, lineitem):
    spark = customer.sparkSession
    V.register(spark)
    return spark.sql("SELECT 'name' AS kind, norm_name(c_name) AS value, count(*) AS n FROM {c} GROUP BY 2 UNION ALL SELECT 'vote', norm_vote(l_returnflag), count(*) FROM {l} GROUP BY 2", c=customer, l=lineitem)


@query("j7_distribution", "events", "SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY 1")
def j7(events):
    return events.groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("deviation"))


QUERIES, ORACLE_SQL = query.QUERIES, query.ORACLE_SQL
