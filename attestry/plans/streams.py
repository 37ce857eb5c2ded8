"""Reads, sinks and streams over events that arrive part by part (families A and I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import joins as D
from attestry.operators import windows as W
from attestry.plans.fixtures import Registry
from attestry.sources import contracts as A
from attestry.sources import sinks as S
from attestry.sources.cursors import Cursor
from attestry.sources.projections import Projection
from attestry.sources.tables import SCHEMAS
from attestry.streaming import events as I
from attestry.streaming import runs as R

query = Registry()
DELAY = "20 minutes"
#: Seconds after which a key without events is let go; longer than the tables' month.
KEEP = 60 * 86400


def _timed(events):
    """Events with ``at`` as a point in time."""
    return events.withColumn("at", F.to_timestamp("ts" if "ts" in events.columns else "occurred_at"))


def _plain(c: str):
    """A point in time back as the tables write it."""
    return F.to_timestamp_ntz(F.col(c).cast("string"))


def _by_event(events, parts=3):
    return R.arrivals(events, F.unix_seconds("at"), parts)


def _by_arrival(events, parts=3):
    return R.arrivals(events, F.unix_seconds("at") + F.col("delay_s"), parts)


@query("a1_declared_read", "orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def a1(orders):
    """The table under its declared schema; the columns of SCHEMAS and no other."""
    return orders.select(*[c.split()[0] for c in SCHEMAS["orders"].split(", ")])


@query("a2_source_samples", "orders pages", """SELECT 'json' AS fmt, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS value FROM orders UNION ALL SELECT 'csv', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders
UNION ALL SELECT 'html', md5(html), CAST(strlen(html) AS VARCHAR) FROM pages UNION ALL SELECT 'bytes', 'html', CAST(sum(strlen(html) + 1) AS VARCHAR) FROM pages""")
def a2(orders, pages):
    spark, path = orders.sparkSession, R.folder(orders, "samples")
    rows = orders.select("o_orderkey", "o_orderpriority")
    rows.write.json(f"{path}/json")
    rows.write.option("header", True).csv(f"{path}/csv")
    pages.select("html").write.option("lineSep", A.RECORD).text(f"{path}/html")
    schema = "o_orderkey long, o_orderpriority string"
    parts = [A.read_source(spark, f"{path}/{fmt}", fmt, schema).select(F.lit(fmt).alias("fmt"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value")) for fmt in ("json", "csv")]
    html = A.read_source(spark, f"{path}/html", "html").select(F.lit("html").alias("fmt"), F.md5("html").alias("key"), F.octet_length("html").cast("string").alias("value"))
    size = A.read_source(spark, f"{path}/html", "bytes").filter(F.col("path").endswith(".txt")).agg(F.sum("length").cast("string").alias("value")).select(F.lit("bytes").alias("fmt"), F.lit("html").alias("key"), "value")
    return parts[0].union(parts[1]).union(html).union(size)


def _raw_events(events):
    """JSON lines of the events: some are cut, some lack the user, some have an unknown type."""
    kind = F.col("event_id") % 50
    user = F.when(kind == 1, "null").otherwise(F.col("user_id").cast("string"))
    text = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"user_id":'), user, F.lit(',"event_type":"'), F.when(kind == 2, "unheard").otherwise(F.col("event_type")), F.lit('"}'))
    return events.select(F.when(kind == 0, F.substring(text, 1, 20)).otherwise(text).alias("value"))


TYPES = ("click", "error", "purchase", "signup", "view")
RAW_SQL = "SELECT CASE WHEN event_id % 50 <> 0 THEN event_id END AS event_id, CASE event_id % 50 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'a_user' WHEN 2 THEN 'b_type' END AS reason FROM events"


def _checks():
    return {"a_user": F.col("user_id").isNotNull(), "b_type": F.col("event_type").isin(*TYPES)}


RAW_SCHEMA = "event_id long, user_id long, event_type string"


@query("a3_contract_read", "events", RAW_SQL)
def a3(events):
    path = R.folder(events, "lines")
    _raw_events(events).write.text(path)
    good, bad = A.read_with_contract(events.sparkSession, path, RAW_SCHEMA, _checks())
    known = F.when(F.col("reason") != "corrupt", F.col("event_id"))
    return good.select("event_id", F.lit(None).cast("string").alias("reason")).union(bad.select(known.alias("event_id"), "reason"))


PULLS = ("2024-01-10", "2024-01-20", "2030-01-01")


def _pulls(events):
    """The table as it stood at each pull: what had arrived by then."""
    received = F.unix_seconds(F.to_timestamp("occurred_at")) + F.col("delay_s")
    return [events.filter(received <= F.unix_seconds(F.lit(at).cast("timestamp"))).select("event_id", "occurred_at", "event_type") for at in PULLS]


def _cursor(events, name):
    return Cursor(events.sparkSession, R.folder(events, name), "event_id long, occurred_at timestamp_ntz, event_type string", "event_id", "occurred_at", 900)


@query("a4_incremental_read", "fx_ops_events", f"SELECT event_id, CASE WHEN occurred_at + to_seconds(delay_s) <= TIMESTAMP '{PULLS[0]}' THEN 1 WHEN occurred_at + to_seconds(delay_s) <= TIMESTAMP '{PULLS[1]}' THEN 2 ELSE 3 END AS pull FROM fx_ops_events")
def a4(events):
    """Three pulls, each from the stored cursor less a quarter hour for late rows, without those seen before."""
    cursor = _cursor(events, "pulled")
    for source in _pulls(events):
        cursor.pull(source)
    return cursor.committed().select("event_id", "pull")


@query("a5_one_pipeline", "events", "SELECT mode, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,6))) AS total FROM events, (VALUES ('backfill'), ('incremental')) m(mode) GROUP BY 1, 2")
def a5(events):
    """One transform for a backfill and for a stream that takes up parts."""
    transform = lambda df: df.select("event_type", F.col("value").cast("decimal(18,6)").alias("amount"))
    streamed = R.appended(_by_event(_timed(events)), transform)
    both = transform(events).withColumn("mode", F.lit("backfill")).unionByName(streamed.withColumn("mode", F.lit("incremental")))
    return both.groupBy("mode", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


@query("a6_idempotent_sink", "fx_ops_events", "SELECT event_id, event_type FROM fx_ops_events")
def a6(events):
    """Each pull breaks once between its write and its commit, where more rows arrive; every event is there once."""
    cursor = _cursor(events, "broken")
    pulls = _pulls(events)
    for source, more in zip(pulls, [*pulls[1:], pulls[-1]]):
        cursor.write(source)
        cursor.pull(more)
    return cursor.committed().select("event_id", "event_type")


@query("a7_append_dated", "events", "SELECT CAST(ts AS DATE) AS event_date, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def a7(events):
    path = R.folder(events, "dated")
    for half in (0, 1):
        S.append_events(events.filter(F.col("event_id") % 2 == half), path, "ts")
    back = events.sparkSession.read.schema(f"{SCHEMAS['events']}, event_date date").parquet(path)
    return back.groupBy("event_date", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a8_publish_version", "documents", "SELECT doc_id, source, 2 AS version FROM documents")
def a8(documents):
    """A second version replaces the first as a whole."""
    table = Projection(documents.sparkSession, R.folder(documents, "published"), "doc_id long, source string", "doc_id")
    table.replace(documents.filter("lang = 'en'").select("doc_id", "source"))
    table.replace(documents.select("doc_id", "source"))
    return table.read().withColumn("version", F.lit(table.manifest()["version"]).cast("long"))


@query("a9_export_canonical", "orders", "SELECT o_orderkey, sha256(o_custkey || '|' || o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m-%d')) AS canonical_key FROM orders")
def a9(orders):
    path = R.folder(orders, "canonical")
    key = F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd")), 256)
    S.export_canonical(orders, path, key)
    return orders.sparkSession.read.schema(f"{SCHEMAS['orders']}, canonical_key string").parquet(path).select("o_orderkey", "canonical_key")


@query("a10_export_csv", "documents", "SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN '''' ELSE '' END || substring('=+-@ab', doc_id % 6 + 1, 1) || source AS cell FROM documents")
def a10(documents):
    path = R.folder(documents, "csv")
    marks = F.substring(F.lit("=+-@ab"), (F.col("doc_id") % 6 + 1).cast("int"), F.lit(1))
    S.export_csv(documents.select("doc_id", F.concat(marks, "source").alias("cell")), ["doc_id", "cell"], path)
    return A.read_source(documents.sparkSession, path, "csv", "doc_id long, cell string")


SNAPSHOT = "occurred_at + to_seconds(delay_s) <= TIMESTAMP '2024-01-20'"
LATEST = "row_number() OVER (PARTITION BY resource_id ORDER BY resource_version DESC) = 1"


def _received(events):
    return F.unix_seconds(F.to_timestamp("occurred_at")) + F.col("delay_s") <= F.unix_seconds(F.lit("2024-01-20").cast("timestamp"))


def snapshot_at(events, cursor):
    """State by what had arrived at the cursor."""
    return W.latest_state(events.filter(cursor), "resource_id", "resource_version")


@query("a11_snapshot", "fx_ops_events", f"SELECT resource_id, event_type, resource_version FROM fx_ops_events WHERE {SNAPSHOT} QUALIFY {LATEST}")
def a11(events):
    return snapshot_at(events, _received(events)).select("resource_id", "event_type", "resource_version")


@query("a12_attributed", "pages", "SELECT page_id, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS publisher, 'external' AS authority FROM pages")
def a12(pages):
    return pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#:]*)", 1).alias("publisher"), F.lit("external").alias("authority"))


@query("i1_stream_intake", "events", RAW_SQL)
def i1(events):
    """Good rows and bad rows go to a sink each."""
    path = R.folder(events, "intake")

    def write(batch, number):
        rows = I.read_events(batch, RAW_SCHEMA, _checks()).persist()
        S.write_batch(f"{path}/good")(rows.filter("reason IS NULL").select("event_id"), number)
        S.write_batch(f"{path}/bad")(rows.filter("reason IS NOT NULL").select(F.when(F.col("reason") != "corrupt", F.col("event_id")).alias("event_id"), "reason"), number)
        rows.unpersist()

    R.batches([_raw_events(p) for p in _by_event(_timed(events))], write, "text")
    read = events.sparkSession.read
    good = read.schema("event_id long").parquet(f"{path}/good").select("event_id", F.lit(None).cast("string").alias("reason"))
    return good.union(read.schema("event_id long, reason string").parquet(f"{path}/bad").select("event_id", "reason"))


@query("i2_stream_dedupe", "events", "SELECT event_id, event_type FROM events")
def i2(events):
    """Every part comes with the part before it once more."""
    parts = _by_event(_timed(events))
    again = [parts[0], *[b.union(a) for a, b in zip(parts, parts[1:])]]
    return R.appended(again, lambda s: I.dedupe(s, ["event_id"], "at", "60 days")).select("event_id", "event_type")


@query("i3_versioned_state", "fx_ops_events", """SELECT resource_id, resource_version, CASE WHEN resource_version <= m THEN 'regression' WHEN resource_version > coalesce(m, 0) + 1 THEN 'gap' ELSE 'applied' END AS outcome FROM (
SELECT *, max(resource_version) OVER (PARTITION BY resource_id ORDER BY occurred_at + to_seconds(delay_s), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fx_ops_events)""")
def i3(events):
    timed = _timed(events).withColumn("received_us", F.unix_micros("at") + F.col("delay_s") * 1_000_000)
    rows = timed.select("resource_id", "resource_version", "received_us", "event_id", "at")
    return R.appended(R.arrivals(rows, F.col("received_us").cast("double")), lambda s: I.versioned_state(s, "resource_id", "resource_version", ["received_us", "event_id"], "at", DELAY, KEEP))


CLOSED = "(SELECT max(ts) - INTERVAL 20 MINUTE FROM events)"


@query("i4_stream_rollup", "fx_ops_events events", f"SELECT * FROM (SELECT time_bucket(INTERVAL 15 MINUTE, occurred_at, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n FROM fx_ops_events GROUP BY 1, 2) WHERE bucket + INTERVAL 15 MINUTE <= {CLOSED}")
def i4(ops, events):
    """Windows that the watermark has closed, although events arrive out of order."""
    found = R.appended(_by_arrival(_timed(ops)), lambda s: I.rollup(s, "at", DELAY, "15 minutes", ["event_type"], F.count(F.lit(1)).alias("n")))
    return found.withColumn("bucket", _plain("bucket"))


@query("i5_sliding_rates", "fx_ops_events events", f"SELECT * FROM (SELECT b - to_minutes(30 * k) AS bucket, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, occurred_at, TIMESTAMP '1970-01-01') AS b, event_type, unnest([0, 1]) AS k FROM fx_ops_events) GROUP BY 1, 2) WHERE bucket + INTERVAL 1 HOUR <= {CLOSED}")
def i5(ops, events):
    found = R.appended(_by_arrival(_timed(ops)), lambda s: I.rollup(s, "at", DELAY, "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), slide="30 minutes"))
    return found.withColumn("bucket", _plain("bucket"))


@query("i6_sessions", "events", f"""WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= {CLOSED}""")
def i6(events):
    found = R.appended(_by_event(_timed(events)), lambda s: I.sessions(s, "at", DELAY, "6 hours", ["user_id"]))
    return found.withColumn("start", _plain("start")).withColumn("end", _plain("end"))


@query("i7_late_split", "fx_ops_events", "SELECT event_id, CASE WHEN delay_s > 600 THEN 'reconciliation' ELSE 'live' END AS route FROM fx_ops_events")
def i7(events):
    path = R.folder(events, "late")

    def write(batch, number):
        occurred = F.unix_seconds("at")
        S.write_batch(path)(I.late_split(batch, occurred, occurred + F.col("delay_s"), 600).select("event_id", "route"), number)

    R.batches(_by_arrival(_timed(events)), write)
    return events.sparkSession.read.schema("event_id long, route string").parquet(path).select("event_id", "route")


@query("i8_delivery_join", "events", """WITH a AS (SELECT * FROM events WHERE event_type = 'view'), d AS (SELECT * FROM events WHERE event_type = 'purchase'), j AS (SELECT a.event_id AS answer_id, a.ts, d.event_id AS delivery_id FROM a LEFT JOIN d ON a.user_id = d.user_id AND d.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR)
SELECT answer_id, delivery_id FROM j WHERE delivery_id IS NOT NULL OR ts + INTERVAL 2 HOUR < (SELECT least((SELECT max(ts) FROM a), (SELECT max(ts) FROM d)) - INTERVAL 20 MINUTE)""")
def i8(events):
    """Answers are views, deliveries purchases of the same user; answers still in time to be delivered wait."""
    of = lambda s, kind: s.filter(F.col("event_type") == kind).select("user_id", "at", F.col("event_id").alias("id"))
    return R.appended(_by_event(_timed(events)), lambda s: I.join_delivery(of(s, "view"), of(s, "purchase"), "user_id", "'2' HOUR", DELAY)).select("answer_id", "delivery_id")


@query("i9_command_timeouts", "events", """WITH c AS (SELECT event_id // 3 AS command, max(ts) FILTER (WHERE event_id % 3 = 0) AS t, max(ts) FILTER (WHERE event_id % 3 = 1 AND event_type <> 'error') AS d, max(ts) FILTER (WHERE event_id % 3 = 2 AND event_type IN ('purchase', 'signup')) AS e FROM events GROUP BY 1)
SELECT command, CASE WHEN e <= t + INTERVAL 1 DAY THEN 'done' WHEN d <= t + INTERVAL 1 DAY THEN 'reconciling' ELSE 'expired' END AS outcome FROM c WHERE t + INTERVAL 1 DAY < (SELECT max(ts) - INTERVAL 20 MINUTE FROM events)""")
def i9(events):
    """Three events in a row are a command, its dispatch (if no error) and its effect (if a purchase or signup)."""
    kind = F.col("event_id") % 3
    what = F.when(kind == 0, "command").when((kind == 1) & (F.col("event_type") != "error"), "dispatch").when((kind == 2) & F.col("event_type").isin("purchase", "signup"), "effect")
    rows = _timed(events).select(F.floor(F.col("event_id") / 3).alias("command"), what.alias("what"), "at")
    return R.appended(_by_event(rows), lambda s: I.command_timeouts(s, 86400, DELAY))


@query("i10_stream_enrich", "events customer", "SELECT event_id, event_type, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def i10(events, customer):
    static = customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return R.appended(_by_event(_timed(events)), lambda s: s.join(static, "user_id", "left").select("event_id", "event_type", "c_mktsegment"))


@query("i11_heartbeats", "events", """WITH b AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) // 1000 AS n FROM events), w AS (SELECT epoch_us(max(ts)) // 1000 - 1200000 AS w FROM events)
SELECT user_id, ms AS last_ms, signal FROM b, w, (VALUES ('stale', 21600000), ('disconnected', 43200000)) s(signal, t) WHERE coalesce(n, w) > ms + t""")
def i11(events):
    """Silence of over 6 and 12 hours after a beat."""
    found = R.appended(_by_event(_timed(events)), lambda s: I.heartbeats(s, "user_id", "at", 21600, 43200, DELAY))
    shift = F.unix_millis(F.lit("1970-01-01 00:00:00").cast("timestamp"))  # of the session's time zone
    return found.withColumn("last_ms", F.col("last_ms") - shift)


ALERT_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, 0 AS phase, 0 AS run, 0 AS before FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, e.event_id,
CASE WHEN bad THEN CASE WHEN phase = 2 THEN 2 WHEN phase = 1 THEN 2 ELSE 1 END ELSE CASE WHEN phase = 2 AND run = 0 THEN 2 ELSE 0 END END,
CASE WHEN bad THEN 0 WHEN phase = 2 AND run = 0 THEN 1 ELSE 0 END, phase FROM s JOIN e ON s.user_id = e.user_id AND e.i = s.i + 1)
SELECT user_id, event_id, CASE phase WHEN 0 THEN 'resolved' WHEN 1 THEN 'pending' ELSE 'firing' END AS alert FROM s WHERE i > 0 AND phase <> before AND NOT (before = 1 AND phase = 0)"""


@query("i12_alert_states", "events", ALERT_SQL)
def i12(events):
    """Two errors in a row fire, two other events in a row resolve."""
    rows = _timed(events).select("user_id", "event_id", F.unix_micros("at").alias("us"), (F.col("event_type") == "error").alias("bad"), "at")
    return R.appended(_by_event(rows), lambda s: I.alert_states(s, "user_id", ["us", "event_id"], "bad", "at", DELAY, KEEP))


@query("i13_projection_upsert", "fx_ops_events", f"SELECT resource_id, event_type, resource_version FROM fx_ops_events QUALIFY {LATEST}")
def i13(events):
    """Each batch rewrites the buckets it touches and is published as a version; a batch that runs again adds none."""
    table = Projection(events.sparkSession, R.folder(events, "projection"), "resource_id long, event_type string, resource_version long", "resource_id")

    def twice(batch, number):
        rows = batch.select("resource_id", "event_type", F.col("resource_version").cast("long"))
        for _ in range(2):
            table.merge(rows, lambda both: W.latest_state(both, "resource_id", "resource_version"), "events", number)

    R.batches(_by_arrival(_timed(events)), twice)
    return table.read()


@query("i14_snapshot_replay", "fx_ops_events", f"SELECT resource_id, event_type, resource_version FROM fx_ops_events QUALIFY {LATEST}")
def i14(events):
    """The snapshot at a cursor and what arrived after it give the full state."""
    after = events.filter(~_received(events))
    columns = ["resource_id", "event_type", "resource_version"]
    both = snapshot_at(events, _received(events)).select(columns).unionByName(after.select(columns))
    return W.latest_state(both, "resource_id", "resource_version")


@query("i15_reconcile_projection", "fx_ops_events", f"""WITH t AS (SELECT * FROM fx_ops_events QUALIFY {LATEST}), p AS (SELECT * FROM fx_ops_events WHERE {SNAPSHOT} QUALIFY {LATEST})
SELECT resource_id, p.resource_version AS left_value, t.resource_version AS right_value, CASE WHEN p.resource_version IS NULL THEN 'missing' WHEN p.resource_version = t.resource_version THEN 'ok' WHEN p.resource_version < t.resource_version THEN 'behind' ELSE 'ahead' END AS label FROM t LEFT JOIN p USING (resource_id)""")
def i15(events):
    projection = snapshot_at(events, _received(events))
    found = D.reconcile(projection, W.latest_state(events, "resource_id", "resource_version"), ["resource_id"], "resource_version", ("ahead", "missing", "ok", "behind"))
    label = F.when((F.col("label") == "behind") & (F.col("left_value") > F.col("right_value")), "ahead").otherwise(F.col("label"))
    return found.withColumn("label", label)


@query("i16_thin", "events", """SELECT DISTINCT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, 'heartbeat' AS event_type, CAST(NULL AS BIGINT) AS event_id FROM events WHERE event_type IN ('view', 'click')
UNION ALL SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), event_type, event_id FROM events WHERE event_type NOT IN ('view', 'click')""")
def i16(events):
    found = R.appended(_by_event(_timed(events)), lambda s: I.thin(s, ["view", "click"], "at", DELAY, "6 hours", "user_id"))
    return found.withColumn("bucket", _plain("bucket"))


QUERIES, ORACLE_SQL = query.QUERIES, query.ORACLE_SQL
