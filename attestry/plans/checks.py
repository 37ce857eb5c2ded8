"""Queries that check, normalise and order rows, and alert rules (families E-H, K, L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.plans.fixtures import Registry

query = Registry()


@query("e44_node_counters", "fx_jobs", "SELECT stage, count(*) AS entered, count(*) FILTER (WHERE state = 'succeeded') AS left_ok, count(*) FILTER (WHERE state IN ('failed', 'dead_letter')) AS failed, count(*) FILTER (WHERE state IN ('queued', 'scheduled', 'retry_wait')) AS pending, max(enqueued_at) AS last_seen FROM fx_jobs GROUP BY 1")
def e44(jobs):
    among = lambda *states: F.count_if(F.col("state").isin(*states))
    return jobs.groupBy("stage").agg(F.count(F.lit(1)).alias("entered"), among("succeeded").alias("left_ok"), among("failed", "dead_letter").alias("failed"), among("queued", "scheduled", "retry_wait").alias("pending"), F.max("enqueued_at").alias("last_seen"))


@query("f21_fenced", "fx_jobs", "SELECT job_id, worker, fencing_token FROM (SELECT *, max(fencing_token) OVER (PARTITION BY worker ORDER BY enqueued_at + to_minutes(job_id * 7919 % 2880), job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM fx_jobs) WHERE fencing_token < most")
def f21(jobs):
    """Writes whose token is behind one that arrived before; a write arrives up to two days after its job began."""
    arrived = F.unix_micros(F.to_timestamp("enqueued_at")) + F.col("job_id") * 7919 % 2880 * 60_000_000
    before = Window.partitionBy("worker").orderBy(arrived, "job_id").rowsBetween(Window.unboundedPreceding, -1)
    return jobs.withColumn("__most", F.max("fencing_token").over(before)).filter(F.col("fencing_token") < F.col("__most")).select("job_id", "worker", "fencing_token")


@query("f23_chronology", "orders lineitem", """SELECT order_id, kind, line, day, row_number() OVER (PARTITION BY order_id ORDER BY day, kind, line, part) AS place FROM (
SELECT o_orderkey AS order_id, 'filed' AS kind, 0 AS line, CAST(o_orderdate AS DATE) AS day, 0 AS part FROM orders UNION ALL SELECT l_orderkey, 'held', l_linenumber, CAST(l_shipdate AS DATE), l_partkey FROM lineitem)""")
def f23(orders, lineitem):
    """Filed and held stay apart as kinds of one timeline."""
    filed = orders.select(F.col("o_orderkey").alias("order_id"), F.lit("filed").alias("kind"), F.lit(0).alias("line"), F.col("o_orderdate").cast("date").alias("day"), F.lit(0).alias("part"))
    held = lineitem.select(F.col("l_orderkey").alias("order_id"), F.lit("held").alias("kind"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_partkey").alias("part"))
    place = F.row_number().over(Window.partitionBy("order_id").orderBy("day", "kind", "line", "part"))
    return filed.unionByName(held).withColumn("place", place).drop("part")


@query("f29_config_as_of", "fx_ops_events", """SELECT resource_id, resource_version, event_type, before FROM (
SELECT *, lag(event_type) OVER (PARTITION BY resource_id ORDER BY resource_version) AS before, row_number() OVER (PARTITION BY resource_id ORDER BY resource_version DESC) AS r
FROM fx_ops_events WHERE occurred_at <= TIMESTAMP '2024-01-15') WHERE r = 1""")
def f29(events):
    """The greatest version in force and the event before it; only two rows of a resource pass the rank filter."""
    known = events.filter(F.col("occurred_at") <= F.lit("2024-01-15").cast("timestamp_ntz"))
    ranked = known.withColumn("__r", F.row_number().over(Window.partitionBy("resource_id").orderBy(F.col("resource_version").desc()))).filter("__r <= 2")
    of = lambda r, c: F.max(F.when(F.col("__r") == r, F.col(c))).alias(c)
    return ranked.groupBy("resource_id").agg(of(1, "resource_version"), of(1, "event_type"), of(2, "event_type").alias("before"))


@query("g3_domain_violations", "lineitem", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')")
def g3(lineitem):
    """A null is allowed."""
    return lineitem.filter(~F.col("l_returnflag").isin("A", "N")).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("g16_without_evidence", "documents labels", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def g16(documents, labels):
    return documents.select("doc_id", "source").join(labels.select("doc_id"), "doc_id", "left_anti")


@query("h2_norm_number", "fx_projects", "SELECT project_id, 'No. 00' || number AS text, ltrim(regexp_replace('No. 00' || number, '[^0-9]', '', 'g'), '0') AS number FROM fx_projects")
def h2(projects):
    text = F.concat(F.lit("No. 00"), "number")
    return projects.select("project_id", text.alias("text"), F.regexp_replace(F.regexp_replace(text, "[^0-9]", ""), "^0+", "").alias("number"))


@query("h4_content_hash", "documents", "SELECT doc_id, sha256(text) AS hash FROM documents")
def h4(documents):
    return documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("h5_stable_key", "orders", "SELECT o_orderkey, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), coalesce(o_orderstatus, '<null>'), coalesce(o_orderpriority, '<null>'))) AS stable_key FROM orders")
def h5(orders):
    """Nulls are marked before the parts are joined, so that no two rows share a key by a missing part."""
    return orders.select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), *[F.coalesce(c, F.lit("<null>")) for c in ("o_orderstatus", "o_orderpriority")]), 256).alias("stable_key"))


@query("h11_local_date", "events", "SELECT event_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS local_day, extract(hour FROM ts - INTERVAL 5 HOUR) AS local_hour FROM events")
def h11(events):
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Bogota"), F.col("ts"))
    return events.select("event_id", local.cast("date").alias("local_day"), F.hour(local).cast("long").alias("local_hour"))


@query("h19_excerpt", "documents", "SELECT doc_id, substring(text, 11, 40) AS excerpt, sha256(substring(text, 11, 40)) AS excerpt_hash FROM documents")
def h19(documents):
    excerpt = F.substring("text", 11, 40)
    return documents.select("doc_id", excerpt.alias("excerpt"), F.sha2(excerpt, 256).alias("excerpt_hash"))


@query("h24_resource_limit", "documents", "SELECT doc_id, length(text) AS n, CASE WHEN length(text) > 20000 THEN 'RESOURCE_LIMIT' ELSE 'ok' END AS outcome FROM documents")
def h24(documents):
    """Texts over the limit are named, never cut."""
    n = F.length("text")
    return documents.select("doc_id", n.cast("long").alias("n"), F.when(n > 20000, "RESOURCE_LIMIT").otherwise("ok").alias("outcome"))


@query("h25_money", "fx_ledger", "SELECT entry_id, CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) || ' ' || currency AS money FROM fx_ledger")
def h25(ledger):
    return ledger.select("entry_id", F.concat_ws(" ", F.col("amount").cast("decimal(18,2)").cast("string"), "currency").alias("money"))


@query("k3_derivatives", "fx_revisions", "SELECT revision_id, sha256(hash || ':recipe-2') AS derivative FROM fx_revisions")
def k3(revisions):
    """A new recipe on the same bytes gives a new derivative of the same revision."""
    return revisions.select("revision_id", F.sha2(F.concat("hash", F.lit(":recipe-2")), 256).alias("derivative"))


@query("l2_freshness_alert", "fx_checks", """SELECT sha256('l2:' || source_id) AS fingerprint, source_id, max(checked_at) FILTER (WHERE ok) AS last_seen, count(*) AS samples FROM fx_checks
GROUP BY source_id HAVING coalesce(max(checked_at) FILTER (WHERE ok) < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR, true)""")
def l2(checks):
    """Sources whose last successful check is older than twice their window of twelve hours, or that have none."""
    seen = checks.groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.col("checked_at"))).alias("last_seen"), F.count(F.lit(1)).alias("samples"))
    late = F.coalesce(F.col("last_seen") < F.lit("2024-01-31").cast("timestamp_ntz") - F.expr("INTERVAL '24' HOUR"), F.lit(True))
    return seen.filter(late).withColumn("fingerprint", F.sha2(F.concat(F.lit("l2:"), F.col("source_id").cast("string")), 256))


@query("l10_telemetry_alert", "customer fx_ops_events", """SELECT sha256('l10:' || c_custkey) AS fingerprint, c_custkey AS resource_id, last_seen FROM customer LEFT JOIN (SELECT resource_id, max(occurred_at + to_seconds(delay_s)) AS last_seen FROM fx_ops_events GROUP BY 1) ON c_custkey = resource_id
WHERE coalesce(last_seen < (SELECT max(occurred_at + to_seconds(delay_s)) FROM fx_ops_events) - INTERVAL 60 SECOND, true)""")
def l10(customer, events):
    """Resources whose last signal is over 60 s older than the newest of all, and those that never sent one."""
    received = F.col("occurred_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("delay_s").cast("decimal(18,6)"))
    last = events.groupBy("resource_id").agg(F.max(received).alias("last_seen"))
    newest = events.agg(F.max(received).alias("__newest"))
    found = customer.select(F.col("c_custkey").alias("resource_id")).join(last, "resource_id", "left").crossJoin(F.broadcast(newest))
    silent = F.coalesce(F.col("last_seen") < F.col("__newest") - F.expr("INTERVAL '60' SECOND"), F.lit(True))
    return found.filter(silent).select(F.sha2(F.concat(F.lit("l10:"), F.col("resource_id").cast("string")), 256).alias("fingerprint"), "resource_id", "last_seen")


QUERIES, ORACLE_SQL = query.QUERIES, query.ORACLE_SQL
