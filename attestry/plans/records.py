"""Queries on records, votes, projects and documents (families A-D, F-H, K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.operators import documents as K
from attestry.operators import filters as C
from attestry.operators import joins as D
from attestry.operators import projections as B
from attestry.operators import search as X
from attestry.operators import vectors as N
from attestry.operators import windows as W
from attestry.operators.graph import connected_components, lineage
from attestry.plans.fixtures import Registry
from attestry.plans.retrieval import QUALITY
from attestry.runtime import saved

query = Registry()
LINE = ["partkey", "line", "price"]
RULE = "CASE authority WHEN 'primary' THEN 0 ELSE 1 END, CASE stage WHEN 'F' THEN 0 ELSE 1 END, effective_date DESC, partkey, line, price"


def _rule():
    return [F.when(F.col("authority") == "primary", 0).otherwise(1), F.when(F.col("stage") == "F", 0).otherwise(1), -F.unix_date("effective_date"), *map(F.col, LINE)]


def _node(kind: str, column: str):
    return F.concat(F.lit(kind), F.col(column).cast("string"))


def _flow_edges(lineitem, supplier, nation):
    """Order to supplier to nation to region."""
    steps = (lineitem.select(_node("o", "l_orderkey"), _node("s", "l_suppkey")).distinct(), supplier.select(_node("s", "s_suppkey"), _node("n", "s_nationkey")), nation.select(_node("n", "n_nationkey"), _node("r", "n_regionkey")))
    return steps[0].union(steps[1]).union(steps[2]).toDF("from_id", "to_id")


@query("project_state", "fx_projects fx_observations customer nation", f"""
WITH p AS (SELECT subject_id, value, row_number() OVER (PARTITION BY subject_id ORDER BY {RULE}) AS r FROM fx_observations),
s AS (SELECT subject_id, count(*) AS considered, count(DISTINCT value) > 1 AS conflict FROM fx_observations GROUP BY 1)
SELECT project_id, status_raw, c_name AS person, n_name AS nation, value AS status, considered, conflict
FROM fx_projects LEFT JOIN p ON project_id = p.subject_id AND r = 1 LEFT JOIN s ON project_id = s.subject_id JOIN customer ON person_id = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def project_state(projects, obs, customer, nation):
    """Projects with their projected state; without an observation it is unknown."""
    state = W.status_projection(obs, "subject_id", "value", _rule()).withColumnRenamed("value", "status")
    sheet = projects.join(state, projects.project_id == state.subject_id, "left").join(customer, F.col("person_id") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return sheet.select("project_id", "status_raw", F.col("c_name").alias("person"), F.col("n_name").alias("nation"), "status", "considered", "conflict")


@query("d1_project_sheet", "fx_projects customer", "SELECT project_id, status_raw, number, filing_year, initiative_type, c_name AS author, CASE WHEN corporation_id = 0 THEN 'chamber' ELSE 'senate' END AS origin FROM fx_projects JOIN customer ON person_id = c_custkey")
def d1(projects, customer):
    author = customer.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("author"))
    origin = F.when(F.col("corporation_id") == 0, "chamber").otherwise("senate")
    return projects.join(author, "person_id").select("project_id", "status_raw", "number", "filing_year", "initiative_type", "author", origin.alias("origin"))


@query("d2_with_catalog", "customer nation region", "SELECT c_custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def d2(customer, nation, region):
    """Small catalogues (25 and 5 rows by the schema) are broadcast."""
    named = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return named.select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("b1_envelope", "orders", """SELECT '1' AS schema_version, 'project' AS record_type, CAST(o_orderkey AS VARCHAR) AS external_id, '{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}' AS normalized FROM orders""")
def b1(orders):
    return B.to_envelope(orders, "project", "o_orderkey", status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"))


@query("b2_project_observation", "events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props FROM events")
def b2(events):
    return events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), "props")


@query("b3_to_observations", "orders", "SELECT o_orderkey, 'o_orderstatus' AS predicate, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders")
def b3(orders):
    return B.to_observations(orders, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("b4_from_observations", "fx_observations", "SELECT subject_id, max(effective_date) FILTER (WHERE stage = 'F') AS F, max(effective_date) FILTER (WHERE stage = 'O') AS O FROM fx_observations GROUP BY 1")
def b4(obs):
    return B.from_observations(obs, "subject_id", "stage", "effective_date", ["F", "O"], F.col("effective_date"))


@query("b5_pseudonymize", "customer", "SELECT c_custkey, sha256('salt' || c_name) AS c_name FROM customer")
def b5(customer):
    return B.pseudonymize(customer.select("c_custkey", "c_name"), ["c_name"], "salt")


@query("b6_redact", "documents", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[email]', 'g'), '(?i)(token|key|secret|password)\s*[=:]\s*[^\s,;]+', '[secret]', 'g'), '\b[0-9]{13,19}\b', '[number]', 'g')) AS redacted_md5 FROM documents""")
def b6(docs):
    return docs.select("doc_id", F.md5(B.redact(F.col("text"))).alias("redacted_md5"))


@query("b7_mask", "conversations", "SELECT conv_id, turn, role, CAST(NULL AS VARCHAR) AS text FROM conversations WHERE role <> 'system' UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE role = 'system'")
def b7(conversations):
    """Without the permission the content is null; system turns may be read."""
    masked = B.mask_unless(conversations.filter("role <> 'system'"), ["text"], False)
    return masked.union(B.mask_unless(conversations.filter("role = 'system'"), ["text"], True))


@query("c1_common_filter", "events", "SELECT event_id, ts FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-12' AND event_type IN ('error', 'view')")
def c1(events):
    return C.common_filter(events, "ts", "2024-01-05", "2024-01-12", event_type=["error", "view"]).select("event_id", "ts")


@query("c4_operation_gate", "fx_sources", "SELECT source_id, code FROM fx_sources WHERE allowed IS TRUE")
def c4(sources):
    return C.allowed(sources, "allowed").select("source_id", "code")


@query("c5_activation", "fx_sources", "SELECT source_id, concat_ws(',', CASE WHEN expected_count > 0 IS NOT TRUE THEN 'coverage' END, CASE WHEN allowed IS NOT TRUE THEN 'policy' END) AS reasons FROM fx_sources")
def c5(sources):
    return sources.select("source_id", F.array_join(C.reasons(policy=F.col("allowed"), coverage=F.col("expected_count") > 0), ",").alias("reasons"))


@query("c6_local_day", "events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-11 05:00:00'")
def c6(events):
    return C.on_local_day(events, "ts", "2024-01-10").select("event_id")


@query("c7_date_precision", "fx_projects", """SELECT project_id, CASE WHEN u IS NULL THEN 'possible' WHEN u >= DATE '1996-03-15' AND e <= DATE '1997-06-01' THEN 'definite' WHEN u < DATE '1997-06-01' AND e > DATE '1996-03-15' THEN 'possible' ELSE 'no' END AS match
FROM (SELECT project_id, CASE date_precision WHEN 'day' THEN filed_on WHEN 'month' THEN date_trunc('month', filed_on) WHEN 'year' THEN date_trunc('year', filed_on) END AS u, CASE date_precision WHEN 'day' THEN filed_on + INTERVAL 1 DAY WHEN 'month' THEN date_trunc('month', filed_on) + INTERVAL 1 MONTH WHEN 'year' THEN date_trunc('year', filed_on) + INTERVAL 1 YEAR END AS e FROM fx_projects)""")
def c7(projects):
    return projects.select("project_id", C.date_match("filed_on", "date_precision", "1996-03-15", "1997-06-01").alias("match"))


@query("c10_retention", "events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-05' - to_days(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 7 WHEN 'error' THEN 30 WHEN 'signup' THEN 90 ELSE 365 END)")
def c10(events):
    """The five retention periods, by the class of each type of event."""
    classes = {"click": "chat_context", "view": "heartbeat", "error": "query_text", "signup": "aggregate", "purchase": "audit"}
    cls = F.coalesce(*[F.when(F.col("event_type") == k, c) for k, c in classes.items()])
    return C.retain(events, cls, "ts", "2024-02-05").select("event_id")


@query("c11_url_allowed", "pages", r"SELECT page_id, regexp_extract(url, '^https?://([^/?#:]*)', 1) <> '' AND regexp_extract(regexp_extract(url, '^https?://([^/?#:]*)', 1), '([^.]+\.[^.]+)$', 1) IN ('example.org', 'example.com') AND NOT regexp_matches(regexp_extract(url, '^https?://([^/?#:]*)', 1), '^(127\.|10\.|192\.168\.|169\.254\.|localhost$)') AS ok FROM pages")
def c11(pages):
    return pages.select("page_id", C.url_allowed("url", ["example.org", "example.com"]).alias("ok"))


@query("c14_tombstones", "fx_revisions labels", "SELECT revision_id, CASE WHEN doc_id IS NULL THEN hash END AS hash, doc_id IS NOT NULL AS withdrawn FROM fx_revisions LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) ON revision_id = doc_id")
def c14(revisions, labels):
    return C.apply_tombstones(revisions.select("revision_id", "hash"), labels.filter("toxic = 1").select(F.col("doc_id").alias("revision_id")), "revision_id", ["hash"])


@query("c16_resendable", "fx_deliveries", "SELECT answer_id, segment FROM fx_deliveries WHERE state = 'failed' AND answer_id NOT IN (SELECT answer_id FROM fx_deliveries WHERE state = 'uncertain')")
def c16(deliveries):
    """Clear failures only, and none of an answer with a segment that may have arrived."""
    unsure = deliveries.filter("state = 'uncertain'").select("answer_id").distinct()
    return deliveries.filter("state = 'failed'").join(unsure, "answer_id", "left_anti").select("answer_id", "segment")


@query("d3_roll_call", "orders fx_vote_obs", """WITH v AS (SELECT voting_id, person_id, vote, row_number() OVER (PARTITION BY voting_id, person_id ORDER BY observed_at DESC, partkey, line, price) AS r FROM fx_vote_obs),
b AS (SELECT DISTINCT o_custkey AS body, person_id FROM fx_vote_obs JOIN orders ON voting_id = o_orderkey)
SELECT o_orderkey AS voting_id, b.person_id, coalesce(vote, 'not_recorded') AS vote FROM orders JOIN b ON o_custkey = body LEFT JOIN v ON v.voting_id = o_orderkey AND v.person_id = b.person_id AND r = 1""")
def d3(orders, votes):
    """The roll of a voting is all who ever voted in its body (an equi-join); absence of a row is not an absence."""
    bodies = orders.select(F.col("o_orderkey").alias("voting_id"), F.col("o_custkey").alias("body"))
    persons = votes.select("voting_id", "person_id").distinct().join(bodies, "voting_id").select("body", "person_id").distinct()
    members = bodies.join(persons, "body").select("voting_id", "person_id")
    current = W.latest_by(votes, ["voting_id", "person_id"], "vote", [-F.unix_micros(F.to_timestamp("observed_at")), *map(F.col, LINE)])
    return D.roll_call(members, current.select("voting_id", "person_id", "vote"), ["voting_id", "person_id"])


@query("d4_reconcile_totals", "fx_vote_obs orders", """WITH n AS (SELECT voting_id, count(*) AS n FROM fx_vote_obs WHERE voting_id % 7 <> 0 GROUP BY 1), t AS (SELECT o_orderkey AS voting_id, CAST(o_orderkey % 6 AS BIGINT) AS n FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(n.voting_id, t.voting_id) AS voting_id, n.n AS left_value, t.n AS right_value, CASE WHEN t.voting_id IS NULL THEN 'only_left' WHEN n.voting_id IS NULL THEN 'only_right' WHEN n.n IS NOT DISTINCT FROM t.n THEN 'equal' ELSE 'different' END AS label FROM n FULL JOIN t ON n.voting_id = t.voting_id""")
def d4(votes, orders):
    nominal = votes.filter("voting_id % 7 <> 0").groupBy("voting_id").agg(F.count(F.lit(1)).alias("n"))
    totals = orders.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("voting_id"), (F.col("o_orderkey") % 6).alias("n"))
    return D.reconcile(nominal, totals, ["voting_id"], "n")


@query("d5_index_diff", "documents labels", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def d5(docs, labels):
    found = D.reconcile(docs.select("doc_id", F.lit(1).alias("v")), labels.select("doc_id", F.lit(1).alias("v")), ["doc_id"], "v", ("missing", "orphan", "ok", "ok"))
    return found.select("doc_id", "label")


@query("d6_evidence_in_scope", "documents labels", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def d6(docs, labels):
    return docs.join(labels.filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("d7_new_or_changed", "documents", "SELECT doc_id, source, sha256(text) AS hash FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.source = d.source AND e.text = d.text)")
def d7(docs):
    hashed = docs.select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return D.new_or_changed(hashed.filter("doc_id % 2 = 1"), hashed.filter("doc_id % 2 = 0"), ["source", "hash"]).select("doc_id", "source", "hash")


@query("d8_orphans", "orders customer", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def d8(orders, customer):
    return D.orphans(orders, customer.filter("c_custkey % 3 <> 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("d9_resolve_identifier", "fx_projects", "SELECT project_id, count(*) OVER k AS candidates, min(project_id) OVER k AS first_candidate FROM fx_projects WINDOW k AS (PARTITION BY number, filing_year, corporation_id, initiative_type)")
def d9(projects):
    """Every project's contextual key with the number of its candidates; the candidates themselves are not paired."""
    keys = ["number", "filing_year", "corporation_id", "initiative_type"]
    ids = projects.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"), F.min("project_id").alias("first_candidate"))
    found = D.resolve_identifier(projects.select("project_id", *keys), ids.withColumn("entry", F.struct("candidates", "first_candidate")), keys, "entry")
    return found.select("project_id", "candidate.candidates", "candidate.first_candidate")


@query("d10_valid_at", "orders fx_memberships", "SELECT o_orderkey, party, term_id FROM orders LEFT JOIN fx_memberships ON o_custkey = person_id AND valid_from <= CAST(o_orderdate AS DATE) AND (valid_to IS NULL OR CAST(o_orderdate AS DATE) < valid_to)")
def d10(orders, members):
    facts = orders.select("o_orderkey", F.col("o_custkey").alias("person_id"), F.to_date("o_orderdate").alias("on_day"))
    return D.valid_at(facts, members, "person_id", "on_day").select("o_orderkey", "party", "term_id")


@query("d11_as_of", "events", """SELECT e.event_id, c.value AS value_as_of FROM (SELECT * FROM events WHERE event_type = 'view') e LEFT JOIN LATERAL (SELECT value FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts <= e.ts ORDER BY ts DESC, event_id DESC LIMIT 1) c ON true""")
def d11(events):
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return D.as_of(views, events.filter("event_type = 'purchase'"), "user_id", "ts", "value", "ts", "event_id").select("event_id", "value_as_of")


@query("d13_via_bridge", "orders lineitem supplier", "SELECT o_orderkey AS l_orderkey, count(DISTINCT s_nationkey) AS n_linked, array_to_string(list_sort(list(DISTINCT s_nationkey) FILTER (WHERE s_nationkey IS NOT NULL)), ',') AS linked FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def d13(orders, lineitem, supplier):
    found = D.via_bridge(orders.select(F.col("o_orderkey").alias("l_orderkey")), lineitem, supplier.withColumnRenamed("s_suppkey", "l_suppkey"), "l_orderkey", "l_suppkey", "s_nationkey")
    linked = F.array_join(F.transform("linked", lambda x: x.cast("string")), ",")
    return found.withColumn("linked", F.when(F.col("n_linked") > 0, linked))


@query("d15_supersedes", "fx_revisions", "SELECT a.document_id, a.seq, a.hash, b.hash AS previous_hash FROM fx_revisions a LEFT JOIN fx_revisions b ON a.document_id = b.document_id AND a.seq = b.seq + 1")
def d15(revisions):
    return D.supersedes(revisions, "document_id", "seq", ["hash"])


@query("d17_coverage_grid", "events", """SELECT u.user_id, t.event_type, w.week, count(e.event_id) AS observed, count(e.event_id) = 0 AS gap FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t
CROSS JOIN (SELECT CAST(unnest(generate_series(date_trunc('week', min(ts)), date_trunc('week', max(ts)), INTERVAL 7 DAY)) AS DATE) AS week FROM events) w
LEFT JOIN (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS week FROM events WHERE value > 60) e ON u.user_id = e.user_id AND t.event_type = e.event_type AND w.week = e.week GROUP BY 1, 2, 3""")
def d17(events):
    """Every source of every class in every week of the range."""
    week = F.trunc(F.to_date("ts"), "week")
    span = events.agg(F.min(week).alias("a"), F.max(week).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL '7' DAY"))).alias("week"))
    cells = events.select("event_type").distinct().crossJoin(span)
    return D.coverage_grid(events.filter("value > 60").withColumn("week", week), events.select("user_id").distinct(), cells, ["user_id", "event_type", "week"])


@query("d18_title_candidates", "part", "WITH t AS (SELECT DISTINCT p_name AS title FROM part) SELECT a.title, b.title AS other, CAST(levenshtein(a.title, b.title) AS INT) AS distance FROM t a JOIN t b ON a.title < b.title AND abs(length(a.title) - length(b.title)) <= 3 WHERE levenshtein(a.title, b.title) <= 3")
def d18(part):
    return D.title_candidates(part, "p_name", 3)


@query("d21_identity_components", "events", """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM g) SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id, part) AS component FROM s""")
def d21(events):
    """Explicit links of each event to the one before it of its user within six hours; an event alone links to itself."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL '6' HOUR")
    return connected_components(events.select(F.col("event_id").alias("a"), F.coalesce(F.when(near, F.lag("event_id").over(w)), F.col("event_id")).alias("b")))


@query("d23_enrich_secondary", "fx_observations", f"""WITH p AS (SELECT subject_id, value, row_number() OVER (PARTITION BY subject_id ORDER BY {RULE}) AS r FROM fx_observations WHERE authority = 'primary'), s AS (SELECT subject_id, value, row_number() OVER (PARTITION BY subject_id ORDER BY {RULE}) AS r FROM fx_observations WHERE authority = 'secondary')
SELECT p.subject_id, p.value, s.value AS secondary_value, p.value <> s.value AS disagrees FROM p LEFT JOIN s ON p.subject_id = s.subject_id AND s.r = 1 WHERE p.r = 1""")
def d23(obs):
    one = lambda kind: W.first_by(obs.filter(F.col("authority") == kind), ["subject_id"], _rule()).select("subject_id", "value")
    return D.enrich_secondary(one("primary"), one("secondary"), "subject_id", "value")


@query("d20_lineage", "orders lineitem supplier nation", """WITH a AS (SELECT DISTINCT 'o' || o_orderkey AS start, 's' || l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey), b AS (SELECT DISTINCT start, 'n' || s_nationkey AS n, s_nationkey FROM a JOIN supplier ON s = 's' || s_suppkey), c AS (SELECT DISTINCT start, 'r' || n_regionkey AS r FROM b JOIN nation ON s_nationkey = n_nationkey)
SELECT 'o' || o_orderkey AS start, 'o' || o_orderkey AS node, 0 AS depth FROM orders UNION ALL SELECT start, s, 1 FROM a UNION ALL SELECT start, n, 2 FROM b UNION ALL SELECT start, r, 3 FROM c""")
def d20(orders, lineitem, supplier, nation):
    """From every order to its suppliers, their nations and regions."""
    starts = orders.select(_node("o", "o_orderkey").alias("node"))
    return lineage(_flow_edges(lineitem, supplier, nation), starts)


@query("f1_status_projection", "fx_observations", f"WITH p AS (SELECT subject_id, value, row_number() OVER (PARTITION BY subject_id ORDER BY {RULE}) AS r FROM fx_observations) SELECT subject_id, p.value, considered, conflict FROM p JOIN (SELECT subject_id, count(*) AS considered, count(DISTINCT value) > 1 AS conflict FROM fx_observations GROUP BY 1) USING (subject_id) WHERE r = 1")
def f1(obs):
    """The status by the order of the rules, how many observations were considered, and whether they conflict."""
    return W.status_projection(obs, "subject_id", "value", _rule())


@query("f2_current_votes", "fx_vote_obs", "WITH c AS (SELECT *, row_number() OVER (PARTITION BY voting_id, person_id ORDER BY observed_at DESC, partkey, line, price) AS r FROM fx_vote_obs) SELECT voting_id, person_id, vote, considered, conflict FROM c JOIN (SELECT voting_id, person_id, count(*) AS considered, count(DISTINCT vote) > 1 AS conflict FROM fx_vote_obs GROUP BY 1, 2) USING (voting_id, person_id) WHERE r = 1")
def f2(votes):
    keys = ["voting_id", "person_id"]
    return W.latest_by(votes, keys, "vote", [-F.unix_micros(F.to_timestamp("observed_at")), *map(F.col, LINE)])


@query("f11_to_intervals", "orders", "SELECT o_orderkey, o_custkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders")
def f11(orders):
    return W.to_intervals(orders, "o_custkey", "o_orderdate", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "valid_from", "valid_to")


@query("f12_overlaps", "fx_observations", "SELECT subject_id, effective_date, partkey FROM (SELECT *, max(effective_date + 30) OVER (PARTITION BY subject_id ORDER BY effective_date, partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fx_observations) WHERE effective_date < m")
def f12(obs):
    return W.overlaps(obs.withColumn("until", F.date_add("effective_date", 30)), "subject_id", "effective_date", "until", "partkey").select("subject_id", "effective_date", "partkey")


@query("g1_union_events", "orders lineitem", "SELECT 'filed' AS kind, o_orderkey AS project_id, o_orderdate AS at, CAST(NULL AS BIGINT) AS source_id FROM orders UNION ALL SELECT 'observed', l_orderkey, l_shipdate, l_suppkey FROM lineitem")
def g1(orders, lineitem):
    filed = orders.select(F.lit("filed").alias("kind"), F.col("o_orderkey").alias("project_id"), F.col("o_orderdate").alias("at"))
    return filed.unionByName(lineitem.select(F.lit("observed").alias("kind"), F.col("l_orderkey").alias("project_id"), F.col("l_shipdate").alias("at"), F.col("l_suppkey").alias("source_id")), allowMissingColumns=True)


@query("g2_snapshot_diff", "documents", "WITH a AS (SELECT source, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT source, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 1) SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'unchanged' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def g2(docs):
    """Both snapshots in one aggregation: one scan and one shuffle."""
    sides = docs.select("source", F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 3 != 0).alias("old"), (F.col("doc_id") % 3 != 1).alias("new"))
    found = sides.groupBy("source", "hash").agg(F.bool_or("old").alias("old"), F.bool_or("new").alias("new"))
    change = F.when(F.col("old") & F.col("new"), "unchanged").when(F.col("old"), "removed").when(F.col("new"), "added")
    return found.select("source", "hash", change.alias("change")).filter("change IS NOT NULL")


@query("g4_duplicates", "lineitem", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def g4(lineitem):
    return lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("g9_keyset_page", "events", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND event_id > 0) ORDER BY ts, event_id LIMIT 100")
def g9(events):
    after = F.lit("2024-01-10").cast("timestamp_ntz")
    return events.filter((F.col("ts") > after) | ((F.col("ts") == after) & (F.col("event_id") > 0))).orderBy("ts", "event_id").limit(100).select("event_id", "ts")


@query("g11_top_milestones", "orders", "SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def g11(orders):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return orders.withColumn("r", r).filter("r <= 5").select("o_custkey", "o_orderkey", "r")


@query("g12_disambiguate", "fx_projects", "SELECT number, filing_year, count(*) AS candidates, CASE WHEN count(*) = 1 THEN 'answered' ELSE 'needs_clarification' END AS status FROM fx_projects GROUP BY 1, 2")
def g12(projects):
    found = projects.groupBy("number", "filing_year").agg(F.count(F.lit(1)).alias("candidates"))
    return found.withColumn("status", F.when(F.col("candidates") == 1, "answered").otherwise("needs_clarification"))


@query("h1_norm_name", "customer", "SELECT c_custkey, regexp_replace(translate(lower(trim(c_name)), 'áéíóúüñ', 'aeiouun'), '\\s+', ' ', 'g') AS name FROM customer")
def h1(customer):
    return customer.select("c_custkey", F.regexp_replace(F.translate(F.lower(F.trim("c_name")), "áéíóúüñ", "aeiouun"), r"\s+", " ").alias("name"))


@query("h14_canonical_url", "pages", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:]*://[^/?#]*')) || regexp_extract(url, '^[^:]*://[^/?#]*([^#]*)', 1), '/$', '') AS url FROM pages")
def h14(pages):
    return pages.select("page_id", F.regexp_replace(F.concat(F.lower(F.regexp_extract("url", r"^[^:]*://[^/?#]*", 0)), F.regexp_extract("url", r"^[^:]*://[^/?#]*([^#]*)", 1)), r"/$", "").alias("url"))


@query("h20_text_quality", "documents", r"SELECT doc_id, CASE WHEN length(text) = 0 THEN 'rejected' WHEN length(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g')) / length(text) >= 0.9 THEN 'accepted' WHEN length(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g')) / length(text) >= 0.6 THEN 'doubtful' ELSE 'rejected' END AS quality FROM documents")
def h20(docs):
    return docs.select("doc_id", K.text_quality(F.col("text")).alias("quality"))


@query("h21_token_count", "documents", r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+')) AS n FROM documents")
def h21(docs):
    return docs.select("doc_id", K.token_count(F.col("text")).cast("long").alias("n"))


@query("h22_html_text", "pages", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f\x0b]+', ' ', 'g'))) AS text_md5 FROM pages""")
def h22(pages):
    return pages.select("page_id", F.md5(K.html_text(F.col("html"))).alias("text_md5"))


@query("k1_blobs", "documents", "SELECT sha256(text) AS hash, count(*) AS n_origins, strlen(any_value(text)) AS n_bytes FROM documents GROUP BY 1")
def k1(docs):
    return K.blobs(docs, "text")


@query("k4_paginate", "documents", f"SELECT doc_id, page, page_md5, quality, CASE WHEN quality = 'accepted' THEN 'native' ELSE 'ocr' END AS method FROM (SELECT doc_id, i AS page, md5(ls[i]) AS page_md5, {QUALITY.format(t='ls[i]')} AS quality FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))")
def k4(docs):
    """Pages from 1 with the quality of their text and the method that follows: what is not accepted natively is read by OCR."""
    quality = K.text_quality(F.col("page_text"))
    pages = K.paginate(docs, "doc_id", "text").select("doc_id", F.col("page").cast("long").alias("page"), F.md5("page_text").alias("page_md5"), quality.alias("quality"))
    return pages.withColumn("method", F.when(F.col("quality") == "accepted", "native").otherwise("ocr"))


@query("k9_inverted_index", "documents", r"SELECT doc_id, term, tf, CAST(count(*) OVER (PARTITION BY term) AS BIGINT) AS df FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY 1, 2)")
def k9(docs):
    """The index is written in blocks; document frequencies come from their heads."""
    return X.Postings.build(docs, "doc_id", "text").rows("doc_id")


@query("k10_lexical", "benchmark documents", r"""WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS dl FROM t GROUP BY 1), n AS (SELECT count(*) AS n, avg(dl) AS a FROM l), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark WHERE item_id % 20 = 0),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM q JOIN t USING (term) JOIN d USING (term) JOIN l USING (doc_id) CROSS JOIN n GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 30""")
def k10(benchmark, docs):
    """A search over the blocks of k9."""
    return X.lexical(benchmark.filter("item_id % 20 = 0"), docs, "item_id", "doc_id", "text")


@query("k11_vector_topk", "embeddings", "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 30")
def k11(embeddings):
    return N.vector_top(embeddings.filter("vec_id % 20 = 0"), embeddings, "vec_id", "embedding")


@query("k21_exact_duplicates", "documents", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id, count(*) OVER (PARTITION BY text) AS copies FROM documents QUALIFY copies > 1")
def k21(docs):
    return K.exact_duplicates(docs, "doc_id", "text")


QUERIES, ORACLE_SQL = query.QUERIES, query.ORACLE_SQL
