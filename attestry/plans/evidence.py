"""Queries on scope, evidence, lineage, agendas and audits (families B-G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators import folds as P
from attestry.operators import joins as D
from attestry.operators import metrics as E
from attestry.operators import windows as W
from attestry.operators.graph import cycle_rest, lineage
from attestry.operators.projections import metric_row
from attestry.plans.fixtures import Registry

query = Registry()
NOW = "2024-01-31"


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _seconds(a: str, b: str):
    """Whole seconds from column ``a`` to column ``b``."""
    return ((F.unix_micros(F.to_timestamp(b)) - F.unix_micros(F.to_timestamp(a))) / 1_000_000).cast("long")


def _duck_s(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a})) // 1000000"


@query("b8_metric_row", "events", "SELECT 'errors' AS metric, count(*) FILTER (WHERE event_type = 'error') AS value, 'events' AS unit, '2024-01' AS time_window, count(*) AS sample_count, DATE '2024-01-31' AS as_of, CASE WHEN count(*) >= 100 THEN 'complete' ELSE 'partial' END AS completeness FROM events")
def b8(events):
    row = metric_row(events, "errors", F.count_if(F.col("event_type") == "error"), "events", "2024-01")
    return row.withColumn("as_of", F.lit(NOW).cast("date")).withColumn("completeness", F.when(F.col("sample_count") >= 100, "complete").otherwise("partial"))


#: Read-only templates: callers choose a name and give values, never SQL.
TEMPLATES = {
    "events_by_type": "SELECT event_type, count(*) AS n FROM {events} WHERE ts >= :start AND ts < :end GROUP BY event_type",
    "events_of_user": "SELECT event_id, event_type FROM {events} WHERE user_id = :user_id AND ts >= :start AND ts < :end",
}


def run_template(events: DataFrame, name: str, args: dict) -> DataFrame:
    """A stated template with bound values."""
    return events.sparkSession.sql(TEMPLATES[name], args=args, events=events)


@query("c2_template", "events", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1")
def c2(events):
    return run_template(events, "events_by_type", {"start": "2024-01-05", "end": "2024-01-15"})


def scope_filter(df: DataFrame, grants: DataFrame, scope: str) -> DataFrame:
    """Rows in a granted scope only, before anything else is read of them."""
    return df.join(grants.select(scope).distinct(), scope, "left_semi")


@query("c3_scope_filter", "documents", "SELECT lang, count(*) AS n FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) % 2 = 0) GROUP BY 1")
def c3(documents):
    grants = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 0")
    return scope_filter(documents.select("source", "lang"), grants, "source").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("c8_relative_day", "events", "SELECT event_id, term, CAST(ts - INTERVAL 5 HOUR AS DATE) + CAST(shift AS INTEGER) AS day FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'ayer' WHEN 1 THEN 'hoy' ELSE 'mañana' END AS term, event_id % 3 - 1 AS shift FROM events)")
def c8(events):
    """A word of time by the local day of the question."""
    terms = F.element_at(F.array(F.lit("ayer"), F.lit("hoy"), F.lit("mañana")), (F.col("event_id") % 3 + 1).cast("int"))
    shift = F.element_at(F.create_map(F.lit("ayer"), F.lit(-1), F.lit("hoy"), F.lit(0), F.lit("mañana"), F.lit(1)), F.col("term"))
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Bogota"), F.col("ts")).cast("date")
    return events.withColumn("term", terms).select("event_id", "term", F.date_add(local, shift).alias("day"))


def trace_events(events: DataFrame, user_id, start: str, end: str) -> DataFrame:
    """Events of one permitted id in a range of seven days at most."""
    import datetime

    if datetime.date.fromisoformat(end) - datetime.date.fromisoformat(start) > datetime.timedelta(7):
        raise ValueError("a trace covers seven days at most")
    found = events.filter((F.col("user_id") == user_id) & (F.col("ts") >= _ntz(start)) & (F.col("ts") < _ntz(end)))
    return found.orderBy("ts", "event_id").select("event_id", "ts", "event_type")


@query("c15_trace", "events", "SELECT event_id, ts, event_type FROM events WHERE user_id = 3 AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
def c15(events):
    return trace_events(events, 3, "2024-01-08", "2024-01-15")


@query("c18_active_namespace", "embeddings", "SELECT vec_id, 'm' || label % 2 AS model FROM embeddings WHERE label % 2 = 0 AND vec_id % 3 = 1 AND len(embedding) = 64")
def c18(embeddings):
    """Vectors of the active model and version, and of its dimension."""
    active = embeddings.sparkSession.createDataFrame([("m0", 1, 64)], "model string, version long, dimensions int")
    named = embeddings.select("vec_id", F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"), (F.col("vec_id") % 3).alias("version"), F.size("embedding").alias("dimensions"))
    return named.join(F.broadcast(active), ["model", "version", "dimensions"], "left_semi").select("vec_id", "model")


@query("d12_within_range", "orders lineitem", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY")
def d12(orders, lineitem):
    spans = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("low"), (F.col("o_orderdate") + F.expr("INTERVAL '60' DAY")).alias("high"))
    return D.within_range(lineitem, spans, "l_orderkey", "l_shipdate", "low", "high").select("l_orderkey", "l_linenumber", "l_partkey")


@query("d12_binned_range", "part supplier", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON CAST(floor(p_retailprice * 10) AS BIGINT) >= CAST(floor(s_acctbal * 10) AS BIGINT) AND CAST(floor(p_retailprice * 10) AS BIGINT) < CAST(floor(s_acctbal * 10) AS BIGINT) + 2000")
def d12_binned(part, supplier):
    """Without a common key ranges are dealt to the bins that they touch."""
    points = part.select("p_partkey", F.floor(F.col("p_retailprice") * 10).alias("cents"))
    low = F.floor(F.col("s_acctbal") * 10)
    return D.binned_range_join(points, supplier.select("s_suppkey", low.alias("low"), (low + 2000).alias("high")), "cents", "low", "high", 2000).select("p_partkey", "s_suppkey")


LINKED = "SELECT l_orderkey // 5 AS gazette, l_orderkey * 10 + l_linenumber AS segment, l_orderkey AS project_id FROM lineitem UNION SELECT l_orderkey // 5, l_orderkey * 10 + l_linenumber, l_orderkey // 5 * 5 FROM lineitem WHERE l_linenumber = 7"


@query("d14_project_chunks", "lineitem", f"WITH l AS ({LINKED}), c AS (SELECT DISTINCT l_orderkey // 5 AS gazette, l_orderkey * 10 + l_linenumber AS segment, l_partkey AS chunk FROM lineitem) SELECT project_id, gazette, segment, chunk FROM c JOIN l USING (gazette, segment)")
def d14(lineitem):
    """Five dossiers share a gazette: chunks reach a project through the links of their segment, of which some have two, never through the gazette."""
    parts = lineitem.select(F.expr("l_orderkey DIV 5").alias("gazette"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("segment"), "l_linenumber", "l_orderkey", F.col("l_partkey").alias("chunk"))
    first = F.when(F.col("l_linenumber") == 7, F.array("l_orderkey", F.col("gazette") * 5)).otherwise(F.array("l_orderkey"))
    links = parts.select("gazette", "segment", F.explode(first).alias("project_id")).distinct()
    chunks = parts.select("gazette", "segment", "chunk").distinct()
    return chunks.join(links, ["gazette", "segment"]).select("project_id", "gazette", "segment", "chunk")


def _claims(conversations: DataFrame) -> DataFrame:
    """Claims: what the assistant says, with the turns that it cites."""
    return conversations.filter("role = 'assistant'").select("conv_id", "turn", F.array(F.col("turn") - 1, F.col("turn") + 1).alias("evidence_ids"))


def unsupported_claims(claims: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(conv_id, turn, evidence): citations of what was not retrieved."""
    cited = claims.select("conv_id", "turn", F.explode("evidence_ids").alias("evidence"))
    return cited.join(retrieved, ["conv_id", "evidence"], "left_anti").select("conv_id", "turn", "evidence")


CITED = "SELECT conv_id, turn, unnest([turn - 1, turn + 1]) AS evidence FROM conversations WHERE role = 'assistant'"
HELD = "(SELECT conv_id, turn FROM conversations WHERE role <> 'assistant')"


def _retrieved(conversations):
    return conversations.filter("role <> 'assistant'").select("conv_id", F.col("turn").alias("evidence"))


@query("d19_unsupported_claims", "conversations", f"SELECT conv_id, turn, evidence FROM ({CITED}) c WHERE NOT EXISTS (SELECT 1 FROM {HELD} h WHERE h.conv_id = c.conv_id AND h.turn = c.evidence)")
def d19(conversations):
    return unsupported_claims(_claims(conversations), _retrieved(conversations))


@query("d22_cycle_check", "events", """WITH RECURSIVE s AS (SELECT user_id AS flow, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
e AS (SELECT DISTINCT flow, a, b FROM s WHERE b IS NOT NULL AND i <= 6), r AS (SELECT flow, a, b FROM e UNION SELECT r.flow, r.a, e.b FROM r JOIN e ON r.flow = e.flow AND r.b = e.a), c AS (SELECT flow, a AS x FROM r WHERE a = b)
SELECT flow, a, b FROM e WHERE EXISTS (SELECT 1 FROM c WHERE c.flow = e.flow AND (c.x = e.a OR EXISTS (SELECT 1 FROM r WHERE r.flow = e.flow AND r.a = c.x AND r.b = e.a)))
AND EXISTS (SELECT 1 FROM c WHERE c.flow = e.flow AND (c.x = e.b OR EXISTS (SELECT 1 FROM r WHERE r.flow = e.flow AND r.a = e.b AND r.b = c.x)))""")
def d22(events):
    """Stages of a flow (the first six events of a user) that follow in circles."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.select(F.col("user_id").alias("flow"), F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"), F.row_number().over(w).alias("i"))
    return cycle_rest(steps.filter("i <= 6"))


@query("d24_affected", "orders lineitem supplier", """WITH c AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'), s AS (SELECT DISTINCT l_suppkey FROM lineitem JOIN c ON l_orderkey = o_orderkey)
SELECT 's' || l_suppkey AS node FROM s UNION SELECT 'n' || s_nationkey FROM s JOIN supplier ON l_suppkey = s_suppkey""")
def d24(orders, lineitem, supplier):
    """All that a withdrawn record leads to."""
    id_ = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = lineitem.select(id_("o", "l_orderkey").alias("from_id"), id_("s", "l_suppkey").alias("to_id")).distinct().union(supplier.select(id_("s", "s_suppkey"), id_("n", "s_nationkey")))
    withdrawn = orders.filter("o_orderstatus = 'P'").select(id_("o", "o_orderkey").alias("node"))
    return lineage(edges, withdrawn).filter("depth > 0").select("node").distinct()


@query("d25_rebuild_answer", "conversations documents", "SELECT q.conv_id, q.turn, md5(q.text) AS question, md5(a.text) AS answer, d.source AS evidence FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' JOIN documents d ON d.doc_id = q.conv_id WHERE q.role = 'user'")
def d25(conversations, documents):
    """Question, answer and evidence of one exchange."""
    asked = conversations.filter("role = 'user'").select("conv_id", "turn", F.md5("text").alias("question"))
    answers = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.md5("text").alias("answer"))
    evidence = documents.select(F.col("doc_id").alias("conv_id"), F.col("source").alias("evidence"))
    return asked.join(answers, ["conv_id", "turn"]).join(evidence, "conv_id")


@query("d26_claims_vs_facts", "pages documents", "SELECT page_id, 'external' AS claim_authority, doc_id, CASE WHEN doc_id IS NOT NULL THEN 'official' END AS fact_authority, lang FROM pages LEFT JOIN documents ON page_id = doc_id")
def d26(pages, documents):
    """A public claim beside the official fact; each keeps its side."""
    facts = documents.select("doc_id", F.lit("official").alias("fact_authority"), "lang")
    return pages.select("page_id", F.lit("external").alias("claim_authority")).join(facts, F.col("page_id") == F.col("doc_id"), "left")


@query("d27_agenda", "lineitem", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS r FROM lineitem)
SELECT l_orderkey AS project_id, CAST(l_shipdate AS DATE) AS day, l_linestatus = 'F' AS held FROM r WHERE r = 1 AND l_shipdate >= TIMESTAMP '1998-03-01 05:00:00' AND l_shipdate < TIMESTAMP '1998-04-01 05:00:00'""")
def d27(lineitem):
    """The last revision of each project's agenda decides on its day; held only with evidence."""
    last = lineitem.groupBy("l_orderkey").agg(F.max_by(F.struct("l_shipdate", "l_linestatus"), F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("x")).select("l_orderkey", "x.*")
    month = last.filter((F.col("l_shipdate") >= _ntz("1998-03-01 05:00:00")) & (F.col("l_shipdate") < _ntz("1998-04-01 05:00:00")))
    return month.select(F.col("l_orderkey").alias("project_id"), F.to_date("l_shipdate").alias("day"), (F.col("l_linestatus") == "F").alias("held"))


@query("d28_votings", "orders fx_vote_obs", """WITH s AS (SELECT o_custkey AS session, CAST(extract(year FROM o_orderdate) AS BIGINT) AS year, o_orderkey AS voting_id, o_orderkey % 300 AS project FROM orders), t AS (SELECT session, year, count(*) AS held, count(DISTINCT project) AS projects FROM s GROUP BY 1, 2)
SELECT session, year, person_id, any_value(projects) AS session_projects, count(DISTINCT voting_id) AS votings, count(DISTINCT project) AS projects, count(DISTINCT voting_id) / any_value(held) AS coverage FROM s JOIN t USING (session, year) LEFT JOIN fx_vote_obs USING (voting_id) GROUP BY 1, 2, 3""")
def d28(orders, votes):
    """Votings by session, year, project and person; coverage is the share of the session's votings with a vote of the person.

    Votings without nominal votes stay, under no person.
    """
    held = orders.select(F.col("o_custkey").alias("session"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderkey").alias("voting_id"), (F.col("o_orderkey") % 300).alias("project"))
    totals = held.groupBy("session", "year").agg(F.count(F.lit(1)).alias("held"), F.countDistinct("project").alias("session_projects"))
    cast = held.join(votes.select("voting_id", "person_id").distinct(), "voting_id", "left")
    found = cast.groupBy("session", "year", "person_id").agg(F.count(F.lit(1)).alias("votings"), F.countDistinct("project").alias("projects"))
    return found.join(totals, ["session", "year"]).select("session", "year", "person_id", "session_projects", "votings", "projects", (F.col("votings") / F.col("held")).alias("coverage"))


@query("d29_attendance", "lineitem", "SELECT r.l_orderkey AS session, r.l_suppkey AS person_id, CASE WHEN a.l_suppkey IS NULL THEN 'not_recorded' ELSE 'present' END AS attendance FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) r LEFT JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_tax < 0.04) a ON r.l_orderkey = a.l_orderkey AND r.l_suppkey = a.l_suppkey")
def d29(lineitem):
    """Attendance by its own rows only; a vote says nothing about it."""
    keys = [F.col("l_orderkey").alias("session"), F.col("l_suppkey").alias("person_id")]
    roll, seen = lineitem.select(*keys).distinct(), lineitem.filter("l_tax < 0.04").select(*keys).distinct().withColumn("attendance", F.lit("present"))
    return D.roll_call(roll, seen, ["session", "person_id"], "attendance")


@query("d31_inhibit", "fx_alerts", "SELECT alert_id, EXISTS (SELECT 1 FROM fx_alerts p WHERE p.severity = 'critical' AND p.rule = (c.rule + 1) % 5 AND c.seen_at >= p.seen_at AND c.seen_at < p.seen_at + INTERVAL 30 MINUTE) AS inhibited FROM fx_alerts c")
def d31(alerts):
    """A child's alert is held back for half an hour after its parent fires; the row stays."""
    parents = alerts.filter("severity = 'critical'").select(((F.col("rule") + 4) % 5).alias("rule"), F.col("seen_at").alias("starts"), (F.col("seen_at") + F.expr("INTERVAL '30' MINUTE")).alias("ends"))
    return D.covered(alerts, parents, "rule", "seen_at", "starts", "ends", 1800).select("alert_id", F.col("covered").alias("inhibited"))


@query("d33_participants", "fx_observations", """SELECT subject_id, stage, CASE value WHEN 'A' THEN 'author' WHEN 'N' THEN 'speaker' ELSE 'coauthor' END AS role, count(DISTINCT source_id) FILTER (WHERE source_id % 3 > 0) AS persons, count(DISTINCT source_id) FILTER (WHERE source_id % 3 = 0) AS organizations, count(DISTINCT source_id) FILTER (WHERE authority = 'primary') AS by_primary, count(DISTINCT source_id) FILTER (WHERE authority <> 'primary') AS by_secondary FROM fx_observations GROUP BY 1, 2, 3""")
def d33(obs):
    """Persons and organizations by role and stage; what primary and secondary sources name is counted apart."""
    role = F.when(F.col("value") == "A", "author").when(F.col("value") == "N", "speaker").otherwise("coauthor")
    n = lambda c: F.countDistinct(F.when(c, F.col("source_id")))
    person, primary = F.col("source_id") % 3 > 0, F.col("authority") == "primary"
    return obs.groupBy("subject_id", "stage", role.alias("role")).agg(n(person).alias("persons"), n(~person).alias("organizations"), n(primary).alias("by_primary"), n(~primary).alias("by_secondary"))


@query("e13_three_clocks", "fx_checks", "SELECT source_id, max(checked_at) AS last_attempt, max(checked_at) FILTER (WHERE ok) AS last_success, max(checked_at) FILTER (WHERE content_hash IS DISTINCT FROM previous) AS last_change FROM (SELECT *, lag(content_hash) OVER (PARTITION BY source_id ORDER BY checked_at, check_id) AS previous FROM fx_checks) GROUP BY 1")
def e13(checks):
    before = F.lag("content_hash").over(Window.partitionBy("source_id").orderBy("checked_at", "check_id"))
    when = lambda c: F.max(F.when(c, F.col("checked_at")))
    return checks.withColumn("previous", before).groupBy("source_id").agg(F.max("checked_at").alias("last_attempt"), when(F.col("ok")).alias("last_success"), when(~F.col("content_hash").eqNullSafe(F.col("previous"))).alias("last_change"))


@query("e14_availability_latency", "orders lineitem", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'first_detection' ELSE 'published' END AS basis, date_diff('day', CASE WHEN o_orderkey % 3 = 0 THEN f ELSE o_orderdate END::DATE, a::DATE) AS days
FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS f, max(l_shipdate) AS a FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def e14(orders, lineitem):
    """From publication, or from the first detection where that is unknown, to availability."""
    seen = lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("detected"), F.max("l_shipdate").alias("available"))
    published = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    found = orders.join(seen, F.col("o_orderkey") == F.col("l_orderkey"))
    return found.select("o_orderkey", F.when(published.isNull(), "first_detection").otherwise("published").alias("basis"), F.datediff(F.to_date("available"), F.to_date(F.coalesce(published, "detected"))).cast("long").alias("days"))


@query("e17_query_duration", "events", """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS stage, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS us FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id))
SELECT user_id, day, stage, CAST(coalesce(sum(us), 0) AS BIGINT) // 1000 AS stage_ms, CAST(sum(coalesce(sum(us), 0)) OVER (PARTITION BY user_id, day) AS BIGINT) // 1000 AS query_ms FROM s GROUP BY 1, 2, 3""")
def e17(events):
    """A query is a user's day: its duration and that of each of its stages, which last until the next begins."""
    day = events.withColumn("day", F.to_date("ts"))
    us = lambda c: F.unix_micros(F.to_timestamp(c))
    steps = day.withColumn("us", us(F.lead("ts").over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))) - us("ts"))
    stages = steps.groupBy("user_id", "day", F.col("event_type").alias("stage")).agg(F.coalesce(F.sum("us"), F.lit(0)).alias("us"))
    total = F.sum("us").over(Window.partitionBy("user_id", "day"))
    return stages.select("user_id", "day", "stage", F.expr("us DIV 1000").alias("stage_ms"), F.call_function("div", total, F.lit(1000).cast("long")).alias("query_ms"))


@query("e36_reviewer_agreement", "labels documents", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1 - toxic) / count(*) AS agreement, count(*) FILTER (WHERE quality <> 1 - toxic) AS to_adjudicate FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def e36(labels, documents):
    """Two reviews of each item (good, and not toxic), compared."""
    first, second = labels.select("doc_id", F.col("quality").alias("a")), labels.select("doc_id", (1 - F.col("toxic")).alias("b"))
    both = first.join(second, "doc_id").join(documents.select("doc_id", "lang"), "doc_id")
    n, same = F.count(F.lit(1)), F.col("a") == F.col("b")
    return both.groupBy("lang").agg(n.alias("n"), (F.count_if(same) / n).alias("agreement"), F.count_if(~same).alias("to_adjudicate"))


@query("e37_compare_runs", "labels documents", "SELECT source AS corpus, count(*) AS cases, avg(quality) AS before, avg(1 - toxic) AS after, avg(1 - toxic) - avg(quality) AS delta FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def e37(labels, documents):
    """Two runs on the cases of the same corpus."""
    corpus = documents.select("doc_id", F.col("source").alias("corpus"))
    run = lambda score, name: labels.join(corpus, "doc_id").select("corpus", "doc_id", score.alias(name))
    both = run(F.col("quality"), "a").join(run(1 - F.col("toxic"), "b"), ["corpus", "doc_id"])
    return both.groupBy("corpus").agg(F.count(F.lit(1)).alias("cases"), F.avg("a").alias("before"), F.avg("b").alias("after"), (F.avg("b") - F.avg("a")).alias("delta"))


@query("e39_eta", "fx_jobs", """WITH h AS (SELECT queue, stage, CASE WHEN count(*) >= 5 THEN sum(completed) / count(*) END AS rate FROM fx_jobs WHERE state = 'succeeded' GROUP BY 1, 2)
SELECT job_id, CASE WHEN rate > 0 THEN CAST(ceil(round((total_units - completed) / rate, 9)) AS BIGINT) END AS rounds_left FROM fx_jobs LEFT JOIN h USING (queue, stage) WHERE state = 'running'""")
def e39(jobs):
    """What is left of a running job by the rate of its class; none while the sample is small or the total unknown."""
    n = F.count(F.lit(1))
    rate = jobs.filter("state = 'succeeded'").groupBy("queue", "stage").agg(F.when(n >= 5, F.sum("completed") / n).alias("rate"))
    left = F.ceil(F.round((F.col("total_units") - F.col("completed")) / F.col("rate"), 9))
    return jobs.filter("state = 'running'").join(rate, ["queue", "stage"], "left").select("job_id", F.when(F.col("rate") > 0, left).cast("long").alias("rounds_left"))


@query("e40_review_cases", "labels documents events", f"SELECT source, count(*) AS cases, count(*) FILTER (WHERE toxic = 1) AS urgent, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS reverted, {_duck_s('min(ts)', 'TIMESTAMP ' + chr(39) + NOW + chr(39))} AS oldest_s, {_duck_s('min(ts) FILTER (WHERE toxic = 1)', 'TIMESTAMP ' + chr(39) + NOW + chr(39))} AS oldest_urgent_s FROM labels JOIN documents USING (doc_id) LEFT JOIN events ON event_id = doc_id GROUP BY 1")
def e40(labels, documents, events):
    """Cases of each source with the age of the oldest; a case is opened by the event of its number."""
    opened = events.select(F.col("event_id").alias("doc_id"), "ts")
    cases = labels.join(documents.select("doc_id", "source"), "doc_id").join(opened, "doc_id", "left")
    urgent = F.col("toxic") == 1
    found = cases.groupBy("source").agg(F.count(F.lit(1)).alias("cases"), F.count_if(urgent).alias("urgent"), F.count_if((F.col("quality") == 0) & ~urgent).alias("reverted"), F.min("ts").alias("a"), F.min(F.when(urgent, F.col("ts"))).alias("u")).withColumn("now", _ntz(NOW))
    return found.select("source", "cases", "urgent", "reverted", _seconds("a", "now").alias("oldest_s"), _seconds("u", "now").alias("oldest_urgent_s"))


@query("e41_convert_currency", "fx_ledger events", """WITH r AS (SELECT CAST(ts AS DATE) AS day, CAST(3900 + max(event_id) % 100 AS DECIMAL(18,0)) AS rate FROM events GROUP BY 1), l AS (SELECT * FROM fx_ledger)
SELECT entry_id, CASE currency WHEN 'USD' THEN CAST(amount * rate AS DECIMAL(18,4)) ELSE CAST(amount AS DECIMAL(18,4)) END AS cop, CASE currency WHEN 'USD' THEN day END AS rate_day FROM l ASOF LEFT JOIN r ON l.seen_at >= CAST(r.day AS TIMESTAMP) + INTERVAL 1 DAY""")
def e41(ledger, events):
    """Dollars at the rate of the last day before; the day of the rate stands beside the amount."""
    rates = events.groupBy(F.to_date("ts").alias("rate_day")).agg((F.lit(3900) + F.max("event_id") % 100).cast("decimal(18,0)").alias("rate"))
    # A rate holds from the day after it to the next one: dealt to those days, it meets the ledger by day.
    until = F.coalesce(F.lead("rate_day").over(Window.orderBy("rate_day")), F.lit(NOW).cast("date"))
    held = rates.withColumn("until", until).withColumn("day", F.explode(F.sequence(F.date_add("rate_day", 1), "until"))).drop("until")
    found = ledger.withColumn("day", F.to_date("seen_at")).join(F.broadcast(held), "day", "left")
    dollars = F.col("currency") == "USD"
    return found.select("entry_id", F.when(dollars, (F.col("amount") * F.col("rate")).cast("decimal(18,4)")).otherwise(F.col("amount").cast("decimal(18,4)")).alias("cop"), F.when(dollars, F.col("rate_day")).alias("rate_day"))


@query("e43_overview", "events fx_jobs documents", """SELECT 'events' AS metric, count(*) AS value, 'cumulative' AS kind, '2024-01' AS time_window FROM events UNION ALL SELECT 'active_jobs', count(*) FILTER (WHERE state IN ('queued', 'scheduled', 'running', 'retry_wait')), 'current', 'now' FROM fx_jobs
UNION ALL SELECT 'documents', count(*), 'cumulative', 'all' FROM documents UNION ALL SELECT 'errors', count(*) FILTER (WHERE event_type = 'error'), 'cumulative', '2024-01' FROM events""")
def e43(events, jobs, documents):
    """One row for each card; what is now and what adds up are kept apart."""
    card = lambda df, name, value, kind, window: metric_row(df, name, value, "n", window).select("metric", "value", F.lit(kind).alias("kind"), "time_window")
    cards = [
        card(events, "events", F.count(F.lit(1)), "cumulative", "2024-01"),
        card(jobs, "active_jobs", F.count_if(F.col("state").isin("queued", "scheduled", "running", "retry_wait")), "current", "now"),
        card(documents, "documents", F.count(F.lit(1)), "cumulative", "all"),
        card(events, "errors", F.count_if(F.col("event_type") == "error"), "cumulative", "2024-01"),
    ]
    return cards[0].unionByName(cards[1]).unionByName(cards[2]).unionByName(cards[3])


@query("e48_citation_report", "conversations", f"SELECT conv_id, count(*) AS citations, count(*) FILTER (WHERE h.conv_id IS NULL) AS unresolved, count(DISTINCT c.turn) FILTER (WHERE h.conv_id IS NULL) AS claims_refused FROM ({CITED}) c LEFT JOIN {HELD} h ON h.conv_id = c.conv_id AND h.turn = c.evidence GROUP BY 1".replace("SELECT conv_id, count(*) AS citations", "SELECT c.conv_id, count(*) AS citations"))
def e48(conversations):
    cited = _claims(conversations).select("conv_id", "turn", F.explode("evidence_ids").alias("evidence"))
    found = cited.join(_retrieved(conversations).withColumn("there", F.lit(True)), ["conv_id", "evidence"], "left")
    return found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("citations"), F.count_if(F.col("there").isNull()).alias("unresolved"), F.countDistinct(F.when(F.col("there").isNull(), F.col("turn"))).alias("claims_refused"))


@query("e50_p95_rise", "events", """WITH q AS (SELECT user_id, quantile_cont(value, 0.95) FILTER (WHERE hour(ts) BETWEEN 8 AND 19) AS loaded, quantile_cont(value, 0.95) FILTER (WHERE hour(ts) NOT BETWEEN 8 AND 19) AS idle FROM events GROUP BY 1)
SELECT user_id, round(loaded, 6) AS loaded, round(idle, 6) AS idle, round((loaded - idle) / nullif(idle, 0), 6) AS rise FROM q""")
def e50(events):
    """p95 of each user in busy hours and in others, and its relative rise."""
    marked = events.withColumn("busy", F.hour("ts").between(8, 19))
    found = E.percentiles(marked, ["user_id", "busy"], "value", (0.95,))
    of = lambda busy: F.max(F.when(F.col("busy") == busy, F.col("p95")))
    found = found.groupBy("user_id").agg(of(True).alias("a"), of(False).alias("b"))
    return found.select("user_id", F.round("a", 6).alias("loaded"), F.round("b", 6).alias("idle"), F.round(F.try_divide(F.col("a") - F.col("b"), F.col("b")), 6).alias("rise"))


@query("e51_incident_times", "fx_alerts events", f"""WITH i AS (SELECT rule, resource_id, min(seen_at) AS a, max(seen_at) AS z, count(*) - 1 AS reopened FROM fx_alerts GROUP BY 1, 2)
SELECT rule, resource_id, {_duck_s('a', "min(ts) FILTER (WHERE event_type = 'view' AND ts > a)")} AS to_acknowledge_s, {_duck_s('a', "min(ts) FILTER (WHERE event_type = 'purchase' AND ts > z)")} AS to_resolve_s, any_value(reopened) AS reopened FROM i LEFT JOIN events ON user_id = resource_id GROUP BY rule, resource_id, a""")
def e51(alerts, events):
    """An incident begins with its first alert; the next view acknowledges it, the first purchase after its last alert resolves it."""
    times = alerts.groupBy("rule", "resource_id").agg(F.min("seen_at").alias("a"), F.max("seen_at").alias("z"), (F.count(F.lit(1)) - 1).alias("reopened"))
    acts = events.filter("event_type IN ('view', 'purchase')").select(F.col("user_id").alias("resource_id"), "event_type", "ts")
    first = lambda kind, after: F.min(F.when((F.col("event_type") == kind) & (F.col("ts") > F.col(after)), F.col("ts")))
    found = times.join(acts, "resource_id", "left").groupBy("rule", "resource_id", "a", "reopened").agg(first("view", "a").alias("k"), first("purchase", "z").alias("r"))
    return found.select("rule", "resource_id", _seconds("a", "k").alias("to_acknowledge_s"), _seconds("a", "r").alias("to_resolve_s"), "reopened")


LINES = "l_linenumber, l_partkey, l_extendedprice"


@query("f4_agenda_changes", "lineitem", f"SELECT l_orderkey, l_linenumber, l_partkey, previous, CASE WHEN l_returnflag = 'R' THEN 'cancelled' WHEN previous IS NULL THEN 'new' WHEN previous <> day THEN 'rescheduled' ELSE 'unchanged' END AS change FROM (SELECT *, CAST(l_shipdate AS DATE) AS day, lag(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_orderkey ORDER BY {LINES}) AS previous FROM lineitem)")
def f4(lineitem):
    """Each revision of an agenda beside the date it had before."""
    before = F.lag("day").over(Window.partitionBy("l_orderkey").orderBy(*LINES.split(", ")))
    revisions = lineitem.withColumn("day", F.to_date("l_shipdate")).withColumn("previous", before)
    change = F.when(F.col("l_returnflag") == "R", "cancelled").when(F.col("previous").isNull(), "new").when(F.col("previous") != F.col("day"), "rescheduled").otherwise("unchanged")
    return revisions.select("l_orderkey", "l_linenumber", "l_partkey", "previous", change.alias("change"))


RUNS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, {c} ORDER BY ts, event_id) AS g FROM events"


@query("f9_sustained", "events", f"SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS length FROM ({RUNS.format(c='value > 40')}) WHERE value > 40 GROUP BY user_id, g HAVING max(ts) - min(ts) >= INTERVAL 2 HOUR")
def f9(events):
    return W.sustained(events, "user_id", ["ts", "event_id"], F.col("value") > 40, 7200)


@query("f10_recovered", "events", "SELECT event_id FROM (SELECT event_id, value < 30 AND lag(value) OVER w < 30 AND lag(value, 2) OVER w >= 30 AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE back")
def f10(events):
    return W.recovered(events, "user_id", ["ts", "event_id"], F.col("value") < 30, 2).select("event_id")


def _admission_sql(keys: str, limit: int) -> str:
    """The fold row by row; ``keys`` name a budget."""
    same = " AND ".join(f"r.{k} = a.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seen_at, entry_id) AS i FROM (SELECT entry_id, provider, currency, seen_at, CAST(seen_at AS DATE) AS day, amount FROM fx_ledger)),
a AS (SELECT {keys}, i, entry_id, amount <= {limit} AS admitted, CAST(CASE WHEN amount <= {limit} THEN amount ELSE 0 END AS DECIMAL(38,6)) AS used FROM r WHERE i = 1
UNION ALL SELECT {", ".join("r." + k for k in keys.split(", "))}, r.i, r.entry_id, a.used + r.amount <= {limit}, CAST(a.used + CASE WHEN a.used + r.amount <= {limit} THEN r.amount ELSE 0 END AS DECIMAL(38,6)) FROM a JOIN r ON {same} AND r.i = a.i + 1)
SELECT entry_id, admitted FROM a"""


@query("f15_admission", "fx_ledger", _admission_sql("provider, currency", 2000))
def f15(ledger):
    """Reservations of a provider's whole budget, over all its days, in their order under a limit of 2000."""
    return P.admitted(ledger, ["provider", "currency"], ["seen_at", "entry_id"], "amount", 2000).select("entry_id", "admitted")


@query("j5_admission_fold", "fx_ledger", _admission_sql("provider, currency, day", 100))
def j5(ledger):
    """The fold for budgets of a day, which begin anew."""
    daily = ledger.withColumn("day", F.to_date("seen_at"))
    return P.ordered_fold(daily, ["provider", "currency", "day"], ["seen_at", "entry_id"], ["amount"], 0, lambda used, x: (used + x, (True,)) if used + x <= 100 else (used, (False,)), "admitted boolean").select("entry_id", "admitted")


@query("f17_concurrency", "fx_jobs", "WITH p AS (SELECT worker, enqueued_at AS moment, 1 AS step FROM fx_jobs UNION ALL SELECT worker, enqueued_at + INTERVAL 8 HOUR, -1 FROM fx_jobs), t AS (SELECT worker, moment, sum(step) AS step FROM p GROUP BY 1, 2) SELECT * FROM (SELECT worker, moment, CAST(sum(step) OVER (PARTITION BY worker ORDER BY moment) AS BIGINT) AS running FROM t) WHERE running > 2")
def f17(jobs):
    """More than two jobs of a worker at once; a job takes eight hours."""
    spans = jobs.select("worker", F.col("enqueued_at").alias("a"), (F.col("enqueued_at") + F.expr("INTERVAL '8' HOUR")).alias("b"))
    return W.concurrency(spans, "worker", "a", "b", 2).withColumnRenamed("at", "moment")


@query("f18_stalled", "fx_jobs", "SELECT worker, max(enqueued_at) AS last_beat, max(enqueued_at) FILTER (WHERE completed > 30) AS last_advance FROM fx_jobs GROUP BY 1 HAVING max(enqueued_at) >= TIMESTAMP '2024-01-29' AND coalesce(max(enqueued_at) FILTER (WHERE completed > 30) < max(enqueued_at) - INTERVAL 1 DAY, true)")
def f18(jobs):
    """The beat is fresh, the last durable advance a day or more before it."""
    last = jobs.groupBy("worker").agg(F.max("enqueued_at").alias("last_beat"), F.max(F.when(F.col("completed") > 30, F.col("enqueued_at"))).alias("last_advance"))
    behind = F.coalesce(F.col("last_advance") < F.col("last_beat") - F.expr("INTERVAL '1' DAY"), F.lit(True))
    return last.filter((F.col("last_beat") >= _ntz("2024-01-29")) & behind)


AGED = "SELECT worker, boot_id, (epoch_us((SELECT max(enqueued_at) + INTERVAL 1 MINUTE FROM fx_jobs)) - epoch_us(max(enqueued_at))) // 1000000 AS age, count(*) FILTER (WHERE state = 'running') AS assigned FROM fx_jobs"


def worker_signals(jobs: DataFrame, keys: list[str], now: Column, stale_s: int = 45, gone_s: int = 90) -> DataFrame:
    """(keys, age, assigned, signal): fresh, stale or disconnected by the last beat, and the work that runs."""
    last = jobs.groupBy(*keys).agg(F.max("enqueued_at").alias("last"), F.count_if(F.col("state") == "running").alias("assigned"))
    aged = last.withColumn("now", now).withColumn("age", _seconds("last", "now"))
    signal = F.when(F.col("age") <= stale_s, "fresh").when(F.col("age") <= gone_s, "stale").otherwise("disconnected")
    return aged.select(*keys, "age", "assigned", signal.alias("signal"))


def _minute_later(jobs: DataFrame) -> Column:
    """A minute after the last beat of the table."""
    return F.lit(jobs.agg((F.max("enqueued_at") + F.expr("INTERVAL '1' MINUTE")).alias("now")).first()[0]).cast("timestamp_ntz")


@query("f19_worker_signal", "fx_jobs", f"SELECT worker, boot_id, CASE WHEN age <= 45 THEN 'fresh' WHEN age <= 90 THEN 'stale' ELSE 'disconnected' END AS signal FROM ({AGED} GROUP BY 1, 2)")
def f19(jobs):
    """Signal of each boot of a worker a minute after the last beat of all."""
    return worker_signals(jobs, ["worker", "boot_id"], _minute_later(jobs)).select("worker", "boot_id", "signal")


@query("f24_alert_lifecycle", "events", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'error') AS bad FROM events GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - row_number() OVER (PARTITION BY user_id, bad ORDER BY day) AS g FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, bad, g ORDER BY day) AS k FROM i), q AS (SELECT *, lag(bad) OVER w AS was, lag(k) OVER w AS run FROM p WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, CASE WHEN bad AND k = 1 THEN 'pending' WHEN bad THEN 'firing' WHEN was AND run >= 2 THEN 'resolved' ELSE 'inactive' END AS state FROM q""")
def f24(events):
    """By evaluation day: pending on the first bad one, firing from the second, resolved on the first good one after that."""
    daily = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "error").alias("bad"))
    runs = W.islands(daily, "user_id", ["day"], F.col("bad"))
    runs = runs.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "island").orderBy("day")))
    w = Window.partitionBy("user_id").orderBy("day")
    state = F.when(F.col("bad") & (F.col("k") == 1), "pending").when(F.col("bad"), "firing").when(F.col("was") & (F.col("run") >= 2), "resolved").otherwise("inactive")
    return runs.withColumn("was", F.lag("bad").over(w)).withColumn("run", F.lag("k").over(w)).select("user_id", "day", state.alias("state"))


@query("f26_cancel_outcome", "fx_jobs", "WITH q AS (SELECT worker, min(enqueued_at) AS asked FROM fx_jobs WHERE state = 'running' GROUP BY 1), e AS (SELECT j.worker, state, row_number() OVER (PARTITION BY j.worker ORDER BY enqueued_at, job_id) AS r FROM fx_jobs j JOIN q ON j.worker = q.worker AND enqueued_at > asked WHERE state IN ('succeeded', 'failed', 'dead_letter', 'cancelled')) SELECT q.worker, coalesce(state, 'open') AS outcome FROM q LEFT JOIN e ON q.worker = e.worker AND r = 1")
def f26(jobs):
    """What ended first after the request (the first running job of a worker)."""
    asked = jobs.filter("state = 'running'").groupBy("worker").agg(F.min("enqueued_at").alias("asked"))
    ends = jobs.filter(F.col("state").isin("succeeded", "failed", "dead_letter", "cancelled")).join(asked, "worker").filter("enqueued_at > asked")
    first = ends.groupBy("worker").agg(F.min_by("state", F.struct("enqueued_at", "job_id")).alias("state"))
    return asked.join(first, "worker", "left").select("worker", F.coalesce("state", F.lit("open")).alias("outcome"))


@query("f27_withdrawn", "fx_checks", """WITH m AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY checked_at, check_id) - row_number() OVER (PARTITION BY source_id, ok ORDER BY checked_at, check_id) AS g FROM fx_checks)
SELECT source_id, min(checked_at) AS first_at, max(checked_at) AS last_at, count(*) AS length FROM m WHERE NOT ok GROUP BY source_id, g HAVING count(*) >= 3""")
def f27(checks):
    """Three absences in a row; fewer say nothing."""
    return W.consecutive(checks, "source_id", ["checked_at", "check_id"], ~F.col("ok"), 3)


@query("g5_idempotent_loads", "documents", "SELECT count(DISTINCT text) AS objects, 0 AS added, 0 AS removed FROM documents")
def g5(documents):
    """Three loads of the same captures give the same objects as one."""
    load = lambda df: df.groupBy(F.sha2("text", 256).alias("hash")).agg(F.lit(1).alias("there"))
    once, thrice = load(documents.select("text")), load(documents.select("text").union(documents.select("text")).union(documents.select("text")))
    both = once.withColumnRenamed("there", "a").join(thrice.withColumnRenamed("there", "b"), "hash", "full")
    return both.agg(F.count("a").alias("objects"), F.count_if(F.col("a").isNull()).cast("int").alias("added"), F.count_if(F.col("b").isNull()).cast("int").alias("removed"))


@query("g6_overwritten", "fx_revisions labels", "SELECT revision_id FROM fx_revisions WHERE revision_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def g6(revisions, labels):
    """Rows of the old version that the new one (without the text of toxic documents) no longer holds as they were."""
    toxic = labels.filter("toxic = 1").select(F.col("doc_id").alias("revision_id"), F.lit(True).alias("t"))
    old = revisions.select("revision_id", "hash")
    new = revisions.join(toxic, "revision_id", "left").select("revision_id", F.when(F.col("t").isNull(), F.col("hash")).otherwise("changed").alias("hash"))
    return D.new_or_changed(old, new, ["revision_id", "hash"]).select("revision_id")


@query("g7_xor_violations", "fx_projects", "SELECT project_id FROM (SELECT project_id, CASE WHEN project_id % 5 <> 0 THEN person_id END AS person, CASE WHEN project_id % 3 = 0 THEN corporation_id END AS organization FROM fx_projects) WHERE (person IS NULL) = (organization IS NULL)")
def g7(projects):
    """A participant is a person or an organization, not both and not neither."""
    rows = projects.select("project_id", F.when(F.col("project_id") % 5 != 0, F.col("person_id")).alias("person"), F.when(F.col("project_id") % 3 == 0, F.col("corporation_id")).alias("organization"))
    return rows.filter(F.col("person").isNull() == F.col("organization").isNull()).select("project_id")


@query("g8_manifest", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'new' WHEN o_orderkey % 11 = 0 THEN 'gone' WHEN o_orderstatus = 'P' THEN 'changed' ELSE 'same' END AS label FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 11 <> 0")
def g8(orders):
    """A frozen manifest (id, version) against what is selected now."""
    frozen = orders.filter("o_orderkey % 7 <> 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("v"))
    now = orders.filter("o_orderkey % 11 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    return D.reconcile(frozen, now, ["o_orderkey"], "v", ("gone", "new", "same", "changed")).select("o_orderkey", "label")


@query("g10_attention", "fx_alerts", "SELECT alert_id, severity, seen_at FROM fx_alerts ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, seen_at, alert_id LIMIT 20")
def g10(alerts):
    return alerts.orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), "seen_at", "alert_id").limit(20).select("alert_id", "severity", "seen_at")


@query("g13_purge_user", "conversations", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def g13(conversations):
    """Marked conversations go; the marks are applied again to what a restore brings back."""
    marks = conversations.filter("role = 'system'").select("conv_id").distinct()
    purge = lambda df: df.join(marks, "conv_id", "left_anti")
    restored = purge(conversations).select("conv_id", "turn", "role").union(conversations.select("conv_id", "turn", "role")).distinct()
    return purge(restored).select("conv_id", "turn")


@query("g14_audit_gaps", "events", """WITH c AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'), k AS (SELECT DISTINCT event_type, user_id, CAST(ts AS DATE) AS day FROM events)
SELECT event_id, gap FROM (SELECT event_id, 'reason' AS gap, user_id, day, 'view' AS needs FROM c UNION ALL SELECT event_id, 'effect', user_id, day, 'signup' FROM c) g WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.event_type = g.needs AND k.user_id = g.user_id AND k.day = g.day)""")
def g14(events):
    """Commands (purchases) without a reason (a view) or an effect (a signup) of their user on that day."""
    keyed = events.select("event_id", "event_type", "user_id", F.to_date("ts").alias("day"))
    commands = keyed.filter("event_type = 'purchase'")
    legs = [commands.join(keyed.filter(F.col("event_type") == kind).select("user_id", "day").distinct(), ["user_id", "day"], "left_anti").select("event_id", F.lit(gap).alias("gap")) for gap, kind in (("reason", "view"), ("effect", "signup"))]
    return legs[0].unionByName(legs[1])


@query("g15_idempotency", "events", "SELECT event_id, CASE WHEN r = 1 THEN 'first' WHEN event_type = f THEN 'replayed' ELSE 'conflict' END AS outcome FROM (SELECT event_id, event_type, first_value(event_type) OVER w AS f, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id))")
def g15(events):
    """The same key and body gets the first answer, another body conflicts."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    outcome = F.when(F.row_number().over(w) == 1, "first").when(F.col("event_type") == F.first("event_type").over(w), "replayed").otherwise("conflict")
    return events.select("event_id", outcome.alias("outcome"))


@query("g17_range_violations", "lineitem orders", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 0 OR l_extendedprice < 0 THEN 'negative' ELSE 'order' END AS violation FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 0 OR l_extendedprice < 0 OR l_shipdate < o_orderdate + INTERVAL 3 DAY")
def g17(lineitem, orders):
    """Amounts below zero, and shipments earlier than three days after their order."""
    rows = lineitem.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    negative = (F.col("l_quantity") < 0) | (F.col("l_extendedprice") < 0)
    early = F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL '3' DAY")
    return rows.filter(negative | early).select("l_orderkey", "l_linenumber", "l_partkey", F.when(negative, "negative").otherwise("order").alias("violation"))


def _alert(df: DataFrame, code: str, key: str, *columns) -> DataFrame:
    """Alert rows with a fingerprint of rule and key, without message or time."""
    return df.select(F.sha2(F.concat(F.lit(f"{code}:"), F.col(key).cast("string")), 256).alias("fingerprint"), key, *columns)


@query("l1_source_failing", "fx_runs", """WITH m AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY finished_at, run_id) - row_number() OVER (PARTITION BY source_id, status = 'failed' ORDER BY finished_at, run_id) AS g FROM fx_runs),
r AS (SELECT source_id, max(finished_at) AS last_at FROM m WHERE status = 'failed' GROUP BY source_id, g HAVING count(*) >= 2) SELECT sha256('l1:' || source_id) AS fingerprint, source_id, max(last_at) AS last_at, count(*) AS occurrences FROM r GROUP BY 2""")
def l1(runs):
    failed = W.consecutive(runs, "source_id", ["finished_at", "run_id"], F.col("status") == "failed", 2)
    return _alert(failed.groupBy("source_id").agg(F.max("last_at").alias("last_at"), F.count(F.lit(1)).alias("occurrences")), "l1", "source_id", "last_at", "occurrences")


@query("l3_quarantine", "events", "SELECT sha256('l3:' || batch) AS fingerprint, batch, n, rate FROM (SELECT CAST(floor(event_id / 100) AS BIGINT) AS batch, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') / count(*) AS rate FROM events GROUP BY 1) WHERE n >= 100 AND rate > 0.1")
def l3(events):
    """Batches of a hundred at least of which more than a tenth is in quarantine."""
    found = E.rate(events.withColumn("batch", F.floor(F.col("event_id") / 100)), ["batch"], F.col("event_type") == "error", F.lit(True), 100)
    return _alert(found.filter("n >= 100 AND rate > 0.1"), "l3", "batch", "n", "rate")


@query("l4_dead_letters", "fx_jobs", """WITH m AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY enqueued_at, job_id) - row_number() OVER (PARTITION BY worker, state IN ('dead_letter', 'failed') ORDER BY enqueued_at, job_id) AS g FROM fx_jobs),
r AS (SELECT worker FROM m WHERE state IN ('dead_letter', 'failed') GROUP BY worker, g HAVING max(enqueued_at) - min(enqueued_at) >= INTERVAL 30 MINUTE) SELECT sha256('l4:' || worker) AS fingerprint, worker, count(*) AS occurrences FROM r GROUP BY 2""")
def l4(jobs):
    """Dead letters that stay for half an hour without any other outcome between."""
    runs = W.sustained(jobs, "worker", ["enqueued_at", "job_id"], F.col("state").isin("dead_letter", "failed"), 1800)
    return _alert(runs.groupBy("worker").agg(F.count(F.lit(1)).alias("occurrences")), "l4", "worker", "occurrences")


@query("l5_worker_silent", "fx_jobs", f"SELECT sha256('l5:' || worker) AS fingerprint, worker, CASE WHEN age > 90 AND assigned > 0 THEN 'incident' ELSE 'warning' END AS severity FROM ({AGED.replace(', boot_id', '')} GROUP BY 1) WHERE age > 45")
def l5(jobs):
    """Silent for 45 s: warning; for 90 s with work assigned: incident."""
    silent = worker_signals(jobs, ["worker"], _minute_later(jobs)).filter("signal <> 'fresh'")
    gone = (F.col("signal") == "disconnected") & (F.col("assigned") > 0)
    return _alert(silent, "l5", "worker", F.when(gone, "incident").otherwise("warning").alias("severity"))


@query("l6_no_advance", "fx_jobs", "SELECT sha256('l6:' || job_id) AS fingerprint, job_id, stage FROM fx_jobs WHERE state = 'running' AND enqueued_at < TIMESTAMP '2024-01-31' - to_days(CASE stage WHEN 'view' THEN 5 WHEN 'click' THEN 10 ELSE 20 END)")
def l6(jobs):
    """Running jobs without an advance for longer than their stage may take."""
    days = F.when(F.col("stage") == "view", 5).when(F.col("stage") == "click", 10).otherwise(20)
    limit = _ntz(NOW) - F.make_dt_interval(days)
    return _alert(jobs.filter((F.col("state") == "running") & (F.col("enqueued_at") < limit)), "l6", "job_id", "stage")


@query("l7_backlog_age", "fx_jobs", """WITH d AS (SELECT worker, CAST(enqueued_at AS DATE) AS day, count(*) FILTER (WHERE state IN ('queued', 'scheduled')) AS waiting FROM fx_jobs GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY day) - row_number() OVER (PARTITION BY worker, waiting > 0 ORDER BY day) AS g FROM d)
SELECT sha256('l7:' || worker) AS fingerprint, worker, max(day) AS last_day, count(*) AS windows FROM m WHERE waiting > 0 GROUP BY worker, g HAVING count(*) >= 2""")
def l7(jobs):
    """A backlog over target in two windows in a row; it has recovered after as many good ones."""
    daily = jobs.groupBy("worker", F.to_date("enqueued_at").alias("day")).agg(F.count_if(F.col("state").isin("queued", "scheduled")).alias("waiting"))
    runs = W.consecutive(daily, "worker", ["day"], F.col("waiting") > 0, 2)
    return _alert(runs, "l7", "worker", F.col("last_at").alias("last_day"), F.col("length").alias("windows"))


@query("l8_index_behind", "documents labels", "SELECT sha256('l8:' || source) AS fingerprint, source, count(*) AS documents, count(*) FILTER (WHERE l.doc_id IS NULL) AS pending FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source HAVING count(*) FILTER (WHERE l.doc_id IS NULL) > 0.55 * count(*)")
def l8(documents, labels):
    done = labels.select("doc_id", F.lit(True).alias("done")).distinct()
    found = documents.select("doc_id", "source").join(done, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("done").isNull()).alias("pending"))
    return _alert(found.filter("pending > 0.55 * documents"), "l8", "source", "documents", "pending")


@query("l9_budget", "fx_ledger", "SELECT sha256('l9:' || provider) AS fingerprint, provider, exposed, CASE WHEN exposed >= 2000 THEN 'block' ELSE 'warning' END AS action FROM (SELECT provider, sum(amount) AS exposed FROM fx_ledger WHERE state = 'settled' GROUP BY 1) WHERE exposed >= 1600")
def l9(ledger):
    """Exposure of 80 % of a budget of 2,000 warns, of all of it blocks."""
    spent = ledger.filter("state = 'settled'").groupBy("provider").agg(F.sum("amount").alias("exposed"))
    return _alert(spent.filter("exposed >= 1600"), "l9", "provider", "exposed", F.when(F.col("exposed") >= 2000, "block").otherwise("warning").alias("action"))


@query("l11_isolation", "orders customer lineitem supplier", """SELECT sha256('l11:' || o_orderkey) AS fingerprint, o_orderkey, count(*) AS foreign_rows FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 2""")
def l11(orders, customer, lineitem, supplier):
    """Records that hold rows of another scope than their own."""
    scope = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    rows = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    odd = scope.join(rows, F.col("o_orderkey") == F.col("l_orderkey")).filter("c_nationkey <> s_nationkey")
    return _alert(odd.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("foreign_rows")), "l11", "o_orderkey", "foreign_rows")


QUERIES, ORACLE_SQL = query.QUERIES, query.ORACLE_SQL
