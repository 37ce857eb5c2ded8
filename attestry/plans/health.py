"""Queries on the health of jobs, workers, sources and evidence (families C, D, E)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.operators import metrics as E
from attestry.plans.fixtures import Registry

query = Registry()
ACTIVE = ("queued", "scheduled", "running", "retry_wait")
LIVE_STATES = "('queued', 'scheduled', 'running', 'retry_wait')"


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


@query("c9_active_jobs", "fx_jobs", f"SELECT job_id, queue, state FROM fx_jobs WHERE state IN {LIVE_STATES}")
def c9(jobs):
    """The active set has no date range: an old job that still runs is active."""
    return jobs.filter(F.col("state").isin(*ACTIVE)).select("job_id", "queue", "state")


@query("c12_citable", "documents labels", "SELECT doc_id, source FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def c12(documents, labels):
    accepted = labels.filter("quality = 1").select("doc_id")
    return documents.filter(F.col("text").isNotNull()).join(accepted, "doc_id", "left_semi").select("doc_id", "source")


@query("c13_exact_only", "fx_vote_obs", "SELECT voting_id, person_id, min(vote) AS vote FROM fx_vote_obs GROUP BY 1, 2 HAVING count(DISTINCT vote) = 1")
def c13(votes):
    """Least and greatest value tell a conflict with map-side partials, without a distinct count."""
    ends = votes.groupBy("voting_id", "person_id").agg(F.min("vote").alias("vote"), F.max("vote").alias("__most"))
    return ends.filter(F.col("vote") == F.col("__most")).drop("__most")


@query("c17_retryable", "fx_jobs", """SELECT job_id, state IN ('failed', 'dead_letter') AND enqueued_at <= TIMESTAMP '2024-01-20' AS retryable,
concat_ws(',', CASE WHEN state NOT IN ('failed', 'dead_letter') THEN 'not failed' END, CASE WHEN enqueued_at > TIMESTAMP '2024-01-20' THEN 'too early' END) AS reasons FROM fx_jobs""")
def c17(jobs):
    """A job may be retried if nothing speaks against it; the reasons are listed."""
    against = [F.when(~F.col("state").isin("failed", "dead_letter"), "not failed"), F.when(F.col("enqueued_at") > _at("2024-01-20"), "too early")]
    return jobs.select("job_id", F.concat_ws(",", *against).alias("reasons")).withColumn("retryable", F.col("reasons") == "")


@query("d30_in_period", "fx_projects", """SELECT project_id, filed_on, y AS legislature, y - (y - 2) % 4 AS term FROM (
SELECT project_id, filed_on, CAST(extract(year FROM filed_on) - CASE WHEN extract(month FROM filed_on) * 100 + extract(day FROM filed_on) < 720 THEN 1 ELSE 0 END AS BIGINT) AS y FROM fx_projects)""")
def d30(projects):
    """A legislature begins on 20 July, a term every fourth year; both follow from the date without a join."""
    early = F.month("filed_on") * 100 + F.dayofmonth("filed_on") < 720
    begun = projects.select("project_id", "filed_on", (F.year("filed_on") - F.when(early, 1).otherwise(0)).cast("long").alias("legislature"))
    return begun.withColumn("term", F.col("legislature") - (F.col("legislature") - 2) % 4)


@query("d32_reconcile_cost", "fx_ledger", """WITH e AS (SELECT reservation_id, currency, sum(amount) AS estimated FROM fx_ledger WHERE state = 'estimated' GROUP BY 1, 2),
s AS (SELECT reservation_id, currency, sum(amount) AS settled FROM fx_ledger WHERE state = 'settled' GROUP BY 1, 2)
SELECT reservation_id, currency, estimated, settled, settled - estimated AS difference FROM e FULL JOIN s USING (reservation_id, currency)""")
def d32(ledger):
    """Both states of a reservation in one aggregation: one shuffle instead of a full join's two."""
    of = lambda state: F.sum(F.when(F.col("state") == state, F.col("amount")))
    both = ledger.filter(F.col("state").isin("estimated", "settled")).groupBy("reservation_id", "currency")
    return both.agg(of("estimated").alias("estimated"), of("settled").alias("settled")).withColumn("difference", F.col("settled") - F.col("estimated"))


@query("e4_jobs_active", "fx_jobs", f"SELECT queue, count(*) FILTER (WHERE enqueued_at >= TIMESTAMP '2024-01-15') AS active, count(*) FILTER (WHERE enqueued_at < TIMESTAMP '2024-01-15') AS stale FROM fx_jobs WHERE state IN {LIVE_STATES} GROUP BY 1")
def e4(jobs):
    seen = F.col("enqueued_at") >= _at("2024-01-15")
    return jobs.filter(F.col("state").isin(*ACTIVE)).groupBy("queue").agg(F.count_if(seen).alias("active"), F.count_if(~seen).alias("stale"))


@query("e16_index_backlog", "documents labels", """SELECT lang AS namespace, count(*) AS documents, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS pending FROM documents d
WHERE text IS NOT NULL AND source IN (SELECT source FROM documents GROUP BY source HAVING count(*) % 3 <> 0) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) GROUP BY 1""")
def e16(documents, labels):
    """Waiting documents of each namespace, without withdrawn ones and those of sources that are not permitted."""
    permitted = documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n % 3 <> 0").select("source")
    state = labels.groupBy(F.col("doc_id").alias("__done")).agg(F.max("toxic").alias("toxic"))
    scope = documents.filter(F.col("text").isNotNull()).select("doc_id", "lang", "source").join(permitted, "source", "left_semi")
    found = scope.join(state, F.col("doc_id") == F.col("__done"), "left").filter("coalesce(toxic, 0) <> 1")
    return found.groupBy(F.col("lang").alias("namespace")).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("__done").isNull()).alias("pending"))


@query("e19_telemetry_latency", "fx_ops_events", "SELECT event_type, count(delay_s) AS sample_count, quantile_cont(delay_s, 0.5) AS p50, quantile_cont(delay_s, 0.95) AS p95, quantile_cont(delay_s, 0.99) AS p99 FROM fx_ops_events GROUP BY 1")
def e19(events):
    return E.percentiles(events, ["event_type"], "delay_s")


@query("e27_pipeline_counters", "fx_runs", "SELECT source_id, count(*) AS detected, count(*) FILTER (WHERE status = 'succeeded') AS published, count(*) FILTER (WHERE status = 'partial') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed FROM fx_runs GROUP BY 1")
def e27(runs):
    states = {"published": "succeeded", "pending": "partial", "failed": "failed"}
    return runs.groupBy("source_id").agg(F.count(F.lit(1)).alias("detected"), *[F.count_if(F.col("status") == s).alias(n) for n, s in states.items()])


@query("e31_monthly_availability", "fx_checks", """WITH m AS (SELECT source_id, CAST(date_trunc('month', checked_at) AS DATE) AS month, date_trunc('minute', checked_at) AS minute, bool_and(ok) AS up FROM fx_checks GROUP BY 1, 2, 3)
SELECT month, source_id, count(*) AS minutes, count(*) FILTER (WHERE up) / count(*) AS availability FROM m GROUP BY GROUPING SETS ((month), (month, source_id))""")
def e31(checks):
    """A minute of a source is up if all its checks passed; the total of a month has no source."""
    minutes = checks.groupBy("source_id", F.date_trunc("minute", "checked_at").alias("minute"), F.trunc(F.col("checked_at").cast("date"), "month").alias("month")).agg(F.bool_and("ok").alias("up"))
    sets = minutes.groupingSets([["month"], ["month", "source_id"]], "month", "source_id")
    return sets.agg(F.count(F.lit(1)).alias("minutes"), (F.count_if("up") / F.count(F.lit(1))).alias("availability"))


@query("e42_source_health", "fx_checks", """SELECT source_id, last_success, n, error_rate, CASE WHEN last_success IS NULL THEN 'never' WHEN last_success < TIMESTAMP '2024-01-20' THEN 'late' WHEN error_rate > 0.25 THEN 'degraded' ELSE 'healthy' END AS state
FROM (SELECT source_id, max(checked_at) FILTER (WHERE ok) AS last_success, count(*) AS n, count(*) FILTER (WHERE NOT ok) / count(*) AS error_rate FROM fx_checks GROUP BY 1)""")
def e42(checks):
    seen = checks.groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.col("checked_at"))).alias("last_success"), F.count(F.lit(1)).alias("n"), (F.count_if(~F.col("ok")) / F.count(F.lit(1))).alias("error_rate"))
    state = F.when(F.col("last_success").isNull(), "never").when(F.col("last_success") < _at("2024-01-20"), "late").when(F.col("error_rate") > 0.25, "degraded").otherwise("healthy")
    return seen.withColumn("state", state)


@query("e45_command_result", "fx_jobs", "SELECT worker, CASE WHEN bool_and(state = 'succeeded') THEN 'all' WHEN bool_or(state = 'succeeded') THEN 'part' ELSE 'none' END AS outcome FROM fx_jobs GROUP BY 1")
def e45(jobs):
    done = F.col("state") == "succeeded"
    return jobs.groupBy("worker").agg(F.when(F.bool_and(done), "all").when(F.bool_or(done), "part").otherwise("none").alias("outcome"))


@query("e46_updates_since", "fx_ops_events", "SELECT resource_id, count(*) FILTER (WHERE resource_version > 3) AS updates, max(resource_version) AS cursor FROM fx_ops_events GROUP BY 1")
def e46(events):
    return events.groupBy("resource_id").agg(F.count_if(F.col("resource_version") > 3).alias("updates"), F.max("resource_version").alias("cursor"))


@query("e49_vote_coverage", "orders fx_vote_obs", "SELECT o_orderpriority AS kind, count(*) AS votings, count(*) FILTER (WHERE o_orderkey IN (SELECT voting_id FROM fx_vote_obs)) / count(*) AS nominal, count(*) FILTER (WHERE o_totalprice > 0) / count(*) AS totals FROM orders GROUP BY 1")
def e49(orders, votes):
    """Nominal votes are counted once for each voting before the join."""
    nominal = votes.select(F.col("voting_id").alias("__voting")).distinct()
    found = orders.select("o_orderkey", "o_orderpriority", "o_totalprice").join(nominal, F.col("o_orderkey") == F.col("__voting"), "left")
    n = F.count(F.lit(1))
    return found.groupBy(F.col("o_orderpriority").alias("kind")).agg(n.alias("votings"), (F.count_if(F.col("__voting").isNotNull()) / n).alias("nominal"), (F.count_if(F.col("o_totalprice") > 0) / n).alias("totals"))


@query("e52_worker_inventory", "fx_jobs", "SELECT worker, count(DISTINCT boot_id) AS boots, count(*) FILTER (WHERE state = 'running') AS running, max(enqueued_at) AS last_signal FROM fx_jobs GROUP BY 1")
def e52(jobs):
    return jobs.groupBy("worker").agg(F.countDistinct("boot_id").alias("boots"), F.count_if(F.col("state") == "running").alias("running"), F.max("enqueued_at").alias("last_signal"))


QUERIES, ORACLE_SQL = query.QUERIES, query.ORACLE_SQL
