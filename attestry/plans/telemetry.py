"""Queries on events, jobs, runs, checks, ledgers and alerts (families E, F, L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.operators import metrics as E
from attestry.operators import windows as W
from attestry.plans.fixtures import Registry
from attestry.runtime import saved

query = Registry()
ENDED = "state IN ('succeeded', 'failed', 'dead_letter', 'cancelled')"


@query("e1_declared_count", "lineitem", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, 'lineitem' AS population FROM lineitem GROUP BY 1")
def e1(lineitem):
    return lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("n_orders")).withColumn("population", F.lit("lineitem"))


@query("e2_tally", "fx_vote_obs", "SELECT voting_id, count(*) FILTER (WHERE vote = 'yes') AS yes, count(*) FILTER (WHERE vote = 'no') AS no, count(*) FILTER (WHERE vote = 'abstain') AS abstain FROM fx_vote_obs GROUP BY 1")
def e2(votes):
    return votes.groupBy("voting_id").agg(*[F.count_if(F.col("vote") == v).alias(v) for v in ("yes", "no", "abstain")])


@query("e3_distinct_objects", "events", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def e3(events):
    return events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))


@query("e5_backlog", "fx_jobs", "SELECT queue, count(*) AS ready, min(enqueued_at) AS oldest FROM fx_jobs WHERE state IN ('queued', 'scheduled') AND enqueued_at <= TIMESTAMP '2024-01-31' GROUP BY 1")
def e5(jobs):
    ready = jobs.filter(F.col("state").isin("queued", "scheduled") & (F.col("enqueued_at") <= F.lit("2024-01-31").cast("timestamp_ntz")))
    return ready.groupBy("queue").agg(F.count(F.lit(1)).alias("ready"), F.min("enqueued_at").alias("oldest"))


@query("e6_queue_counts", "fx_jobs", "SELECT queue, count(*) FILTER (WHERE state = 'queued') AS queued, count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'retry_wait') AS retry_wait, count(*) FILTER (WHERE state = 'dead_letter') AS dead_letter FROM fx_jobs GROUP BY 1")
def e6(jobs):
    return jobs.groupBy("queue").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "running", "retry_wait", "dead_letter")])


@query("e7_throughput", "events", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(DISTINCT user_id) AS objects FROM events GROUP BY 1, 2")
def e7(events):
    return E.tumbling(events, "ts", "1 hour", ["event_type"], F.countDistinct("user_id").alias("objects"))


@query("e7_merged_distinct", "events", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(DISTINCT user_id) AS objects, true AS close FROM events GROUP BY 1, 2")
def e7_merged(events):
    """Weeks from stored sketches of quarter hours, beside the exact count; ``close`` if they differ by 5 % at most."""
    stored = saved(E.distinct_sketches(events, "ts", "15 minutes", ["event_type"], "user_id"))
    exact = E.tumbling(events, "ts", "7 days", ["event_type"], F.countDistinct("user_id").alias("objects"))
    found = exact.join(E.merged_distinct(stored, "7 days", ["event_type"]), ["bucket", "event_type"])
    return found.select("bucket", "event_type", "objects", (F.abs(F.col("estimate") - F.col("objects")) <= 0.05 * F.col("objects")).alias("close"))


@query("e8_attempt_failure", "fx_jobs", "SELECT queue, count(*) FILTER (WHERE state IN ('succeeded', 'failed', 'dead_letter')) AS n, count(*) FILTER (WHERE state IN ('failed', 'dead_letter')) / nullif(count(*) FILTER (WHERE state IN ('succeeded', 'failed', 'dead_letter')), 0) AS rate FROM fx_jobs GROUP BY 1")
def e8(jobs):
    return E.rate(jobs, ["queue"], F.col("state").isin("failed", "dead_letter"), F.col("state").isin("succeeded", "failed", "dead_letter"))


@query("e9_run_success", "fx_runs", "SELECT source_id, count(*) FILTER (WHERE status IN ('succeeded', 'failed', 'partial')) AS n, count(*) FILTER (WHERE status = 'succeeded') / nullif(count(*) FILTER (WHERE status IN ('succeeded', 'failed', 'partial')), 0) AS rate FROM fx_runs GROUP BY 1")
def e9(runs):
    return E.rate(runs, ["source_id"], F.col("status") == "succeeded", F.col("status").isin("succeeded", "failed", "partial"))


@query("e10_dedupe_ratio", "documents", "SELECT source, count(*) AS captures, 1 - count(DISTINCT text) / count(*) AS ratio FROM documents GROUP BY 1")
def e10(docs):
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("captures"), (1 - F.countDistinct(F.sha2("text", 256)) / F.count(F.lit(1))).alias("ratio"))


@query("e11_quarantine_rate", "events", "SELECT user_id % 30 AS batch, count(DISTINCT event_id) AS n, CASE WHEN count(DISTINCT event_id) >= 100 THEN count(*) FILTER (WHERE event_type = 'error') / count(DISTINCT event_id) END AS rate FROM events GROUP BY 1")
def e11(events):
    return E.rate(events.dropDuplicates(["event_id"]).withColumn("batch", F.col("user_id") % 30), ["batch"], F.col("event_type") == "error", F.lit(True), 100)


@query("e12_source_status", "fx_checks", "SELECT source_id, max(checked_at) AS last_attempt, max(checked_at) FILTER (WHERE ok) AS last_success, count(*) FILTER (WHERE NOT ok) AS failures, CAST(floor(epoch(TIMESTAMP '2024-01-31' - max(checked_at) FILTER (WHERE ok))) AS BIGINT) AS age_s FROM fx_checks GROUP BY 1")
def e12(checks):
    return E.source_status(checks, "2024-01-31 00:00:00")


@query("e15_coverage", "fx_sources lineitem", "SELECT source_id, expected_count, coalesce(n, 0) AS observed, CASE WHEN expected_count > 0 THEN coalesce(n, 0) / expected_count END AS coverage FROM fx_sources LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON source_id = l_suppkey")
def e15(sources, lineitem):
    """Observed rows of each source against the expected count, where that is known."""
    seen = lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    found = sources.join(seen, F.col("source_id") == F.col("l_suppkey"), "left").select("source_id", "expected_count", F.coalesce("n", F.lit(0)).alias("observed"))
    return found.withColumn("coverage", F.when(F.col("expected_count") > 0, F.col("observed") / F.col("expected_count")))


@query("e18_delivery_confirmed", "fx_deliveries", "SELECT answer_id, count(*) AS segments, bool_and(state = 'confirmed') AS confirmed FROM fx_deliveries GROUP BY 1")
def e18(deliveries):
    return deliveries.groupBy("answer_id").agg(F.count(F.lit(1)).alias("segments"), F.bool_and(F.col("state") == "confirmed").alias("confirmed"))


@query("e20_exposed_cost", "fx_ledger", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY reservation_id ORDER BY CASE state WHEN 'settled' THEN 2 WHEN 'estimated' THEN 1 ELSE 0 END DESC, entry_id DESC) AS r FROM fx_ledger) SELECT currency, sum(amount) AS exposed, count(*) AS reservations FROM l WHERE r = 1 GROUP BY 1")
def e20(ledger):
    return E.exposed_cost(ledger)


@query("e21_cost_rollup", "fx_ledger", "SELECT currency, provider, state, sum(amount) AS amount, count(*) AS n FROM fx_ledger GROUP BY GROUPING SETS ((currency, provider, state), (currency, provider), (currency))")
def e21(ledger):
    rolled = ledger.withColumn("c", F.col("currency")).rollup("currency", "provider", "state").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    return rolled.filter("currency IS NOT NULL")


@query("e22_latency", "events", "SELECT event_type, count(value) AS sample_count, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1")
def e22(events):
    return E.percentiles(events, ["event_type"], "value")


@query("e23_merged_quantiles", "events")
def e23(events):
    daily = E.quantile_sketches(events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value")
    return E.merged_quantiles(daily, ["event_type"])


@query("e24_histogram", "events", "SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def e24(events):
    return events.groupBy("event_type", F.floor(F.col("value") / 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("e25_metric_rollup", "events", """SELECT s.size, time_bucket(s.i, ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,6))) AS total
FROM events, (VALUES ('15 minutes', INTERVAL 15 MINUTE), ('1 hour', INTERVAL 1 HOUR), ('24 hours', INTERVAL 24 HOUR), ('7 days', INTERVAL 168 HOUR)) s(size, i) GROUP BY 1, 2, 3""")
def e25(events):
    """The small buckets are summed to the larger ones: the events are read and shuffled once."""
    small = E.tumbling(events, "ts", "15 minutes", ["event_type"], F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))
    sizes = {"15 minutes": 900, "1 hour": 3600, "24 hours": 86400, "7 days": 604800}
    second = F.datediff(F.to_date("bucket"), F.lit("1970-01-01").cast("date")) * 86400 + F.hour("bucket") * 3600 + F.minute("bucket") * 60
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("size"), (F.floor(second / s) * s).alias("at")) for k, s in sizes.items()]))
    found = small.select("event_type", "n", F.col("total").alias("t"), each.alias("z")).groupBy("z.size", "z.at", "event_type").agg(F.sum("n").alias("n"), F.sum("t").cast("decimal(38,6)").alias("total"))
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return found.select("size", (epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("at").cast("decimal(18,6)"))).alias("bucket"), "event_type", "n", "total")


@query("e26_metric_cube", "documents", "SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY CUBE (lang, source)")
def e26(docs):
    return docs.cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("e28_conflicts", "fx_observations", "SELECT subject_id, count(DISTINCT value) AS n_values, array_to_string(list_sort(list(DISTINCT value)), ',') AS vals FROM fx_observations GROUP BY 1 HAVING count(DISTINCT value) > 1")
def e28(obs):
    return obs.groupBy("subject_id").agg(F.countDistinct("value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("value")), ",").alias("vals")).filter("n_values > 1")


@query("e29_alert_groups", "fx_alerts", "SELECT sha256(rule || '|' || resource_id || '|' || severity) AS fingerprint, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS occurrences FROM fx_alerts GROUP BY 1")
def e29(alerts):
    return E.alert_groups(alerts)


@query("d16_apply_silences", "fx_alerts events", "WITH s AS (SELECT user_id % 5 AS rule, ts AS starts, ts + INTERVAL 10 MINUTE AS ends FROM events WHERE event_type = 'signup') SELECT alert_id, EXISTS (SELECT 1 FROM s WHERE s.rule = a.rule AND a.seen_at >= starts AND a.seen_at < ends) AS silenced FROM fx_alerts a")
def d16(alerts, events):
    silences = events.filter("event_type = 'signup'").select((F.col("user_id") % 5).alias("rule"), F.col("ts").alias("starts"), (F.col("ts") + F.expr("INTERVAL '10' MINUTE")).alias("ends"))
    return E.apply_silences(alerts, silences).select("alert_id", "silenced")


@query("e30_slo", "events", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value <= 50) / count(*) AS rate FROM events GROUP BY 1")
def e30(events):
    return E.rate(events, ["event_type"], F.col("value") <= 50, F.lit(True))


@query("e32_flow_state", "fx_jobs", f"SELECT worker, CASE WHEN NOT bool_and({ENDED}) THEN 'open' WHEN bool_and(state = 'succeeded') THEN 'succeeded' WHEN bool_or(state = 'succeeded') THEN 'partial' ELSE 'failed' END AS flow_state FROM fx_jobs GROUP BY 1")
def e32(jobs):
    return E.flow_state(jobs, "worker")


@query("e33_progress", "fx_jobs", "SELECT stage, sum(completed) AS completed, sum(total_units) AS total, sum(completed) / sum(total_units) AS share FROM fx_jobs WHERE total_units IS NOT NULL GROUP BY 1")
def e33(jobs):
    known = jobs.filter("total_units IS NOT NULL").groupBy("stage").agg(F.sum("completed").alias("completed"), F.sum("total_units").alias("total"))
    return known.withColumn("share", F.col("completed") / F.col("total"))


@query("e34_route_mix", "conversations", r"""WITH r AS (SELECT CASE WHEN text LIKE '%?' THEN 'clarification' WHEN length(text) < 60 THEN 'abstention' WHEN regexp_matches(text, '[0-9]') AND text LIKE '%' || chr(10) || '%' THEN 'hybrid' WHEN regexp_matches(text, '[0-9]') THEN 'sql' ELSE 'document' END AS route FROM conversations WHERE role = 'assistant')
SELECT route, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM r GROUP BY 1""")
def e34(conversations):
    """How answers came about: a question back, too short to be one, with numbers, with text, with both. None of these is an error."""
    text, number = F.col("text"), F.col("text").rlike("[0-9]")
    route = F.when(text.endswith("?"), "clarification").when(F.length(text) < 60, "abstention").when(number & text.contains("\n"), "hybrid").when(number, "sql").otherwise("document")
    counts = conversations.filter("role = 'assistant'").groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("e35_evaluate", "labels documents", "SELECT source AS corpus, doc_id % 2 AS version, count(*) AS n, avg(quality) AS exact, count(*) FILTER (WHERE quality = 0 AND toxic = 0) / count(*) AS abstained, avg(1 - toxic) AS supported FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def e35(labels, docs):
    """Scores by corpus and version: exact matches, abstentions, supported answers."""
    n = F.count(F.lit(1))
    cases = labels.join(docs.select("doc_id", F.col("source").alias("corpus")), "doc_id").withColumn("version", F.col("doc_id") % 2)
    return cases.groupBy("corpus", "version").agg(n.alias("n"), F.avg("quality").alias("exact"), (F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)) / n).alias("abstained"), F.avg(1 - F.col("toxic")).alias("supported"))


@query("e38_bound_dims", "events", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT user_id FROM c ORDER BY n DESC, user_id LIMIT 10) SELECT CASE WHEN t.user_id IS NULL THEN 'other' ELSE CAST(c.user_id AS VARCHAR) END AS label, CAST(sum(n) AS BIGINT) AS n FROM c LEFT JOIN t ON c.user_id = t.user_id GROUP BY 1")
def e38(events):
    return E.bound_dims(events, "user_id", 10)


@query("f3_changes", "fx_checks", "SELECT check_id, previous FROM (SELECT *, lag(content_hash) OVER (PARTITION BY source_id ORDER BY checked_at, check_id) AS previous FROM fx_checks) WHERE previous IS NULL OR previous <> content_hash")
def f3(checks):
    return W.changes(checks, "source_id", "content_hash", ["checked_at", "check_id"]).select("check_id", "previous")


@query("f5_latest_state", "fx_ops_events", "SELECT resource_id, event_type, resource_version FROM fx_ops_events QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY resource_version DESC) = 1")
def f5(events):
    return W.latest_state(events, "resource_id", "resource_version").select("resource_id", "event_type", "resource_version")


@query("f6_monotonic", "fx_ops_events", "SELECT event_id FROM fx_ops_events QUALIFY coalesce(resource_version > max(resource_version) OVER (PARTITION BY resource_id ORDER BY occurred_at + to_seconds(delay_s), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)")
def f6(events):
    received = events.withColumn("received_us", F.unix_micros(F.to_timestamp("occurred_at")) + F.col("delay_s") * 1_000_000)
    return W.monotonic(received, "resource_id", "resource_version", ["received_us", "event_id"]).select("event_id")


@query("f7_version_gaps", "fx_ops_events", "SELECT event_id, previous_version FROM (SELECT *, lag(resource_version) OVER (PARTITION BY resource_id ORDER BY resource_version) AS previous_version FROM fx_ops_events WHERE event_id % 10 <> 0) WHERE resource_version - previous_version > 1")
def f7(events):
    return W.version_gaps(events.filter("event_id % 10 <> 0"), "resource_id", "resource_version").select("event_id", "previous_version")


@query("f8_consecutive_failures", "fx_runs", """WITH m AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY finished_at, run_id) - row_number() OVER (PARTITION BY source_id, status = 'failed' ORDER BY finished_at, run_id) AS g FROM fx_runs)
SELECT source_id, min(finished_at) AS first_at, max(finished_at) AS last_at, count(*) AS length FROM m WHERE status = 'failed' GROUP BY source_id, g HAVING count(*) >= 2""")
def f8(runs):
    return W.consecutive(runs, "source_id", ["finished_at", "run_id"], F.col("status") == "failed", 2)


@query("f13_stage_durations", "events", "SELECT event_id, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts) AS seconds FROM events")
def f13(events):
    return W.stage_durations(events, "user_id", "ts", "event_id").select("event_id", "seconds")


@query("f14_running_exposure", "fx_ledger", "SELECT entry_id, running, CASE WHEN running >= 20000 THEN 'over' WHEN running >= 16000 THEN 'warning' ELSE 'ok' END AS level FROM (SELECT entry_id, sum(amount) OVER (PARTITION BY provider, currency ORDER BY seen_at, entry_id ROWS UNBOUNDED PRECEDING) AS running FROM fx_ledger)")
def f14(ledger):
    """Running exposure against a budget of 20,000, with its crossings of 80 and 100 %."""
    found = W.running_total(ledger, ["provider", "currency"], ["seen_at", "entry_id"], "amount").select("entry_id", "running")
    return found.withColumn("level", F.when(F.col("running") >= 20000, "over").when(F.col("running") >= 16000, "warning").otherwise("ok"))


@query("f16_rate_violations", "events", "SELECT event_id, in_window FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_window FROM events) WHERE in_window > 1")
def f16(events):
    return W.rate_violations(events, "user_id", "ts", 1, 3600).select("event_id", "in_window")


@query("f20_backoff", "fx_jobs", "SELECT job_id, attempt, attempt >= 5 AS dead_letter, wait_s, enqueued_at + to_seconds(wait_s) AS next_at FROM (SELECT *, CASE WHEN attempt < 5 THEN CASE WHEN job_id % 3 = 0 THEN 17 + job_id % 5000 ELSE CAST(least(30 * pow(2, attempt - 1), 3600) AS BIGINT) END END AS wait_s FROM (SELECT job_id, enqueued_at, row_number() OVER (PARTITION BY worker ORDER BY enqueued_at, job_id) AS attempt FROM fx_jobs WHERE state = 'retry_wait'))")
def f20(jobs):
    """When each waiting job may be tried next; every third server named its own time."""
    waiting = jobs.filter("state = 'retry_wait'").withColumn("retry_after", F.when(F.col("job_id") % 3 == 0, 17 + F.col("job_id") % 5000))
    found = W.backoff(waiting, "worker", ["enqueued_at", "job_id"], "retry_after")
    next_at = F.col("enqueued_at") + F.make_dt_interval(secs=F.col("wait_s").cast("decimal(18,6)"))
    return found.select("job_id", "attempt", "dead_letter", "wait_s", next_at.alias("next_at"))


@query("f22_volume_anomaly", "events", """WITH g AS (SELECT DISTINCT user_id FROM events), c AS (SELECT CAST(unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS DATE) AS day FROM events),
d AS (SELECT g.user_id, c.day, count(e.event_id) AS n FROM g CROSS JOIN c LEFT JOIN events e ON e.user_id = g.user_id AND CAST(e.ts AS DATE) = c.day GROUP BY 1, 2)
SELECT user_id, day, n FROM (SELECT *, avg(n) OVER w AS m, stddev_samp(n) OVER w AS s FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) WHERE round(abs(n - m), 9) > round(1.5 * s, 9)""")
def f22(events):
    """Every day of every source is in the grid, so that a day without events counts 0."""
    day = F.to_date("ts")
    days = events.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    counts = events.groupBy("user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    grid = events.select("user_id").distinct().crossJoin(F.broadcast(days)).join(counts, ["user_id", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return W.moving_anomaly(grid, "user_id", "day", "n", 7, 1.5).select("user_id", "day", "n")


@query("f25_illegal_transitions", "fx_jobs", "SELECT job_id, previous, state FROM (SELECT *, lag(state) OVER (PARTITION BY worker ORDER BY enqueued_at, job_id) AS previous FROM fx_jobs) WHERE previous IS NOT NULL AND previous || '>' || state NOT IN ('queued>running', 'running>succeeded', 'running>failed', 'failed>retry_wait', 'retry_wait>running')")
def f25(jobs):
    allowed = {("queued", "running"), ("running", "succeeded"), ("running", "failed"), ("failed", "retry_wait"), ("retry_wait", "running")}
    return W.illegal_transitions(jobs, "worker", "state", ["enqueued_at", "job_id"], allowed).select("job_id", "previous", "state")


@query("f28_version_conflicts", "events", "SELECT event_id, attempt FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS attempt FROM events) WHERE attempt > 1")
def f28(events):
    return W.version_conflicts(events.withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"], ["ts", "event_id"]).select("event_id", "attempt")


QUERIES, ORACLE_SQL = query.QUERIES, query.ORACLE_SQL
