"""Domain views over the test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from attestry.sources.tables import read_table

VIEWS = {
    "fx_sources": "SELECT s_suppkey AS source_id, s_name AS code, s_nationkey AS scope_id, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS allowed, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 50 END AS expected_count, abs(s_acctbal) AS budget FROM supplier",
    "fx_projects": "SELECT o_orderkey AS project_id, o_custkey AS person_id, o_orderstatus AS status_raw, CAST(o_orderdate AS DATE) AS filed_on, CAST(o_orderkey % 300 AS STRING) AS number, CAST(extract(year FROM o_orderdate) AS BIGINT) AS filing_year, o_custkey % 2 AS corporation_id, o_orderpriority AS initiative_type, CASE o_orderkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' ELSE 'unknown' END AS date_precision FROM orders",
    "fx_observations": "SELECT l_orderkey AS subject_id, l_suppkey AS source_id, CASE WHEN l_suppkey % 2 = 0 THEN 'primary' ELSE 'secondary' END AS authority, l_linestatus AS stage, l_returnflag AS value, CAST(l_shipdate AS DATE) AS effective_date, l_partkey AS partkey, l_linenumber AS line, l_extendedprice AS price FROM lineitem",
    "fx_vote_obs": "SELECT l_orderkey AS voting_id, l_suppkey AS person_id, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' WHEN 'R' THEN 'abstain' ELSE 'other' END AS vote, l_shipdate AS observed_at, l_partkey AS partkey, l_linenumber AS line, l_extendedprice AS price FROM lineitem",
    "fx_memberships": "SELECT o_custkey AS person_id, o_orderpriority AS party, CAST(o_orderdate AS DATE) AS valid_from, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS valid_to, o_orderkey AS term_id FROM orders",
    "fx_ops_events": "SELECT event_id, user_id AS resource_id, event_type, ts AS occurred_at, (event_id * 7919) % 900 AS delay_s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS resource_version FROM events",
    "fx_runs": "SELECT event_id AS run_id, user_id AS source_id, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' WHEN 'signup' THEN 'cancelled' ELSE 'running' END AS status, ts AS finished_at FROM events",
    "fx_checks": "SELECT event_id AS check_id, user_id AS source_id, ts AS checked_at, event_type <> 'error' AS ok, props AS content_hash FROM events",
    "fx_jobs": "SELECT event_id AS job_id, user_id % 5 AS queue, event_type AS stage, CASE event_id % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'running' WHEN 3 THEN 'retry_wait' WHEN 4 THEN 'succeeded' WHEN 5 THEN 'failed' WHEN 6 THEN 'dead_letter' ELSE 'cancelled' END AS state, ts AS enqueued_at, user_id AS worker, event_id % 3 AS boot_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fencing_token, CASE WHEN event_id % 5 <> 0 THEN 40 END AS total_units, event_id % 41 AS completed, value FROM events",
    "fx_ledger": "SELECT event_id AS entry_id, event_id // 3 AS reservation_id, CASE event_id % 3 WHEN 0 THEN 'reserved' WHEN 1 THEN 'estimated' ELSE 'settled' END AS state, CASE WHEN (event_id // 3) % 2 = 0 THEN 'COP' ELSE 'USD' END AS currency, user_id % 7 AS provider, CAST(value AS DECIMAL(18,6)) AS amount, ts AS seen_at FROM events",
    "fx_deliveries": "SELECT conv_id AS answer_id, turn AS segment, CASE WHEN turn % 5 = 4 THEN 'uncertain' WHEN (conv_id + turn) % 6 = 5 THEN 'failed' ELSE 'confirmed' END AS state FROM conversations",
    "fx_alerts": "SELECT event_id AS alert_id, user_id % 5 AS rule, user_id AS resource_id, ts AS seen_at, CASE WHEN value > 50 THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE event_type = 'error'",
    "fx_revisions": "SELECT doc_id AS revision_id, doc_id // 4 AS document_id, doc_id % 4 + 1 AS seq, text, lang, sha256(text) AS hash FROM documents",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view or a test table, read under its declared schema."""
    if name not in VIEWS:
        return read_table(spark, sf_dir, name, declared=True)
    text = VIEWS[name].replace("sha256(text)", "sha2(text, 256)").replace("event_id // 3", "event_id DIV 3").replace("doc_id // 4", "doc_id DIV 4")
    table = re.search(r"FROM (\w+)(?: WHERE .*)?$", text)[1]
    return spark.sql(re.sub(rf"FROM {table}\b", "FROM {source}", text), source=read_table(spark, sf_dir, table, declared=True))


def with_views(sql: str) -> str:
    """DuckDB SQL with the fixture views it names as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({VIEWS[n].replace('STRING', 'VARCHAR')})" for n in used)
    if not ctes:
        return sql
    if sql.strip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql.strip()[15:]}"
    return f"WITH {ctes}, {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH {ctes} {sql}"


class Registry:
    """Collects queries with their SQL twins: ``@registry("name", "table ...", sql)``."""

    def __init__(self):
        self.QUERIES, self.ORACLE_SQL = {}, {}

    def __call__(self, name: str, tables: str, sql: str | None = None):
        def add(f):
            self.QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, t) for t in tables.split()))
            if sql:
                self.ORACLE_SQL[name] = with_views(sql)
            return f

        return add
