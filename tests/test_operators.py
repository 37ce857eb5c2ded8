"""Operators without an SQL twin, and edge rows, against plain definitions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.functions import values as V
from attestry.operators import documents as K
from attestry.operators import folds
from attestry.operators import vectors as N
from attestry.operators import joins as D
from attestry.operators import metrics as E
from attestry.operators import windows as W
from attestry.plans import catalogue
from attestry.sources import contracts, sinks

SF = "/root/testdata/sf0.001"


def test_merged_quantiles_lie_within_a_rank_error(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    values = {}
    for r in events.select("event_type", "value").collect():
        values.setdefault(r.event_type, []).append(r.value)
    rows = catalogue.queries()["e23_merged_quantiles"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(values)
    for r in rows:
        own = np.sort(values[r.event_type])
        assert r.sample_count == len(own)
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert abs(np.searchsorted(own, r[name], "right") / len(own) - q) <= 0.03


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_ann_recall_against_exact_neighbours(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    near = catalogue.queries()["k12_vector_ann"](spark, f"/root/testdata/{sf}").collect()
    exact = [r for r in catalogue.queries()["k11_vector_topk"](spark, f"/root/testdata/{sf}").collect() if r["rank"] <= 10]
    want, got = ({(r.query_id, r.vec_id) for r in rows} for rows in (exact, near))
    assert len(want & got) >= 0.9 * len(want)
    rows = N.unit_rows(vectors, "vec_id", "embedding")
    asked = rows.filter("id % 20 = 0")
    index = N.CodeIndex.of(rows, 64, 10)
    index.calibrate(asked)
    assert index.comparisons(asked) < 0.2 * rows.count() * asked.count()


def test_ann_leaves_far_cells_out(spark):
    """Tight clusters: a query's neighbours are in its own cell."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 5
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.2).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    units = N.unit_rows(df, "vec_id", "embedding")
    index = N.CodeIndex.of(units, 16, 10)
    index.calibrate(units.filter("id % 20 = 0"))
    assert len(index.centres) == 23 and index.probes <= 3
    near = {(r.query_id, r.vec_id) for r in N.vector_ann(df.filter("vec_id % 20 = 0"), df, "vec_id", "embedding").collect()}
    exact = {(r.query_id, r.vec_id) for r in N.vector_top(df.filter("vec_id % 20 = 0"), df, "vec_id", "embedding", 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    assert N.vector_ann(df.limit(0), df, "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("block", [8192, 3])
def test_vector_top_matches_plain_cosines(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "SHARE", block)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)] + [(200, [1.0, 0.0, 0.0, 0.0]), (201, [2.0, 0.0, 0.0, 0.0]), (202, [0.0] * 4), (203, [1.0, 2.0]), (204, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in N.vector_top(df.filter("vec_id % 20 = 0"), df, "vec_id", "embedding", 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    full = [(i, np.array(x)) for i, x in rows if x and len(x) == 4 and any(x)]
    for i, x in full:
        if i % 20 == 0:
            scored = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6), j) for j, y in full if j != i)
            assert sorted(got[i]) == [(k + 1, j) for k, (_, j) in enumerate(scored[:5])]
    assert N.vector_top(df.limit(0), df, "vec_id", "embedding").count() == 0


def test_near_candidates_hold_close_texts_only(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(60)]
    texts += [t + " one more" for t in texts[:20]] + [None, "", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.rep) for r in K.near_candidates(df, "doc_id", "text").collect()}
    assert len({(60 + i, i) for i in range(20)} & got) >= 18 and all(a - b == 60 for a, b in got)


def test_covered_points(spark):
    rng = random.Random(3)
    points = [(i, rng.choice("ab"), f"2024-01-01 {rng.randrange(24):02d}:{rng.randrange(60):02d}:00") for i in range(200)] + [(900, "a", None), (901, None, "2024-01-01 00:00:00")]
    spans = []
    for _ in range(25):
        start = rng.randrange(86000)
        spans.append((rng.choice("ab"), start, start + rng.choice([0, 60, 600, 9000])))
    stamp = lambda s: F.timestamp_seconds(F.lit(1704067200) + F.col(s)).cast("timestamp_ntz")
    p = spark.createDataFrame(points, "id long, rule string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    s = spark.createDataFrame(spans, "rule string, a long, b long").select("rule", stamp("a").alias("a"), stamp("b").alias("b"))
    got = {r.id: r.covered for r in D.covered(p, s, "rule", "at", "a", "b", 700).collect()}
    for i, rule, at in points:
        t = at and int(at[11:13]) * 3600 + int(at[14:16]) * 60
        assert got[i] == any(k == rule and t is not None and a <= t < b for k, a, b in spans)


def test_title_candidates_find_every_pair_within_three_edits(spark):
    rng = random.Random(5)
    titles = ["".join(rng.choice("abc ") for _ in range(rng.randrange(14))) for _ in range(120)]
    titles += ["".join(c for c in t if rng.random() > 0.15) for t in titles[:60]] + [None, titles[0]]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    own = sorted({t for t in titles if t is not None})
    want = {(a, b, distance(a, b)) for a in own for b in own if a < b and distance(a, b) <= 3}
    df = spark.createDataFrame([(t,) for t in titles], "name string")
    assert {(r.title, r.other, r.distance) for r in D.title_candidates(df, "name", 3).collect()} == want


def test_running_totals_and_admission_fold(spark):
    rng = random.Random(6)
    rows = [(i, "ab"[i % 2], f"2024-01-{1 + rng.randrange(5):02d} 10:00:{rng.randrange(60):02d}", rng.randrange(1, 60)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, at string, n int").select("id", "k", F.col("at").cast("timestamp_ntz").alias("at"), F.col("n").cast("decimal(18,6)").alias("n"))
    total, used, want, fits = Counter(), Counter(), {}, {}
    for i, k, at, n in sorted(rows, key=lambda r: (r[2], r[0])):
        total[k] += n
        want[i] = total[k]
        fits[i] = used[k] + n <= 500
        used[k] += n if fits[i] else 0
    assert {r.id: int(r.running) for r in W.running_total(df, ["k"], ["at", "id"], "n").collect()} == want
    assert {r.id: r.admitted for r in folds.admitted(df, ["k"], ["at", "id"], "n", 500).collect()} == fits


def test_lexical_scores_match_the_formula(spark):
    docs = [(1, "red fox and red hen"), (2, "blue fox"), (3, None), (4, ""), (5, "green"), (5, "green")]
    df = spark.createDataFrame(docs[:5], "doc_id long, text string")
    q = spark.createDataFrame([(9, "Red fox!"), (10, None), (11, "absent")], "item_id long, text string")
    got = {(r.item_id, r.doc_id): r.score for r in K.lexical(q, df, "item_id", "doc_id", "text").collect()}
    n, avg = 3, (5 + 2 + 1) / 3
    one = lambda tf, df_, dl: math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got == {(9, 1): round(one(2, 1, 5) + one(1, 2, 5), 6), (9, 2): round(one(1, 2, 2), 6)}


def test_adapters_and_partial_dates(spark):
    q = catalogue.queries()
    a, b = ({r.doc_id: r.embedding for r in q["j1_embed"](spark, SF).collect()} for _ in range(2))
    assert a == b and all(abs(np.linalg.norm(x) - 1) < 1e-9 or not any(x) for x in a.values())
    ranked = q["j2_rerank"](spark, SF).collect()
    assert ranked and max(r["rank"] for r in ranked) <= 8 and all(0 <= r.score <= 1 for r in ranked)
    df = spark.createDataFrame([("2024-02-30",), ("2024-02",), ("",), (None,), ("2024-13",)], "t string")
    day, precision = V.partial_date(F.col("t"))
    assert [(str(r.d), r.p) for r in df.select(day.alias("d"), precision.alias("p")).collect()] == [("None", "unknown"), ("2024-02-01", "month"), ("None", "unknown"), ("None", "unknown"), ("None", "unknown")]


def test_sinks_and_contracts_on_edge_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1"), (2, None), (3, "\ttab"), (4, 'say "hi", twice\nline'), (5, "")], "id long, cell string")
    sinks.export_csv(df, ["id", "cell"], f"{tmp_path}/csv")
    back = {r.id: r.cell for r in contracts.read_source(spark, f"{tmp_path}/csv", "csv", "id long, cell string").collect()}
    assert back[1] == "'=1+1" and back[3] == "'\ttab" and back[4] == 'say "hi", twice\nline' and not back[2]
    assert sinks.published(spark, f"{tmp_path}/none") is None
    lines = spark.createDataFrame([('{"a": 1}',), ('{"a": "x"}',), ("",), ('{"b": 2}',), ("{",)], "value string")
    lines.coalesce(1).write.text(f"{tmp_path}/lines")
    good, bad = contracts.read_with_contract(spark, f"{tmp_path}/lines", "a long", {"has_a": F.col("a").isNotNull()})
    assert [r.a for r in good.collect()] == [1] and sorted(r.reason for r in bad.collect()) == ["corrupt", "corrupt", "has_a"]


def test_percentiles_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert E.percentiles(empty, ["k"], "v").count() == 0
