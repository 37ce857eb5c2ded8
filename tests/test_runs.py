import random

import pytest
from pyspark.sql import functions as F

from attestry.operators.windows import consecutive, recovered, runs

FORMS = "k string, s long, id long, ok boolean"


@pytest.mark.parametrize("width", [1, 37, 500, 10**6])
def test_runs_stitched_over_bins_equal_plain_runs(spark, width):
    rng = random.Random(width)
    rows, at = [], 0
    for k in ("a", "b", None, "long"):
        s = 0
        for i in range(300 if k == "long" else 80):
            s += rng.choice([0, 1, 5, 90])
            rows.append((k, s, i, rng.random() < (0.97 if k == "long" else 0.6)))
    rows.append(("b", 99_999, 1000, None))
    df = spark.createDataFrame(rows, FORMS).withColumn("at", F.timestamp_seconds("s")).repartition(3)
    want, back = [], []
    for k in {r[0] for r in rows}:
        own, run, seen = sorted(r[1:] for r in rows if r[0] == k), [], False
        for s, i, ok in [*own, (None, None, False)]:
            if ok:
                run.append((s, i))
                if len(run) == 3 and seen:
                    back.append((k, i))
                continue
            if run:
                want.append((k, run[0][0], run[-1][0], len(run)))
            run, seen = [], True
    order = ["at", "id"]
    got = runs(df, "k", order, F.col("ok"), 1, width).select("k", F.unix_seconds("first_at"), F.unix_seconds("last_at"), "length")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert consecutive(df, "k", order, F.col("ok"), 4, width).count() == sum(w[3] >= 4 for w in want)
    assert sorted(((r.k, r.id) for r in recovered(df, "k", order, F.col("ok"), 3, width).collect()), key=str) == sorted(back, key=str)
    assert runs(df.limit(0), "k", order, F.col("ok")).count() == 0
