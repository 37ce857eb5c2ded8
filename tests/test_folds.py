import random

from attestry.operators.folds import admitted, ordered_fold


def test_a_rejected_reservation_leaves_its_room(spark):
    rng = random.Random(4)
    rows = [(b, i, rng.choice([None, 1, 5, 9, 30])) for b in ("a", None, "b") for i in range(rng.choice([3, 400]))] + [("one", i, 7) for i in range(30_000)]
    df = spark.createDataFrame(rows, "budget string, at int, amount int").repartition(5)
    got = {(r.budget, r.at): r.admitted for r in admitted(df, ["budget"], ["at"], "amount", 100).collect()}
    used, want = {}, {}
    for b, i, x in rows:
        want[b, i] = x is not None and used.get(b, 0) + x <= 100
        used[b] = used.get(b, 0) + (x if want[b, i] else 0)
    assert got == want


def test_a_fold_carries_its_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(i % 2, i) for i in range(100)], "k int, x int")
        found = ordered_fold(df, ["k"], ["x"], ["x"], 0, lambda s, x: (s + x, (s, s + x)), "before long, after long")
        rows = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows == sorted((i % 2, i, sum(range(i % 2, i, 2)), sum(range(i % 2, i + 1, 2))) for i in range(100))
    assert ordered_fold(df.limit(0), ["k"], ["x"], ["x"], 0, lambda s, x: (s, (s,)), "y long").count() == 0
