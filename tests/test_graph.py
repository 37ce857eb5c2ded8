import random

from pyspark.sql import functions as F

from attestry.operators.graph import connected_components, cycle_rest, lineage
from attestry.runtime import hot_keys, join_split, saved


def test_hot_keys_are_not_shuffled_to_one_task(spark):
    rows = [(1 if i % 3 == 0 else i, i) for i in range(12_000)]
    big = saved(spark.createDataFrame(rows, "k long, x long").repartition(8))
    small = spark.createDataFrame([(i, -i) for i in range(0, 12_000, 2)] + [(1, -1)], "k long, y long")
    hot = hot_keys(big, "k")
    assert [r.k for r in hot.collect()] == [1]
    for how in ("inner", "left"):
        found = join_split(big, small, "k", hot, how)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, big.join(small, "k", how).select("k", "x", "y").collect()), key=str)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in join_split(big, small, "k", hot).groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in big.join(small, "k").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes) < 4 * sorted(sizes)[len(sizes) // 2] and max(plain) > 2 * max(sizes)


def test_components_of_stars_chains_and_loops(spark):
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 4000)] + [(10_000 + i, 10_001 + i) for i in range(700)] + [(20_000, 20_000), (5, None)]
    edges += [(30_000 + rng.randrange(300), 30_000 + rng.randrange(300)) for _ in range(250)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if v is not None:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    found = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4))
    assert {tuple(r) for r in found.collect()} == {(x, root(x)) for x in list(parent)}


def test_lineage_goes_to_the_end_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(70)] + [(500, 501), (501, 502), (502, 500), (502, 600), (0, 69), (None, 1)]
    found = lineage(spark.createDataFrame(edges, "from_id long, to_id long"), spark.createDataFrame([(0,), (500,), (7,), (None,)], "node long"))
    want = {(0, i, i) for i in range(69)} | {(0, 69, 1), (0, 70, 2)} | {(7, i, i - 7) for i in range(7, 71)} | {(500, 500, 0), (500, 501, 1), (500, 502, 2), (500, 600, 3)}
    assert {tuple(r) for r in found.collect()} == want
    assert lineage(spark.createDataFrame(edges, "from_id long, to_id long"), spark.createDataFrame([(0,)], "node long"), 3).count() == 6


def test_cycle_rest_of_long_chains_and_of_random_graphs(spark):
    rng = random.Random(5)
    edges = {(1, i, i + 1) for i in range(1000)} | {(2, i, (i + 1) % 300) for i in range(300)} | {(2, 100, 900), (2, 901, 5)} | {(3, 1, 1), (3, 1, 2), (3, 2, 3), (3, 3, 4), (3, 4, 3)}
    edges |= {(10 + f, rng.randrange(12), rng.randrange(12)) for f in range(12) for _ in range(rng.randrange(1, 16))}
    want = set(edges)
    while True:
        into, out = {(f, b) for f, _, b in want}, {(f, a) for f, a, _ in want}
        less = {(f, a, b) for f, a, b in want if (f, a) in into and (f, b) in out}
        if less == want:
            break
        want = less
    found = cycle_rest(spark.createDataFrame(sorted(edges), "flow long, a long, b long"))
    assert {tuple(r) for r in found.collect()} == want and not any(f == 1 for f, _, _ in want)
