import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.operators import metrics
from attestry.operators.metrics import percentiles


@pytest.mark.parametrize("accuracy", [1000, 100])
def test_percentiles_are_exact_and_brackets_small(spark, monkeypatch, accuracy):
    monkeypatch.setattr(metrics, "ACCURACY", accuracy)
    rng = np.random.default_rng(8)
    groups = {"wide": rng.normal(size=30_000), "ties": rng.integers(0, 3, 20_000).astype(float), "skew": rng.pareto(1.0, 9000), "few": np.array([3.0, 1.0]), "one": np.array([7.0]), None: rng.random(5000)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {r.k: r for r in percentiles(df, ["k"], "x", (0.0, 0.5, 0.95, 0.99, 1.0)).collect()}
    assert got["none"].sample_count == 0 and got["none"].p50 is None and len(got) == 7
    for k, x in groups.items():
        assert got[k].sample_count == len(x)
        for name, p in (("p0", 0), ("p50", 50), ("p95", 95), ("p99", 99), ("p100", 100)):
            assert got[k][name] == pytest.approx(np.percentile(x, p), rel=1e-12), (k, name)
    assert percentiles(df.limit(0), ["k"], "x").count() == 0


def test_sorted_part_of_a_large_group_is_small(spark):
    """The values that a task sorts are those of the brackets: a few thousandths a point."""
    df = spark.range(200_000).select(F.lit("a").alias("k"), F.rand(3).alias("x"))
    near = df.agg(F.percentile_approx("x", [0.498, 0.502], metrics.ACCURACY)).first()[0]
    assert df.filter(F.col("x").between(*near)).count() < 0.01 * 200_000
