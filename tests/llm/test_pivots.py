import math
import random

import numpy as np
import pytest

from attestry.llm import pivots
from attestry.llm.pivots import scaled, scores, top_k

FORMS = "id long, e array<float>"


def plain(rows, k=20):
    """Every row against every other, in Python's whole numbers."""
    sound = {(i, tuple(math.floor(64 * float(np.float32(x))) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for i, v in sound:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in sound if (j, w) != (i, v) and len(v) == len(w))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def found(spark, rows, k=20, forms=FORMS):
    vectors = scaled(spark.createDataFrame(rows, forms), "id", "e")
    return sorted(map(tuple, top_k(vectors, vectors.filter("id % 20 = 0"), k).collect()))


def test_scores_are_exact_for_large_numbers():
    x = np.array([[2.0**31 + 1, 3.0]])
    assert scores(x, x).tolist() == [[(2**31 + 1) ** 2 + 9]]


@pytest.mark.parametrize("annulus,first,share", [(512, 2, 1 << 14), (8, 1, 3)])
def test_equals_brute_force(spark, monkeypatch, annulus, first, share):
    monkeypatch.setattr(pivots, "ANNULUS", annulus)
    monkeypatch.setattr(pivots, "FIRST", first)
    monkeypatch.setattr(pivots, "SHARE", share)
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(600)]
    rows += [(600 + i, [0.5] * 6) for i in range(300)]  # a third of the rows are one vector
    rows += [(2000 + i, [round(rng.random(), 1) for _ in range(6)]) for i in range(100)]  # ties
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (None, [1.0, 1.0])]
    rows += [(20, []), (21, []), (40, [1.0]), (60, [-0.0, 0.001]), (-20, [1.0, 1.0]), (61, [1.0, 1.0]), (80, None), (100, [5.0e4, 1.0e4])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, 2) == plain(rows, 2)
    assert found(spark, []) == []
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], FORMS + ", v int, qid string")
    vectors = scaled(wide, "id", "e")
    assert sorted(map(tuple, top_k(vectors, vectors.filter("id % 20 = 0")).collect())) == plain(rows)


def test_far_annuli_are_left_out(spark):
    """Clusters far apart: a query's work stays near its own."""
    rng = random.Random(2)
    rows = [(i, [100.0 * math.cos(i % 16), 100.0 * math.sin(i % 16), rng.random()]) for i in range(4000)]
    vectors = scaled(spark.createDataFrame(rows, FORMS), "id", "e")
    classes = vectors.selectExpr("v", "array(id) as ids")
    index = pivots.PivotIndex.of(classes.dropDuplicates(["v"]), 3)
    least = 64 * 64 * 9999  # what 21 vectors of the own cluster reach
    asked = vectors.filter("id % 20 = 0").selectExpr("string(id) as qid", "v", f"{least}L as least")
    visits = index.visits(asked, 0, len(index.bounds))
    assert visits.count() < 0.25 * asked.count() * len(index.bounds)
