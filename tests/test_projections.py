import tempfile

import pytest
from pyspark.sql import functions as F

from attestry.operators.windows import latest_state
from attestry.sources.projections import Projection

SCHEMA = "k long, v string, n long"


@pytest.fixture
def table(spark):
    return Projection(spark, tempfile.mkdtemp(prefix="spark-") + "/table", SCHEMA, "k", 8)


def merged(both):
    return latest_state(both, "k", "n")


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def held(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, table):
    assert held(table) == []
    assert table.merge(rows(spark, *[(k, "a", 1) for k in range(40)]), merged, "s", 0) == 1
    before = table.manifest()["buckets"]
    assert table.merge(rows(spark, (7, "b", 2), (7, "old", 1)), merged, "s", 1) == 2
    after = table.manifest()["buckets"]
    own = str(spark.range(1).select(F.pmod(F.xxhash64(F.lit(7).cast("long")), F.lit(8))).first()[0])
    assert {b for b in after if after[b] != before[b]} == {own}
    assert held(table) == sorted([(k, "a", 1) for k in range(40) if k != 7] + [(7, "b", 2)])
    assert held(table, 1) == [(k, "a", 1) for k in range(40)]


def test_replay_adds_no_version_and_sources_count_apart(spark, table):
    batch = rows(spark, (1, "a", 1))
    assert [table.merge(batch, merged, "s", n) for n in (0, 0, 1, 0, 1)] == [1, 1, 2, 2, 2]
    assert table.merge(batch, merged, "other", 0) == 3
    assert table.merge(batch.limit(0), merged, "s", 9) == 3
    assert table.manifest()["ledger"] == {"s": 1, "other": 0}


def test_two_writers_do_not_mix(spark, table):
    """A writer that was overtaken before its commit starts again from the other's version."""
    other = Projection(spark, table.path, SCHEMA, "k", 8)
    table.merge(rows(spark, (1, "a", 1), (2, "a", 1)), merged, "s", 0)
    calls = []

    def overtaken(both):
        calls.append(1)
        if len(calls) == 1:
            other.merge(rows(spark, (1, "c", 3), (3, "c", 1)), merged, "t", 5)
        return merged(both)

    assert table.merge(rows(spark, (1, "b", 2), (2, "b", 2)), overtaken, "s", 1) == 3
    assert len(calls) == 2 and held(table) == [(1, "c", 3), (2, "b", 2), (3, "c", 1)]
    assert held(table, 2) == [(1, "c", 3), (2, "a", 1), (3, "c", 1)]
    assert not table._commit({"version": 3, "buckets": {}, "ledger": {}})
    assert held(other) == held(table)


def test_a_crash_before_the_commit_leaves_nothing(spark, table):
    table.replace(rows(spark, (1, "a", 1)))

    def broken(both):
        table._write(both)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.merge(rows(spark, (1, "b", 2)), broken, "s", 0)
    assert held(table) == [(1, "a", 1)] and table.manifest()["version"] == 1
    assert table.merge(rows(spark, (1, "b", 2)), merged, "s", 0) == 2
    assert table.replace(rows(spark, (5, "z", 1))) == 3 and held(table) == [(5, "z", 1)]
    assert table.vacuum(1) == 3 and held(table) == [(5, "z", 1)]
