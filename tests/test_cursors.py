import tempfile

import pytest
from pyspark.sql import functions as F

from attestry.sources.cursors import Cursor

SCHEMA = "k long, at timestamp_ntz"


def table(spark, *rows):
    return spark.createDataFrame(rows, "k long, s long").select("k", F.to_timestamp_ntz(F.timestamp_seconds("s").cast("string")).alias("at"))


def test_late_rows_come_once_and_a_crash_loses_nothing(spark):
    cursor = Cursor(spark, tempfile.mkdtemp(prefix="spark-") + "/c", SCHEMA, "k", "at", 100)
    assert cursor.state()["cursor"] is None and cursor.committed().count() == 0
    first = table(spark, (1, 1000), (2, 1100), (None, 1100), (9, None))
    assert cursor.pull(first) == 1 and cursor.state()["cursor"] == "1970-01-01 00:18:20"
    late = table(spark, (1, 1000), (2, 1100), (3, 1050), (4, 1200), (5, 900))  # 3 is late, 5 too late
    cursor.write(late)  # broken before the commit
    assert sorted(r.k for r in cursor.committed().collect()) == [1, 2]
    again = Cursor(spark, cursor.path, SCHEMA, "k", "at", 100)
    assert again.pull(late) == 2 and again.pull(late) == 3
    assert sorted((r.k, r.pull) for r in again.committed().collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_of_two_writers_one_commits(spark):
    one, two = (Cursor(spark, path, SCHEMA, "k", "at", 100) for path in [tempfile.mkdtemp(prefix="spark-") + "/c"] * 2)
    commit = one.write(table(spark, (1, 1000)))
    two.pull(table(spark, (1, 1000), (2, 1001)))
    assert not one.commits.create(commit["number"], commit)
    with pytest.raises(RuntimeError):
        one.write = lambda source: commit
        one.pull(table(spark, (1, 1000)))
    assert sorted(r.k for r in two.committed().collect()) == [1, 2]
