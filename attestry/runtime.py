"""Helpers around a SparkSession that every part of the library shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset a temporary folder is
    made once per application, in local mode only: on a cluster it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        path = _own_dirs.setdefault(app, "") or tempfile.mkdtemp(prefix="attestry-")
        _own_dirs[app] = path
    return path.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: later stages, and stages that rerun after an
    executor is lost, read the files instead of computing ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written meanwhile goes to Python in batches of at most so many rows.

    A batch stands in the JVM and in the worker at once, and a row of whole
    texts or sets has some kilobytes.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` (saved, of a few narrow columns) marked for broadcast if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores at least: a small file is one partition, however much work its rows are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def hot_keys(df: DataFrame, key: str) -> DataFrame | None:
    """The values of ``key`` that more than a thousandth of the rows of ``df`` (saved) have, if any: fewer than a thousand."""
    least = max(1000, df.count() // 1000)
    hot = saved(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).select(key))
    return None if hot.isEmpty() else hot


def join_split(big: DataFrame, small: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``big.join(small, key, how)`` where ``small`` has each key once and few keys of ``big`` may have most rows.

    Rows with a hot key (of :func:`hot_keys`) stay where they are and meet a
    broadcast of fewer than a thousand rows; the others are shuffled. Keys are
    not null.
    """
    if hot is None:
        return big.join(small, key, how)
    hot = F.broadcast(hot)
    few = F.broadcast(saved(small.join(hot, key, "left_semi")))
    rest = big.join(hot, key, "left_anti").join(small.join(hot, key, "left_anti"), key, how)
    return big.join(hot, key, "left_semi").join(few, key, how).unionByName(rest)
