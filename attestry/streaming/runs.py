"""Runs of a stream over files that arrive part by part, from one checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from attestry.runtime import shared_dir


def folder(df: DataFrame, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(df.sparkSession)}/attestry-{name}-{uuid.uuid4().hex}"


def arrivals(events: DataFrame, second: Column, parts: int = 3) -> list[DataFrame]:
    """The events in parts by their second of arrival; the bounds are quantiles, found with an error of 1 %."""
    marked = events.withColumn("__second", second)
    cuts = marked.approxQuantile("__second", [i / parts for i in range(1, parts)], 0.01)
    low = [None, *cuts]
    high = [*cuts, None]
    inside = lambda a, b: F.lit(True) & (F.lit(True) if a is None else F.col("__second") > a) & (F.lit(True) if b is None else F.col("__second") <= b)
    return [marked.filter(inside(a, b)).drop("__second") for a, b in zip(low, high, strict=True)]


def run(parts: list[DataFrame], build: Callable[[DataFrame], DataStreamWriter], fmt: str = "parquet") -> None:
    """Each part arrives as files and is taken up by the stream where it stopped before."""
    spark = parts[0].sparkSession
    source, state = folder(parts[0], "arrived"), folder(parts[0], "state")
    for part in parts:
        writer = part.write.mode("append")
        writer.parquet(source) if fmt == "parquet" else writer.text(source)
        reader = spark.readStream.schema(part.schema)
        stream = reader.parquet(source) if fmt == "parquet" else spark.readStream.text(source)
        build(stream).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def appended(parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that the transformed stream appends, read back."""
    out, schema = folder(parts[0], "out"), []

    def build(stream: DataFrame) -> DataStreamWriter:
        found = transform(stream)
        schema[:] = [found.schema]
        return found.writeStream.format("parquet").option("path", out).outputMode("append")

    run(parts, build)
    return parts[0].sparkSession.read.schema(schema[0]).parquet(out)


def batches(parts: list[DataFrame], write: Callable[[DataFrame, int], None], fmt: str = "parquet", transform: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> None:
    """Runs ``write(batch, number)`` on every micro-batch."""
    run(parts, lambda stream: (transform(stream) if transform else stream).writeStream.foreachBatch(write).outputMode(mode), fmt)
