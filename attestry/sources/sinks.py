"""Sinks: dated appends, idempotent batches and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.sources.manifests import Manifests


def append_events(df: DataFrame, path: str, at: str) -> None:
    """Appends rows under their date; what is there is never changed."""
    df.withColumn("event_date", F.to_date(at)).write.partitionBy("event_date").mode("append").parquet(path)


def write_batch(path: str):
    """A function for foreachBatch: a batch that runs again replaces what it wrote before."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def published(spark: SparkSession, path: str) -> int | None:
    """The version in force of a :class:`attestry.sources.projections.Projection` at ``path``, null before the first."""
    return max(Manifests(spark, f"{path}/manifests").numbers(), default=None)


def safe_cell(cell: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def export_csv(df: DataFrame, columns: list[str], path: str) -> None:
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    shown = [safe_cell(F.col(c)).alias(c) if c in texts else F.col(c) for c in columns]
    df.select(*shown).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_canonical(df: DataFrame, path: str, key: Column) -> None:
    """Parquet under a key that follows from the content alone."""
    df.withColumn("canonical_key", key).write.mode("overwrite").parquet(path)
