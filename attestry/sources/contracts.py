"""Reads of outside files: samples in several formats, and reads under a contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"
#: Parts records of text files whose records may hold line breaks.
RECORD = "\x1e"


def read_source(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    """Files of a source: json and csv with a declared schema, html (one record between RECORD marks) or bytes (any file)."""
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    if fmt == "html":
        return spark.read.option("lineSep", RECORD).text(path).withColumnRenamed("value", "html")
    if fmt == "bytes":
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    raise ValueError(f"unknown format {fmt}")


def judged(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``rows`` with ``reason``: corrupt, the first check by name that does not hold, or null."""
    reason = F.when(F.col(CORRUPT).isNotNull(), "corrupt")
    for name, check in sorted(checks.items()):
        reason = reason.when(~F.coalesce(check, F.lit(False)), name)
    return rows.withColumn("reason", reason)


def read_with_contract(spark: SparkSession, path: str, schema: str, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows of JSON lines; none is dropped.

    Lines that do not fit the schema keep their text in ``_corrupt_record``;
    rows that fail a check (a null result has failed) name it in ``reason``.
    """
    rows = judged(spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path), checks)
    return rows.filter("reason IS NULL").drop(CORRUPT, "reason"), rows.filter("reason IS NOT NULL")
