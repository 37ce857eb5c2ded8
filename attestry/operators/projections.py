"""Projections: envelopes, observations, redaction, masking (family B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECRETS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[email]"),
    (r"(?i)(token|key|secret|password)\s*[=:]\s*[^\s,;]+", "[secret]"),
    (r"\b[0-9]{13,19}\b", "[number]"),
)


def to_envelope(df: DataFrame, record_type: str, id_col: str, **fields: Column) -> DataFrame:
    """Common envelope (schema_version, record_type, external_id, normalized as JSON)."""
    body = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return df.select(F.lit("1").alias("schema_version"), F.lit(record_type).alias("record_type"), F.col(id_col).cast("string").alias("external_id"), body.alias("normalized"))


def to_observations(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row for each predicate (column) of a record; a null value stays null."""
    typed = df.select(id_col, *[F.col(c).cast("string") for c in columns])
    return typed.unpivot(id_col, columns, "predicate", "value")


def from_observations(obs: DataFrame, id_col: str, predicate: str, value: str, names: list[str], order: Column) -> DataFrame:
    """Wide record with the greatest value by ``order`` of each predicate."""
    return obs.groupBy(id_col).pivot(predicate, names).agg(F.max_by(value, order))


def pseudonymize(df: DataFrame, columns: list[str], salt: str) -> DataFrame:
    """SHA-256 of salt and value; null stays null."""
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in columns})


def redact(column: Column) -> Column:
    """Credentials, addresses and long numbers replaced by labels."""
    for pattern, label in SECRETS:
        column = F.regexp_replace(column, pattern, label)
    return column


def mask_unless(df: DataFrame, columns: list[str], permitted: bool) -> DataFrame:
    """Content columns become null without the permission to read them."""
    return df if permitted else df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})


def ratio(num: Column, den: Column, min_n: int = 1) -> Column:
    """num / den, null without a valid denominator of at least ``min_n``."""
    return F.when(den >= min_n, num / den)


def metric_row(df: DataFrame, name: str, value: Column, unit: str, window: str, population: Column | None = None) -> DataFrame:
    """One labelled result row: metric, value, unit, window, sample_count."""
    n = F.count(F.lit(1) if population is None else population)
    return df.agg(value.alias("value"), n.alias("sample_count")).select(F.lit(name).alias("metric"), "value", F.lit(unit).alias("unit"), F.lit(window).alias("time_window"), "sample_count")
