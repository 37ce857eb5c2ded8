"""Filters and predicates (family C). Columns stay bare so that filters reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_filter(df: DataFrame, at: str | None = None, start: str | None = None, end: str | None = None, **isin) -> DataFrame:
    """Half-open time range and allowed values by column."""
    if start:
        df = df.filter(F.col(at) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.filter(F.col(at) < F.lit(end).cast("timestamp_ntz"))
    for column, values in isin.items():
        df = df.filter(F.col(column).isin(*values))
    return df


def on_local_day(df: DataFrame, at: str, day: str, utc_offset_hours: int = -5) -> DataFrame:
    """A whole local day (Bogotá by default) as a half-open interval of instants."""
    start = F.lit(day).cast("timestamp_ntz") - F.expr(f"INTERVAL '{utc_offset_hours}' HOUR")
    return df.filter((F.col(at) >= start) & (F.col(at) < start + F.expr("INTERVAL '1' DAY")))


def allowed(df: DataFrame, column: str) -> DataFrame:
    """Only what is approved; unknown is not approval."""
    return df.filter(F.col(column).eqNullSafe(True))


def reasons(**checks: Column) -> Column:
    """Sorted names of the failed checks; a null check has failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in sorted(checks.items())]))


def date_match(day: str, precision: str, start: str, end: str) -> Column:
    """definite, possible or no: whether a date of a precision lies in [start, end)."""
    unit = F.when(F.col(precision) == "day", F.col(day)).when(F.col(precision) == "month", F.trunc(day, "month")).when(F.col(precision) == "year", F.trunc(day, "year"))
    upto = F.when(F.col(precision) == "day", F.date_add(day, 1)).when(F.col(precision) == "month", F.add_months(F.trunc(day, "month"), 1)).when(F.col(precision) == "year", F.add_months(F.trunc(day, "year"), 12))
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    return F.when(unit.isNull(), "possible").when((unit >= low) & (upto <= high), "definite").when((unit < high) & (upto > low), "possible").otherwise("no")


def url_allowed(url: str, domains: list[str]) -> Column:
    """https or http, an allowed registered domain, no literal loopback or private address."""
    host = F.regexp_extract(url, r"^https?://([^/?#:]*)", 1)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    private = host.rlike(r"^(127\.|10\.|192\.168\.|169\.254\.|localhost$)")
    return (host != "") & domain.isin(*domains) & ~private


#: Days that each class of data is kept.
RETENTION_DAYS = {"chat_context": 1, "heartbeat": 7, "query_text": 30, "aggregate": 90, "audit": 365}


def retain(df: DataFrame, cls: Column, at: str, now: str, days: dict[str, int] = RETENTION_DAYS) -> DataFrame:
    """Rows whose class ``cls`` still keeps them at ``now``; a class without a period, or none, keeps its rows."""
    period = F.coalesce(*[F.when(cls == name, F.lit(n)) for name, n in days.items()])
    age = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(period)
    return df.filter(period.isNull() | (F.col(at) >= age))


def apply_tombstones(df: DataFrame, tombstones: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Withdrawn rows stay, their content does not."""
    marked = df.join(tombstones.select(F.col(key), F.lit(True).alias("withdrawn")).distinct(), key, "left")
    gone = F.coalesce("withdrawn", F.lit(False))
    return marked.withColumns({c: F.when(~gone, F.col(c)) for c in content}).withColumn("withdrawn", gone)
