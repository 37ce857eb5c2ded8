"""Expressions over single values (family H), as Columns and as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ACCENTS, PLAIN = "áéíóúüñ", "aeiouun"
SPACES = r"[ \t\n\r\f\x0b]+"

#: First bytes (hex) of media types.
MAGIC = (("25504446", "application/pdf"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"))


def norm_question(text: Column) -> Column:
    """Case, accents, punctuation and spaces evened out; names, numbers and words of time stay."""
    bare = F.regexp_replace(F.translate(F.lower(text), ACCENTS, PLAIN), "[¿?¡!.,;:]+", " ")
    return F.trim(F.regexp_replace(bare, SPACES, " "))


def cache_key(**parts: Column) -> Column:
    """SHA-256 of the JSON of the named parts in the order of their names; a null part is left out of the JSON."""
    return F.sha2(F.to_json(F.struct(*[c.cast("string").alias(n) for n, c in sorted(parts.items())])), 256)


def mapped(raw: Column, names: dict[str, str], other: str) -> Column:
    """The label of a raw value; unknown ones and null get ``other``."""
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.coalesce(F.element_at(table, raw), F.lit(other))


def partial_date(text: Column) -> tuple[Column, Column]:
    """(date, precision) of a text that names a day, a month or a year; null and unknown otherwise."""
    shape = lambda p: text.rlike(p)
    day, month, year = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}$", r"^\d{4}$"
    whole = F.when(shape(day), text).when(shape(month), F.concat(text, F.lit("-01"))).when(shape(year), F.concat(text, F.lit("-01-01")))
    date = F.try_to_timestamp(whole, F.lit("yyyy-MM-dd")).cast("date")
    return date, F.when(date.isNull(), "unknown").when(shape(day), "day").when(shape(month), "month").otherwise("year")


def age_label(at: Column, now: str) -> Column:
    """The date itself beside its age in days."""
    return F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit(" ("), F.datediff(F.lit(now).cast("date"), at.cast("date")).cast("string"), F.lit(" d)"))


def millis(start: Column, end: Column) -> Column:
    return ((F.unix_micros(F.to_timestamp(end)) - F.unix_micros(F.to_timestamp(start))) / 1000).cast("long")


def citation(url: Column, title: Column, revision: Column, page: Column) -> Column:
    """Link text; the page and its anchor only where there is one."""
    anchor = F.coalesce(F.concat(F.lit("#page="), page.cast("string")), F.lit(""))
    return F.concat_ws(" | ", F.concat(url, anchor), title, F.concat(F.lit("rev "), revision.cast("string")), F.concat(F.lit("p. "), page.cast("string")))


def locator(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def merge_counters(a: Column, b: Column) -> Column:
    """Sums by name of two maps of counts; a name of one map only keeps its count."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def sniff_mime(data: Column) -> Column:
    """Media type by the first bytes: known signatures, then HTML, JSON and plain text."""
    head = F.hex(F.substring(data, 1, 4))
    text = F.lower(F.trim(F.decode(F.substring(data, 1, 64), "ISO-8859-1")))
    found = F.when(F.length(data) == 0, "application/x-empty")
    for magic, kind in MAGIC:
        found = found.when(head.startswith(magic), kind)
    return found.when(text.startswith("<!doctype html") | text.startswith("<html"), "text/html").when(text.startswith("{"), "application/json").otherwise("text/plain")


def telemetry_state(last: Column, now: str, fresh_s: int, stale_s: int) -> Column:
    """fresh, stale or disconnected by the age of the last signal; without one not_instrumented."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.to_timestamp(last))) / 1e6
    return F.when(last.isNull(), "not_instrumented").when(age <= fresh_s, "fresh").when(age <= stale_s, "stale").otherwise("disconnected")


def register(spark: SparkSession) -> None:
    """Temporary SQL functions of this family: norm_name, norm_vote, content_hash, dur_ms."""
    for signature, body in {
        "norm_name(s STRING) RETURNS STRING": f"regexp_replace(translate(lower(trim(s)), '{ACCENTS}', '{PLAIN}'), '\\\\s+', ' ')",
        "norm_vote(s STRING) RETURNS STRING": "CASE s WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'other' END",
        "content_hash(s STRING) RETURNS STRING": "sha2(s, 256)",
        "dur_ms(a TIMESTAMP, b TIMESTAMP) RETURNS BIGINT": "(unix_micros(b) - unix_micros(a)) DIV 1000",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
