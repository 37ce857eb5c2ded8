"""Operational metrics over jobs, runs, checks, ledgers and alerts (families E and L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.joins import covered
from attestry.operators.projections import ratio
from attestry.runtime import broadcast_if_small, saved


#: A bracket's sketch is exact to one part in so many of a group's rows; smaller groups are one bracket.
ACCURACY = 1000


def percentiles(df: DataFrame, keys: list[str], value: str, points=(0.5, 0.95, 0.99)) -> DataFrame:
    """Exact interpolated percentiles from samples, with the sample count; none of an empty group.

    A sketch of each group brackets the ranks that are asked for, within its
    guaranteed error. A second pass counts what lies below each bracket and the
    distinct values inside it, so that a task sorts a few thousandths of a
    large group and not the group. Null samples are not counted.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("v"))
    near = [min(max(p + s * 2 / ACCURACY, 0.0), 1.0) for p in points for s in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(F.count("v").alias("sample_count"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", near, ACCURACY).alias("near"))
    bounds = []
    for i, p in enumerate(points):
        whole = F.col("sample_count") <= 4 * ACCURACY
        low = F.when(whole | (p < 2 / ACCURACY), F.col("least")).otherwise(F.get("near", F.lit(2 * i)))
        high = F.when(whole | (p > 1 - 2 / ACCURACY), F.col("most")).otherwise(F.get("near", F.lit(2 * i + 1)))
        bounds.append(F.struct(F.lit(i).alias("point"), low.alias("low"), high.alias("high")))
    groups = saved(sketch.select(*keys, "sample_count", F.array(*bounds).alias("brackets")))
    known = groups.select(*[F.col(k).alias(f"__{k}") for k in keys], "brackets")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = rows.filter("v IS NOT NULL").join(broadcast_if_small(known), same).select(*keys, "v", F.explode("brackets").alias("b"))
    met = met.select(*keys, "b.point", F.when(F.col("v") >= F.col("b.low"), F.col("v")).alias("v"), F.col("b.high").alias("high")).filter("v IS NULL OR v <= high")
    counts = met.groupBy(*keys, "point", "v").agg(F.count(F.lit(1)).alias("n"))  # what is below a bracket is its null value
    upto = F.sum("n").over(Window.partitionBy(*keys, "point").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n")).filter("v IS NOT NULL")
    placed = placed.join(broadcast_if_small(groups.select(*[F.col(k).alias(f"__{k}") for k in keys], "sample_count")), same).drop(*[f"__{k}" for k in keys])
    rank = F.get(F.array(*[F.lit(float(p)) for p in points]), F.col("point")) * (F.col("sample_count") - 1)
    holds = lambda r: (F.col("before") <= r) & (r < F.col("upto"))
    found = placed.withColumn("rank", rank).withColumns({"lo": F.floor("rank"), "hi": F.ceil("rank")})
    found = found.groupBy(*keys, "point").agg(F.max("rank").alias("rank"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.when(holds(F.col("lo")), F.col("v"))).alias("a"), F.max(F.when(holds(F.col("hi")), F.col("v"))).alias("b"))
    between = F.when(F.col("lo") == F.col("hi"), F.col("a")).otherwise((F.col("hi") - F.col("rank")) * F.col("a") + (F.col("rank") - F.col("lo")) * F.col("b"))
    names = [f"p{round(p * 100)}" for p in points]
    wide = found.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[F.max(F.when(F.col("point") == i, between)).alias(name) for i, name in enumerate(names)])
    return groups.select(*keys, "sample_count").join(wide, same, "left").select(*keys, "sample_count", *names)


def quantile_sketches(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A mergeable sketch of the distribution for each bucket; percentiles are never averaged."""
    return df.groupBy(*keys).agg(F.expr(f"kll_sketch_agg_double({value})").alias("sketch"), F.count(value).alias("sample_count"))


def merged_quantiles(sketches: DataFrame, keys: list[str], points=(0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles of buckets merged by ``keys``."""
    merged = sketches.groupBy(*keys).agg(F.expr("kll_merge_agg_double(sketch)").alias("sketch"), F.sum("sample_count").alias("sample_count"))
    quantiles = [F.expr(f"kll_sketch_get_quantile_double(sketch, {p}D)").alias(f"p{round(p * 100)}") for p in points]
    return merged.select(*keys, "sample_count", *quantiles)


def distinct_sketches(df: DataFrame, at: str, size: str, keys: list[str], value: str) -> DataFrame:
    """(bucket, keys, sketch): a mergeable sketch of the distinct values of each window, some 4 KB at most, to be stored."""
    return tumbling(df, at, size, keys, F.hll_sketch_agg(value, 14).alias("sketch"))


def merged_distinct(sketches: DataFrame, size: str, keys: list[str]) -> DataFrame:
    """(bucket, keys, estimate): about how many distinct values there are in longer windows, from stored sketches alone.

    The relative error is under 3 % for 99 windows in 100.
    """
    return tumbling(sketches, "bucket", size, keys, F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def tumbling(df: DataFrame, at: str, size: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by window and keys."""
    return df.groupBy(F.window(F.to_timestamp(at), size).alias("w"), *keys).agg(*aggregates).withColumn("bucket", F.to_timestamp_ntz(F.col("w.start").cast("string"))).drop("w")


def rate(df: DataFrame, keys: list[str], good: Column, counted: Column, min_n: int = 1) -> DataFrame:
    """Share of good rows among the counted ones, with N; null below the least sample."""
    n = F.count_if(counted)
    return df.groupBy(*keys).agg(n.alias("n"), ratio(F.count_if(good & counted), n, min_n).alias("rate"))


def source_status(checks: DataFrame, now: str) -> DataFrame:
    """Last attempt, success and age of the last successful check of each source."""
    good = F.max(F.when(F.col("ok"), F.col("checked_at")))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.to_timestamp("last_success"))) / 1e6
    return checks.groupBy("source_id").agg(F.max("checked_at").alias("last_attempt"), good.alias("last_success"), F.count_if(~F.col("ok")).alias("failures")).withColumn("age_s", age.cast("long"))


def exposed_cost(ledger: DataFrame) -> DataFrame:
    """By currency: settled, else estimated, else reserved amount of each reservation, counted once."""
    state = F.when(F.col("state") == "settled", 2).when(F.col("state") == "estimated", 1).otherwise(0)
    last = ledger.groupBy("reservation_id", "currency").agg(F.max_by("amount", F.struct(state, "entry_id")).alias("amount"))
    return last.groupBy("currency").agg(F.sum("amount").alias("exposed"), F.count(F.lit(1)).alias("reservations"))


def flow_state(jobs: DataFrame, key: str) -> DataFrame:
    """open while a child is not terminal, then failed, partial or succeeded."""
    ended = F.col("state").isin("succeeded", "failed", "dead_letter", "cancelled")
    found = jobs.groupBy(key).agg(F.bool_and(ended).alias("closed"), F.bool_and(F.col("state") == "succeeded").alias("all_good"), F.bool_or(F.col("state") == "succeeded").alias("some_good"))
    return found.select(key, F.when(~F.col("closed"), "open").when(F.col("all_good"), "succeeded").when(F.col("some_good"), "partial").otherwise("failed").alias("flow_state"))


def fingerprint(*columns: str) -> Column:
    """Alert identity without message or time."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def alert_groups(alerts: DataFrame) -> DataFrame:
    """First, last and number of occurrences of each fingerprint."""
    marked = alerts.withColumn("fingerprint", fingerprint("rule", "resource_id", "severity"))
    return marked.groupBy("fingerprint").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"))


def apply_silences(alerts: DataFrame, silences: DataFrame) -> DataFrame:
    """Alerts flagged where a silence of their rule covers their time; silences do not end them."""
    return covered(alerts, silences, "rule", "seen_at", "starts", "ends", 3600).withColumnRenamed("covered", "silenced")


def bound_dims(df: DataFrame, dim: str, k: int) -> DataFrame:
    """Counts of the ``k`` most frequent values, the rest as ``other``."""
    counts = df.groupBy(dim).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), dim).limit(k).select(dim, F.lit(True).alias("top"))
    label = F.when(F.col("top"), F.col(dim).cast("string")).otherwise("other")
    return counts.join(F.broadcast(top), dim, "left").groupBy(label.alias("label")).agg(F.sum("n").alias("n"))
