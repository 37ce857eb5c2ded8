"""Window operators over observations, events, runs and ledgers (family F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.runtime import saved


def latest_by(df: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    """(keys, value, considered, conflict): the value that comes first in ``order``, by one aggregation without a sort."""
    one = F.min_by(value, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(one.alias(value), F.count(F.lit(1)).alias("considered"), (F.min(value) != F.max(value)).alias("conflict"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def status_projection(obs: DataFrame, key: str, value: str, order: list) -> DataFrame:
    """The projected value by the rule order, how many were considered, and whether they conflict."""
    return latest_by(obs, [key], value, order)


def changes(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from the one before of their key; a first row is a change."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("previous", before).filter(F.col("previous").isNull() | (F.col("previous") != F.col(value)))


def latest_state(events: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of each resource, whatever the arrival order."""
    return first_by(events, [key], [F.col(version).desc()])


def monotonic(events: DataFrame, key: str, version: str, arrival: list[str]) -> DataFrame:
    """Events whose version exceeds all that arrived before."""
    w = Window.partitionBy(key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("__top", F.max(version).over(w)).filter(F.col("__top").isNull() | (F.col(version) > F.col("__top"))).drop("__top")


def version_gaps(events: DataFrame, key: str, version: str) -> DataFrame:
    """Versions that follow a gap, with the version before it."""
    before = F.lag(version).over(Window.partitionBy(key).orderBy(version))
    return events.withColumn("previous_version", before).filter(F.col(version) - F.col("previous_version") > 1)


def islands(df: DataFrame, key: str, order: list[str], holds: Column) -> DataFrame:
    """Rows with ``island``: the number of the run of equal ``holds`` that they are in."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("holds", holds)
    turned = F.when(F.lag("holds").over(w).eqNullSafe(F.col("holds")), 0).otherwise(1)
    return marked.withColumn("__turn", turned).withColumn("island", F.sum("__turn").over(w)).drop("__turn")


def runs(df: DataFrame, key: str, order: list[str], holds: Column, keep: int = 1, width_s: int = 86_400) -> DataFrame:
    """Runs of rows of a key in which ``holds``: key, first_at, last_at, length, head (the first ``keep`` rows' order), preceded.

    The first column of ``order`` is a time; a null ``holds`` does not hold.
    Rows are dealt by key and time bin, so that no task sorts the history of a
    key. Runs inside a bin are whole; those at its edges are stitched with
    those of the next bin that has rows, by one row or two for each bin.
    ``preceded`` tells whether the key has a row before the run.
    """
    place = F.struct(*order)
    bins = F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / (width_s * 1_000_000))
    rows = df.select(F.col(key), F.coalesce(holds, F.lit(False)).alias("__holds"), place.alias("__at"), bins.alias("__bin"))
    inside = Window.partitionBy(key, "__bin").orderBy("__at")
    turned = F.when(F.lag("__holds").over(inside) == F.col("__holds"), 0).otherwise(1)
    rows = rows.withColumn("__turn", turned).withColumn("__island", F.sum("__turn").over(inside))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__bin", "__island").orderBy("__at")))
    parts = rows.groupBy(key, "__bin", "__island", "__holds").agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.count(F.lit(1)).alias("length"), F.array_sort(F.collect_list(F.when(F.col("__n") <= keep, F.col("__at")))).alias("head"))
    parts = saved(parts.withColumn("__edge", (F.col("__island") == 1) | (F.col("__island") == F.max("__island").over(Window.partitionBy(key, "__bin")))))
    shown = [F.col(key), F.col("first")[order[0]].alias("first_at"), F.col("last")[order[0]].alias("last_at"), "length", "head", "preceded"]
    closed = parts.filter("NOT __edge AND __holds").withColumn("preceded", F.lit(True)).select(*shown)
    along = Window.partitionBy(key).orderBy("__bin", "__island")
    goes_on = (F.lag("__holds").over(along) == F.col("__holds")) & (F.lag("__bin").over(along) != F.col("__bin"))
    edges = parts.filter("__edge").withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(along))
    before = F.sum("length").over(Window.partitionBy(key, "__run").orderBy("__bin", "__island").rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumn("__early", F.coalesce(before, F.lit(0)) < keep).filter("__holds")
    heads = F.slice(F.array_sort(F.flatten(F.collect_list(F.when(F.col("__early"), F.col("head"))))), 1, keep)
    stitched = edges.groupBy(key, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length"), heads.alias("head"))
    return closed.unionByName(stitched.withColumn("preceded", F.col("__run") > 1).select(*shown))


def consecutive(df: DataFrame, key: str, order: list[str], holds: Column, n: int, width_s: int = 86_400) -> DataFrame:
    """Runs of at least ``n`` rows in which ``holds``: key, first_at, last_at, length."""
    return runs(df, key, order, holds, 1, width_s).filter(F.col("length") >= n).drop("head", "preceded")


def to_intervals(df: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """Half-open validity from a change log; the last interval is open."""
    return df.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(Window.partitionBy(key).orderBy(*order)))


def overlaps(df: DataFrame, key: str, low: str, high: str, tie: str) -> DataFrame:
    """Intervals that begin before an earlier one of their key has ended."""
    w = Window.partitionBy(key).orderBy(low, tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("latest_end", F.max(F.coalesce(high, F.lit("9999-12-31").cast("date"))).over(w)).filter(F.col(low) < F.col("latest_end"))


def stage_durations(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Seconds from each event to the next of its trace; null for the last."""
    after = F.lead(at).over(Window.partitionBy(key).orderBy(at, tie))
    return df.withColumn("seconds", (F.unix_micros(F.to_timestamp(after)) - F.unix_micros(F.to_timestamp(at))) / 1e6)


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: str) -> DataFrame:
    """``df`` with ``running``: the sum of a key up to each row.

    ``order`` begins with a time. Sums by day give what came before a day, so a
    task holds a day of a key and not all of it.
    """
    dated = df.withColumn("__day", F.to_date(order[0]))
    daily = dated.groupBy(*keys, "__day").agg(F.sum(amount).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    daily = daily.select(*keys, "__day", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum(amount).over(Window.partitionBy(*keys, "__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dated.join(daily, [*keys, "__day"]).withColumn("running", F.col("__before") + inside).drop("__day", "__before")


def sustained(df: DataFrame, key: str, order: list[str], holds: Column, seconds: int) -> DataFrame:
    """Runs of rows in which ``holds`` that last at least so long: key, first_at, last_at, length."""
    runs = consecutive(df, key, order, holds, 1)
    return runs.filter(F.unix_micros(F.to_timestamp("last_at")) - F.unix_micros(F.to_timestamp("first_at")) >= seconds * 1_000_000)


def recovered(df: DataFrame, key: str, order: list[str], good: Column, k: int, width_s: int = 86_400) -> DataFrame:
    """(key, order): rows at which ``good`` holds for the ``k``-th time in a row after it had not."""
    found = runs(df, key, order, good, k, width_s).filter((F.col("length") >= k) & F.col("preceded"))
    return found.select(key, F.get("head", F.lit(k - 1)).alias("__at")).select(key, *[F.col("__at")[c].alias(c) for c in order])


def concurrency(df: DataFrame, key: str, start: str, end: str, most: int) -> DataFrame:
    """(key, at, running): times at which more than ``most`` intervals of a key are open (half-open intervals)."""
    steps = df.select(key, F.col(start).alias("at"), F.lit(1).alias("step")).union(df.select(key, F.col(end), F.lit(-1)))
    total = steps.groupBy(key, "at").agg(F.sum("step").alias("step"))
    running = F.sum("step").over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return total.withColumn("running", running).filter(F.col("running") > most).select(key, "at", "running")


def rate_violations(df: DataFrame, key: str, at: str, n: int, seconds: int) -> DataFrame:
    """Events with more than ``n`` of their key in the seconds up to them."""
    second = F.floor(F.unix_micros(F.to_timestamp(at)) / 1_000_000)
    w = Window.partitionBy(key).orderBy("__second").rangeBetween(-seconds + 1, 0)
    return df.withColumn("__second", second).withColumn("in_window", F.count(F.lit(1)).over(w)).filter(F.col("in_window") > n).drop("__second")


def backoff(df: DataFrame, key: str, order: list[str], retry_after: str | None = None, base: int = 30, most: int = 3600, tries: int = 5) -> DataFrame:
    """Seconds to wait after each attempt, doubled up to the limit; the last try leads to dead letter.

    A column ``retry_after`` of seconds that the server asked for wins over the schedule where it is set.
    """
    attempt = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    wait = F.least(F.lit(base) * F.pow(F.lit(2), F.least(F.col("attempt"), F.lit(20)) - 1), F.lit(most)).cast("long")
    wait = F.coalesce(F.col(retry_after).cast("long"), wait) if retry_after else wait
    return df.withColumn("attempt", attempt).withColumn("dead_letter", F.col("attempt") >= tries).withColumn("wait_s", F.when(~F.col("dead_letter"), wait))


def moving_anomaly(daily: DataFrame, key: str, day: str, n: str, before: int, k: float) -> DataFrame:
    """Days whose count lies more than ``k`` deviations from the mean of the days before."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(-before, -1)
    scored = daily.withColumn("mean", F.avg(n).over(w)).withColumn("deviation", F.stddev_samp(n).over(w))
    # Rounded, so that a count right on the limit is one on every machine.
    return scored.filter(F.round(F.abs(F.col(n) - F.col("mean")), 9) > F.round(k * F.col("deviation"), 9))


def illegal_transitions(df: DataFrame, key: str, state: str, order: list[str], allowed: set[tuple[str, str]]) -> DataFrame:
    """Steps from one state to another that the table does not allow."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    pairs = F.concat_ws(">", "previous", state)
    return df.withColumn("previous", before).filter(F.col("previous").isNotNull() & ~pairs.isin(*[f"{a}>{b}" for a, b in sorted(allowed)]))


def version_conflicts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Decisions after the first on the same expected version."""
    return df.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("attempt > 1")
