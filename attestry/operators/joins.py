"""Joins of records, votes, intervals, versions and lineage (family D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def roll_call(members: DataFrame, votes: DataFrame, keys: list[str], vote: str = "vote") -> DataFrame:
    """Every member with a vote or ``not_recorded``: absence of a row is not an absence."""
    return members.join(votes, keys, "left").withColumn(vote, F.coalesce(vote, F.lit("not_recorded")))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str, labels=("only_left", "only_right", "equal", "different")) -> DataFrame:
    """Full outer comparison of one value by key, with a label for each row."""
    left = a.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("in_left"))
    right = b.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("in_right"))
    label = F.when(F.col("in_right").isNull(), labels[0]).when(F.col("in_left").isNull(), labels[1]).when(F.col("left_value").eqNullSafe(F.col("right_value")), labels[2]).otherwise(labels[3])
    return left.join(right, keys, "full").select(*keys, "left_value", "right_value", label.alias("label"))


def new_or_changed(batch: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key (with its hash) was not seen before."""
    return batch.join(seen.select(*keys).distinct(), keys, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows with a foreign key that has no parent; a null key is no orphan."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def resolve_identifier(query: DataFrame, ids: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Candidates of a contextual key, null-safe; the number alone is never a key."""
    right = ids.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(id_col).alias("candidate"))
    return query.join(right, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys], "left").drop(*[f"r_{k}" for k in keys])


def valid_at(facts: DataFrame, members: DataFrame, key: str, at: str) -> DataFrame:
    """Facts with the memberships in force at their time (half-open); kept without one."""
    right = members.withColumnRenamed(key, "m_key")
    on = (F.col(key) == F.col("m_key")) & (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return facts.join(right, on, "left").drop("m_key")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, right_at: str, tie: str) -> DataFrame:
    """The last right value at or before each left row's time, by key: one shuffle, no pairs."""
    a = left.select(F.col(key), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).alias("__tie"), F.lit(None).alias("__value"), F.struct(*left.columns).alias("__row"))
    b = right.select(F.col(key), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.struct(F.col(value).alias("v")).alias("__value"), F.lit(None).alias("__row"))
    w = Window.partitionBy(key).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("__seen", F.last("__value", ignorenulls=True).over(w))
    return seen.filter("__side = 1").select("__row.*", F.col("__seen.v").alias(f"{value}_as_of"))


def within_range(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str) -> DataFrame:
    """Points inside ranges of the same key, ends included."""
    right = ranges.withColumnRenamed(key, "r_key")
    return points.join(right, (F.col(key) == F.col("r_key")) & F.col(point).between(F.col(low), F.col(high))).drop("r_key")


def binned_range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points inside half-open ranges without a common key: ranges are dealt to the bins they touch."""
    binned = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return points.withColumn("__bin", F.floor(F.col(point) / width)).join(binned, "__bin").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bin")


def via_bridge(a: DataFrame, bridge: DataFrame, b: DataFrame, a_key: str, b_key: str, label: str) -> DataFrame:
    """Each left key once, with the distinct right labels that the bridge leads to."""
    links = bridge.select(a_key, b_key).distinct().join(b, b_key)
    return a.select(a_key).distinct().join(links, a_key, "left").groupBy(a_key).agg(F.countDistinct(label).alias("n_linked"), F.array_sort(F.collect_set(label)).alias("linked"))


def supersedes(revisions: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Each revision beside the one before it."""
    before = revisions.select(F.col(key), (F.col(seq) + 1).alias(seq), *[F.col(c).alias(f"previous_{c}") for c in columns])
    return revisions.select(key, seq, *columns).join(before, [key, seq], "left")


def coverage_grid(rows: DataFrame, keys: DataFrame, classes: DataFrame, on: list[str]) -> DataFrame:
    """Every key of every class with its count, gaps shown as 0 observed."""
    found = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("observed"))
    return keys.crossJoin(F.broadcast(classes)).join(found, on, "left").withColumn("gap", F.col("observed").isNull()).withColumn("observed", F.coalesce("observed", F.lit(0)))


def title_candidates(titles: DataFrame, title: str, most: int) -> DataFrame:
    """(title, other, distance): pairs of different titles within ``most`` edits, for review; never a link.

    Equal titles are one. A title is cut into ``most`` + 1 segments, of which
    any title within ``most`` edits holds one unchanged and shifted by ``most``
    places at most; titles meet by those and are then measured.
    """
    distinct = titles.select(F.col(title).alias("title")).filter(F.col("title").isNotNull()).distinct()
    cut = most + 1
    edge = lambda n, k: F.floor(n * k / cut)
    own = F.array(*[F.struct(F.lit(k).alias("k"), F.length("title").alias("n"), F.col("title").substr((edge(F.length("title"), F.lit(k)) + 1).cast("int"), (edge(F.length("title"), F.lit(k + 1)) - edge(F.length("title"), F.lit(k))).cast("int")).alias("part")) for k in range(cut)])
    kept = distinct.select(F.col("title").alias("other"), F.explode(own).alias("s")).select("other", "s.*")
    n, k = F.col("n"), F.col("k")
    asked = distinct.withColumn("n", F.explode(F.sequence(F.greatest(F.length("title") - most, F.lit(0)), F.length("title") + most)))
    asked = asked.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(cut)]))).withColumn("at", F.explode(F.array(*[F.lit(i) for i in range(-most, most + 1)])))
    place = edge(n, k) + F.col("at")
    asked = asked.filter((place >= 0) & (place <= F.length("title"))).select("title", "n", "k", F.col("title").substr((place + 1).cast("int"), (edge(n, k + 1) - edge(n, k)).cast("int")).alias("part")).distinct()
    pairs = asked.join(kept, ["k", "n", "part"]).filter(F.col("title") < F.col("other")).select("title", "other").distinct()
    return pairs.withColumn("distance", F.levenshtein("title", "other", most).cast("int")).filter("distance >= 0")


def enrich_secondary(official: DataFrame, secondary: DataFrame, key: str, value: str) -> DataFrame:
    """Official values untouched, secondary ones beside them with a flag where they disagree."""
    right = secondary.select(key, F.col(value).alias(f"secondary_{value}"))
    return official.join(right, key, "left").withColumn("disagrees", F.col(value) != F.col(f"secondary_{value}"))


def covered(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width_s: int) -> DataFrame:
    """``points`` with ``covered``: whether an interval of their key holds their time (half-open).

    Intervals are dealt to the bins of ``width_s`` seconds that they touch. In a
    bin a point is covered if the greatest end of what began up to it lies
    after it, so no pairs of points and intervals are made.
    """
    second = lambda c: F.unix_micros(F.to_timestamp(c))
    width = width_s * 1_000_000
    spans = intervals.select(F.col(key), second(start).alias("__t"), second(end).alias("__end")).filter("__end > __t")
    spans = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__t") / width), F.floor((F.col("__end") - 1) / width))))
    rows = points.select(F.col(key), second(at).alias("__t"), F.lit(None).cast("long").alias("__end"), F.struct(*points.columns).alias("__row")).withColumn("__bin", F.floor(F.col("__t") / width))
    both = rows.unionByName(spans.withColumn("__row", F.lit(None)), allowMissingColumns=True)
    w = Window.partitionBy(key, "__bin").orderBy("__t", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("covered", F.coalesce(F.max("__end").over(w) > F.col("__t"), F.lit(False)))
    return seen.filter("__row IS NOT NULL").select("__row.*", "covered")
