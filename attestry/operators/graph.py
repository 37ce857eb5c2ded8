"""Iterative operators on edges, with each round written to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.runtime import hot_keys, join_split, saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge; the component is its least node.

    Each round takes the least label among neighbours and then the label of
    that label, so the rounds grow with the logarithm of the diameter. Nodes
    with very many edges and labels with very many nodes are not shuffled to
    one task: what they join is broadcast. Rows with a null end are ignored;
    loops only add their node.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    links = saved(ends.union(ends.select("v", "u")).distinct())
    hubs = hot_keys(links, "v")
    labels = saved(links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"), F.lit(True).alias("moved")))
    for _ in range(max_rounds):
        near = join_split(links, labels.select(F.col("node").alias("v"), "component"), "v", hubs).groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        step = saved(step)
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("further"))
        jumped = join_split(step, jump, "new", hot_keys(step, "new"))
        labels = saved(jumped.select("node", F.least("new", "further").alias("component"), (F.least("new", "further") != F.col("old")).alias("moved")))
        if labels.filter("moved").isEmpty():
            return labels.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def lineage(edges: DataFrame, start: DataFrame, depth: int | None = None, steps: int = 8) -> DataFrame:
    """(start, node, depth): all that ``start`` (column node) leads to along ``edges`` (from_id, to_id), by the least number of steps.

    What is new after a few steps is written and goes on, until nothing is new
    or ``depth`` is reached; cycles end and chains may have any length.
    """
    edges = saved(edges.select(F.col("from_id").alias("node"), "to_id").dropna().distinct())
    begun = saved(start.select("node").dropna().distinct().select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")))
    found, front, at = [begun], begun, 0
    while depth is None or at < depth:
        reached, level = [], front
        upto = at + steps if depth is None else min(at + steps, depth)
        for k in range(at + 1, upto + 1):
            level = level.join(edges, "node").select("start", F.col("to_id").alias("node")).distinct().withColumn("depth", F.lit(k))
            reached.append(level)
        near = reduce(DataFrame.unionByName, reached).groupBy("start", "node").agg(F.min("depth").alias("depth"))
        seen = reduce(DataFrame.unionByName, found).select("start", "node")
        new = saved(near.join(seen, ["start", "node"], "left_anti"))
        if new.isEmpty():
            break
        found.append(new)
        front, at = new.filter(F.col("depth") == upto), upto
        if len(found) > 16:  # many small tables are written as one
            found = [saved(reduce(DataFrame.unionByName, found))]
    return reduce(DataFrame.unionByName, found)


def cycle_rest(edges: DataFrame) -> DataFrame:
    """Edges (flow, a, b) on a cycle of their flow or on a way from one cycle to another.

    Nodes without a way in or out are taken away again and again. So that long
    chains end soon, nodes with one way in and one way out are drawn out of
    their chain, no two neighbours at a time: an edge stands for those before
    it, which share its fate. A flow without a cycle leaves nothing.
    """
    every = edges.select("flow", "a", "b").dropna().distinct()
    every = saved(every.withColumn("edge", F.struct("a", "b", F.lit(0).alias("round"))))
    left, merged, number = every, [], 0
    while True:
        number += 1
        n = left.count()
        into, out = left.select("flow", F.col("b").alias("a")).distinct(), left.select("flow", F.col("a").alias("b")).distinct()
        left = saved(left.join(into, ["flow", "a"], "left_semi").join(out, ["flow", "b"], "left_semi").select("flow", "a", "b", "edge"))
        ins = left.groupBy("flow", F.col("b").alias("x")).agg(F.count(F.lit(1)).alias("n_in"), F.min("a").alias("p"), F.min("edge").alias("first"))
        outs = left.groupBy("flow", F.col("a").alias("x")).agg(F.count(F.lit(1)).alias("n_out"), F.min("b").alias("q"), F.min("edge").alias("second"))
        inner = saved(ins.join(outs, ["flow", "x"]).filter("n_in = 1 AND n_out = 1 AND p <> x AND q <> x").select("flow", "x", "p", "q", "first", "second"))
        draw = lambda c: F.struct(F.xxhash64(F.lit(number), "flow", c), F.col(c))
        lots = inner.select("flow", "x")
        lower = lambda c: lots.select("flow", F.col("x").alias(c), F.lit(True).alias(f"{c}_inner"))
        beside = inner.join(lower("p"), ["flow", "p"], "left").join(lower("q"), ["flow", "q"], "left")
        free = (F.col("p_inner").isNull() | (draw("x") < draw("p"))) & (F.col("q_inner").isNull() | (draw("x") < draw("q")))
        drawn = saved(beside.filter(free).select("flow", "p", "q", "first", "second", F.struct(F.col("x").alias("a"), F.col("x").alias("b"), F.lit(number).alias("round")).alias("edge")))
        if drawn.isEmpty() and left.count() == n:
            break
        gone = drawn.select("flow", "edge", F.explode(F.array("first", "second")).alias("old"))
        merged.append(saved(gone))
        kept = left.join(gone.select("flow", F.col("old").alias("edge")), ["flow", "edge"], "left_anti")
        left = saved(kept.select("flow", "a", "b", "edge").unionByName(drawn.select("flow", F.col("p").alias("a"), F.col("q").alias("b"), "edge")))
    rest = left.select("flow", "edge")
    for gone in reversed(merged):
        parts = rest.join(gone, ["flow", "edge"]).select("flow", F.col("old").alias("edge"))
        rest = saved(rest.join(gone.select("flow", "edge").distinct(), ["flow", "edge"], "left_anti").unionByName(parts))
    return rest.select("flow", "edge.a", "edge.b")
