"""Connected components by random-order contraction.

Every round hooks each node to the neighbour (or itself) with the smallest salted hash and contracts the
graph along the hooks, so nodes and edges shrink geometrically whatever the shape of the components (chains
included).  Labels travel back through one join per round on the hook column, whose multiplicity is a node's
degree in that round, never a component's size: no join key grows with a hot component.

What a round hands on is a written table: a checkpoint remembers how its plan was partitioned, in every name that a column
had, and planning takes several times longer with every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.lineage import written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``(node, component)`` where component is the smallest node reachable.

    Direction, repeats and self-loops do not matter; rows with a null end are ignored.  Only nodes that
    occur in an edge between two different nodes are returned; an empty input gives an empty result.
    """
    edges, path = written(edges.select("u", "v").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    low = None  # smallest original node behind each contracted node; None while nodes are originals
    hooks: list[DataFrame] = []
    for salt in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        hook = both.groupBy("u").agg(F.least(F.min(order("v")), F.first(order("u")))["n"].alias("to"))
        hook = hook.withColumn("low", F.col("u")) if low is None else hook.join(low, "u", "left").withColumn("low", F.coalesce("low", "u"))
        hook, _ = written(hook)
        low = _lows(hook).withColumnRenamed("component", "low")
        hooks.append(hook)
        a = hook.select("u", F.col("to").alias("a"))
        b = hook.select(F.col("u").alias("v"), F.col("to").alias("b"))
        moved = edges.join(a, "u").join(b, "v").where("a <> b")
        edges, path = written(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), path)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if low is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label, path = _lows(hooks[-1]), None
    for k in range(len(hooks) - 1, -1, -1):
        label = hooks[k].select("u", "to").join(label.withColumnRenamed("u", "to"), "to").select("u", "component")
        if k:  # targets of the round before that have no edges left are complete components
            done = _lows(hooks[k - 1]).withColumnRenamed("component", "settled")
            label = done.join(label, "u", "left").select("u", F.coalesce("component", "settled").alias("component"))
        label, path = written(label, path)  # one small plan a round: a chain of all rounds is a plan that the driver can hardly hold
    return label.select(F.col("u").alias("node"), "component")


def _lows(hook: DataFrame) -> DataFrame:
    """The smallest original node behind each target of a round."""
    return hook.groupBy(F.col("to").alias("u")).agg(F.min("low").alias("component"))
