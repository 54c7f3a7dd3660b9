"""Connected components of a graph of any size, in rounds of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.session import materialize


LEAST_HEAVY, MOST_HEAVY = 1_000, 10_000  # a node is heavy with so many edges, and with more than one in MOST_HEAVY of all


def with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` (v, u) with m of their v from ``least`` (v, m, d: edges of v).

    The edges of a heavy node would meet in one task. There are at most 2 * MOST_HEAVY heavy nodes at any size, so their
    rows are sent to all tasks, and only the edges of other nodes are shuffled.
    """
    heavy = F.col("d") > max(LEAST_HEAVY, n // MOST_HEAVY)
    some = edges.join(F.broadcast(least.filter(heavy).select("v", "m")), "v", "left")
    light = some.filter("m is null").select("v", "u").join(least.filter(~heavy).select("v", "m"), "v")
    return some.filter("m is not null").select("v", "u", "m").unionByName(light.select("v", "u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node per node: (node, label), for every node that has an edge.

    ``edges`` has the columns a and b (long), in any order and with repeats. Large and small stars in turn: every node
    hangs its larger (then its smaller) neighbours on the smallest node it knows, until nothing moves. Each round is a
    combining minimum per node and a join; neighbours are never collected, so a node may have any number of them.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = materialize(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count(F.lit(1)).alias("d")))
        large = with_least(both, low, state[0]).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        large = materialize(large)
        least = materialize(large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("d")))
        hung = with_least(large, least, state[0]).select(F.col("u").alias("v"), F.col("m").alias("u"))
        least = least.select("v", F.col("m").alias("u"))
        now = materialize(hung.unionByName(least).filter("v <> u").distinct())
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(roots)
