"""Connected components and what is derived from them (GRF-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.session import checkpoint_root

#: A key is hot if it has more than this part of all rows, and more than the least number; so at most a thousand keys are.
HOT_PART, HOT_LEAST = 1 / 1000, 200


def hot_limit(total: int) -> float:
    return max(total * HOT_PART, HOT_LEAST)


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, limit: float) -> DataFrame:
    """``rows`` with the columns of ``keyed`` (one row a key, and in column ``n`` how many of ``rows`` have it). Keys of
    more than ``limit`` rows, a thousand at most with ``hot_limit``, are broadcast, so that no task gathers the rows of one;
    the others meet by a shuffle."""
    hot = keyed.where(F.col("n") > limit).drop("n")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col("n") <= limit).drop("n"), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))




def _state(edges: DataFrame) -> tuple:
    """Count and hash sum of the edges, and the most that one node has."""
    both = edges.select("a", F.xxhash64("a", "b").cast("decimal(38,0)").alias("h")).unionAll(edges.select(F.col("b"), F.lit(0).cast("decimal(38,0)")))
    row = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("n").alias("most")).first()
    return (row["n"] or 0) // 2, row["h"], row["most"] or 0


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the graph over edges (a, b): rows (node, component), component = least node reachable.

    Alternates large-star and small-star rounds, which need O(log^2 n) rounds at most on any shape. Minima are partial
    aggregates, and hubs of over a thousandth of the edges get theirs by broadcast, so a hub is never gathered in one task.
    Each round is checkpointed; only counts and hash sums reach the driver. Nodes without an edge are not returned; self
    loops and null ends are ignored.
    """
    checkpoint_root(edges.sparkSession)
    edges = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    before = _state(edges)
    if before[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        limit = hot_limit(before[0])
        own = [F.min("b").alias("m"), F.count(F.lit(1)).alias("n")]

        def joined(rows: DataFrame, keyed: DataFrame, limit=limit, hubs=before[2] > limit) -> DataFrame:
            return join_counted(rows, keyed, "a", limit) if hubs else rows.join(keyed.drop("n"), "a")

        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(*own).select("a", F.least("a", "m").alias("m"), "n")
        large = joined(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(*own)
        small = joined(large, low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.union(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        after = _state(edges)
        if after[:2] == before[:2]:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
