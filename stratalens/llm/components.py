"""Connected components of an edge table by alternating star contraction.

Every round runs two joins over the edges and writes them, so no neighbour list and
no component is ever gathered in one task: the least neighbour is an aggregate that
combines before the shuffle, and the edges of a busy node (more than a thousandth of
all) are dealt over several tasks.  Rounds grow with the logarithm of the longest chain.

Defined results: loops and repeated edges are allowed; nodes without an edge do not
appear; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .util import cut, hot_keys, spread_join


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _look(edges: DataFrame, total: int) -> tuple[bool, list[tuple]]:
    """Whether `edges` (a > b) are stars around least nodes, and the busy nodes; one job."""
    degrees = _both_ways(edges).groupBy("a").agg(F.count("*").alias("n"), F.count(F.when(F.col("b") < F.col("a"), 1)).alias("less"))
    seen = Observation()
    bent = (F.col("less") > 1) | ((F.col("less") == 1) & (F.col("n") > 1))
    busy = hot_keys(degrees.observe(seen, F.max(bent.cast("int")).alias("bent")), "a", total)
    return not seen.get["bent"], busy


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (least node of its component) for the nodes of `edges` (a, b longs)."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    total = now.count()
    done, busy = _look(now, total) if total else (True, [])
    for _ in range(max_rounds):
        if done:
            break
        # large star: larger neighbours of each node move to its least neighbour
        two = _both_ways(now)
        least = two.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = spread_join(two.where("b > a"), least, "a", busy).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(moved.where("a <> b").distinct(), "components")
        # small star: smaller neighbours and the node itself move to the least of them; a
        # node has no more of these than it had neighbours, so the busy ones are among those known
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        moved = spread_join(now, least, "a", busy).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        now = cut(moved.where("a <> b").distinct(), "components")
        done, busy = _look(now, total)
    else:
        if not done:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
