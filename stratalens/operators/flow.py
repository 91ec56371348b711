"""Flow between tiers of files, and the order of messages below an entry point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalens.storage import cut

BOOT = "(boot)"
RETURNS = 1 << 30  # place of a return among its siblings: behind all calls


def boot_edges(nodes: DataFrame, edges: DataFrame, handlers: DataFrame, most: int = 5) -> DataFrame:
    """Edges (src, dst) from a made-up entry node to the handlers (id) that most edges enter; ties by id.

    Handlers that are no node have none.  A caller adds them where a framework starts the program and no
    node is an entry.
    """
    known = handlers.select("id").distinct().join(nodes.select("id"), "id", "left_semi")
    degree = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return known.join(degree, "id", "left").orderBy(F.desc(F.coalesce("n", F.lit(0))), "id").limit(most).select(F.lit(BOOT).alias("src"), F.col("id").alias("dst"))


def tier_edges(nodes: DataFrame, edges: DataFrame, tier: str) -> DataFrame:
    """from_tier, to_tier, links between different tiers; edges with an unknown end drop out."""
    a, b = nodes.select(F.col("id").alias("src"), F.col(tier).alias("from_tier")), nodes.select(F.col("id").alias("dst"), F.col(tier).alias("to_tier"))
    return edges.join(a, "src").join(b, "dst").where("from_tier <> to_tier").groupBy("from_tier", "to_tier").agg(F.count("*").alias("links"))


def tier_paths(links: DataFrame, most: int = 5, longest: int = 5) -> DataFrame:
    """place, tiers, weight of the `most` heaviest paths of 2 to `longest` distinct tiers; ties by the tiers' names.

    links: from_tier, to_tier, links, one row a pair.  A path grows a tier a level.  Before a level, paths go that could
    not reach the weight of the `most`-th best so far even if every further link were the
    heaviest one, so the result is exact and a level holds few rows.
    """
    step = links.select(F.col("from_tier").alias("end"), F.col("to_tier").alias("next"), F.col("links").cast("long").alias("w"))
    step = cut(step.where(F.col("end") != F.col("next")), "tier-links")
    heaviest = step.agg(F.max("w")).first()[0] or 0
    front = cut(step.select(F.array("end", "next").alias("tiers"), F.col("next").alias("end"), F.col("w").alias("weight")), "tier-paths")
    order = (F.desc("weight"), F.col("tiers"))
    best = cut(front.orderBy(*order).limit(most).select("tiers", "weight"), "tier-best")
    for length in range(3, longest + 1):
        least = best.agg(F.when(F.count("*") >= most, F.min("weight"))).first()[0]
        able = front if least is None else front.where(F.col("weight") + heaviest * (longest - length + 1) >= least)
        grown = able.join(step, "end").where(~F.array_contains("tiers", F.col("next")))
        front = cut(grown.select(F.concat("tiers", F.array("next")).alias("tiers"), F.col("next").alias("end"), (F.col("weight") + F.col("w")).alias("weight")), "tier-paths")
        best = cut(best.unionAll(front.select("tiers", "weight")).orderBy(*order).limit(most), "tier-best")
    return best.select(F.row_number().over(W.orderBy(*order)).alias("place"), "tiers", "weight")  # `most` rows


def sequence_flow(nodes: DataFrame, edges: DataFrame, entry: str, max_depth: int = 6, max_branches: int = 4, max_messages: int = 60) -> DataFrame:
    """step, src, dst, depth, is_cycle, is_return, truncated of the messages below `entry`, depth first.

    A node calls its successors, those that most edges enter first, then by id, at most
    `max_branches`.  A call to a node on the way from the entry is a cycle and not followed.  A
    node that was followed and has successors returns.  Calls are counted together with returns; the first
    `max_messages` messages say which calls stay, and every call that stays returns.  truncated: whether a limit left
    anything out.

    Levels grow by joins of at most max_branches ** max_depth rows; a row's place in the
    depth-first order is the array of its ancestors' ranks, by which all messages are
    numbered at the end.
    """
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    entered = inside.groupBy(F.col("dst")).agg(F.count("*").alias("n_in"))
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("n_in"), "dst", "u"))
    ranked = inside.select("src", "dst", F.monotonically_increasing_id().alias("u")).join(entered, "dst").withColumn("rank", rank)
    out = ranked.groupBy("src").agg(F.count("*").alias("n_out"))
    calls = cut(ranked.where(F.col("rank") <= max_branches).join(out.withColumnRenamed("src", "dst").withColumnRenamed("n_out", "below"), "dst", "left").join(out, "src").select("src", "dst", "rank", "n_out", F.coalesce("below", F.lit(0)).alias("below")), "sequence-calls")
    level = calls.where(F.col("src") == entry).select(F.array("rank").alias("key"), F.array("src").alias("way"), "src", "dst", "n_out", "below", F.lit(0).alias("depth"))
    rows = None
    for depth in range(max_depth):
        level = cut(level.withColumn("is_cycle", F.array_contains("way", F.col("dst")) & (F.lit(depth > 0) | (F.col("dst") == entry))), "sequence-level")
        rows = level if rows is None else rows.unionAll(level)
        if depth == max_depth - 1:
            break
        on = level.where("not is_cycle").select("key", F.concat("way", F.array("dst")).alias("way"), F.col("dst").alias("src"))
        level = on.join(calls, "src").select(F.concat("key", F.array("rank")).alias("key"), "way", "src", "dst", "n_out", "below", F.lit(depth + 1).alias("depth"))
    messages = rows.select("key", "src", "dst", "depth", "is_cycle", F.lit(False).alias("is_return"), "n_out", "below", "key").toDF("key", "src", "dst", "depth", "is_cycle", "is_return", "n_out", "below", "call")
    back = rows.where("not is_cycle and below > 0").select(F.concat("key", F.array(F.lit(RETURNS))).alias("key"), F.col("dst").alias("src"), F.col("src").alias("dst"), "depth", F.lit(False).alias("is_cycle"), F.lit(True).alias("is_return"), "n_out", "below", F.col("key").alias("call"))
    numbered = messages.unionAll(back).withColumn("at", F.row_number().over(W.orderBy("key")))
    numbered = cut(numbered, "sequence-messages")
    stay = numbered.where((~F.col("is_return")) & (F.col("at") <= max_messages)).select("call")
    kept = numbered.join(stay, "call", "left_semi")
    dropped = F.lit(numbered.where("not is_return").count() > stay.count())
    cut_off = (~F.col("is_return")) & (((F.col("depth") == max_depth - 1) & ~F.col("is_cycle")) | (F.col("n_out") > max_branches))
    flagged = kept.agg(F.coalesce(F.max(cut_off), F.lit(False)).alias("truncated"))
    numbered = kept.select(F.row_number().over(W.orderBy("key")).alias("step"), "src", "dst", "depth", "is_cycle", "is_return")
    return numbered.crossJoin(F.broadcast(flagged)).withColumn("truncated", F.col("truncated") | dropped)  # one row
