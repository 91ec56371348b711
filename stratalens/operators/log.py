"""The append-only event log: queries, latest-wins state, closing, recent entities.

Log rows: line (place in the log), ts, agent, action, outcome, ckey and others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DEFAULT_LIMIT, MOST = 200, 5000


def query_log(log: DataFrame, since: str | None = None, until: str | None = None, agent: str | None = None, outcome: str | None = None, action: str | None = None, tag: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest first, ends of the period included; at most 5000 rows."""
    for name, value in (("agent", agent), ("outcome", outcome), ("action", action)):
        if value is not None:
            log = log.where(F.col(name) == value)
    if since is not None:
        log = log.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        log = log.where(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    if tag is not None:
        log = log.where(F.array_contains("tags", tag))
    return log.orderBy(F.desc("ts"), "line").limit(min(limit, MOST))


def latest_by_key(log: DataFrame) -> DataFrame:
    """The newest row of each (action, ckey); of equal times the one that stands first in the log.

    An aggregate, so it combines before the shuffle however often a key occurs.
    """
    keep = [c for c in log.columns if c not in ("action", "ckey")]
    best = F.max_by(F.struct(*keep), F.struct("ts", -F.col("line")))
    return log.groupBy("action", "ckey").agg(best.alias("b")).select("action", "ckey", *[f"b.{c}" for c in keep])


def open_items(log: DataFrame, opened: str, closed: str) -> DataFrame:
    """ckey, ts of keys opened and not closed since."""
    now = latest_by_key(log.where(F.col("action").isin(opened, closed)))
    a = now.where(F.col("action") == opened).select("ckey", "ts", "line")
    b = now.where(F.col("action") == closed).select("ckey", F.col("ts").alias("c_ts"), F.col("line").alias("c_line"))
    shut = (F.col("c_ts") > F.col("ts")) | ((F.col("c_ts") == F.col("ts")) & (F.col("c_line") > F.col("line")))
    return a.join(b, "ckey", "left").where(~F.coalesce(shut, F.lit(False))).select("ckey", "ts")


def recent_entities(log: DataFrame, column: str, most: int = 20) -> DataFrame:
    """The most recently touched distinct values with their last time."""
    return log.groupBy(column).agg(F.max("ts").alias("last")).orderBy(F.desc("last"), column).limit(most)


def last_served(log: DataFrame, action: str) -> DataFrame:
    """agent and its last row of an action."""
    return log.where(F.col("action") == action).groupBy("agent").agg(F.max_by("ckey", F.struct("ts", -F.col("line"))).alias("ckey"), F.max("ts").alias("ts"))


def close_target(opened: DataFrame, wanted: str) -> DataFrame:
    """The open item a closing names: by key, else by text.  The match comes before any limit, so every item can be named."""
    tier = F.when(F.col("ckey") == wanted, 0).when(F.col("text") == wanted, 1)
    return opened.withColumn("tier", tier).where("tier is not null").orderBy("tier", F.desc("ts"), "ckey").limit(1).drop("tier")


def validated(log: DataFrame) -> DataFrame:
    """Rows with `valid` and `reason`: lengths and ranges of an event's fields."""
    reason = (
        F.when(F.length("agent") > 64, "agent is too long").when(F.length("action") > 64, "action is too long").when(F.length(F.coalesce("reasoning", F.lit(""))) > 500, "reasoning is too long")
        .when(~F.coalesce("confidence", F.lit(0.0)).between(0, 1), "confidence is out of range").when(F.col("ts").isNull(), "no timestamp")
    )
    return log.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def sessions(log: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """key, start, end, n of bursts of activity with pauses below `gap`, as a debounce groups them."""
    out = log.groupBy(key, F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def counters(log: DataFrame) -> DataFrame:
    """action, outcome, n, agents."""
    return log.groupBy("action", "outcome").agg(F.count("*").alias("n"), F.countDistinct("agent").alias("agents"))


def ring(log: DataFrame, key: str, size: int) -> DataFrame:
    """The latest `size` rows of each key."""
    return log.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("ts"), "line"))).where(F.col("__n") <= size).drop("__n")
