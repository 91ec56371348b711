"""Commit logs as text: header lines followed by the files of the commit.

A header is `mark`, author, name and seconds, divided by the unit separator (0x1F); file
names follow, one a line or divided by NUL.  Spark cuts large logs into splits at line ends, so a
file's header may lie in an earlier split: headers are filled forward inside each split, and the last header of a split
is carried over to those behind it that begin without one.  Neither step needs a whole log in one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MARK = "__C__"


def read_commit_log(spark: SparkSession, path: str, mark: str = MARK) -> DataFrame:
    """log, at, author, name, ts (timestamp_ntz), path: a row a commit and file of the logs below `path`.

    at: the header's place in its log.  Names of files use forward slashes.  A header with fewer than three
    fields, or without a number of seconds above zero, drops its files, as do lines before the first
    header; blank lines are skipped; an empty name or author is kept.  An empty log gives no
    rows.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.col("value"))
    # NUL divides like a line end; ids rise along a split
    parts = lines.select("log", "block", "m", F.posexplode(F.split("value", "\u0000")).alias("k", "part")).where("part <> ''")
    head = F.col("part").startswith(mark)
    fields = F.split(F.substring("part", len(mark) + 1, 1 << 30), "\u001f")
    seconds = F.try_element_at(fields, F.lit(3))
    good = (F.size(fields) >= 3) & seconds.rlike(r"^\s*\d+(?:\.\d+)?\s*$")
    commit = F.struct(F.col("block").alias("block"), F.col("m").alias("m"), F.col("k").alias("k"), F.when(good, fields[0]).alias("author"), F.when(good, fields[1]).alias("name"), F.when(good, F.trim(seconds).cast("double")).alias("seconds"))
    marked = parts.withColumn("commit", F.when(head, commit))
    along = W.partitionBy("log", "block").orderBy("m", "k").rowsBetween(W.unboundedPreceding, 0)
    filled = marked.withColumn("last", F.last("commit", ignorenulls=True).over(along))
    # one row a split
    blocks = marked.groupBy("log", "block").agg(F.max("commit").alias("ends"))
    before = blocks.withColumn("carried", F.last("ends", ignorenulls=True).over(W.partitionBy("log").orderBy("block").rowsBetween(W.unboundedPreceding, -1))).select("log", "block", "carried")
    named = filled.where("commit is null").join(before, ["log", "block"]).withColumn("c", F.coalesce("last", "carried")).where("c.seconds > 0")
    at = F.concat_ws(":", F.lpad(F.col("c.block").cast("string"), 19, "0"), F.lpad(F.col("c.m").cast("string"), 19, "0"), F.lpad(F.col("c.k").cast("string"), 10, "0"))
    return named.select("log", at.alias("at"), F.col("c.author").alias("author"), F.col("c.name").alias("name"), F.timestamp_seconds("c.seconds").cast("timestamp_ntz").alias("ts"), F.translate("part", "\\", "/").alias("path"))
