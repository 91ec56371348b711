"""Joins of many rows with one row a key, and numbering, that no hot key holds up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.storage import cut

HOT = 1000  # a key is hot if it holds more than a HOT-th of all rows, and more than HOT_ROWS
HOT_ROWS = 64
TASK_ROWS = 1 << 20  # rows that one task sorts, where their number is known


def hot_keys(sizes: DataFrame, key: str, total: int) -> list[tuple]:
    """(key, pieces) of the keys of `sizes` (key, n) that hold more than a thousandth of `total` rows.

    There are fewer than HOT such keys whatever the table's size, so the list is bounded.
    """
    most = max(HOT_ROWS, total // HOT)
    return [(r[key], -(-r["n"] // most)) for r in sizes.where(F.col("n") > most).select(key, "n").collect()]


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: list[tuple], how: str = "inner", hint: str | None = None) -> DataFrame:
    """`many` joined with `one` (one row a key) on `key`; rows of the `hot` keys are dealt over as many tasks as they have pieces.

    Only rows of `one` with a hot key are repeated, once a piece.  The table of hot keys
    is broadcast; `hot_keys` bounds it.  `hint` fixes the join's kind, so that plans do not
    change with size.
    """
    if not hot:
        return many.join(one.hint(hint) if hint else one, key, how)
    kind = one.schema[key].dataType.simpleString()
    few = F.broadcast(many.sparkSession.createDataFrame(hot, f"`{key}` {kind}, __pieces int"))
    pieces = F.coalesce("__pieces", F.lit(1))
    dealt = many.join(few, key, "left").withColumn("__piece", F.pmod(F.monotonically_increasing_id(), pieces).cast("int")).drop("__pieces")
    copies = one.join(few, key, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("__pieces")
    return dealt.join(copies.hint(hint) if hint else copies, [key, "__piece"], how).drop("__piece")


def dealt(rows: DataFrame, *keys: str, total: int = 0) -> DataFrame:
    """`rows` over as many tasks as a shuffle has, by the keys if any: one task reads a small file, however much work its rows are.

    The number is given, so that tasks are not merged again by their bytes before rows grow.
    With `total`, the number of rows, it grows with them beyond TASK_ROWS a task.
    """
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS)), *keys)


def numbered(rows: DataFrame, order: list, column: str = "number") -> DataFrame:
    """`rows`, written, with their place (0, 1, ...) in the order; one number a partition reaches the driver."""
    written = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    split = written.withColumn("__part", F.shiftright("__m", 33)).withColumn("__at", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    total, starts = 0, []
    for r in sorted(split.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        starts.append((r["__part"], total))
        total += r["n"]
    before = rows.sparkSession.createDataFrame(starts, "__part long, __before long")
    return split.join(F.broadcast(before), "__part").withColumn(column, F.col("__before") + F.col("__at")).drop("__m", "__part", "__at", "__before")
