"""Mixing sources to target weights: capped water-filling, seeded repetitions.

DataFrame functions only.  A source's target is its weighted share of the budget,
clamped at `max_epochs` times its size; what the clamp leaves over goes to the other
sources by weight until none is above its cap.  With sources in order of
cap / weight, the clamped ones are a prefix of that order, so the fixed point is
found by running sums over one small row per source instead of a loop.

Each source then takes its target as whole repetitions of all its documents plus
one fractional repetition: documents in a seeded order until the target is met.
Equal rows are one group with a count, made by a combining aggregate, so neither null ids nor
repeated rows meet in one task.  The order of the groups is cut into hash buckets whose sums are
made before any shuffle of single groups, so no source meets in one task, however large it
is.  The windows that fill the targets see one row of five numbers a source in one task, which
bounds the number of sources to some tens of millions; documents never meet there.  The one
document on the border is taken in part, so a source takes its target to within a
word.

Defined results: null text counts 0 words; null source is a source of its own, after
all others; sources without words and an empty table have target 0; repeated rows
are separate documents, interchangeable, of which those counted first are taken first; a null doc_id is
kept; very long texts are counted whole; columns other than those named are ignored, whatever
their names, but for those that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .util import cut

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
PIECE = 1000  # equal rows that one task gives out at a time


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: float) -> DataFrame:
    """`sources` (sk, sn, source_size), one row per source -> the same with `target`."""
    by_name = W.orderBy(F.col("sn"), F.col("sk"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("w", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = W.orderBy(F.col("ratio"), F.col("sn"), F.col("sk"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    filled = (
        ranked.withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("rest", F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", F.col("rest") / F.col("rest_w"))
        .withColumn("pos", F.row_number().over(order))
    )
    free = F.when(F.col("level") <= F.col("ratio"), F.struct("pos", "level"))
    return filled.withColumn("first_free", F.min(free).over(whole)).select(
        "sk", "sn", "source_size",
        F.when(F.col("pos") >= F.col("first_free.pos"), F.least("cap", F.col("first_free.level") * F.col("w"))).otherwise(F.col("cap")).alias("target"),
    )


def _taken(groups: DataFrame, order: list[str], weights: tuple[float, ...], budget: float, max_epochs: float) -> DataFrame:
    """`groups` (sk, sn, size, copies, h, others) with source_size, target, epochs (whole repetitions of all rows) and part.

    part: words that the group takes of the fractional repetition, between 0 and size * copies.  Groups of a
    source stand in the order of h, then of the columns `order`.
    """
    sized = groups.withColumn("b", F.pmod(F.xxhash64("h"), F.lit(BUCKETS)).cast("int")).withColumn("words", F.col("size") * F.col("copies"))
    buckets = sized.groupBy("sk", "sn", "b").agg(F.sum("words").alias("bucket_size"))
    targets = water_fill(buckets.groupBy("sk", "sn").agg(F.sum("bucket_size").alias("source_size")), weights, budget, max_epochs)
    # at most BUCKETS rows of a source stand in one task here
    prefix = F.coalesce(F.sum("bucket_size").over(W.partitionBy("sk", "sn").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = (
        buckets.withColumn("prefix", prefix)
        .join(targets, ["sk", "sn"])
        .withColumn("epochs", epochs)
        .withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size") - F.col("prefix"))
        .select("sk", "sn", "b", "source_size", "target", "epochs", "left")
    )
    run = F.sum("words").over(W.partitionBy("sk", "sn", "b").orderBy("h", *order).rowsBetween(W.unboundedPreceding, -1))
    room = F.col("left") - F.coalesce(F.col("run"), F.lit(0))
    part = F.greatest(F.lit(0.0), F.least(F.col("words").cast("double"), room))
    return sized.withColumn("run", run).join(plan, ["sk", "sn", "b"]).withColumn("part", part)


def _source(docs: DataFrame) -> list[Column]:
    return [F.coalesce("source", F.lit("")).alias("sk"), F.col("source").isNull().alias("sn"), word_count(F.col("text")).alias("size")]


def _dealt(rows: DataFrame, most: int | None, key: list[str]) -> DataFrame:
    """`rows` as often as their column __n says, numbered from 0 in __at; `most` is the largest __n.

    Rows of many repeats are dealt over tasks in pieces first, so that none gives out all of them.
    """

    def counted(df: DataFrame, first: Column, last: Column) -> DataFrame:
        return df.withColumn("__at", F.explode(F.sequence(first, last - 1))).drop("__n", "__piece")

    small = counted(rows.where(F.col("__n") <= PIECE), F.lit(0).cast("long"), F.col("__n"))
    if not most or most <= PIECE:
        return small
    pieces = rows.where(F.col("__n") > PIECE).withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / PIECE)))).repartition(*key, "__piece")
    return small.unionAll(counted(pieces, F.col("__piece") * PIECE, F.least(F.col("__n"), (F.col("__piece") + 1) * PIECE)))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken per row of `docs` (doc_id, source, text).

    weights: by sources in code point order, repeating.  budget: total of the targets
    as a multiple of all sizes; at most max_epochs, else every source is clamped.
    """
    found = docs.select("doc_id", *_source(docs)).groupBy("doc_id", "sk", "sn", "size").agg(F.count("*").alias("copies"))
    groups = cut(found.withColumn("h", F.xxhash64("doc_id", F.isnull("doc_id"), "size", F.lit(seed))), "mix-sizes")
    taken = _taken(groups, ["doc_id", "size"], weights, budget, max_epochs).select("doc_id", "size", "source_size", "target", "epochs", "part", "copies")
    rows = _dealt(taken.withColumnRenamed("copies", "__n"), groups.agg(F.max("copies")).first()[0], ["doc_id", "size"]).withColumnRenamed("__at", "j")
    own = F.greatest(F.lit(0.0), F.least(F.col("size").cast("double"), F.col("part") - F.col("j") * F.col("size")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.floor(own + 0.5)).cast("long").alias("taken"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2, seed: int = 42) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken.

    Texts are never cut here: the border document of a source counts as one more
    repetition if at least half of it is taken, so a source misses its target by half a document at most.  Rows are known by
    the hash (128 bits) of all their columns, not by ids, which may be null or repeated; equal rows are
    drawn together.  Rows whose text has no words are kept once.  Texts are shuffled once.
    """
    names = docs.columns
    parts = [x for c in names for x in (F.col(f"`{c}`"), F.isnull(F.col(f"`{c}`")))]
    keyed = docs.withColumn("__k1", F.xxhash64(*parts)).withColumn("__k2", F.xxhash64(F.lit(seed), *parts))
    found = keyed.select("__k1", "__k2", *_source(docs)).groupBy("__k1", "__k2", "sk", "sn", "size").agg(F.count("*").alias("copies"))
    groups = cut(found.withColumn("h", F.xxhash64("__k1", F.lit(seed))), "mix-rows")
    times = F.when(F.col("size") > 0, F.col("epochs") * F.col("copies") + F.floor(F.col("part") / F.col("size") + 0.5)).otherwise(F.col("copies"))
    taken = cut(_taken(groups, ["__k1", "__k2"], weights, budget, max_epochs).select("__k1", "__k2", times.cast("long").alias("__n")).where("__n > 0"), "mix-times")
    rows = keyed.dropDuplicates(["__k1", "__k2"]).join(taken, ["__k1", "__k2"])
    return _dealt(rows, taken.agg(F.max("__n")).first()[0], ["__k1", "__k2"]).select(*[F.col(f"`{c}`") for c in names])
