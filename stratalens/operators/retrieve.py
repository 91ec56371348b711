"""Ranked and budgeted retrieval over nodes (id, importance, tokens, mtime, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalens.functions.scalar import basename, extension, identifier_words, is_source_path, query_tokens, round4
from stratalens.operators.graph import reach
from stratalens.storage import cut

#: weights of importance, nearness, name match, recency; bonus for recently touched; fixed values
WEIGHTS = (0.35, 0.30, 0.20, 0.15)
SESSION_BONUS = 0.10
#: seeds kept from a question's words, a name's suggestions and altogether; hops; tokens; files of a cold start; fixed values
QUERY_SEEDS, PER_TOKEN, MOST_SEEDS, HOPS, BUDGET, COLD_FILES = 6, 3, 10, 2, 8000, 10
CHUNK = 2000  # candidates folded at once; the fill goes on until none fits


def node_words(path: Column, name: Column) -> Column:
    """Words of a node: of its name and its last two path segments."""
    return identifier_words(F.concat_ws(" ", name, F.array_join(F.slice(F.reverse(F.split(path, r"[/\\\\]")), 1, 2), " ")))


def name_match(nodes: DataFrame, question: str) -> DataFrame:
    """Adds `hits` and `match`: the number and share of the question's tokens that begin a word of the node."""
    tokens = query_tokens(F.lit(question))
    name = F.col("name") if "name" in nodes.columns else basename(F.col("id"))
    words = node_words(F.col("path") if "path" in nodes.columns else F.col("id"), name)
    hits = F.size(F.filter(tokens, lambda t: F.exists(words, lambda w: F.startswith(w, t))))
    return nodes.withColumn("hits", hits).withColumn("match", F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(F.col("hits") / F.size(tokens)))


def seeds(nodes: DataFrame, question: str, most: int = QUERY_SEEDS) -> DataFrame:
    """Nodes that most of the question's tokens hit, then the more important, then by id."""
    return name_match(nodes, question).where("hits > 0").orderBy(F.desc("hits"), F.desc(F.coalesce("importance", F.lit(0.0))), "id").limit(most)


def start_nodes(nodes: DataFrame, question: str, explicit: list[str] | None = None) -> DataFrame:
    """id, direct: seeds named by the caller or by the whole question (direct, all kept), and those of the question's words, at most ten in all.

    A name that no node has gives its first suggestions instead.
    """
    name = F.lower("name") if "name" in nodes.columns else F.lower(basename(F.col("id")))
    named = None
    for text in [*(explicit or []), question]:
        low = text.lower()
        found = nodes.where((F.col("id") == text) | (name == low)).select("id")
        if text != question and found.isEmpty():
            found = nodes.where(F.contains(F.lower("id"), F.lit(low))).orderBy("id").limit(PER_TOKEN).select("id")
        named = found if named is None else named.unionAll(found)
    direct = cut(named.distinct(), "context-direct")
    room = MOST_SEEDS - direct.limit(MOST_SEEDS).count()
    extra = seeds(nodes, question).join(direct, "id", "left_anti").orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), "id").limit(room)
    return direct.select("id", F.lit(True).alias("direct")).unionAll(extra.select("id", F.lit(False)))


def ranked(nodes: DataFrame, edges: DataFrame, start: DataFrame, question: str, recent: DataFrame | None = None, hops: int = HOPS) -> DataFrame:
    """id, tokens, hops, direct, score of everything within `hops` of the start nodes (id, direct).

    Recency (a column of `nodes`, if there) counts relative to the largest among the candidates.
    """
    near = reach(edges, start.select("id"), "both", hops).join(start, "id", "left")
    scored = name_match(nodes.join(near, "id"), question).withColumn("recency", F.coalesce("recency", F.lit(0.0)) if "recency" in nodes.columns else F.lit(0.0))
    most = scored.agg(F.max("recency").alias("most"))  # one row
    scored = scored.join(F.broadcast(most))
    if recent is None:
        scored = scored.withColumn("bonus", F.lit(0.0))
    else:
        scored = scored.join(recent.select("id", F.lit(SESSION_BONUS).alias("bonus")).distinct(), "id", "left")
    w = WEIGHTS
    recency = F.when(F.col("most") > 0, F.col("recency") / F.col("most")).otherwise(0.0)
    score = w[0] * F.coalesce("importance", F.lit(0.0)) + w[1] / (1 + F.col("hops")) + w[2] * F.col("match") + w[3] * recency + F.coalesce("bonus", F.lit(0.0))
    return scored.select("id", "tokens", "hops", F.coalesce("direct", F.lit(False)).alias("direct"), round4(F.least(F.lit(1.0), score)).alias("score"))


def within_budget(candidates: DataFrame, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """Greedy filling with skips: direct rows always, then by score those that still fit, at least one row.

    A skip changes what fits after it, so rows are folded in order, a bounded chunk at a
    time; between chunks the rows that no longer fit are filtered away, and the fill goes on
    until none is left.  No candidate is cut off.
    """
    spark = candidates.sparkSession
    rows = cut(candidates.withColumn("neg", -F.col("score")), "budget")
    used = rows.where("direct").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    rest, taken, last = rows.where("not direct"), [], None
    while budget - used >= 0:
        left = rest.where(F.col("tokens") <= budget - used)
        if last is not None:
            left = left.where((F.col("neg") > last[0]) | ((F.col("neg") == last[0]) & (F.col("id") > last[1])))
        some = left.orderBy("neg", "id").limit(chunk).select("neg", "id", "tokens").collect()  # at most `chunk` short rows
        for r in some:
            if used + r["tokens"] <= budget:
                used += r["tokens"]
                taken.append((r["id"],))
        if len(some) < chunk:
            break
        last = (some[-1]["neg"], some[-1]["id"])
    kept = spark.createDataFrame(taken, "id string")
    out = rows.where("direct").drop("neg").unionByName(rest.join(kept, "id", "left_semi").drop("neg"))
    if not taken and rows.where("direct").isEmpty():
        return rows.orderBy("neg", "id").limit(1).drop("neg")
    return out


def assemble(nodes: DataFrame, edges: DataFrame, question: str, budget: int = BUDGET, explicit: list[str] | None = None, recent: DataFrame | None = None) -> DataFrame:
    """id, tokens, hops, direct, score of the context for a question; of one that names nothing the cold start, which the budget does not cut."""
    start = cut(start_nodes(nodes, question, explicit), "context-seeds")
    if start.isEmpty():
        return cold_start(nodes)
    return within_budget(ranked(nodes, edges, start, question, recent), budget)


def connecting_edges(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are among the items."""
    ends = items.select("id")
    return edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


def cold_start(nodes: DataFrame, most: int = COLD_FILES) -> DataFrame:
    """The most important source files (ids without an ending are taken for such); ties by id."""
    source = is_source_path(F.col("id")) | (extension(F.col("id")) == "")
    return nodes.where(source).orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), "id").limit(most).select("id", "tokens", F.lit(0).alias("hops"), F.lit(False).alias("direct"), round4(F.coalesce("importance", F.lit(0.0))).alias("score"))


def grep(files: DataFrame, tokens: list[str]) -> DataFrame:
    """Files (path, text) that hold any of the tokens, any case: the plain baseline."""
    low = F.lower("text")
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.contains(low, F.lit(t.lower()))
    return files.where(hit)


def search_all(items: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Items whose column holds every term, any case."""
    low = F.lower(column)
    for t in terms:
        items = items.where(F.contains(low, F.lit(t.lower())))
    return items


def search_by_vendor(models: DataFrame, terms: list[str], most_price: float | None = None) -> DataFrame:
    """vendor, place, model (cheapest first, then by name) of models (vendor, name, price) whose vendor and name hold every term and that cost no more than given."""
    found = search_all(models.withColumn("__text", F.concat_ws(" ", "name", "vendor")), "__text", terms)
    if most_price is not None:
        found = found.where(F.col("price") <= most_price)
    place = F.row_number().over(W.partitionBy("vendor").orderBy("price", "name"))
    return found.select("vendor", place.alias("place"), F.col("name").alias("model"))


def top_per_group(df: DataFrame, group: str, order: list, most: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
