"""Entity graph: tables and views, infrastructure resources, documents, and the links among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.code import ddl_tables, ddl_views, hcl_resources
from stratalens.functions.scalar import dirname
from stratalens.operators.resolve import named_entity

EDGE = ("src", "dst", "kind", "confidence")


def entity_id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.concat_ws(".", *parts))


def link_target(path: Column, href: Column) -> Column:
    """Project path of a document's relative link; null for other schemes and bare anchors; '..' above the root stays there."""
    bare = F.regexp_replace(F.replace(href, F.lit("\\"), F.lit("/")), r"[#?].*$", "")
    whole = F.when(bare.startswith("/"), bare).otherwise(F.concat_ws("/", dirname(path), bare))
    start = F.expr("cast(array() as array<string>)")

    def step(a, x):
        return F.when((x == "") | (x == "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1))).otherwise(F.array_append(a, x))

    return F.when(~href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & (bare != ""), F.array_join(F.aggregate(F.split(whole, "/"), start, step), "/"))


def document_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from documents to the project's files that their links (path, href) name."""
    met = links.select("path", link_target(F.col("path"), F.col("href")).alias("dst")).where("dst is not null").join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    return met.select(entity_id("doc", F.col("path")).alias("src"), "dst", F.lit("documents").alias("kind"), F.lit("extracted").alias("confidence")).distinct()


def heading_mentions(headings: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges from documents to entities (id, name) whose bare name, of four characters or more, is a word of a heading (path, text), any case."""
    names = entities.select("id", F.lower(F.substring_index("name", ".", -1)).alias("word")).where(F.length("word") >= 4).distinct()
    tally = names.groupBy("word").agg(F.count("*").alias("n"))
    words = headings.select("path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0), F.lower))).alias("word")).where(F.length("word") >= 4).distinct()
    met = words.join(names, "word").join(tally, "word")
    # of several words that name one entity the first in the alphabet gives the confidence
    best = met.groupBy("path", "id").agg(F.min(F.struct("word", "n"))["n"].alias("n"))
    return best.select(entity_id("doc", F.col("path")).alias("src"), F.col("id").alias("dst"), F.lit("documents").alias("kind"), F.when(F.col("n") == 1, "inferred").otherwise("ambiguous").alias("confidence"))


def schema_entities(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, name, path) of tables and views of SQL texts (path, text), and foreign key and view edges.

    A target is looked up by its whole name, else by its bare name; a view's link is inferred at best.
    """
    tables, views = ddl_tables(texts), ddl_views(texts)
    nodes = tables.select(entity_id("sql", F.col("name")).alias("id"), F.lit("table").alias("kind"), "name", "path").unionAll(views.select(entity_id("sql", F.col("name")).alias("id"), F.lit("view"), "name", "path"))
    nodes = nodes.groupBy("id").agg(F.min(F.struct("path", "kind", "name")).alias("b")).select("id", "b.kind", "b.name", "b.path")
    asked = tables.select(entity_id("sql", F.col("name")).alias("src"), F.explode("references").alias("name"), F.lit("fk").alias("kind")).unionAll(views.select(entity_id("sql", F.col("name")), F.explode("references"), F.lit("references")))
    found = named_entity(asked.distinct(), nodes.select("id", "name")).where("target is not null and target <> src")
    sure = F.when((F.col("kind") == "references") & (F.col("confidence") == "extracted"), "inferred").otherwise(F.col("confidence"))
    rank = F.array_position(F.array(F.lit("extracted"), F.lit("inferred"), F.lit("ambiguous")), sure)
    edges = found.groupBy("src", F.col("target").alias("dst"), "kind").agg(F.min_by(sure, rank).alias("confidence"))
    return nodes, edges.select(*EDGE)


def resource_entities(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, name, path) of the resources of HCL texts, and edges to those of the same file that they name."""
    r = hcl_resources(texts)
    nodes = r.groupBy(entity_id("iac", F.col("id")).alias("e"), "id").agg(F.min("path").alias("path")).select(F.col("e").alias("id"), F.lit("resource").alias("kind"), F.col("id").alias("name"), "path")
    edges = r.select(entity_id("iac", F.col("id")).alias("src"), F.explode("references").alias("t")).select("src", entity_id("iac", F.col("t")).alias("dst"), F.lit("depends-on").alias("kind"), F.lit("extracted").alias("confidence")).distinct()
    return nodes, edges


def entity_graph(sql: DataFrame, hcl: DataFrame, docs: DataFrame, links: DataFrame, headings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, name, path) and (src, dst, kind, confidence) of tables, views, resources and documents (path, title)."""
    tables, keys = schema_entities(sql)
    resources, needs = resource_entities(hcl)
    papers = docs.select(entity_id("doc", F.col("path")).alias("id"), F.lit("doc").alias("kind"), F.col("title").alias("name"), "path")
    infra = tables.unionByName(resources)
    edges = keys.unionByName(needs).unionByName(document_links(links, files)).unionByName(heading_mentions(headings, infra.select("id", "name")))
    return infra.unionByName(papers), edges.dropDuplicates(["src", "dst", "kind"])
