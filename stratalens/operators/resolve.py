"""Resolution joins: imports to files, references to symbols, dependencies to lock files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalens.functions.scalar import dirname, is_test_or_example_path

#: endings tried in this order, then index files; fixed values
EXTENSIONS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".json", ".vue", ".svelte", ".astro")
INDEX_FILES = ("index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs", "index.cjs", "__init__.py", "index.vue")


def normalise(path: Column) -> Column:
    """'.' and '..' resolved; null if the path leaves the root."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("p"), F.lit(True).alias("ok"))

    def step(a, x):
        up = F.struct(F.slice(a["p"], F.lit(1), F.greatest(F.lit(0), F.size(a["p"]) - 1)).alias("p"), (a["ok"] & (F.size(a["p"]) > 0)).alias("ok"))
        down = F.struct(F.array_append(a["p"], x).alias("p"), a["ok"].alias("ok"))
        return F.when((x == ".") | (x == ""), a).when(x == "..", up).otherwise(down)

    out = F.aggregate(F.split(path, "/"), start, step)
    return F.when(out["ok"], F.array_join(out["p"], "/"))


def candidates(base: Column) -> Column:
    """Probe order of a path without ending: endings, index files, then sources of emitted names."""
    ends = [F.concat(base, F.lit(e)) for e in EXTENSIONS]
    index = [F.concat(base, F.lit("/" + i)) for i in INDEX_FILES]
    swaps = [F.regexp_replace(base, a, b) for a, b in ((r"\.js$", ".ts"), (r"\.jsx$", ".tsx"), (r"\.mjs$", ".mts"), (r"\.cjs$", ".cts"))]
    return F.array(*ends, *index, *swaps)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, specifier, target for relative specifiers: the first candidate that exists.

    Candidates are exploded and met with the file set by a plain hash join.
    """
    base = normalise(F.concat_ws("/", dirname(F.col("file")), F.regexp_replace("specifier", r"[?#].*$", "")))
    pairs = imports.select("file", "specifier").distinct().where(F.col("specifier").rlike(r"^\.\.?(/|$)")).withColumn("base", base).where("base is not null")
    tried = pairs.select("file", "specifier", F.posexplode(candidates(F.col("base"))).alias("pos", "path"))
    return tried.join(files.select("path").distinct(), "path").groupBy("file", "specifier").agg(F.min_by("path", "pos").alias("target"))


def longest_prefix(items: DataFrame, key: str, prefixes: DataFrame, sep: str = "/") -> DataFrame:
    """Adds the longest of `prefixes` (prefix, ...) that is the key or stands before a separator in it.

    The key's own prefixes are exploded and joined by equality, so no pair is compared in
    vain and no side need be small.
    """
    parts = F.split(F.col(key), sep)
    own = items.select(key).distinct().withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))))
    rest = [c for c in prefixes.columns if c != "prefix"]
    best = own.join(prefixes, "prefix").groupBy(key).agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix", *rest)).alias("b"))
    return items.join(best.select(key, F.col("b.prefix").alias("prefix"), *[f"b.{c}" for c in rest]), key, "left")


def alias_targets(imports: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Candidate targets by path aliases (scope, pattern, target): nearest scope first, then the order given; '*' is substituted once."""
    ranked = sorted(enumerate(rules), key=lambda r: (-len(r[1][0]), r[0]))
    out = F.lit(None).cast("string")
    for _, (scope, pattern, target) in reversed(ranked):
        head, _, tail = pattern.partition("*")
        spec = F.col("specifier")
        hit = (F.startswith(F.col("file"), F.lit(scope))) & ((F.startswith(spec, F.lit(head)) & F.endswith(spec, F.lit(tail)) & (F.length(spec) >= len(head) + len(tail))) if "*" in pattern else spec == pattern)
        middle = F.expr(f"substr(specifier, {len(head) + 1}, length(specifier) - {len(head) + len(tail)})")
        value = F.concat(F.lit(target.partition("*")[0]), middle, F.lit(target.partition("*")[2])) if "*" in target else F.lit(target)
        out = F.when(hit, value).otherwise(out)
    return imports.withColumn("target", out)


def innermost(points: DataFrame, spans: DataFrame, point: str, outer: bool = False, bucket: int = 256) -> DataFrame:
    """The innermost span (file, start, end, id) that holds each point (file, `point`): least length, ties to the latest start.

    Spans are cut into buckets of lines and meet points on (file, bucket), so a file with
    many points and spans does not become one product.
    """
    s = spans.select("file", F.col("start").alias("s"), F.col("end").alias("e"), F.col("id").alias("owner")).withColumn("b", F.explode(F.expr(f"sequence(cast(floor(s / {bucket}) as long), cast(floor(e / {bucket}) as long))")))
    p = points.withColumn("b", F.floor(F.col(point) / bucket).cast("long"))
    hit = p.select("file", point, "b").distinct().join(s, ["file", "b"]).where(F.col(point).between(F.col("s"), F.col("e")))
    best = hit.groupBy("file", point).agg(F.min(F.struct((F.col("e") - F.col("s")).alias("len"), (-F.col("s")).alias("neg"), "owner")).alias("m")).select("file", point, F.col("m.owner").alias("owner"))
    return points.join(best, ["file", point], "left" if outer else "inner")


def reference_targets(refs: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """src, dst, kind, confidence, score of references (file, src, name, kind).

    Tiers: a symbol of the same file (extracted), one of an imported file (inferred, .9),
    the only one of that name anywhere outside tests and examples (inferred, .7), one of several
    (ambiguous, .4, the least id).  References to themselves drop out; of equal edges the
    surest stays.  symbols: (id, file, name); imported: (file, target).
    """
    refs = refs.select("file", "src", "name", "kind").distinct()
    here = symbols.groupBy("file", "name").agg(F.min("id").alias("d1"))
    # a reference's name is looked up in the imported files only, never every symbol of every import
    asked = refs.select("file", "name").distinct().join(imported.distinct(), "file")
    via = asked.join(here.select(F.col("file").alias("target"), "name", F.col("d1").alias("d2")), ["target", "name"]).groupBy("file", "name").agg(F.min("d2").alias("d2"))
    everywhere = symbols.where(~is_test_or_example_path(F.col("file"))).groupBy("name").agg(F.min("id").alias("d3"), F.min(F.struct("id", "file"))["file"].alias("f3"), F.count("*").alias("n"))
    j = refs.join(here, ["file", "name"], "left").join(via, ["file", "name"], "left").join(everywhere, "name", "left")
    other = F.when(F.col("f3") != F.col("file"), F.col("d3"))
    tier = F.when(F.col("d1").isNotNull(), 0).when(F.col("d2").isNotNull(), 1).when(other.isNotNull() & (F.col("n") == 1), 2).when(other.isNotNull(), 3)
    out = j.withColumn("tier", tier).where("tier is not null").withColumn("dst", F.coalesce("d1", "d2", other)).where("src <> dst")
    best = out.groupBy("src", "dst", "kind").agg(F.min("tier").alias("tier"))
    names, scores = (F.array(*[F.lit(x) for x in v]) for v in (("extracted", "inferred", "inferred", "ambiguous"), (1.0, 0.9, 0.7, 0.4)))
    return best.select("src", "dst", "kind", names[F.col("tier")].alias("confidence"), scores[F.col("tier")].alias("score"))


def symbol_graph(refs: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """src, dst, kind, confidence, score of the references (file, line, name, kind) that stand inside a symbol (file, start, end, id, name).

    A reference belongs to the innermost symbol around it and goes to the symbol its name finds.
    """
    placed = innermost(refs, symbols, "line").select("file", F.col("owner").alias("src"), "name", "kind")
    return reference_targets(placed, symbols.select("id", "file", "name"), imported)


def named_entity(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds `target` and `confidence`: exact qualified name (extracted), else the bare name in any case (inferred; of several ids the least, ambiguous); entities: (id, name)."""
    exact = entities.groupBy("name").agg(F.min("id").alias("t1"))
    bare = entities.groupBy(F.lower(F.substring_index("name", ".", -1)).alias("bare")).agg(F.min("id").alias("t2"), F.max("id").alias("t3"))
    found = refs.join(exact, "name", "left").withColumn("bare", F.lower(F.substring_index("name", ".", -1))).join(bare, "bare", "left").withColumn("target", F.coalesce("t1", "t2"))
    confidence = F.when(F.col("t1").isNotNull(), "extracted").when(F.col("t2").isNull(), None).when(F.col("t2") == F.col("t3"), "inferred").otherwise("ambiguous")
    return found.withColumn("confidence", confidence).drop("bare", "t1", "t2", "t3")


def locked_versions(deps: DataFrame, locks: DataFrame) -> DataFrame:
    """Adds `locked`: the version in the nearest ancestor lock file that lists the importer; deps: (dir, name), locks: (dir, importer, name, version)."""
    importers = locks.select(F.col("dir").alias("prefix"), "importer").distinct()
    nearest = longest_prefix(deps.select("dir").distinct(), "dir", importers.select("prefix").distinct()).where("prefix is not null")
    found = nearest.join(locks.select(F.col("dir").alias("prefix"), F.col("importer").alias("dir"), "name", F.col("version").alias("locked")), ["prefix", "dir"])
    return deps.join(found.select("dir", "name", "locked"), ["dir", "name"], "left")


def best_per_key(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """One row a key, the first in the order given."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
