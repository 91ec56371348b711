"""Modules and packages: Python and Go imports, exports, local specifiers, routes, workspaces, rationale."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalens.functions.scalar import dirname


def _upward(path: Column) -> Column:
    """The folder itself, then each one above it, the root ('') last."""
    parts = F.split(path, "/")
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit(""))))


def _search_dirs(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """dir, search: folders in which an absolute import from `dir` is looked up, in order.

    Outside regular packages: the folder, then each above it.  Inside one, the folder that
    holds the outermost package and those above it come first, then the root, then the
    package's own folders; a folder without __init__.py inside a package keeps itself first.
    """
    packages = files.where(F.col("path").endswith("/__init__.py")).select(dirname(F.col("path")).alias("up"), F.lit(True).alias("is_package")).distinct()
    rows = dirs.select("dir", F.posexplode(_upward(F.col("dir"))).alias("pos", "up")).join(packages.hint("merge"), "up", "left")
    # one entry a level of the path
    chain = F.array_sort(F.collect_list(F.struct("pos", "up", F.coalesce("is_package", F.lit(False)).alias("is_package"))))
    found = rows.groupBy("dir").agg(chain.alias("chain")).withColumn("ups", F.transform("chain", lambda c: c["up"])).withColumn("flags", F.transform("chain", lambda c: c["is_package"]))
    found = found.withColumn("i", (F.array_position("flags", True) - 1).cast("int"))
    run = F.expr("aggregate(slice(flags, i + 1, size(flags)), named_struct('n', 0, 'go', true), (a, f) -> if(a.go and f, named_struct('n', a.n + 1, 'go', true), named_struct('n', a.n, 'go', false)), a -> a.n)")
    found = found.withColumn("r", F.when(F.col("i") >= 0, F.col("i") + run))
    outer, inner = F.expr("slice(ups, r + 1, size(ups))"), F.expr("slice(ups, 1, r)")
    late = F.expr("concat(slice(ups, 1, 1), slice(ups, r + 1, size(ups)), slice(ups, 2, r - 1))")
    return found.select("dir", F.when(F.col("i") < 0, F.col("ups")).when(F.col("i") == 0, F.concat(outer, inner)).otherwise(late).alias("search"))


def python_targets(imports: DataFrame, files: DataFrame, standard: Sequence[str] | None = None) -> DataFrame:
    """file, specifier, target of Python imports (file, specifier) that land in `files` (path).

    Dots climb from the importer's folder.  Absolute names are tried in every search folder;
    the first that gives a file wins: a module, a package, else the first file below a folder
    of that name, unless the importer lies in it.  A name that only a folder around the
    importer has stays without a target; any other goes to the shortest path that ends in it.
    Names of the standard library have none.  Candidates meet files by equality joins, by sorting:
    built and exploded paths are far larger than the size that a plan expects, so none may be broadcast.
    """
    known = sorted(sys.stdlib_module_names if standard is None else standard)
    wanted = imports.select("file", "specifier").distinct().withColumn("dir", dirname(F.col("file"))).where(~F.split("specifier", r"\.")[0].isin(*known))
    python = files.where(F.col("path").endswith(".py")).select("path").distinct()
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    inside = F.replace(F.regexp_replace("specifier", r"^\.+|\.+$", ""), F.lit("."), F.lit("/"))
    parts = F.when(F.col("dir") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("dir", "/"))
    base = F.concat_ws("/", F.filter(F.array(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - dots + 1)), "/"), inside), lambda x: x != ""))
    relative = wanted.where(dots > 0).select("file", "specifier", "dir", F.lit(0).alias("pos"), base.alias("base"))
    absolute = wanted.where((dots == 0) & (inside != "")).join(_search_dirs(wanted.select("dir").distinct(), files).hint("merge"), "dir").select("file", "specifier", "dir", F.posexplode("search").alias("pos", "at"), inside.alias("name"))
    tried = relative.unionByName(absolute.select("file", "specifier", "dir", "pos", F.when(F.col("at") == "", F.col("name")).otherwise(F.concat_ws("/", "at", "name")).alias("base")))
    module = python.select(F.regexp_replace("path", r"\.py$", "").alias("base"), F.col("path").alias("m"))
    package = python.where(F.col("path").endswith("/__init__.py")).select(dirname(F.col("path")).alias("base"), F.col("path").alias("p"))
    below = python.select(F.explode(_upward(dirname(F.col("path")))).alias("base"), "path").where("base <> ''").groupBy("base").agg(F.min("path").alias("u"))
    met = tried.join(module.hint("merge"), "base", "left").join(package.hint("merge"), "base", "left").join(below.hint("merge"), "base", "left")
    around = (F.col("base") == "") | (F.col("base") == F.col("dir")) | F.startswith(F.col("dir"), F.concat("base", F.lit("/")))
    target = F.coalesce("m", "p", F.when(~around, F.col("u")))
    best = met.withColumn("target", target).groupBy("file", "specifier").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("pos"))).alias("target"), F.max(around & F.col("target").isNull()).alias("near"))
    stem = F.regexp_replace(F.regexp_replace("path", r"/__init__\.py$", ""), r"\.py$", "")
    words = F.split(stem, "/")
    ends = python.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, n, F.size(words)), "/"))).alias("name"))
    far = ends.groupBy("name").agg(F.min(F.struct(F.length("path").alias("n"), "path"))["path"].alias("far"))
    out = best.withColumn("name", F.when(~F.col("specifier").startswith("."), inside)).join(far.hint("merge"), "name", "left")
    return out.select("file", "specifier", F.coalesce("target", F.when(~F.col("near"), F.col("far"))).alias("target")).where("target is not null")


def go_targets(imports: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """file, specifier, target of Go imports under a module of the project.

    modules: (module, dir, place).  The first module that is a prefix and whose folder has a
    file that is no test gives the folder's first file.  Joins sort, as in `python_targets`.
    """
    parts = F.split("specifier", "/")
    tried = imports.select("file", "specifier").distinct().select("file", "specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("module"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("rest")))).alias("t")).select("file", "specifier", "t.*")
    first = files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).groupBy(dirname(F.col("path")).alias("folder")).agg(F.min("path").alias("target"))
    folder = F.concat_ws("/", F.filter(F.array("dir", "rest"), lambda x: x != ""))
    return tried.join(modules.hint("merge"), "module").withColumn("folder", folder).join(first.hint("merge"), "folder").groupBy("file", "specifier").agg(F.min_by("target", "place").alias("target"))


def exports(symbols: DataFrame, reexports: DataFrame) -> DataFrame:
    """file, name, kind, is_default: exported declarations (file, name, kind, exported), and what `export ... from` passes on (file, name; '*' for all), each name once."""
    own = symbols.where("exported").select("file", "name", "kind", (F.col("name") == "default").alias("is_default"))
    passed = reexports.select("file", "name").distinct().select("file", "name", F.lit("variable").alias("kind"), (F.col("name") == "default").alias("is_default"))
    return own.unionAll(passed)


def local_specifiers(imports: DataFrame, workspaces: DataFrame, aliases: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Imports (file, specifier) that should resolve inside the project: relative, of a workspace (name), or by an alias (scope, pattern).

    A catch-all alias says nothing.  A specifier's own prefixes meet the workspaces by equality.
    """
    spec = F.col("specifier")
    named = F.lit(False)
    for scope, pattern in aliases:
        head, star, tail = pattern.partition("*")
        if star and not head and not tail:
            continue
        hit = F.startswith(spec, F.lit(head)) & F.endswith(spec, F.lit(tail)) & (F.length(spec) >= len(head) + len(tail)) if star else spec == pattern
        named = named | (hit & (F.lit(not scope) | (F.col("file") == scope) | F.startswith(F.col("file"), F.lit(scope + "/"))))
    parts = F.split(spec, "/")
    prefixes = imports.select("specifier").distinct().select("specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("name"))
    inside = prefixes.join(workspaces.select("name").distinct(), "name", "left_semi").select("specifier", F.lit(True).alias("inside")).distinct()
    return imports.join(inside, "specifier", "left").where(spec.rlike(r"^\.\.?/") | named | F.coalesce("inside", F.lit(False))).select(*imports.columns)


#: route conventions and the frameworks that back them; fixed values
BACKED = {"nextjs": "Next.js", "remix": "Remix", "astro": "Astro"}
ROUTING = ("Next.js", "Remix", "Astro", "React Router", "Nuxt", "SvelteKit")


def distinct_routes(routes: DataFrame) -> DataFrame:
    """One row per framework, method (ANY if null) and path of routes (framework, method, path, handler, place): the first with a handler, else the first."""
    names = [c for c in routes.columns if c not in ("framework", "method", "path")]
    order = F.struct(F.col("handler").isNull().alias("bare"), "place")
    one = routes.groupBy("framework", F.coalesce("method", F.lit("ANY")).alias("verb"), "path").agg(F.min_by(F.struct("method", *names), order).alias("b"))
    return one.select("framework", "b.method", "path", *[f"b.{c}" for c in names])


def reclassified_routes(routes: DataFrame, frameworks: Sequence[str]) -> DataFrame:
    """Routes of a file convention whose framework the project lacks: relabelled where it routes by another, dropped where it has none."""
    unbacked = F.lit(False)
    for label, name in BACKED.items():
        if name not in frameworks:
            unbacked = unbacked | (F.col("framework") == label)
    if not set(ROUTING) & set(frameworks):
        return routes.where(~unbacked)
    other = "react-router" if "React Router" in frameworks else "spa-page"
    return routes.withColumn("framework", F.when(unbacked, other).otherwise(F.col("framework")))


def top_routes(routes: DataFrame, most: int = 20) -> DataFrame:
    return routes.select(F.coalesce("method", F.lit("GET")).alias("method"), "path", "framework").orderBy(F.coalesce("framework", F.lit("")), F.coalesce("path", F.lit("")), "method").limit(most)


def open_risks(risks: DataFrame, most: int = 20) -> DataFrame:
    """The first high and critical findings, in the order of `place`."""
    return risks.where(F.col("severity").isin("high", "critical")).orderBy("place").limit(most)


def reference_counts(refs: DataFrame) -> DataFrame:
    """file, name, n."""
    return refs.groupBy("file", "name").agg(F.count("*").alias("n"))


#: file at the root -> workspace manager, first that exists; fixed values
MANAGERS = (("pnpm-workspace.yaml", "pnpm"), ("turbo.json", "turbo"), ("nx.json", "nx"), ("lerna.json", "lerna"))


def monorepo(files: DataFrame, key: str) -> DataFrame:
    """key, packages (manifests below the root), manager (null if none)."""
    manager = F.lit(None).cast("string")
    for path, name in reversed(MANAGERS):
        manager = F.when(F.max(F.col("path") == path), name).otherwise(manager)
    return files.groupBy(key).agg(F.count_if(F.col("path").endswith("package.json") & (F.col("path") != "package.json")).alias("packages"), manager.alias("manager"))


def why(rationale: DataFrame, needle: str) -> DataFrame:
    """Rationale rows (file, symbol, ...) whose symbol or file holds the needle, any case."""
    low = F.lit(needle.replace("\\", "/").lower())
    return rationale.where(F.contains(F.lower(F.coalesce("symbol", F.lit(""))), low) | F.contains(F.lower("file"), low))


def symbol_facts(items: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Adds path, importance, churn and loc to items (id): a symbol's are those of its file, an unknown one's are null or 0."""
    named = items.join(symbols.select("id", F.col("path").alias("__path")), "id", "left").withColumn("path", F.coalesce("__path", "id")).drop("__path")
    facts = files.select("path", "importance", "churn", "loc")
    return named.join(facts, "path", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0))).withColumn("churn", F.coalesce("churn", F.lit(0.0)))


#: rule -> plain words; {file} stands for the finding's file
PLAIN = {
    "aws-access-key": "A cloud access key can be read in {file}. Replace the key and load it at run time.", "github-token": "A code host token can be read in {file}. Revoke it before merging.", "private-key-header": "A private key is kept in {file}. Treat its public half as known to others.",
    "generic-secret": "A value in {file} may be a real password. Check it, and move it out if it is.", "unresolved-import": "{file} imports something that does not exist, so it cannot be built as it stands.", "large-file": "{file} is too long to hold in mind. Consider splitting it.",
}


def plain_messages(risks: DataFrame, words: dict[str, str] = PLAIN) -> DataFrame:
    """Risks (rule, category, severity, file, message) with plain messages, the former kept as message_technical; fixture secrets and other rules stay."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    text = F.replace(table[F.col("rule")], F.lit("{file}"), F.coalesce("file", F.lit("a file")))
    said = F.when(~((F.col("category") == "secret") & (F.col("severity") == "low")), text)
    return risks.withColumn("message_technical", F.when(said.isNotNull(), F.col("message"))).withColumn("message", F.coalesce(said, "message"))


def features(headings: DataFrame) -> DataFrame:
    """path, text, line of headings one level below one that names features (path, line, depth, text), up to the next heading as high.

    The nearest heading above of each level is carried along by windows.
    """
    w = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    names = F.col("text").rlike(r"(?i)\b(features?|capabilit(y|ies)|what (it|we) (can )?do|surfaces?)\b")
    up = headings
    for depth in range(1, 6):
        # the last heading of this depth, unless a higher one came after it
        last = F.max(F.when(F.col("depth") == depth, F.struct("line", names.alias("hit")))).over(w)
        closed = F.max(F.when(F.col("depth") < depth, F.col("line"))).over(w)
        up = up.withColumn(f"d{depth}", F.when(closed.isNull() | (last["line"] > closed), last["hit"]))
    hit = F.lit(False)
    for depth in range(1, 6):
        hit = hit | ((F.col("depth") == depth + 1) & F.coalesce(f"d{depth}", F.lit(False)))
    return up.where(hit).select("path", "text", "line")
