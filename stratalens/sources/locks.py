"""Lock files: what is installed, by manifest.

Indented locks (pnpm, yarn berry) become rows of keys below keys: the last line of every lesser
indentation that none has ended is the key above, found by one window a file and indentation.  npm's first
format nests its packages: each round reads one level and keeps the text below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalens.joins import dealt
from stratalens.storage import cut

CONCRETE = r"^\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$"
FIELDS = ("dependencies", "devDependencies", "optionalDependencies")
_KEY = r"^(?:'((?:[^']|'')*)'|\"((?:[^\"\\]|\\.)*)\"|(.*?)):(?:\s+(.*))?$"
_ALIAS = r"^npm:((?:@[A-Za-z0-9~-][A-Za-z0-9._~-]*/)?[A-Za-z0-9~-][A-Za-z0-9._~-]*)(?:@(.*))?$"


def keyed_lines(texts: DataFrame) -> DataFrame:
    """path, line, keys (from the outermost to the line's own), value (null if keys below it follow) of indented texts (path, text).

    Block maps of plain and quoted keys and scalars; comments, blank lines, marks of documents and items
    of lists drop out, flow values stay text.  A line that is no `key: value` drops out.
    """
    lines = dealt(texts, "path").select("path", F.posexplode(F.split(F.translate("text", "\r", ""), "\n")).alias("line", "l")).withColumn("body", F.ltrim("l"))
    lines = lines.where("body <> '' and not startswith(body, '#') and body not in ('---', '...', '-') and not startswith(body, '- ')").withColumn("indent", F.length("l") - F.length("body"))
    part = lambda k: F.regexp_extract("body", _KEY, k)
    key = F.coalesce(F.nullif(F.replace(part(1), F.lit("''"), F.lit("'")), F.lit("")), F.nullif(part(2), F.lit("")), F.nullif(F.trim(part(3)), F.lit("")))
    raw = F.trim(part(4))
    plain = F.trim(F.regexp_replace(raw, r" #.*$", ""))
    value = F.when(raw.rlike("^'"), F.regexp_extract(raw, "^'((?:[^']|'')*)'", 1)).when(raw.rlike('^"'), F.regexp_extract(raw, r'^"((?:[^"\\]|\\.)*)"', 1)).otherwise(plain)
    rows = lines.select("path", "line", "indent", key.alias("key"), F.nullif(value, F.lit("")).alias("value")).where("key is not null")
    levels = F.collect_set("indent").over(W.partitionBy("path"))  # a handful of indentations a file
    spread = rows.withColumn("levels", levels).withColumn("level", F.explode("levels"))
    above = W.partitionBy("path", "level").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    holder = F.when(F.col("indent") == F.col("level"), F.col("key"))
    seen = spread.withColumn("over", F.last(F.when(F.col("indent") <= F.col("level"), F.struct(holder.alias("key"))), ignorenulls=True).over(above))
    over = F.collect_list(F.when((F.col("level") < F.col("indent")) & F.col("over.key").isNotNull(), F.struct("level", F.col("over.key").alias("key"))))
    found = seen.groupBy("path", "line").agg(F.transform(F.array_sort(over), lambda x: x["key"]).alias("above"), F.any_value("key").alias("key"), F.any_value("value").alias("value"))
    return found.select("path", "line", F.concat("above", F.array("key")).alias("keys"), "value")


def _without_peers(version: Column, major: Column) -> Column:
    bare = F.regexp_replace(version, r"\(.*$", "")
    return F.when(major < 6, F.regexp_replace(bare, "_.*$", "")).otherwise(bare)


def _package(name: Column, version: Column) -> Column:
    return F.when(version.rlike(CONCRETE) & (name != ""), F.struct(name.alias("name"), version.alias("version")))


def _dep_path(key: Column, major: Column) -> Column:
    """name and version of a package's key: `name@1.2.3`, `/name@1.2.3(peer)`, before version 6 `/name/1.2.3_peer`."""
    k = F.regexp_replace(key, "^/", "")
    bare = _without_peers(k, major)
    old = r"^(@[^/]+/[^/]+|[^@/][^/]*)/([^/]+)$"
    return F.when(major < 6, _package(F.regexp_extract(k, old, 1), _without_peers(F.regexp_extract(k, old, 2), major))).otherwise(_package(F.regexp_extract(bare, r"^(.+)@([^@]*)$", 1), F.regexp_extract(bare, r"^(.+)@([^@]*)$", 2)))


def _pnpm(texts: DataFrame) -> DataFrame:
    """`keyed_lines` with the lock's major version; a text without one drops out."""
    rows = cut(keyed_lines(texts), "lock-lines")
    major = rows.where("size(keys) = 1 and keys[0] = 'lockfileVersion'").groupBy("path").agg(F.max(F.regexp_extract("value", r"^(\d+)", 1)).alias("m")).where("m <> ''")
    return rows.join(major.select("path", F.col("m").cast("int").alias("major")), "path")


def pnpm_importers(texts: DataFrame) -> DataFrame:
    """path, importer ('' for the lock's own folder), package, name, version of what workspace packages ask for, in pnpm locks.

    name differs from package for aliases.  Links, files and versions that are not of three numbers drop out.
    """
    rows = _pnpm(texts)
    several = rows.where("keys[0] = 'importers'").select("path").distinct().withColumn("several", F.lit(True))
    rows = rows.join(several, "path", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    k = F.when(F.col("several"), F.slice("keys", 2, 9)).otherwise(F.concat(F.array(F.lit(".")), F.col("keys")))
    inside = rows.where("not several or keys[0] = 'importers'").withColumn("k", k).where("size(k) >= 3").where(F.col("k")[1].isin(*FIELDS))
    told = inside.where("value is not null and (size(k) = 3 or (size(k) = 4 and element_at(k, 4) = 'version'))")
    ref, own = F.col("value"), F.col("k")[2]
    bare = _without_peers(ref, F.col("major"))
    pkg = F.when(ref.rlike("^(link|file|workspace|portal):"), None).when(ref.startswith("/"), _dep_path(ref, F.col("major"))).when(bare.rlike(CONCRETE), F.struct(own.alias("name"), bare.alias("version"))).otherwise(_dep_path(ref, F.col("major")))
    return told.select("path", F.when(F.col("k")[0] == ".", "").otherwise(F.col("k")[0]).alias("importer"), own.alias("package"), pkg.alias("p")).where("p is not null").select("path", "importer", "package", "p.name", "p.version")


def pnpm_packages(texts: DataFrame) -> DataFrame:
    """path, name, version, dev (null where the lock does not say) of the packages of pnpm locks, once each."""
    rows = _pnpm(texts).where("keys[0] = 'packages' and size(keys) >= 2").withColumn("p", _dep_path(F.col("keys")[1], F.col("major"))).where("p is not null")
    dev = F.when((F.size("keys") == 3) & (F.get("keys", F.lit(2)) == "dev") & F.col("value").isin("true", "false"), F.struct("line", (F.col("value") == "true").alias("dev")))
    return rows.groupBy("path", "p.name", "p.version").agg(F.min(dev).alias("d")).select("path", "name", "version", F.col("d.dev").alias("dev"))


def berry_descriptors(texts: DataFrame) -> DataFrame:
    """path, descriptor, name, version of registry packages in yarn berry locks: every descriptor of a head has the version it resolves to."""
    return _berry_descriptors(keyed_lines(texts))


def _berry_descriptors(lines: DataFrame) -> DataFrame:
    rows = lines.where("size(keys) = 2 and keys[0] <> '__metadata' and keys[1] = 'resolution'")
    part = lambda k: F.regexp_extract("value", r"^(@?[^@]+)@npm:(.*)$", k)
    heads = rows.withColumn("p", _package(part(1), part(2))).where("p is not null").select("path", F.explode(F.split(F.col("keys")[0], r",\s*")).alias("descriptor"), "p")
    return heads.select("path", F.trim(F.translate("descriptor", "\"'", "")).alias("descriptor"), "p.name", "p.version").where("descriptor <> ''")


def berry_importers(texts: DataFrame) -> DataFrame:
    """path, importer, package, name, version of what workspaces ask for, joined by descriptor."""
    rows = cut(keyed_lines(texts), "lock-lines")
    spaces = rows.where("size(keys) = 2 and keys[1] = 'resolution' and value rlike '^@?[^@]+@workspace:'").select("path", F.col("keys")[0].alias("head"), F.regexp_replace("value", "^@?[^@]+@workspace:", "").alias("dir"))
    asked = rows.where("size(keys) = 3 and keys[1] = 'dependencies'").select("path", F.col("keys")[0].alias("head"), F.col("keys")[2].alias("package"), F.concat(F.col("keys")[2], F.lit("@"), F.coalesce("value", F.lit(""))).alias("descriptor"))
    found = asked.join(spaces, ["path", "head"]).join(_berry_descriptors(rows), ["path", "descriptor"])
    return found.select("path", F.when(F.col("dir") == ".", "").otherwise(F.col("dir")).alias("importer"), "package", "name", "version")


def npm_v1_packages(texts: DataFrame) -> DataFrame:
    """path, package, name, version, dev, depth of the nested packages of package-lock.json texts of version 1 (path, text).

    depth 0 is what the root resolves.  A round reads one level; the text below it is kept for the next.  Aliases
    have the real name; installs from git or files and versions that are not of three numbers drop out, not what
    stands below them.  Text that is no JSON, and locks with a `packages` table, have no rows.
    """
    entry = "map<string, struct<version: string, resolved: string, dev: boolean, dependencies: string>>"
    now = texts.select("path", F.from_json("text", "packages string, dependencies string").alias("root")).where("root.packages is null and root.dependencies is not null").select("path", F.col("root.dependencies").alias("below"))
    out, depth = None, 0
    while True:
        level = cut(now.select("path", F.explode(F.from_json("below", entry)).alias("package", "e")), "lock-level")
        alias = F.col("e.version").rlike(_ALIAS) & (F.regexp_extract("e.version", _ALIAS, 2) != "")
        name = F.when(alias, F.regexp_extract("e.version", _ALIAS, 1)).otherwise(F.col("package"))
        version = F.when(alias, F.regexp_extract("e.version", _ALIAS, 2)).otherwise(F.col("e.version"))
        good = version.rlike(CONCRETE) & ~F.coalesce(F.col("e.resolved").rlike("^(git|file:)"), F.lit(False))
        found = level.where(good).select("path", "package", name.alias("name"), version.alias("version"), F.coalesce("e.dev", F.lit(False)).alias("dev"), F.lit(depth).alias("depth"))
        out = found if out is None else out.unionAll(found)
        now = level.where("e.dependencies is not null").select("path", F.col("e.dependencies").alias("below"))
        if now.isEmpty():
            return out
        depth += 1
