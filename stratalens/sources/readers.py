"""Readers: file trees, event logs, snapshots, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions.scalar import basename, extension

# fixed values: folders that are never read, the last being this library's own output
HARD_EXCLUDES = (
    "node_modules", "dist", "build", ".next", ".turbo", ".cache", "__pycache__", ".venv", ".git", "vendor", "target", "coverage", ".pnpm-store", ".vscode", ".idea", ".playwright-mcp", "playwright-report", "test-results", ".stratalens",
)
# fixed values: endings of build records, in any case
NOISE_ENDINGS = (".tsbuildinfo", ".tsbuildinfo.json")
# fixed values: files that tools write for one developer, as patterns of whole paths
PERSONAL_FILES = (r"(^|/)\.claude/settings\.local\.json$", r"(^|/)CLAUDE\.local\.md$", r"(^|/)\.cursor/rules/[^/]*\.local\.mdc$")
#: files whose rules decide what is read; the last is this library's own
IGNORE_FILES = (".gitignore", ".cursorignore", ".aiignore", ".stratalensignore")
BINARY_ENDINGS = ("png", "jpg", "jpeg", "gif", "webp", "ico", "pdf", "zip", "gz", "woff", "woff2", "ttf", "mp4", "mp3", "wasm", "so", "dll", "exe", "class", "jar")
MAX_BYTES = 1 << 20
EVENTS = "schemaVersion string, timestamp string, agent string, model string, ticketId string, action string, outcome string, reasoning string, filesAffected array<string>, confidence double, tags array<string>, meta string"


def is_excluded(path: Column) -> Column:
    """Whether a folder of the path is never read, or the file is a build record or personal; secrets' usual homes are not left out."""
    low = F.lower(basename(path))
    noise = reduce(lambda a, b: a | b, [low.endswith(x) for x in NOISE_ENDINGS])
    return F.exists(F.split(path, "/"), lambda x: x.isin(*HARD_EXCLUDES)) | noise | path.rlike("|".join(PERSONAL_FILES))


def ignore_files(texts: DataFrame) -> DataFrame:
    """Those of `texts` (path, text) that hold ignore rules."""
    return texts.where(basename(F.col("path")).isin(*IGNORE_FILES))


def ignore_rules(texts: DataFrame) -> DataFrame:
    """dir, place, keep, only_dirs, pattern (a regular expression on paths below dir) of ignore files (path, text).

    Blank lines and comments drop out; `!` keeps; a slash at the end means folders, one
    elsewhere ties the rule to the file's own folder; `*` and `?` stop at slashes, `**` does
    not.
    """
    rows = texts.select(F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1).alias("dir"), F.posexplode(F.split("text", r"\r?\n")).alias("place", "l")).withColumn("l", F.rtrim("l")).where("l <> '' and not startswith(l, '#')")
    rows = rows.withColumn("keep", F.col("l").startswith("!")).withColumn("l", F.regexp_replace("l", r"^!", "")).withColumn("only_dirs", F.col("l").endswith("/")).withColumn("l", F.regexp_replace("l", "/$", ""))
    tied = F.col("l").contains("/")
    body = F.regexp_replace(F.regexp_replace("l", "^/", ""), r"([.+^$(){}|\\])", r"\\$1")
    for mark, out in ((r"\*\*/", "\u0001"), (r"/\*\*$", "\u0002"), (r"\*\*", "\u0003"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", "/.*"), ("\u0003", ".*")):
        body = F.regexp_replace(body, mark, out)
    return rows.select("dir", "place", "keep", "only_dirs", F.concat(F.when(tied, "^").otherwise("^(?:.*/)?"), body, F.lit("$")).alias("pattern"))


def without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files (path) that no rule ignores.

    The deepest folder with a matching rule decides, and of its rules the last.  What lies in
    an ignored folder is ignored.  Distinct folders and files meet rules by the folder of the
    rules' file.
    """

    def up(path: str, whole: bool) -> Column:
        parts = F.split(path, "/")
        some = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        return some if whole else F.concat(F.array(F.lit("")), F.slice(some, F.lit(1), F.size(parts) - 1))

    below = files.select("path", F.explode(up("path", True)).alias("at"))
    met = below.select("at", (F.col("at") != F.col("path")).alias("is_dir")).distinct().withColumn("dir", F.explode(up("at", False))).join(rules, "dir")
    inside = F.when(F.col("dir") == "", F.col("at")).otherwise(F.substr(F.col("at"), F.length("dir") + 2))
    hit = met.where((F.col("is_dir") | ~F.col("only_dirs")) & F.rlike(inside, F.col("pattern")))
    last = hit.groupBy("at").agg(F.max_by("keep", F.struct(F.length("dir"), "place")).alias("keep")).where("not keep")
    gone = below.join(last.select("at"), "at", "left_semi").select("path").distinct()
    return files.join(gone, "path", "left_anti")


def decode_text(content: Column) -> Column:
    """UTF-8 or, after its byte order mark, UTF-16; the mark is dropped."""
    head = F.hex(F.substring(content, 1, 2))
    text = F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(F.decode(content, "UTF-8"))
    return F.regexp_replace(text, "^﻿", "")


def walk(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, bytes, mtime, status ('ok', 'binary', 'too_large'), text of a tree; excluded folders are left out.

    Contents of files that are too large or binary are never decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^.*?" + F"{root.rstrip('/').replace('.', '[.]')}/", "")
    status = F.when(F.col("length") > max_bytes, "too_large").when(extension(path).isin(*BINARY_ENDINGS), "binary").otherwise("ok")
    out = files.select(path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), status.alias("status"), "content").where(~is_excluded(F.col("path")))
    return out.withColumn("text", F.when(F.col("status") == "ok", decode_text(F.col("content")))).drop("content")


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of a JSON-lines log: blank lines are skipped, bad ones give their text.

    `line` orders events by file and place; use one file a log, or files named in order.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    parsed = raw.withColumn("e", F.from_json("value", EVENTS + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("e").isNull() | F.col("e._corrupt").isNotNull() | F.col("e.timestamp").isNull() | F.col("e.action").isNull() | F.try_to_timestamp("e.timestamp").isNull()
    reason = F.when(F.col("e").isNull() | F.col("e._corrupt").isNotNull(), "not JSON").otherwise("schema")
    events = parsed.where(~bad).select("line", F.to_timestamp("e.timestamp").alias("ts"), *[f"e.{c.split()[0]}" for c in EVENTS.split(", ") if not c.startswith("timestamp")])
    return events, parsed.where(bad).select("line", "value", reason.alias("reason"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all snapshots below a folder with `snapshot`, the name of each row's file."""
    return spark.read.json(path).withColumn("snapshot", F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.json)?$", 1))


def manifest_ecosystem(path: Column) -> Column:
    name = basename(path)
    return (
        F.when(name == "package.json", "npm").when(name.isin("pyproject.toml", "requirements.txt", "setup.py"), "pypi").when(name == "Cargo.toml", "crates").when(name == "go.mod", "go").when(name == "pom.xml", "maven").when(name == "Gemfile", "rubygems")
    )


def npm_dependencies(manifests: DataFrame) -> DataFrame:
    """path, package, spec, scope of package.json texts (path, text)."""
    m = manifests.withColumn("m", F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"))
    parts = [m.select("path", F.explode(f"m.{field}").alias("package", "spec"), F.lit(scope).alias("scope")) for field, scope in (("dependencies", "direct"), ("devDependencies", "dev"), ("peerDependencies", "peer"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def npm_lock_versions(locks: DataFrame) -> DataFrame:
    """path, importer, package, version of package-lock.json texts of versions 2 and 3 (path, text).

    A dependency of an importer is looked up in its own node_modules, then in those of its
    ancestors: ancestors are exploded and joined by path, the deepest wins.
    """
    entry = "map<string, struct<version: string, link: boolean, dependencies: map<string,string>, devDependencies: map<string,string>>>"
    rows = locks.select("path", F.explode(F.from_json("text", f"packages {entry}")["packages"]).alias("key", "e"))
    importers = rows.where(~F.col("key").contains("node_modules")).select("path", F.col("key").alias("importer"), F.explode(F.map_keys(F.map_concat(F.coalesce("e.dependencies", F.create_map().cast("map<string,string>")), F.coalesce("e.devDependencies", F.create_map().cast("map<string,string>"))))).alias("package"))
    parts = F.split("importer", "/")
    folders = F.when(F.col("importer") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))))
    tried = importers.select("path", "importer", "package", F.posexplode(folders).alias("depth", "folder")).withColumn("key", F.concat("folder", F.lit("node_modules/"), "package"))
    found = tried.join(rows.where(~F.coalesce("e.link", F.lit(False))).select("path", "key", F.col("e.version").alias("version")), ["path", "key"])
    return found.groupBy("path", "importer", "package").agg(F.max_by("version", "depth").alias("version")).where(F.col("version").rlike(r"^\d"))


def yarn_lock_versions(locks: DataFrame) -> DataFrame:
    """path, package, spec, version of yarn v1 lock texts: every descriptor of a block shares its version line."""
    blocks = locks.select("path", F.explode(F.split("text", r"\n\n+")).alias("b")).where(F.col("b").rlike(r"(?m)^\s+version "))
    head = F.regexp_extract("b", r"(?m)^([^\s#][^\n]*):$", 1)
    one = blocks.select("path", F.explode(F.split(F.replace(head, F.lit('"'), F.lit("")), ",\\s*")).alias("d"), F.regexp_extract("b", r"(?m)^\s+version \"?([^\"\n]+)\"?", 1).alias("version"))
    return one.select("path", F.regexp_extract("d", r"^(@?[^@]+)@", 1).alias("package"), F.regexp_extract("d", r"^@?[^@]+@(.*)$", 1).alias("spec"), "version")
