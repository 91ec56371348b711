"""The tabular pack: a line format of keyed tables with a checksum, and its change sets.

    # stratalens-pack 1            header
    & <table> <tab-separated columns>
    ~ <table> <tab-separated column=group>     columns whose cells are keys of a dictionary
    @ <group><number> <cell>             an entry of a dictionary
    - <table> <tab-separated cells>      a row; null is \\N, other cells are escaped
    x <table> <key>                      in change sets: a deletion, before the additions
    + <table> <tab-separated cells>      in change sets: an addition
    = <rows> <tables> <12 hex digits>    trailer: counts, and the digest of the row digests

Rows are lines of text files written by Spark; a line carries its table, so files can be
read in any order.  The digest adds up row digests, so it does not depend on the order
of rows or files and is computed by an aggregate.

Interned columns of one group share a dictionary, so a value is written once and a cell is its key: short keys
for frequent values.  Entries are numbered by range over all tasks and joined to the rows; reading
joins them back.  Neither step holds a dictionary in one task, and a value that most cells
have is dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions.scalar import escape_cell, unescape_cell
from stratalens.joins import hot_keys, numbered, spread_join
from stratalens.storage import cut

HEADER = "# stratalens-pack 1"
NULL = "\\N"
MOST_HEADS = 100_000  # head lines that are read


def _cells(columns: list[str]) -> Column:
    return F.concat_ws("\t", *[F.coalesce(escape_cell(F.col(c).cast("string")), F.lit(NULL)) for c in columns])


def row_lines(df: DataFrame, name: str, mark: str = "-") -> DataFrame:
    return df.select(F.concat(F.lit(f"{mark} {name} "), _cells(df.columns)).alias("value"))


def digest(lines: DataFrame) -> DataFrame:
    """rows, sha: 12 hex digits over the sum of the lines' digests."""
    part = F.conv(F.substring(F.sha2("value", 256), 1, 14), 16, 10).cast("decimal(38,0)")
    return lines.agg(F.count("*").alias("rows"), F.substring(F.sha2(F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).cast("string"), 256), 1, 12).alias("sha"))


def dictionary(tables: dict[str, DataFrame], interned: dict[str, dict[str, str]]) -> DataFrame:
    """group, cell, n, key of the distinct values of interned columns (table -> column -> group), frequent ones first in a group."""
    parts = [tables[t].select(F.lit(g).alias("group"), F.col(c).cast("string").alias("cell")) for t, columns in interned.items() for c, g in columns.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    values = every.where("cell is not null").groupBy("group", "cell").agg(F.count("*").alias("n"))
    return numbered(values, [F.desc("n"), "group", "cell"]).withColumn("key", F.concat("group", F.col("number").cast("string"))).drop("number")


def _interned(df: DataFrame, entries: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`df` with the cells of `columns` (column -> group) replaced by their keys."""
    names, total = df.columns, df.count()
    for c, g in columns.items():
        one = entries.where(F.col("group") == g).select(F.col("cell").alias("__cell"), F.col("key").alias("__key"), "n")
        many = df.withColumn("__cell", F.col(c).cast("string"))
        df = spread_join(many, one.drop("n"), "__cell", hot_keys(one.select("__cell", "n"), "__cell", total), "left").withColumn(c, F.col("__key")).select(*names)
    return df


def encode(spark: SparkSession, tables: dict[str, DataFrame], path: str, interned: dict[str, dict[str, str]] | None = None) -> str:
    """Write the tables as a pack; gives its 12-digit digest.  An empty table still gives its column line.

    interned: columns by table that go through a dictionary, with the group they share it
    in; a group is made of letters only, so that no two keys are equal.
    """
    interned = interned or {}
    for columns in interned.values():
        for g in columns.values():
            if not g.isalpha():
                raise ValueError(f"a group is made of letters: {g}")
    body = entries = None
    if any(interned.values()):
        entries = cut(dictionary(tables, interned), "pack-dictionary")
        body = entries.select(F.concat(F.lit("@ "), "key", F.lit(" "), escape_cell(F.col("cell"))).alias("value"))
    for name, df in tables.items():
        lines = row_lines(_interned(df, entries, interned[name]) if interned.get(name) else df, name)
        body = lines if body is None else body.unionAll(lines)
    got = digest(body).first()
    heads = [HEADER, *[f"& {n} " + "\t".join(df.columns) for n, df in tables.items()], *[f"~ {n} " + "\t".join(f"{c}={g}" for c, g in columns.items()) for n, columns in interned.items() if columns], f"= {got['rows']} {len(tables)} {got['sha']}"]
    spark.createDataFrame([(h,) for h in heads], "value string").unionAll(body).write.text(path)
    return got["sha"]


def decode(spark: SparkSession, path: str, strict: bool = True, limits: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Tables of a pack, all columns strings.

    Strict: header, trailer counts and digest must hold, unknown lines, doubled or missing keys of a dictionary are
    errors.  Otherwise unknown lines are passed over, a missing key stands for itself, and of a doubled one
    the least value counts.  limits: most `lines`, `rows`, `entries`, `tables` and `columns`; a pack beyond one is an
    error in either mode.
    """
    lines = spark.read.text(path)
    kind = F.substring("value", 1, 2)
    if strict:
        bad = lines.where(~kind.isin("# ", "& ", "~ ", "@ ", "- ", "= ")).limit(1).collect()
        if bad:
            raise ValueError(f"unknown line: {bad[0]['value'][:80]}")
    heads = [r["value"] for r in lines.where(kind.isin("# ", "& ", "~ ", "= ")).limit(MOST_HEADS).collect()]  # a few lines a table
    names = {h.split(" ", 2)[1]: h.split(" ", 2)[2].split("\t") for h in heads if h.startswith("& ")}
    interned = {h.split(" ", 2)[1]: dict(x.rsplit("=", 1) for x in h.split(" ", 2)[2].split("\t")) for h in heads if h.startswith("~ ")}
    if limits:
        n = lines.agg(F.count("*").alias("lines"), F.count(F.when(kind == "- ", 1)).alias("rows"), F.count(F.when(kind == "@ ", 1)).alias("entries")).first().asDict()
        n |= {"tables": len(names), "columns": max(map(len, names.values()), default=0)}
        for what, most in limits.items():
            if n[what] > most:
                raise ValueError(f"{n[what]} {what}, the limit is {most}")
    body = lines.where(kind == "- ")
    if strict:
        ends = [h for h in heads if h.startswith("= ")]
        got = digest(lines.where(kind.isin("- ", "@ "))).first()
        if HEADER not in heads or len(ends) != 1 or ends[0] != f"= {got['rows']} {len(names)} {got['sha']}":
            raise ValueError("header or trailer does not hold")
    out = {n: _table(body, n, columns) for n, columns in names.items()}
    if interned:
        entry = lines.where(kind == "@ ").select(F.regexp_extract("value", r"^@ (\S+) ", 1).alias("__key"), unescape_cell(F.regexp_replace("value", r"^@ \S+ ", "")).alias("__cell"))
        found = cut(entry.groupBy("__key").agg(F.min("__cell").alias("__cell"), F.count("*").alias("n")), "pack-dictionary")
        if strict and not found.where("n > 1 or __key = ''").isEmpty():
            raise ValueError("a key of the dictionary stands twice")
        out |= {n: _resolved(out[n], found.drop("n"), columns, strict) for n, columns in interned.items()}
    return out


def _resolved(df: DataFrame, entries: DataFrame, columns: dict[str, str], strict: bool) -> DataFrame:
    """`df` with the keys in `columns` (column -> group) replaced by their entries."""
    names, total = df.columns, df.count()
    for c, g in columns.items():
        one = entries.where(F.col("__key").rlike(f"^{g}[0-9]+$"))
        many = df.withColumn("__key", F.col(c))
        sizes = many.where("__key is not null").groupBy("__key").agg(F.count("*").alias("n"))
        df = spread_join(many, one, "__key", hot_keys(sizes, "__key", total), "left")
        if strict and not df.where("__key is not null and __cell is null").isEmpty():
            raise ValueError(f"column {c} has a key that is not in the dictionary")
        df = df.withColumn(c, F.coalesce("__cell", "__key")).select(*names)
    return df


def _table(body: DataFrame, name: str, columns: list[str], mark: str = "-") -> DataFrame:
    head = f"{mark} {name} "
    cells = F.split(F.substr(F.col("value"), F.lit(len(head) + 1)), "\t")
    return body.where(F.startswith("value", F.lit(head))).select(*[F.when(cells[i] != NULL, unescape_cell(cells[i])).alias(c) for i, c in enumerate(columns)])


def encode_changes(added: DataFrame, deleted: DataFrame, name: str, key: str) -> DataFrame:
    """place, value: deletions (place 0) before additions (place 1)."""
    gone = deleted.select(F.lit(0).alias("place"), F.concat(F.lit(f"x {name} "), escape_cell(F.col(key).cast("string"))).alias("value"))
    return gone.unionAll(row_lines(added, name, "+").select(F.lit(1).alias("place"), "value"))


def decode_changes(lines: DataFrame, name: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(added, deleted keys) of change-set lines (value); the key is the first column."""
    gone = lines.where(F.startswith("value", F.lit(f"x {name} "))).select(unescape_cell(F.substr(F.col("value"), F.lit(len(f"x {name} ") + 1))).alias(columns[0]))
    return _table(lines, name, columns, "+"), gone


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """place, value: GraphML elements of nodes (id) and edges (src, dst, kind); write sorted by place and value."""
    def xml(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    n = nodes.select(F.lit(0).alias("place"), F.format_string('<node id="%s"/>', xml(F.col("id"))).alias("value"))
    return n.unionAll(edges.select(F.lit(1).alias("place"), F.format_string('<edge source="%s" target="%s" label="%s"/>', xml(F.col("src")), xml(F.col("dst")), xml(F.col("kind"))).alias("value")))


def mermaid_lines(cells: DataFrame) -> DataFrame:
    """value: diagram edges of (from_group, to_group, n)."""
    def name(c: str) -> Column:
        return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")

    return cells.select(F.format_string("  %s -->|%d| %s", name("from_group"), F.col("n"), name("to_group")).alias("value"))
