"""Comparing two snapshots: files, findings, keyed tables, change sets, verdicts.

Sides are matched by shuffles on their keys; multisets pair the k-th row of a key on one
side with the k-th on the other, so a key with many rows is ranked per key, never per
table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalens.functions.scalar import severity_weight
from stratalens.joins import dealt
from stratalens.operators.security import is_exposed_secret, is_graded

#: levels of a verdict, rising; fixed values
SEVERITIES = ("none", "low", "medium", "high", "critical")


def file_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, change, loc_delta, token_delta of files (path, loc, tokens); unchanged files are left out."""
    b = base.select("path", F.col("loc").alias("b_loc"), F.col("tokens").alias("b_tokens"), F.lit(True).alias("in_base"))
    h = head.select("path", F.col("loc").alias("h_loc"), F.col("tokens").alias("h_tokens"), F.lit(True).alias("in_head"))
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "removed").when((F.col("b_loc") != F.col("h_loc")) | (F.col("b_tokens") != F.col("h_tokens")), "changed")
    both = b.join(h, "path", "full_outer").withColumn("change", change).where("change is not null")
    zero = F.lit(0)
    return both.select("path", "change", (F.coalesce("h_loc", zero) - F.coalesce("b_loc", zero)).alias("loc_delta"), (F.coalesce("h_tokens", zero) - F.coalesce("b_tokens", zero)).alias("token_delta"))


def stat_deltas(base: DataFrame, head: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """stat, before, after, delta for aggregates over the two sides; one row a stat."""

    def side(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[c.cast("double").alias(k) for k, c in stats.items()])
        return one.select(F.expr("stack(%d, %s) as (stat, %s)" % (len(stats), ", ".join(f"'{k}', `{k}`" for k in stats), name)))

    return side(base, "before").join(side(head, "after"), "stat").withColumn("delta", F.col("after") - F.col("before"))


def headline_stats(base: tuple[DataFrame, DataFrame, DataFrame], head: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """stat, before, after, delta of loc, tokens, files, risks, todos, secrets and vulns.

    A side: files (loc, tokens, todos), risks (category, severity), vulnerabilities (id).
    Secrets are exposed ones, vulnerabilities distinct ids.
    """

    def side(files: DataFrame, risks: DataFrame, vulnerabilities: DataFrame, name: str) -> DataFrame:
        zero = F.lit(0)
        one = files.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("loc", "tokens", "todos")], F.count("*").alias("files"))
        two = risks.agg(F.count("*").alias("risks"), F.count_if(is_exposed_secret(F.col("category"), F.col("severity"))).alias("secrets"))
        every = one.join(F.broadcast(two)).join(F.broadcast(vulnerabilities.agg(F.countDistinct("id").alias("vulns"))))  # one row each
        names = ("loc", "tokens", "files", "risks", "todos", "secrets", "vulns")
        return every.select(F.expr("stack(7, " + ", ".join(f"'{n}', cast(`{n}` as long)" for n in names) + f") as (stat, {name})"))

    both = side(*base, "before").join(F.broadcast(side(*head, "after")), "stat")  # seven rows
    return both.select("stat", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def one_sided(base: DataFrame, head: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, side: 'fixed' if the key stands on the base side only, 'new' if on the head side only."""
    b, h = base.select(*keys).distinct(), head.select(*keys).distinct()
    return b.join(h, list(keys), "left_anti").withColumn("side", F.lit("fixed")).unionAll(h.join(b, list(keys), "left_anti").withColumn("side", F.lit("new")))


def severity_shift(base: DataFrame, head: DataFrame) -> DataFrame:
    """One row: weighted score before and after, and the shift."""
    b, h = (d.agg(F.coalesce(F.sum(severity_weight(F.col("severity"))), F.lit(0)).alias(n)) for d, n in ((base, "before"), (head, "after")))
    return b.join(F.broadcast(h)).withColumn("shift", F.col("after") - F.col("before"))


def multiset_diff(base: DataFrame, head: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of either side left after pairing the k-th of each key: side 'fixed' or 'new', and all columns.

    Counts by key and side, which combine before the shuffle, tell which keys differ and
    how many rows pair.  Rows are dealt by key over tasks in step with their number, and
    sorted once: ranks come before the join with the counts, which keeps their order.
    """
    names = base.columns
    both = base.select(*key).withColumn("__b", F.lit(1)).unionAll(head.select(*key).withColumn("__b", F.lit(0)))
    counts = both.groupBy(*key).agg(F.sum("__b").alias("__nb"), F.count("*").alias("__n"))
    longer = counts.select(*key, (F.col("__nb") * 2 - F.col("__n")).alias("__more"), F.least("__nb", F.col("__n") - F.col("__nb")).alias("__paired")).where("__more <> 0")
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    n = both.agg(F.count_if(F.col("__b") == 1).alias("base"), F.count_if(F.col("__b") == 0).alias("head")).first()

    def left(df: DataFrame, total: int, which: str, side: str) -> DataFrame:
        ranked = dealt(df, *key, total=total).withColumn("__k", place)
        return ranked.join(longer.where(which), list(key)).where("__k > __paired").select(*names, F.lit(side).alias("side"))

    return left(base, n["base"], "__more > 0", "fixed").unionByName(left(head, n["head"], "__more < 0", "new"))


def moved_pairs(left: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Second pass over a multiset diff: pairs of a fixed and a new row that share the narrower key also cancel."""
    n = F.row_number().over(W.partitionBy("side", *key).orderBy(*order))
    ranked = left.withColumn("__n", n)
    other = ranked.select(F.when(F.col("side") == "new", "fixed").otherwise("new").alias("side"), *key, "__n")
    return ranked.join(other, ["side", *key, "__n"], "left_anti").drop("__n")


def keyed_diff(prev: DataFrame, nxt: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(added rows, deleted keys); a changed row is deleted and added.  Null or repeated keys raise when the result is computed."""
    names = [c for c in prev.columns if c != key]
    sides = []
    for df in (prev, nxt):
        n = F.count("*").over(W.partitionBy(key))
        ok = df.withColumn("__n", n).withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit("null key"))).when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string")))).otherwise(F.col(key)))
        sides.append(ok.select(key, F.struct(*names).alias("row")))
    p, x = sides
    both = p.withColumnRenamed("row", "old").join(x.withColumnRenamed("row", "new"), key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.where("new is not null").select(key, "new.*"), both.where("old is not null").select(key)


def graded_sides(base: DataFrame, head: DataFrame, key: Sequence[str], same_rules: bool) -> DataFrame:
    """Keys and number of findings that a comparison grades: all where both sides ran the same rules, else those of one side only."""
    both = base.select(*key).unionAll(head.select(*key))
    if not same_rules:
        both = both.join(one_sided(base, head, key).select(*key), list(key), "left_semi")
    return both.groupBy(*key).agg(F.count("*").alias("findings"))


def apply_diff(prev: DataFrame, added: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Deletes before adds."""
    return prev.join(deleted.select(key), key, "left_anti").unionByName(added)


def apply_chain(master: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Master rows after a chain of change sets: `changes` has seq, op ('x' or '+') and the row; the latest decides, '+' after 'x' in one set."""
    names = [key, *[c for c in master.columns if c != key]]
    rows = master.select(*names, F.lit(-1).cast("long").alias("seq"), F.lit("+").alias("op")).unionByName(changes.select(*names, F.col("seq").cast("long").alias("seq"), "op"))
    last = F.max_by(F.struct("op", *names[1:]), F.struct("seq", F.when(F.col("op") == "+", 1).otherwise(0)))
    return rows.groupBy(key).agg(last.alias("l")).where("l.op = '+'").select(key, *[f"l.{c}" for c in names[1:]])


def since_mtime(files: DataFrame, moment: str) -> DataFrame:
    """Files modified strictly after the moment; an unreadable moment gives none."""
    return files.where(F.col("mtime") > F.try_to_timestamp(F.lit(moment)).cast("timestamp_ntz"))


def since_baseline(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, kind (added, modified, removed), mtime; by kind, then most recent first."""
    d = file_diff(base, head).select("path", F.when(F.col("change") == "changed", "modified").otherwise(F.col("change")).alias("kind"))
    return d.join(head.select("path", "mtime"), "path", "left")


def cycle_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """head scc, state: 'old' if a base cycle holds all of its members, 'grown' if one shares some, else 'fresh'.

    Both sides are (scc, id); they meet on members, so cycles are never compared pairwise.
    """
    size = head.groupBy("scc").agg(F.count("*").alias("n"))
    shared = head.join(base.select(F.col("scc").alias("b"), "id"), "id").groupBy("scc", "b").agg(F.count("*").alias("m")).groupBy("scc").agg(F.max("m").alias("m"))
    state = F.when(F.col("m").isNull(), "fresh").when(F.col("m") >= F.col("n"), "old").otherwise("grown")
    return size.join(shared, "scc", "left").select("scc", state.alias("state"))


def verdict(files: DataFrame, risks: DataFrame, reach: DataFrame, cycles: DataFrame, vulnerabilities: DataFrame | None = None) -> DataFrame:
    """One row: severity (of the worst finding, 'none' without one), findings, changed_files, loc_delta of a change.

    files: file_diff rows; risks: (severity, category, side); reach: (seed, reached);
    cycles: (state); vulnerabilities: (id, severity, scope, side).  New exposed secrets are
    one finding, high; other new risks one, low; fresh and grown cycles one each, medium;
    the file with most dependents one, low from 5 and medium from 20 on; new vulnerabilities
    of direct scope one, as severe as the worst of them (an unknown one is medium).  What is
    not graded (fixtures, possible secrets, dev and transitive scopes) never raises it.
    """

    def finding(df: DataFrame, severity: Column) -> DataFrame:
        return df.select(severity.alias("severity")).where("severity is not null")

    new = risks.where("side = 'new'")
    exposed = is_exposed_secret(F.col("category"), F.col("severity"))
    tally = new.agg(F.count_if(exposed).alias("secrets"), F.count_if(F.col("category") != "secret").alias("others"))
    loops = cycles.agg(F.count_if(F.col("state") == "fresh").alias("fresh"), F.count_if(F.col("state") == "grown").alias("grown"))
    hot = reach.agg(F.max("reached").alias("reached"))
    every = (
        finding(tally, F.when(F.col("secrets") > 0, "high")).unionAll(finding(tally, F.when(F.col("others") > 0, "low")))
        .unionAll(finding(loops, F.when(F.col("fresh") > 0, "medium"))).unionAll(finding(loops, F.when(F.col("grown") > 0, "medium")))
        .unionAll(finding(hot, F.when(F.col("reached") >= 20, "medium").when(F.col("reached") >= 5, "low")))
    )
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    if vulnerabilities is not None:
        level = F.array_position(names, F.when(F.col("severity").isin("critical", "high", "medium", "low"), F.col("severity")).otherwise("medium"))
        worst = vulnerabilities.where((F.col("side") == "new") & is_graded(F.col("scope"))).agg(F.max(level).cast("int").alias("r"))
        every = every.unionAll(finding(worst, F.when(F.col("r").isNotNull(), F.element_at(names, F.col("r")))))
    top = every.agg(F.coalesce(F.max(F.array_position(names, F.col("severity"))), F.lit(1)).cast("int").alias("r"), F.count("*").alias("findings"))
    changed = files.agg(F.count("*").alias("changed_files"), F.coalesce(F.sum("loc_delta"), F.lit(0)).alias("loc_delta"))
    return top.join(F.broadcast(changed)).select(F.element_at(names, F.col("r")).alias("severity"), "findings", "changed_files", "loc_delta")  # one row each


def sync_mode(requests: DataFrame) -> DataFrame:
    """mode for (have, current, parent): 'unchanged', 'diff' or 'full'; shas compare by their first 12 digits."""
    h, c, p = (F.substring(n, 1, 12) for n in ("have", "current", "parent"))
    return requests.withColumn("mode", F.when(h == c, "unchanged").when(h == p, "diff").otherwise("full"))
