"""Roll-ups: totals, directory tree, environment reads, health, git history, rubric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalens.functions.scalar import dirname, round4
from stratalens.operators.security import is_exposed_secret, is_graded

#: points a vulnerability costs by severity, others 2; and factor -> (points each, most points); fixed values
VULNERABILITY_POINTS = {"critical": 20, "high": 12, "medium": 5, "low": 2, "unknown": 2, "info": 0}
FACTORS = {"secrets exposed": (25, 60), "known vulnerabilities": (1, 50), "broken imports": (8, 32), "import cycles": (3, 18), "oversized files": (2, 10), "stale files": (1, 10), "TODOs": (0.02, 6)}
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.sum("loc").alias("loc"), F.sum("tokens").alias("tokens"), F.count("*").alias("files"))


def share_of(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Adds each row's share of the total, four digits; for grouped tables of few rows."""
    return df.withColumn(name, round4(F.col(value) / F.sum(value).over(W.partitionBy())))


def tree_rollup(files: DataFrame, measures: Sequence[str]) -> DataFrame:
    """dir, files and sums of the measures at every ancestor directory; the root is ''.

    Files are summed by their own directory first, so only directories are exploded.
    """
    own = files.groupBy(dirname(F.col("path")).alias("d")).agg(*[F.sum(m).alias(m) for m in measures], F.count("*").alias("files"))
    parts = F.split("d", "/")
    ancestors = F.when(F.col("d") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    return own.withColumn("dir", F.explode(ancestors)).groupBy("dir").agg(*[F.sum(m).alias(m) for m in measures], F.sum("files").alias("files"))


def env_rollup(reads: DataFrame, least_share: float = 0.75) -> DataFrame:
    """name, n, defaults (distinct ones, sorted, joined by commas), n_defaults, primary_access of environment reads (name, file, line, access, default).

    The primary access is the most frequent one if it has at least `least_share` of the
    reads, else null; of equally frequent ones the one read first by (file, line).
    """
    by_access = reads.groupBy("name", "access").agg(F.count("*").alias("n"), F.min(F.struct("file", "line")).alias("first"))
    best = by_access.groupBy("name").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("neg"), "first", "access")).alias("b"))
    defaults = env_defaults(reads).groupBy("name").agg(F.count("*").alias("n_defaults"), F.array_join(F.sort_array(F.collect_list("default")), ",").alias("defaults"))
    primary = F.when(-F.col("b.neg") >= least_share * F.col("total"), F.col("b.access"))
    return best.join(defaults, "name", "left").select("name", F.col("total").alias("n"), F.coalesce("defaults", F.lit("")).alias("defaults"), F.coalesce("n_defaults", F.lit(0)).alias("n_defaults"), primary.alias("primary_access"))


def env_defaults(reads: DataFrame) -> DataFrame:
    """name, default, n of the defaults that environment reads (name, default) give."""
    return reads.where("default is not null").groupBy("name", "default").agg(F.count("*").alias("n"))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def health(risks: DataFrame, files: DataFrame, vulnerabilities: DataFrame, cycles: DataFrame, key: str | None = None) -> DataFrame:
    """score, grade and the three largest factors (most points first, then by name); per `key` if given.

    risks: (category, rule, severity, file); files: (status, todos); vulnerabilities:
    (severity, scope); cycles: one row a cycle.  Exposed secrets, vulnerabilities of direct
    scope, files with broken imports or unreadable text, cycles, large and stale files and
    every fifty markers cost points up to a cap each; only factors that cost are listed.
    Everything is counted before the shuffle; one row a factor and key meets.
    """
    keys = [key] if key else []
    broken = F.when(F.col("category").isin("broken-import", "parse-error", "read-error") & (F.col("rule") != "unscanned-import"), F.col("file"))
    points = F.create_map(*[F.lit(x) for kv in VULNERABILITY_POINTS.items() for x in kv])

    def count(df: DataFrame, **labels: Column) -> DataFrame:
        one = df.groupBy(*keys).agg(*[c.cast("double").alias(n) for n, c in labels.items()])
        pairs = ", ".join(f"'{n.replace('_', ' ')}', `{n}`" for n in labels)
        return one.select(*keys, F.expr(f"stack({len(labels)}, {pairs}) as (factor, n)"))

    every = (
        count(risks, secrets_exposed=F.count_if(is_exposed_secret(F.col("category"), F.col("severity"))), broken_imports=F.countDistinct(broken), oversized_files=F.count_if(F.col("category") == "large-file"))
        .unionAll(count(files, stale_files=F.count_if(F.col("status") == "stale"), TODOs=F.coalesce(F.sum("todos"), F.lit(0))))
        .unionAll(count(vulnerabilities, known_vulnerabilities=F.coalesce(F.sum(F.when(is_graded(F.col("scope")), F.coalesce(points[F.col("severity")], F.lit(2)))), F.lit(0))))
        .unionAll(count(cycles, import_cycles=F.count("*")))
    )
    each, most = (F.create_map(*[F.lit(x) for n, v in FACTORS.items() for x in (n, float(v[k]))]) for k in (0, 1))
    raw = F.floor(F.round(F.col("n") * each[F.col("factor")], 6))
    cost = every.select(*keys, "factor", F.least(F.greatest(F.lit(0.0), raw.cast("double")), most[F.col("factor")]).cast("long").alias("cost"))
    # at most one entry a factor
    listed = F.array_sort(F.collect_list(F.when(F.col("cost") > 0, F.struct((-F.col("cost")).alias("neg"), "factor"))))
    factors = F.array_join(F.transform(F.slice(listed, 1, 3), lambda x: x["factor"]), ",")
    out = cost.groupBy(*keys).agg(F.greatest(F.lit(0), 100 - F.sum("cost")).cast("long").alias("score"), factors.alias("factors"))
    return out.withColumn("grade", grade(F.col("score")))


def git_stats(commits: DataFrame, window_start: str, contributors: int = 3) -> DataFrame:
    """path, last, churn, authors, top of commit rows (path, author, name, ts).

    `last` looks at all rows; churn and authors at those from `window_start` on; top holds
    the authors with most commits, then the most recent.
    """
    recent = commits.where(F.col("ts") >= F.lit(window_start).cast("timestamp_ntz"))
    by_author = recent.groupBy("path", "author").agg(F.count("*").alias("n"), F.max("ts").alias("latest"), F.max_by("name", "ts").alias("name"))
    place = F.row_number().over(W.partitionBy("path").orderBy(F.desc("n"), F.desc("latest"), "author"))
    top = by_author.withColumn("place", place).groupBy("path").agg(
        F.sum("n").alias("churn"), F.count("*").alias("authors"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= contributors, F.struct("place", "author")))), lambda x: x["author"]), ",").alias("top")
    )
    return commits.groupBy("path").agg(F.max("ts").alias("last")).join(top, "path", "left")


def recall_report(runs: DataFrame) -> DataFrame:
    """task, recall, savings of retrieval runs (task, expected array, found array, tokens, baseline)."""
    hit = F.size(F.array_intersect("expected", "found"))
    return runs.select("task", round4(F.when(F.size("expected") == 0, F.lit(1.0)).otherwise(hit / F.size("expected"))).alias("recall"), round4((F.col("baseline") - F.col("tokens")) / F.col("baseline")).alias("savings"))


def rubric(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """item, score: weighted mean of clamped criteria (item, criterion, value), renormalised over those present."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    rows = scores.where("value is not null").withColumn("w", w[F.col("criterion")]).where("w is not null")
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value")))
    return rows.groupBy("item").agg(round4(F.sum(v * F.col("w")) / F.sum("w")).alias("score"))


def price_ladder(usage: DataFrame, prices: dict[str, float]) -> DataFrame:
    """item, model, saved, ratio, cost: every model of a price table (model to rate for a million tokens) for every usage row (item, tokens, baseline).

    The price table is the user's; its rows are exploded beside each usage row, so nothing is joined or shuffled.
    """
    table = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(r)).alias("rate")) for m, r in prices.items()])
    out = usage.withColumn("__p", F.explode(table)).select("*", "__p.model", "__p.rate")
    return out.select("item", "model", (F.col("baseline") - F.col("tokens")).alias("saved"), round4(F.col("tokens") / F.col("baseline")).alias("ratio"), round4(F.col("tokens") / 1e6 * F.col("rate")).alias("cost"))


def review_floor(files: DataFrame, tiers: Sequence[tuple[int, int]]) -> DataFrame:
    """path, passes: sum of the passes of every tier (least lines, passes) a file reaches."""
    total = sum((F.when(F.col("loc") >= least, n).otherwise(0) for least, n in tiers), F.lit(0))
    return files.select("path", total.cast("long").alias("passes"))


def review_tokens(files: DataFrame) -> DataFrame:
    """One row: tokens and non_test_tokens of files (path, tokens); a path with test, fixture or .spec. in it is a test's."""
    test = F.col("path").contains("test") | F.col("path").contains("fixture") | F.col("path").contains(".spec.")
    tokens = F.greatest(F.lit(0), F.col("tokens"))
    return files.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(~test, tokens)), F.lit(0)).alias("non_test_tokens"))


def classify(items: DataFrame, text: str, rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Adds `tier`: the tier with the largest sum of weights over rules (tier, pattern, weight) that match; ties to the earliest rule; null if none does."""
    tiers = list(dict.fromkeys(t for t, _, _ in rules))
    sums = [sum((F.when(F.col(text).rlike(p), w).otherwise(0.0) for t2, p, w in rules if t2 == t), F.lit(0.0)) for t in tiers]
    best = F.greatest(*sums, F.lit(0.0))
    out = F.lit(None).cast("string")
    for t, s in reversed(list(zip(tiers, sums, strict=True))):
        out = F.when((s == best) & (best > 0), t).otherwise(out)
    return items.withColumn("tier", out)
