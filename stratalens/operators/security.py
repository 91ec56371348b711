"""Dependencies and advisories: matching, fixed versions, severities, licence risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalens.functions.scalar import cvss2_score, cvss3_score, license_class, semver_key

SCOPES = ("direct", "dev", "transitive")


#: least to most severe; an unknown severity ranks as low when rows are merged
SEVERITY_ORDER = ("info", "low", "unknown", "medium", "high", "critical")


def is_exposed_secret(category: Column, severity: Column) -> Column:
    """A secret that counts: fixtures are low, possible ones info."""
    return (category == "secret") & ~severity.isin("low", "info")


def is_graded(scope: Column) -> Column:
    """A vulnerability that costs points: of a direct dependency, or of unknown scope."""
    return scope.isNull() | (scope == "direct")


def filter_findings(findings: DataFrame, severity: str | None = None, category: str | None = None, ecosystem: str | None = None, package: str | None = None) -> DataFrame:
    """Findings that meet all conditions given; the package by substring in any case."""
    for name, value in (("severity", severity), ("category", category), ("ecosystem", ecosystem)):
        if value is not None:
            findings = findings.where(F.col(name) == value)
    if package is not None:
        findings = findings.where(F.contains(F.lower("package"), F.lit(package.lower())))
    return findings


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), severity)


def severity(advisory_label: Column, v3: Column, v2: Column, v4: Column | None = None) -> Column:
    """A known label, else the CVSS 3 score, else the impact metrics of a CVSS 4 vector, else the CVSS 2 score (which has no critical band)."""
    label = F.lower(advisory_label)
    known = F.when(label.isin("moderate", "medium"), "medium").when(label.isin("critical", "high", "low"), label)

    def band(score: Column) -> Column:
        return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score.isNotNull(), "low")

    new = F.lit(None).cast("string") if v4 is None else F.when(v4.rlike(r"\bVC:H") & v4.rlike(r"\bVI:H") & v4.rlike(r"\bVA:H"), "critical").when(v4.rlike(r"\bV[CIA]:H"), "high").when(v4.rlike(r"\bV[CIA]:L"), "medium")
    old = cvss2_score(v2)
    return F.coalesce(known, band(cvss3_score(v3)), new, F.when(old >= 7, "high").otherwise(band(old)), F.lit("unknown"))


def match_advisories(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """id, package, version, severity, fixed of deps (package, version, scope) in a range (package, id, introduced, fixed, severity).

    Versions compare by sortable keys; a range without `fixed` is open.  A dependency in
    several ranges of one advisory counts once, with the lowest fix above it and the worst
    severity.
    """
    d = deps.withColumn("v", semver_key(F.col("version"))).where("v is not null")
    a = advisories.withColumn("lo", semver_key(F.coalesce("introduced", F.lit("0.0.0")))).withColumn("hi", semver_key(F.col("fixed")))
    inside = (F.col("v") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    hit = d.join(a, "package").where(inside)
    near = F.min(F.when(F.col("hi").isNotNull(), F.struct("hi", "fixed")))
    return hit.groupBy("id", "package", "version").agg(near["fixed"].alias("fixed"), F.max(F.struct(severity_rank(F.col("severity")).alias("r"), "severity"))["severity"].alias("severity"))


def fixed_versions(findings: DataFrame, events: DataFrame) -> DataFrame:
    """`findings` (id, package, installed) with `fixed`: the fix of the installed version's own range, else the lowest one above it.

    events: (id, package, affected, range, kind, event, introduced, fixed), one row an event of
    an advisory's ranges, in the order of the three numbers.  Entries of the finding's
    package count, or all where there is none; GIT ranges and versions that do not compare
    give the first fix only if nothing compares, and a version above every fix gives null.
    """
    place = F.struct("affected", "range", "event")
    since = F.last("introduced", ignorenulls=True).over(W.partitionBy("id", "affected", "range").orderBy("event"))
    fixes = events.withColumn("since", F.coalesce(since, F.lit("0"))).where("fixed <> ''").select("id", F.col("package").alias("of"), "kind", "since", "fixed", place.alias("place"))
    rows = findings.select("id", "package", "installed").distinct().join(fixes, "id")
    own = rows.withColumn("named", (F.col("of") == F.col("package")).cast("int"))
    any_named = own.groupBy("id", "package", "installed").agg(F.max("named").alias("named"))
    rows = own.join(any_named, ["id", "package", "installed", "named"])
    v, hi, lo = semver_key(F.col("installed")), semver_key(F.col("fixed")), semver_key(F.col("since"))
    rows = rows.withColumn("v", F.when(F.col("kind") != "GIT", v)).withColumn("hi", hi).withColumn("lo", lo)
    compares = F.col("v").isNotNull() & F.col("hi").isNotNull()
    below = compares & (F.col("v") < F.col("hi"))
    inside = below & ((F.col("since") == "0") | (F.col("lo") <= F.col("v")))
    picked = rows.groupBy("id", "package", "installed").agg(
        F.min_by("fixed", F.when(inside, F.col("place"))).alias("own"), F.min(F.when(below, F.struct("hi", "place", "fixed")))["fixed"].alias("above"), F.max(compares).alias("compared"), F.min_by("fixed", "place").alias("first")
    )
    fixed = F.coalesce("own", "above", F.when(~F.col("compared"), F.col("first")))
    return findings.join(picked.select("id", "package", "installed", fixed.alias("fixed")), ["id", "package", "installed"], "left")


def advisory_url(references: Column, id: Column) -> Column:
    """First http reference of type ADVISORY, else one to a host that lists advisories, else any, else the advisory's page; references: array of (type, url)."""
    web = F.filter(references, lambda r: r["url"].rlike("(?i)^https?://"))
    tiers = (F.filter(web, lambda r: r["type"] == "ADVISORY"), F.filter(web, lambda r: r["url"].contains("github.com/advisories")), web)
    return F.coalesce(*[F.try_element_at(t, F.lit(1))["url"] for t in tiers], F.concat(F.lit("https://osv.dev/vulnerability/"), id))


def reconcile(previous: DataFrame, queried: DataFrame) -> DataFrame:
    """Earlier findings that the present queries (package, version) still cover; those without a version by package alone."""
    known = previous.where("version is not null").join(queried.select("package", "version").distinct(), ["package", "version"], "left_semi")
    loose = previous.where("version is null").join(queried.select("package").distinct(), "package", "left_semi")
    return known.unionByName(loose)


def plan_labels(deps: DataFrame) -> DataFrame:
    """package, version, scope, source: one query a package and version; the closest scope wins, 'lockfile' if any row has it."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.col("scope"))
    one = deps.groupBy("package", "version").agg(F.min(rank).alias("r"), F.max(F.col("source") == "lockfile").alias("locked"))
    return one.select("package", "version", F.element_at(F.array(*[F.lit(s) for s in SCOPES]), F.col("r").cast("int")).alias("scope"), F.when(F.col("locked"), "lockfile").otherwise("range").alias("source"))


def outdated(deps: DataFrame, registry: DataFrame) -> DataFrame:
    """package, version, latest, state ('current', 'patch', 'minor', 'major', 'unknown')."""
    j = deps.join(registry.select("package", "latest"), "package", "left").withColumn("a", semver_key(F.col("version"))).withColumn("b", semver_key(F.col("latest")))
    state = F.when(F.col("a").isNull() | F.col("b").isNull(), "unknown").when(F.col("a") >= F.col("b"), "current").when(F.col("a.major") != F.col("b.major"), "major").when(F.col("a.minor") != F.col("b.minor"), "minor").otherwise("patch")
    return j.select("package", "version", "latest", state.alias("state"))


def license_risk(licence: Column) -> Column:
    """Severity a licence adds to a proprietary code base."""
    c = license_class(licence)
    return F.when(c == "strong-copyleft", "high").when(c.isin("weak-copyleft", "non-commercial"), "medium").when(c.isin("unknown", "other", "proprietary"), "low")


def vulnerability_flow(findings: DataFrame) -> DataFrame:
    """severity, target, n: findings grouped for a flow diagram; direct or unscoped ones keep their severity, others are 'ungraded'."""
    graded = F.col("scope").isNull() | (F.col("scope") == "direct")
    return findings.groupBy(F.when(graded, F.col("severity")).otherwise("ungraded").alias("severity"), F.concat_ws("@", "package", "version").alias("target")).agg(F.count("*").alias("n"))


def worktree_state(trees: DataFrame) -> DataFrame:
    """Adds integration, publish and commit_state by ordered rules over (ahead, behind, dirty, merged, upstream)."""
    integration = F.when(F.col("merged"), "integrated").when(F.col("ahead") == 0, "empty").when(F.col("behind") > 0, "diverged").otherwise("pending")
    publish = F.when(F.col("upstream").isNull(), "local").when(F.col("ahead") > 0, "unpushed").otherwise("published")
    commit = F.when(F.col("dirty") > 0, "uncommitted").otherwise("clean")
    return trees.withColumn("integration", integration).withColumn("publish", publish).withColumn("commit_state", commit)
