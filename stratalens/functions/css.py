"""Style sheets as blocks, breakpoints, device bands and findings.

A sheet is cut at braces and semicolons; a running sum gives each piece its depth, and the last
opener of every lesser depth tells what it stands in, so at-blocks nest and a rule's inner braces stay
in its body.  A task sorts the pieces of one sheet at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalens.joins import dealt
from stratalens.storage import cut

DEPTHS = 8  # at-blocks nested deeper count as part of a rule
# fixed values: device bands in px, the last one open, and the widths that stand for them
DEVICE_BANDS = (("mobile", 320, 480), ("large-mobile", 481, 767), ("tablet", 768, 1023), ("desktop", 1024, 1439), ("large-desktop", 1440, None))
TIERS = ("mobile", "tablet", "desktop")
# fixed values: features that older browsers lack
MODERN_FEATURES = (
    ("color-mix()", r"(?i)\bcolor-mix\s*\("), (":has()", r"(?i):has\s*\("), ("container queries", r"(?i)@container\b"), ("oklch()/oklab()", r"(?i)\boklch\s*\(|\boklab\s*\("),
    ("light-dark()", r"(?i)\blight-dark\s*\("), ("aspect-ratio", r"(?i)\baspect-ratio\s*:"), (":is()/:where()", r"(?i):is\s*\(|:where\s*\("), ("inset shorthand", r"(?i)\binset\s*:"),
)
# fixed values: class names that describe markup
NON_SEMANTIC = r"(?i)^(box|wrap(per)?|cont(ainer)?|div|el|elem|item|thing|block|inner|outer|main|content|temp|test|foo|bar)\d*$"
TRANSFORMERS = ("lightningcss", "postcss", "autoprefixer")
CLASS = r"\.(-?[A-Za-z_][\w-]*)"


def css_blocks(texts: DataFrame) -> DataFrame:
    """path, line, kind (rule, media, container), prelude, body, important, responsive of the blocks of sheets (path, text).

    A rule's body is its text up to the brace that closes it; that of at-blocks is null.  responsive: whether a rule stands
    in an @media or @container block.  Comments are blanked; statements like @import end at their
    semicolon; other at-blocks have no row.
    """
    bare = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(r"(?s)/\*.*?\*/|[^/]+|/"), 0), lambda p: F.when(p.startswith("/*"), F.regexp_replace(p, r"[^\n]", "")).otherwise(p)), "")
    cut_up = dealt(texts, "path").select("path", F.posexplode(F.regexp_extract_all(bare, F.lit(r"[^{};]*[{};]|[^{};]+"), 0)).alias("k", "piece"))
    file = W.partitionBy("path").orderBy("k")
    before, upto = file.rowsBetween(W.unboundedPreceding, -1), file.rowsBetween(W.unboundedPreceding, 0)
    opens, closes = F.col("piece").endswith("{"), F.col("piece").endswith("}")
    rows = cut_up.withColumn("depth", F.coalesce(F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(before), F.lit(0)))
    rows = rows.withColumn("line", F.sum(F.length("piece") - F.length(F.translate("piece", "\n", ""))).over(upto) + 1)
    prelude = F.trim(F.regexp_replace(F.regexp_replace("piece", r"\{$", ""), r"\s+", " "))
    lower = F.lower(F.ltrim(F.regexp_replace("piece", r"\s+", " ")))
    rows = rows.withColumn("kind", F.when(opens, F.when(lower.startswith("@media"), "media").when(lower.startswith("@container"), "container").when(lower.startswith("@"), "at").otherwise("rule")))
    around = [F.when(F.col("depth") > v, F.last(F.when(F.col("depth") == v, F.col("kind")), ignorenulls=True).over(before)) for v in range(DEPTHS)]
    rows = rows.withColumn("around", F.array_compact(F.array(*around)))
    inside = F.array_contains("around", "rule") | (F.col("depth") > DEPTHS)
    rows = rows.withColumn("inside", inside).withColumn("own", (F.col("kind") == "rule") & ~inside)
    rows = rows.withColumn("rule", F.sum(F.col("own").cast("int")).over(upto))
    # a rule ends with the first piece behind it that is back at its depth
    bodies = rows.where("inside").groupBy("path", "rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("body"))
    blocks = rows.where("own or (kind in ('media', 'container') and not inside)").withColumn("prelude", prelude)
    body = F.when(F.col("own"), F.coalesce(F.regexp_replace("body", r"\}$", ""), F.lit("")))
    found = blocks.join(bodies, ["path", "rule"], "left").withColumn("body", body)
    count = F.coalesce(F.size(F.regexp_extract_all("body", F.lit("!important"), 0)), F.lit(0))
    return found.select("path", "line", "kind", "prelude", "body", F.when(F.col("own"), count).otherwise(0).alias("important"), F.exists("around", lambda a: a.isin("media", "container")).alias("responsive"))


def _px(value: Column, unit: Column, at_least: Column, strict: Column) -> Column:
    """Whole px that reach the same widths: a least width rounds up, a greatest one down; a strict bound is not itself reached."""
    n = value.cast("double") * F.when(F.lower(unit) == "px", 1).otherwise(16)
    return F.when(at_least, F.when(strict, F.floor(n) + 1).otherwise(F.ceil(n))).otherwise(F.when(strict, F.ceil(n) - 1).otherwise(F.floor(n))).cast("long")


def width_bounds(query: Column) -> Column:
    """array of (feature, px) of a media query: `min-width: 3px`, `width >= 3px`, `3px <= width`."""
    number = r"([\d.]+)(px|rem|em)"

    def bounds(pattern: str, value: int, unit: int, at_least, strict) -> Column:
        def one(text: Column) -> Column:
            low, hard = at_least(text), strict(text)
            return F.struct(F.when(low, "min-width").otherwise("max-width").alias("feature"), _px(F.regexp_extract(text, pattern, value), F.regexp_extract(text, pattern, unit), low, hard).alias("px"))

        return F.transform(F.regexp_extract_all(query, F.lit(pattern), 0), one)

    legacy = bounds(rf"(?i)(min|max)-width\s*:\s*{number}", 2, 3, lambda t: F.lower(t).startswith("min"), lambda t: F.lit(False))
    ranged = bounds(rf"(?i)\bwidth\s*(>=|<=|>|<)\s*{number}\b", 2, 3, lambda t: t.contains(">"), lambda t: ~t.contains("="))
    turned = bounds(rf"(?i){number}\s*(>=|<=|>|<)\s*width\b", 1, 2, lambda t: t.contains("<"), lambda t: ~t.contains("="))
    return F.concat(legacy, ranged, turned)


def breakpoints(blocks: DataFrame, key: str = "path") -> DataFrame:
    """key, feature, px, n of the widths that @media blocks name."""
    return blocks.where("kind = 'media'").select(key, F.explode(width_bounds(F.col("prelude"))).alias("b")).groupBy(key, F.col("b.feature").alias("feature"), F.col("b.px").alias("px")).agg(F.count("*").alias("n"))


def device_bands(keys: DataFrame, points: DataFrame, key: str = "path") -> DataFrame:
    """key, band, covered for each key of `keys`: whether a greatest width reaches the band's start or a least width its end."""
    bands = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for n, lo, hi in DEVICE_BANDS])
    ends = points.groupBy(key).agg(F.max(F.when(F.col("feature") == "max-width", F.col("px"))).alias("most"), F.min(F.when(F.col("feature") == "min-width", F.col("px"))).alias("least"))
    rows = keys.select(key).distinct().join(ends, key, "left").withColumn("b", F.explode(bands))
    covered = F.coalesce(F.col("b.lo") <= F.col("most"), F.lit(False)) | F.coalesce(F.coalesce("b.hi", F.lit(1 << 53)) >= F.col("least"), F.lit(False))
    return rows.select(key, F.col("b.band").alias("band"), covered.alias("covered"))


def media_gaps(blocks: DataFrame, key: str = "path") -> DataFrame:
    """key, from_px, to_px (null: no end) of widths that no @media query with a bound reaches.

    A query's comma parts are ranges, from the largest least width to the smallest greatest one.  The union of the
    ranges is swept by the running maximum of their ends.
    """
    parts = blocks.where("kind = 'media'").select(key, F.explode(F.split("prelude", ",")).alias("q")).withColumn("b", width_bounds(F.col("q"))).where(F.size("b") > 0)
    side = lambda name: F.transform(F.filter("b", lambda x: x["feature"] == name), lambda x: x["px"])
    ranges = parts.select(key, F.coalesce(F.array_max(side("min-width")), F.lit(0)).cast("long").alias("lo"), F.coalesce(F.array_min(side("max-width")), F.lit(1 << 53)).cast("long").alias("hi")).where("lo <= hi")
    order = W.partitionBy(key).orderBy("lo", "hi")
    reached = ranges.withColumn("upto", F.coalesce(F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)))
    inner = reached.where(F.col("lo") > F.col("upto") + 1).select(key, (F.col("upto") + 1).alias("from_px"), (F.col("lo") - 1).alias("to_px"))
    last = ranges.groupBy(key).agg(F.max("hi").alias("hi")).where(F.col("hi") < 1 << 53).select(key, F.col("hi") + 1, F.lit(None).cast("long"))
    return inner.unionAll(last)


def _body(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"\s+", " "), r"\s*([:;{}])\s*", "$1"))


def css_findings(blocks: DataFrame, projects: DataFrame) -> DataFrame:
    """project, category, severity, n of the findings about a project's sheets.

    blocks: project, scope (the cascade a sheet belongs to) and the columns of `css_blocks`; projects: project, deps
    (array of lower-case names).  n counts what a finding is about.
    """
    blocks = cut(blocks, "css-blocks")  # read by every part below
    rules = blocks.where("kind = 'rule'")
    bare = rules.where(~F.col("responsive") & F.trim("prelude").rlike(r"^\.[-\w]+$"))
    named = bare.groupBy("project", "scope", F.trim("prelude").alias("selector")).agg(F.count("*").alias("n"), F.countDistinct(_body(F.col("body"))).alias("bodies")).where("n > 1")
    twice = named.groupBy("project").agg(F.count(F.when(F.col("bodies") > 1, 1)).alias("conflicts"), F.count(F.when(F.col("bodies") == 1, 1)).alias("repeats"))
    modern = F.array_compact(F.array(*[F.when(F.col("body").rlike(p), n) for n, p in MODERN_FEATURES]))
    wide = F.col("body").rlike(r"\bwidth\s*:") & F.col("prelude").contains(".")
    per = rules.groupBy("project").agg(
        F.count("*").alias("rules"), F.sum("important").alias("important"), F.count(F.when(F.col("prelude").contains("#"), 1)).alias("ids"), F.count(F.when(wide, 1)).alias("wide"),
        F.size(F.array_distinct(F.flatten(F.collect_set(modern)))).alias("modern"),  # sets of at most eight names
    )
    classes = rules.select("project", F.explode(F.regexp_extract_all("prelude", F.lit(CLASS), 1)).alias("c")).distinct()
    bad = F.col("c").rlike(NON_SEMANTIC) | F.col("c").rlike("(?i)^[a-z]$") | F.col("c").rlike(r"\d{2,}$")
    kebab = F.col("c").contains("-") & ~F.col("c").rlike("[A-Z]")
    names = classes.groupBy("project").agg(F.count(F.when(bad, 1)).alias("bad"), F.count(F.when(kebab, 1)).alias("kebab"), F.count(F.when(~kebab & F.col("c").rlike("[a-z][A-Z]"), 1)).alias("camel"))
    points = breakpoints(blocks, "project")
    media = points.groupBy("project").agg(F.count("*").alias("points"))
    boxes = blocks.where("kind = 'container'").groupBy("project").agg(F.count("*").alias("containers"))
    bands = device_bands(projects, points, "project").where(F.col("band").isin(*TIERS) & ~F.col("covered")).groupBy("project").agg(F.count(F.when(F.col("band") == "mobile", 1)).alias("no_mobile"), F.count(F.when(F.col("band") != "mobile", 1)).alias("no_wider"))
    seen = projects.select("project", "deps")
    for part in (per, twice, names, media, boxes, bands):
        seen = seen.join(part, "project", "left")
    seen = seen.na.fill(0)
    tools = F.arrays_overlap("deps", F.array(*map(F.lit, TRANSFORMERS)))
    n = F.col
    none = (n("points") == 0) & (n("rules") > 8)
    found = [
        ("conflict", F.lit("medium"), n("conflicts"), n("conflicts") > 0), ("duplicate", F.lit("low"), n("repeats"), n("repeats") > 0),
        ("specificity", F.when(n("ids") > 5, "high").otherwise("medium"), n("ids"), n("ids") > 0), ("important", F.when(n("important") > 30, "high").when(n("important") > 8, "medium").otherwise("low"), n("important"), n("important") > 0),
        ("naming", F.lit("low"), n("bad"), n("bad") > 0), ("casing", F.lit("info"), n("kebab") + n("camel"), (n("kebab") > 2) & (n("camel") > 2)),
        ("responsive", F.lit("high"), n("rules"), none), ("responsive", F.lit("medium"), n("no_mobile"), ~none & (n("no_mobile") > 0)), ("responsive", F.lit("low"), n("no_wider"), ~none & (n("no_wider") > 0)),
        ("container-query", F.lit("info"), n("wide"), (n("containers") == 0) & (n("wide") >= 3) & (n("points") > 0)),
        ("fallback", F.lit("medium"), n("modern"), (n("modern") > 0) & ~tools), ("fallback", F.lit("info"), n("modern"), (n("modern") > 0) & F.array_contains("deps", "lightningcss")),
    ]
    rows = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(c).alias("category"), s.alias("severity"), v.cast("long").alias("n"))) for c, s, v, when in found]))
    return seen.select("project", F.explode(rows).alias("f")).select("project", "f.*")
