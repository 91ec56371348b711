"""Sheets whose parts come and go with the key, their bands, gaps and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import css
from stratalens.plans.outline_queries import source_texts
from stratalens.registry import query

LINES = (
    ("true", "/* .no { } @media (max-width: 1px) {} */ @import url(x.css);"), ("true", ".card { width: 10px; color: red !important }"), ("c_custkey % 2 = 0", ".card { color: blue; }"), ("c_custkey % 3 = 0", ".dup{a:b}"), ("c_custkey % 3 = 0", ".dup { a : b }"), ("c_custkey % 5 = 0", "#top a { x: y }"),
    ("c_custkey % 7 = 0", "@media (max-width: 767.98px) {"), ("c_custkey % 7 = 0", "  .card { color: green }"), ("c_custkey % 7 = 0", "}"),
    ("c_custkey % 4 = 1", "@media screen and (min-width: 64rem) and (max-width: 1439px), (width >= 1500px) {"), ("c_custkey % 4 = 1", "  .x { width: 1px; &:hover { width: 2px } }"), ("c_custkey % 4 = 1", "  @media (20em <= width < 700px) { .y1 { width: 2px } }"), ("c_custkey % 4 = 1", "}"),
    ("c_custkey % 6 = 0", "@font-face { font-family: q; src: url(a) }"), ("true", ".box, .Wrap12 { width : 3px }"), ("c_custkey % 8 = 0", "@container (min-width: 1px) { .z { aspect-ratio: 1 } }"), ("true", ".fooBar { color: color-mix(in srgb, red, blue) }"),
)
KEYS = "keys AS (SELECT concat('f', c_custkey) AS path, c_custkey AS k FROM customer)"


def blocks(spark, sf):
    return css.css_blocks(source_texts(spark, sf, LINES))


@query("a19_css_blocks", f"""
  WITH {KEYS}, all_ AS (SELECT path, k, b.* FROM keys, LATERAL (VALUES (true, 'rule', '.card', 'width: 10px; color: red !important', 1, false), (k % 2 = 0, 'rule', '.card', 'color: blue;', 0, false), (k % 3 = 0, 'rule', '.dup', 'a:b', 0, false), (k % 3 = 0, 'rule', '.dup', 'a : b', 0, false), (k % 5 = 0, 'rule', '#top a', 'x: y', 0, false),
    (k % 7 = 0, 'media', '@media (max-width: 767.98px)', NULL, 0, false), (k % 7 = 0, 'rule', '.card', 'color: green', 0, true), (k % 4 = 1, 'media', '@media screen and (min-width: 64rem) and (max-width: 1439px), (width >= 1500px)', NULL, 0, false), (k % 4 = 1, 'rule', '.x', 'width: 1px; &:hover {{ width: 2px }}', 0, true),
    (k % 4 = 1, 'media', '@media (20em <= width < 700px)', NULL, 0, true), (k % 4 = 1, 'rule', '.y1', 'width: 2px', 0, true), (true, 'rule', '.box, .Wrap12', 'width : 3px', 0, false), (k % 8 = 0, 'container', '@container (min-width: 1px)', NULL, 0, false), (k % 8 = 0, 'rule', '.z', 'aspect-ratio: 1', 0, true),
    (true, 'rule', '.fooBar', 'color: color-mix(in srgb, red, blue)', 0, false)) b(present, kind, prelude, body, important, responsive))
  SELECT path, kind, prelude, body, important, responsive FROM all_ WHERE present""")  # fmt: skip
def all_blocks(spark, sf):
    return blocks(spark, sf).drop("line").withColumn("body", F.trim("body"))


POINTS = "(k % 7 = 0, 'max-width', 767), (k % 4 = 1, 'min-width', 1024), (k % 4 = 1, 'max-width', 1439), (k % 4 = 1, 'min-width', 1500), (k % 4 = 1, 'min-width', 320), (k % 4 = 1, 'max-width', 699)"


@query("a19_breakpoints", f"WITH {KEYS} SELECT path, feature, CAST(px AS BIGINT) AS px, count(*) AS n FROM keys, LATERAL (VALUES {POINTS}) b(present, feature, px) WHERE present GROUP BY ALL")
def points(spark, sf):
    return css.breakpoints(blocks(spark, sf))


@query("a19_device_bands", f"""
  WITH {KEYS} SELECT path, band, EXISTS (SELECT 1 FROM (VALUES {POINTS}) b(present, feature, px) WHERE present AND ((feature = 'max-width' AND px >= lo) OR (feature = 'min-width' AND px <= coalesce(hi, 999999)))) AS covered
  FROM keys, (VALUES ('mobile', 320, 480), ('large-mobile', 481, 767), ('tablet', 768, 1023), ('desktop', 1024, 1439), ('large-desktop', 1440, NULL)) t(band, lo, hi)""")  # fmt: skip
def bands(spark, sf):
    b = blocks(spark, sf)
    return css.device_bands(b, css.breakpoints(b))


# with both queries: 0-767, 320-699, 1024-1439, 1500-; a width is in a gap if no range holds it
@query("a19_media_gaps", f"""
  WITH {KEYS}, ranges AS (SELECT path, lo, hi FROM keys, LATERAL (VALUES (k % 7 = 0, 0, 767), (k % 4 = 1, 1024, 1439), (k % 4 = 1, 1500, 100000), (k % 4 = 1, 320, 699)) r(present, lo, hi) WHERE present),
  edges AS (SELECT path, 0 AS w FROM ranges UNION SELECT path, hi + 1 FROM ranges WHERE hi < 100000), starts AS (SELECT e.path, w FROM edges e WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.path = e.path AND r.lo <= e.w AND e.w <= r.hi))
  SELECT s.path, CAST(w AS BIGINT) AS from_px, CAST((SELECT min(r.lo) - 1 FROM ranges r WHERE r.path = s.path AND r.lo > s.w) AS BIGINT) AS to_px FROM starts s""")  # fmt: skip
def gaps(spark, sf):
    return css.media_gaps(blocks(spark, sf))


@query("a19_css_findings", f"""
  WITH {KEYS} SELECT path AS project, f.category, f.severity, CAST(f.n AS BIGINT) AS n FROM keys, LATERAL (VALUES (k % 2 = 0, 'conflict', 'medium', 1), (k % 3 = 0, 'duplicate', 'low', 1), (k % 5 = 0, 'specificity', 'medium', 1), (true, 'important', 'low', 1),
    (true, 'naming', 'low', 2 + CAST(k % 4 = 1 AS INT) + CAST(k % 8 = 0 AS INT)), (k % 4 <> 1 AND k % 7 <> 0, 'responsive', 'medium', 1), (k % 4 <> 1, 'responsive', 'low', 2), (k % 4 = 1, 'container-query', 'info', 4),
    (k % 10 <> 9 AND k % 10 <> 8, 'fallback', 'medium', 1 + CAST(k % 8 = 0 AS INT)), (k % 10 = 9, 'fallback', 'info', 1 + CAST(k % 8 = 0 AS INT))) f(present, category, severity, n) WHERE present""")  # fmt: skip
def findings(spark, sf):
    b = blocks(spark, sf).withColumnRenamed("path", "project").withColumn("scope", F.lit("global"))
    key = F.regexp_extract("path", "[0-9]+", 0).cast("long") % 10
    deps = F.when(key == 9, F.array(F.lit("lightningcss"))).when(key == 8, F.array(F.lit("postcss"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    return css.css_findings(b, source_texts(spark, sf, LINES).select(F.col("path").alias("project"), deps.alias("deps")))
