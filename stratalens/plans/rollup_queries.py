"""Roll-ups, resolution joins, retrieval and security over the adapted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import resolve as V
from stratalens.operators import retrieve as T
from stratalens.operators import rollup as R
from stratalens.operators import security as X
from stratalens.plans.adapters import EDGES, NODES, view
from stratalens.registry import query

READS = "SELECT concat('VAR', CAST(l_partkey % 60 AS STRING)) AS name, concat('f', CAST(l_orderkey AS STRING)) AS file, l_linenumber AS line, CASE WHEN l_quantity < 45 THEN 'required' ELSE 'optional' END AS access, CASE WHEN l_discount > 0.08 THEN CAST(l_suppkey % 4 AS STRING) END AS \"default\" FROM lineitem"


@query("a6_env_rollup", f"""
  WITH r AS ({READS}), a AS (SELECT name, access, count(*) AS n, min((file, line)) AS first FROM r GROUP BY name, access), t AS (SELECT name, sum(n) AS total FROM a GROUP BY name),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, first) AS k FROM a) WHERE k = 1), d AS (SELECT name, string_agg(DISTINCT "default", ',' ORDER BY "default") AS defaults, count(DISTINCT "default") AS n_defaults FROM r WHERE "default" IS NOT NULL GROUP BY name)
  SELECT name, CAST(total AS BIGINT) AS n, coalesce(defaults, '') AS defaults, coalesce(n_defaults, 0) AS n_defaults, CASE WHEN b.n >= 0.75 * total THEN access END AS primary_access FROM b JOIN t USING (name) LEFT JOIN d USING (name)""")  # fmt: skip
def env(spark, sf):
    return R.env_rollup(view(spark, sf, READS.replace('"default"', "`default`")))


@query("a6_env_defaults", f'SELECT name, "default", count(*) AS n FROM ({READS}) WHERE "default" IS NOT NULL GROUP BY name, "default"')
def env_default_rows(spark, sf):
    return R.env_defaults(view(spark, sf, READS.replace('"default"', "`default`")))


#: line items as an order's findings, files, vulnerabilities and cycles
RISKS = """SELECT l_orderkey AS project, CASE WHEN l_quantity > 44 THEN 'secret' WHEN l_quantity > 36 THEN 'broken-import' WHEN l_quantity > 32 THEN 'parse-error' WHEN l_quantity > 24 THEN 'large-file' ELSE 'style' END AS category,
  CASE WHEN l_linenumber = 2 THEN 'unscanned-import' ELSE 'rule' END AS rule, CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.05 THEN 'info' ELSE 'high' END AS severity, CASE WHEN l_linenumber <> 5 THEN concat('f', CAST(l_partkey % 2 AS STRING)) END AS file FROM lineitem"""
PROJECT_FILES = "SELECT l_orderkey AS project, CASE WHEN l_returnflag = 'R' THEN 'stale' ELSE 'fresh' END AS status, CAST(l_quantity * 3 AS BIGINT) AS todos FROM lineitem"
VULNERABLE = "SELECT l_orderkey AS project, CASE CAST(l_quantity AS BIGINT) % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' ELSE 'unknown' END AS severity, CASE WHEN l_linestatus = 'O' THEN 'direct' WHEN l_linenumber = 1 THEN NULL ELSE 'dev' END AS scope FROM lineitem"
CYCLES = "SELECT DISTINCT l_orderkey AS project, l_suppkey AS cycle FROM lineitem"


@query("a8_health", f"""
  WITH r AS ({RISKS}), f AS ({PROJECT_FILES}), v AS ({VULNERABLE}), c AS ({CYCLES}),
  p AS (SELECT project, 'secrets exposed' AS factor, least(60, 25 * count(*) FILTER (category = 'secret' AND severity NOT IN ('low', 'info'))) AS cost FROM r GROUP BY project
    UNION ALL SELECT project, 'broken imports', least(32, 8 * count(DISTINCT file) FILTER (category IN ('broken-import', 'parse-error', 'read-error') AND rule <> 'unscanned-import')) FROM r GROUP BY project
    UNION ALL SELECT project, 'oversized files', least(10, 2 * count(*) FILTER (category = 'large-file')) FROM r GROUP BY project
    UNION ALL SELECT project, 'stale files', least(10, count(*) FILTER (status = 'stale')) FROM f GROUP BY project
    UNION ALL SELECT project, 'TODOs', least(6, sum(todos) // 50) FROM f GROUP BY project
    UNION ALL SELECT project, 'known vulnerabilities', least(50, coalesce(sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 12 WHEN 'medium' THEN 5 WHEN 'info' THEN 0 ELSE 2 END) FILTER (scope IS NULL OR scope = 'direct'), 0)) FROM v GROUP BY project
    UNION ALL SELECT project, 'import cycles', least(18, 3 * count(*)) FROM c GROUP BY project),
  o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY cost DESC, factor) AS i FROM p)
  SELECT project, score, factors, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade
  FROM (SELECT project, CAST(greatest(0, 100 - sum(cost)) AS BIGINT) AS score, coalesce(string_agg(factor, ',' ORDER BY i) FILTER (WHERE i <= 3 AND cost > 0), '') AS factors FROM o GROUP BY project)""")  # fmt: skip
def health(spark, sf):
    return R.health(*[view(spark, sf, t) for t in (RISKS, PROJECT_FILES, VULNERABLE, CYCLES)], "project")


COMMITS = "SELECT concat('f', CAST(l_partkey % 300 AS STRING)) AS path, CAST(l_suppkey % 9 AS STRING) AS author, concat('name', CAST(l_suppkey % 9 AS STRING)) AS name, l_shipdate AS ts FROM lineitem"


@query("a9_git_stats", f"""
  WITH c AS ({COMMITS}), w AS (SELECT * FROM c WHERE ts >= TIMESTAMP '1996-01-01 00:00:00'), a AS (SELECT path, author, count(*) AS n, max(ts) AS latest FROM w GROUP BY path, author), o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, latest DESC, author) AS k FROM a),
  t AS (SELECT path, CAST(sum(n) AS BIGINT) AS churn, count(*) AS authors, string_agg(author, ',' ORDER BY k) FILTER (WHERE k <= 3) AS top FROM o GROUP BY path)
  SELECT c.path, max(c.ts) AS last, any_value(churn) AS churn, any_value(authors) AS authors, any_value(top) AS top FROM c LEFT JOIN t ON t.path = c.path GROUP BY c.path""")  # fmt: skip
def git(spark, sf):
    return R.git_stats(view(spark, sf, COMMITS), "1996-01-01 00:00:00")


@query("v18_review_floor", "SELECT concat('o', CAST(o_orderkey AS STRING)) AS path, CAST((CASE WHEN o_totalprice >= 1000 THEN 1 ELSE 0 END) + (CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END) + (CASE WHEN o_totalprice >= 250000 THEN 2 ELSE 0 END) AS BIGINT) AS passes FROM orders")
def floor(spark, sf):
    return R.review_floor(view(spark, sf, "SELECT concat('o', CAST(o_orderkey AS STRING)) AS path, o_totalprice AS loc FROM orders"), [(1000, 1), (100000, 1), (250000, 2)])


@query("v17_price_ladder", "SELECT CAST(o_orderkey AS BIGINT) AS item, model, b - t AS saved, floor(t / b * 10000 + 0.5) / 10000 AS ratio, floor(t / 1e6 * rate * 10000 + 0.5) / 10000 AS cost FROM (SELECT o_orderkey, floor(o_totalprice) AS t, floor(o_totalprice) * 2 + 1 AS b FROM orders) CROSS JOIN (VALUES ('small', 0.5::DOUBLE), ('large', 3.0::DOUBLE)) m(model, rate)")
def ladder(spark, sf):
    u = view(spark, sf, "SELECT CAST(o_orderkey AS BIGINT) AS item, CAST(floor(o_totalprice) AS DOUBLE) AS tokens, CAST(floor(o_totalprice) * 2 + 1 AS DOUBLE) AS baseline FROM orders")
    return R.price_ladder(u, {"small": 0.5, "large": 3.0})


@query("v20_rubric", "SELECT item, floor(sum(least(1.0, greatest(0.0, v)) * w) / sum(w) * 10000 + 0.5) / 10000 AS score FROM (SELECT user_id AS item, value / 100 AS v, CASE event_type WHEN 'click' THEN 2.0::DOUBLE WHEN 'view' THEN 1.0::DOUBLE WHEN 'purchase' THEN 5.0::DOUBLE END AS w FROM events) WHERE w IS NOT NULL GROUP BY item")
def rubric(spark, sf):
    return R.rubric(view(spark, sf, "SELECT user_id AS item, event_type AS criterion, value / 100 AS value FROM events"), {"click": 2.0, "view": 1.0, "purchase": 5.0})


@query("v9_tiers", "SELECT p_partkey, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a >= b THEN 'ui' ELSE 'data' END AS tier FROM (SELECT p_partkey, (CASE WHEN contains(lower(p_type), 'steel') THEN 2.0 ELSE 0 END) + (CASE WHEN contains(lower(p_type), 'plated') THEN 1.0 ELSE 0 END) AS a, (CASE WHEN contains(lower(p_type), 'copper') THEN 2.0 ELSE 0 END) + (CASE WHEN contains(lower(p_type), 'plated') THEN 1.5 ELSE 0 END) AS b FROM part)")
def tiers(spark, sf):
    rules = [("ui", "(?i)steel", 2.0), ("ui", "(?i)plated", 1.0), ("data", "(?i)copper", 2.0), ("data", "(?i)plated", 1.5)]
    return R.classify(view(spark, sf, "SELECT p_partkey, p_type FROM part"), "p_type", rules).select("p_partkey", "tier")


@query("j1_resolve_imports", f"""
  WITH n AS ({NODES}), i AS (SELECT id AS file, concat('../src/f', CAST(k AS STRING)) AS specifier FROM n),
  t AS (SELECT file, specifier, concat(regexp_replace(regexp_replace(file, '/[^/]*$', ''), '/[^/]*$', ''), '/src/', regexp_extract(specifier, '[^/]*$')) AS base FROM i)
  SELECT file, specifier, coalesce(a.id, b.id) AS target FROM t LEFT JOIN n a ON a.id = concat(base, '.ts') LEFT JOIN n b ON b.id = concat(base, '.py') WHERE a.id IS NOT NULL OR b.id IS NOT NULL""")  # fmt: skip
def imports(spark, sf):
    n = view(spark, sf, NODES)
    return V.resolve_imports(n.select(F.col("id").alias("file"), F.concat(F.lit("../src/f"), F.col("k").cast("string")).alias("specifier")), n.select(F.col("id").alias("path")))


@query("j2_alias", f"SELECT id AS file, CASE WHEN starts_with(id, 'building') THEN concat('building/lib/', name) ELSE concat('src/', name) END AS target FROM ({NODES})")
def alias(spark, sf):
    i = view(spark, sf, NODES).select(F.col("id").alias("file"), F.concat(F.lit("@/"), F.col("name")).alias("specifier"))
    return V.alias_targets(i, [("", "@/*", "src/*"), ("building", "@/*", "building/lib/*")]).select("file", "target")


@query("j3_longest_prefix", f"WITH n AS ({NODES}), p AS (SELECT DISTINCT grp AS prefix FROM n UNION SELECT concat(grp, '/n', CAST(nation AS STRING)) FROM n WHERE nation % 2 = 0) SELECT id, max_by(prefix, length(prefix)) AS prefix FROM n JOIN p ON id = prefix OR starts_with(id, concat(prefix, '/')) GROUP BY id")
def prefix(spark, sf):
    n = view(spark, sf, NODES)
    p = n.select(F.col("grp").alias("prefix")).union(n.where("nation % 2 = 0").select(F.concat("grp", F.lit("/n"), F.col("nation").cast("string")))).distinct()
    return V.longest_prefix(n.select("id"), "id", p)


SPANS = "SELECT concat('u', CAST(user_id % 40 AS STRING)) AS file, event_id % 1000 AS start, event_id % 1000 + CAST(floor(value) AS BIGINT) AS \"end\", event_id AS id FROM events WHERE event_type = 'signup'"
POINTS = "SELECT concat('u', CAST(user_id % 40 AS STRING)) AS file, event_id % 1000 AS line, event_id AS point FROM events WHERE event_type <> 'signup'"


@query("j5_interval_innermost", f"WITH s AS ({SPANS}), p AS ({POINTS}), x AS (SELECT p.point, s.id AS owner, row_number() OVER (PARTITION BY p.point ORDER BY s.\"end\" - s.start, s.start DESC, s.id) AS n FROM p JOIN s ON s.file = p.file AND p.line BETWEEN s.start AND s.\"end\") SELECT point, owner FROM x WHERE n = 1")
def innermost(spark, sf):
    s, p = view(spark, sf, SPANS.replace('"end"', "`end`")), view(spark, sf, POINTS)
    return V.innermost(p, s, "line").select("point", "owner")


@query("j15_enclosing_or_null", f"WITH s AS ({SPANS}), p AS ({POINTS}) SELECT count(*) AS points, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.file = p.file AND p.line BETWEEN s.start AND s.\"end\") THEN 0 ELSE 1 END) AS BIGINT) AS outside FROM p")
def enclosing(spark, sf):
    s, p = view(spark, sf, SPANS.replace('"end"', "`end`")), view(spark, sf, POINTS)
    return V.innermost(p, s, "line", outer=True).agg(F.count("*").alias("points"), F.count_if(F.col("owner").isNull()).alias("outside"))


SYMBOLS = "SELECT concat('y', CAST(o_orderkey AS STRING)) AS id, concat('f', CAST(o_custkey % 90 AS STRING)) AS file, concat('n', CAST(o_orderkey % 400 AS STRING)) AS name FROM orders"
REFS = "SELECT concat('f', CAST(l_partkey % 90 AS STRING)) AS file, concat('r', CAST(l_suppkey AS STRING)) AS src, concat('n', CAST(l_orderkey % 600 AS STRING)) AS name, 'call' AS kind FROM lineitem"
IMPORTED = "SELECT DISTINCT concat('f', CAST(c_custkey % 90 AS STRING)) AS file, concat('f', CAST(c_nationkey AS STRING)) AS target FROM customer"


@query("j6_reference_cascade", f"""
  WITH s AS ({SYMBOLS}), r AS ({REFS}), i AS ({IMPORTED}), h AS (SELECT file, name, min(id) AS d1 FROM s GROUP BY 1, 2), v AS (SELECT i.file, s.name, min(s.id) AS d2 FROM i JOIN s ON s.file = i.target GROUP BY 1, 2), g AS (SELECT name, min(id) AS d3, arg_min(file, id) AS f3, count(*) AS n FROM s GROUP BY name),
  c AS (SELECT r.src, r.kind, CASE WHEN d1 IS NOT NULL THEN 0 WHEN d2 IS NOT NULL THEN 1 WHEN f3 <> r.file AND n = 1 THEN 2 WHEN f3 <> r.file THEN 3 END AS tier, coalesce(d1, d2, CASE WHEN f3 <> r.file THEN d3 END) AS dst FROM r LEFT JOIN h USING (file, name) LEFT JOIN v USING (file, name) LEFT JOIN g USING (name))
  SELECT src, dst, kind, ['extracted', 'inferred', 'inferred', 'ambiguous'][min(tier) + 1] AS confidence, [1.0, 0.9, 0.7, 0.4][min(tier) + 1]::DOUBLE AS score FROM c WHERE tier IS NOT NULL AND src <> dst GROUP BY src, dst, kind""")  # fmt: skip
def cascade(spark, sf):
    return V.reference_targets(view(spark, sf, REFS), view(spark, sf, SYMBOLS), view(spark, sf, IMPORTED))


DECLARED = "SELECT concat('u', CAST(user_id % 40 AS STRING)) AS file, event_id % 1000 AS start, event_id % 1000 + CAST(floor(value) AS BIGINT) AS \"end\", concat('y', CAST(event_id AS STRING)) AS id, concat('n', CAST(event_id % 50 AS STRING)) AS name FROM events WHERE event_type = 'signup'"
NAMED = "SELECT concat('u', CAST(user_id % 40 AS STRING)) AS file, event_id % 1000 AS line, concat('n', CAST(event_id % 70 AS STRING)) AS name, 'call' AS kind FROM events WHERE event_type <> 'signup'"
USES = "SELECT DISTINCT concat('u', CAST(c_nationkey AS STRING)) AS file, concat('u', CAST(c_nationkey + 3 AS STRING)) AS target FROM customer"


@query("g16_symbol_graph", f"""
  WITH s AS ({DECLARED}), p AS ({NAMED}), i AS ({USES}), o AS (SELECT p.file, p.line, p.name, p.kind, s.id AS src, row_number() OVER (PARTITION BY p.file, p.line ORDER BY s."end" - s.start, s.start DESC, s.id) AS k FROM (SELECT DISTINCT * FROM p) p JOIN s ON s.file = p.file AND p.line BETWEEN s.start AND s."end"),
  w AS (SELECT file, line, arg_min(src, k) AS src FROM o GROUP BY 1, 2), r AS (SELECT DISTINCT p.file, w.src, p.name, p.kind FROM p JOIN w USING (file, line)),
  h AS (SELECT file, name, min(id) AS d1 FROM s GROUP BY 1, 2), v AS (SELECT i.file, s.name, min(s.id) AS d2 FROM i JOIN s ON s.file = i.target GROUP BY 1, 2), g AS (SELECT name, min(id) AS d3, arg_min(file, id) AS f3, count(*) AS n FROM s GROUP BY name),
  c AS (SELECT r.src, r.kind, CASE WHEN d1 IS NOT NULL THEN 0 WHEN d2 IS NOT NULL THEN 1 WHEN f3 <> r.file AND n = 1 THEN 2 WHEN f3 <> r.file THEN 3 END AS tier, coalesce(d1, d2, CASE WHEN f3 <> r.file THEN d3 END) AS dst FROM r LEFT JOIN h USING (file, name) LEFT JOIN v USING (file, name) LEFT JOIN g USING (name))
  SELECT src, dst, kind, ['extracted', 'inferred', 'inferred', 'ambiguous'][min(tier) + 1] AS confidence, [1.0, 0.9, 0.7, 0.4][min(tier) + 1]::DOUBLE AS score FROM c WHERE tier IS NOT NULL AND src <> dst GROUP BY src, dst, kind""")  # fmt: skip
def symbol_graph(spark, sf):
    """References placed in the innermost symbol around them, then resolved by tiers."""
    return V.symbol_graph(view(spark, sf, NAMED), view(spark, sf, DECLARED.replace('"end"', "`end`")), view(spark, sf, USES))


LOCKS = "SELECT DISTINCT concat('a/p', CAST(p_partkey % 20 AS STRING)) AS dir, concat('a/p', CAST(p_partkey % 20 AS STRING), '/q', CAST(p_size AS STRING)) AS importer, p_brand AS name, max(concat('1.', CAST(p_size AS STRING), '.0')) OVER (PARTITION BY p_partkey % 20, p_size, p_brand) AS version FROM part"
DEPS = "SELECT DISTINCT concat('a/p', CAST(p_partkey % 25 AS STRING), '/q', CAST(p_size AS STRING)) AS dir, p_brand AS name FROM part"


@query("j7_locked_versions", f"WITH l AS ({LOCKS}), d AS ({DEPS}) SELECT d.dir, d.name, l.version AS locked FROM d LEFT JOIN l ON l.importer = d.dir AND l.name = d.name AND starts_with(d.dir, concat(l.dir, '/'))")
def locked(spark, sf):
    return V.locked_versions(view(spark, sf, DEPS), view(spark, sf, LOCKS))


ENTITIES = "SELECT concat('e', CAST(s_suppkey AS STRING)) AS id, CASE WHEN s_suppkey % 2 = 0 THEN concat('Db.Table', CAST(s_suppkey % 30 AS STRING)) ELSE concat('table', CAST(s_suppkey % 30 AS STRING)) END AS name FROM supplier"
MENTIONS = "SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN concat('Db.Table', CAST(o_orderkey % 40 AS STRING)) ELSE concat('TABLE', CAST(o_orderkey % 40 AS STRING)) END AS name FROM orders"


@query("j9_named_entity", f"WITH e AS ({ENTITIES}), m AS ({MENTIONS}) SELECT m.name, coalesce((SELECT min(id) FROM e WHERE e.name = m.name), (SELECT min(id) FROM e WHERE lower(regexp_extract(e.name, '[^.]*$')) = lower(regexp_extract(m.name, '[^.]*$')))) AS target, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.name = m.name) THEN 'extracted' ELSE (SELECT CASE count(*) WHEN 0 THEN NULL WHEN 1 THEN 'inferred' ELSE 'ambiguous' END FROM e WHERE lower(regexp_extract(e.name, '[^.]*$')) = lower(regexp_extract(m.name, '[^.]*$'))) END AS confidence FROM m")
def entity(spark, sf):
    return V.named_entity(view(spark, sf, MENTIONS), view(spark, sf, ENTITIES))


QUESTION = "guard tests"
FACTS = f"SELECT id, name, loc / 10000.0 AS importance, tokens, CAST(tokens % 97 AS DOUBLE) AS recency FROM ({NODES})"


@query("r1_context", f"""
  WITH RECURSIVE f AS ({FACTS}), e AS ({EDGES}), m AS (SELECT *, CASE WHEN contains(id, '/tests/') THEN 1 ELSE 0 END AS hits FROM f), s AS (SELECT id FROM m WHERE hits > 0 ORDER BY hits DESC, importance DESC, id LIMIT 6),
  pairs AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), walk AS (SELECT id, 0 AS hops FROM s UNION SELECT p.b, w.hops + 1 FROM walk w JOIN pairs p ON p.a = w.id WHERE w.hops < 2), h AS (SELECT id, min(hops) AS hops FROM walk GROUP BY id),
  c AS (SELECT m.id, tokens, hops, 0.35::DOUBLE * importance::DOUBLE + 0.3::DOUBLE / (1 + hops) + 0.2::DOUBLE * (hits / 2) + 0.15::DOUBLE * (recency / (SELECT max(recency) FROM m JOIN h USING (id))) AS x FROM m JOIN h USING (id)),
  o AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k FROM (SELECT id, tokens, hops, floor(least(1.0, x) * 10000 + 0.5) / 10000 AS score FROM c)),
  fold AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, false AS took UNION ALL SELECT o.k, CASE WHEN used + tokens <= 60000 THEN used + tokens ELSE used END, used + tokens <= 60000 FROM fold JOIN o ON o.k = fold.k + 1)
  SELECT id, tokens, CAST(hops AS INTEGER) AS hops, false AS direct, score FROM o JOIN fold USING (k) WHERE took""")  # fmt: skip
def context(spark, sf):
    return T.assemble(view(spark, sf, FACTS), view(spark, sf, EDGES), QUESTION, 60000)


@query("r1_context_edges", f"WITH f AS (SELECT id FROM ({FACTS}) WHERE contains(id, '/tests/') ORDER BY importance DESC, id LIMIT 6), e AS ({EDGES}) SELECT src, dst, kind FROM e WHERE src IN (FROM f) OR dst IN (FROM f)".replace(") OR dst", ") AND dst"))
def context_edges(spark, sf):
    return T.connecting_edges(T.seeds(view(spark, sf, FACTS), QUESTION), view(spark, sf, EDGES)).select("src", "dst", "kind")


@query("r1_seeds", f"SELECT id FROM (SELECT id, loc FROM ({NODES})) WHERE contains(id, '/src/') ORDER BY loc DESC, id LIMIT 6")
def context_seeds(spark, sf):
    return T.seeds(view(spark, sf, NODES).withColumn("importance", F.col("loc")), "the src of files").select("id")


@query("r3_cold_start", f"SELECT id, tokens, CAST(0 AS INTEGER) AS hops, false AS direct, floor(loc / 10000 * 10000 + 0.5) / 10000 AS score FROM ({NODES}) WHERE id NOT LIKE '%.md' ORDER BY loc / 10000 DESC, id LIMIT 10")
def cold(spark, sf):
    return T.cold_start(view(spark, sf, NODES).withColumn("importance", F.col("loc") / 10000))


PACKAGES = "SELECT p_brand AS package, concat(CAST(p_size % 5 AS STRING), '.', CAST(p_size AS STRING), '.', CAST(p_partkey % 10 AS STRING)) AS version, CASE WHEN p_partkey % 3 = 0 THEN 'direct' WHEN p_partkey % 3 = 1 THEN 'dev' ELSE 'transitive' END AS scope, CASE WHEN p_partkey % 4 = 0 THEN 'lockfile' ELSE 'range' END AS source FROM part"
KEY = "CAST(string_split({0}, '.')[1] AS INTEGER) * 1000000 + CAST(string_split({0}, '.')[2] AS INTEGER) * 1000 + CAST(string_split({0}, '.')[3] AS INTEGER)"
#: two ranges of different severity for every advisory; they overlap, and some have no fix
ADVISORIES = """SELECT DISTINCT concat('ADV-', p_brand) AS id, p_brand AS package, '1.2.0' AS introduced, '3.10.5' AS fixed, 'medium' AS severity FROM part
  UNION ALL SELECT DISTINCT concat('ADV-', p_brand), p_brand, '2.0.0', '2.30.0', 'low' FROM part UNION ALL SELECT DISTINCT concat('ADV-', p_brand), p_brand, '3.0.0', CAST(NULL AS STRING), 'critical' FROM part"""


@query("s13_match_advisories", f"""WITH d AS (SELECT DISTINCT package, version FROM ({PACKAGES})), a AS ({ADVISORIES}),
  m AS (SELECT id, package, version, fixed, severity, {KEY.format('fixed')} AS k FROM d JOIN a USING (package) WHERE {KEY.format('version')} >= {KEY.format('introduced')} AND (fixed IS NULL OR {KEY.format('version')} < {KEY.format('fixed')}))
  SELECT id, package, version, arg_min(fixed, k) AS fixed, ['low', 'medium', 'critical'][max(list_position(['low', 'medium', 'critical'], severity))] AS severity FROM m GROUP BY 1, 2, 3""")  # fmt: skip
def advisories(spark, sf):
    return X.match_advisories(view(spark, sf, PACKAGES).select("package", "version").distinct(), view(spark, sf, ADVISORIES))


#: ranges [0, 1.10.0), [2.0.0, 2.20.0), [3.0.0, 3.5.0) of the package, one of another package and one of commits
EVENTS = " UNION ALL ".join(
    f"SELECT DISTINCT concat('ADV-', p_brand) AS id, {package} AS package, {a} AS affected, {r} AS `range`, '{kind}' AS kind, {e} AS event, {lo} AS introduced, {hi} AS fixed FROM part"
    for package, a, r, kind, e, lo, hi in (("'other'", 0, 0, "SEMVER", 0, "'0'", "NULL"), ("'other'", 0, 0, "SEMVER", 1, "NULL", "'9.9.9'"), ("p_brand", 1, 0, "GIT", 0, "NULL", "'abcdef'"), ("p_brand", 1, 1, "SEMVER", 0, "'0'", "NULL"), ("p_brand", 1, 1, "SEMVER", 1, "NULL", "'1.10.0'"), ("p_brand", 1, 1, "SEMVER", 2, "'2.0.0'", "'2.20.0'"), ("p_brand", 1, 2, "SEMVER", 0, "'3.0.0'", "'3.5.0'"))
)


@query("f16_fixed_versions", f"""WITH d AS (SELECT DISTINCT package, version FROM ({PACKAGES}) UNION ALL SELECT DISTINCT package, 'next' FROM ({PACKAGES})), k AS (SELECT package, version, CASE WHEN version <> 'next' THEN {KEY.format("replace(version, 'next', '0.0.0')")} END AS v FROM d)
  SELECT concat('ADV-', package) AS id, package, version AS installed, CASE WHEN v IS NULL THEN 'abcdef' WHEN v < 1010000 THEN '1.10.0' WHEN v < 2020000 THEN '2.20.0' WHEN v < 3005000 THEN '3.5.0' END AS fixed FROM k""")  # fmt: skip
def fixes(spark, sf):
    d = view(spark, sf, PACKAGES).select("package", "version").distinct()
    d = d.unionAll(d.select("package", F.lit("next")).distinct()).select(F.concat(F.lit("ADV-"), "package").alias("id"), "package", F.col("version").alias("installed"))
    return X.fixed_versions(d, view(spark, sf, EVENTS))


@query("a18_plan_labels", f"SELECT package, version, ['direct', 'dev', 'transitive'][min(list_position(['direct', 'dev', 'transitive'], scope))] AS scope, CASE WHEN max(source = 'lockfile') THEN 'lockfile' ELSE 'range' END AS source FROM ({PACKAGES}) GROUP BY 1, 2")
def labels(spark, sf):
    return X.plan_labels(view(spark, sf, PACKAGES))


@query("a17_outdated_summary", f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN {KEY.format('version')} >= 3020000 THEN 'current' WHEN string_split(version, '.')[1] <> '3' THEN 'major' WHEN string_split(version, '.')[2] <> '20' THEN 'minor' ELSE 'patch' END AS state FROM ({PACKAGES})) GROUP BY state")
def outdated(spark, sf):
    d = view(spark, sf, PACKAGES)
    return X.outdated(d, d.select("package", F.lit("3.20.0").alias("latest")).distinct()).groupBy("state").agg(F.count("*").alias("n"))


@query("p10_graded_findings", f"SELECT package, count(*) AS n FROM ({PACKAGES}) WHERE scope = 'direct' GROUP BY package")
def graded_scopes(spark, sf):
    return view(spark, sf, PACKAGES).where(X.is_graded(F.col("scope"))).groupBy("package").agg(F.count("*").alias("n"))


@query("p9_exposed_secrets", f"WITH r AS ({RISKS}) SELECT project, count(*) AS n FROM r WHERE category = 'secret' AND severity NOT IN ('low', 'info') GROUP BY project")
def exposed(spark, sf):
    return view(spark, sf, RISKS).where(X.is_exposed_secret(F.col("category"), F.col("severity"))).groupBy("project").agg(F.count("*").alias("n"))


@query("p11_finding_filters", f"WITH r AS (SELECT *, concat('Pkg', CAST(project % 30 AS STRING)) AS package, 'npm' AS ecosystem FROM ({RISKS})) SELECT project, rule, file FROM r WHERE severity = 'high' AND category = 'large-file' AND ecosystem = 'npm' AND contains(lower(package), 'kg2')")
def filters(spark, sf):
    r = view(spark, sf, RISKS).withColumn("package", F.concat(F.lit("Pkg"), (F.col("project") % 30).cast("string"))).withColumn("ecosystem", F.lit("npm"))
    return X.filter_findings(r, "high", "large-file", "npm", "KG2").select("project", "rule", "file")


@query("f17_advisory_url", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN concat('https://a.example/', p_brand) WHEN p_size % 5 = 1 THEN concat('https://github.com/advisories/', p_brand) WHEN p_size % 5 = 2 THEN 'HTTP://b.example/x' ELSE concat('https://osv.dev/vulnerability/', p_brand) END AS url FROM part""")
def urls(spark, sf):
    def ref(kind, url):
        return F.struct(F.lit(kind).alias("type"), url.alias("url"))

    n, web = F.col("p_size") % 5, F.lit("HTTP://b.example/x")
    refs = F.when(n == 0, F.array(ref("WEB", web), ref("ADVISORY", F.lit("javascript:alert(1)")), ref("ADVISORY", F.concat(F.lit("https://a.example/"), "p_brand")))).when(n == 1, F.array(ref("WEB", web), ref("WEB", F.concat(F.lit("https://github.com/advisories/"), "p_brand")))).when(n == 2, F.array(ref("ADVISORY", F.lit("data:x")), ref("WEB", web))).when(n == 3, F.array(ref("WEB", F.lit("ftp://x"))))
    return view(spark, sf, "SELECT p_partkey, p_size, p_brand FROM part").select("p_partkey", X.advisory_url(refs, F.col("p_brand")).alias("url"))


RECENT = "SELECT concat('V', CAST(p_partkey AS STRING)) AS id, p_brand AS package, CASE WHEN p_size % 4 > 0 THEN concat('1.0.', CAST(p_size % 4 AS STRING)) END AS version FROM part"
QUERIED = "SELECT DISTINCT p_brand AS package, concat('1.0.', CAST(p_size % 7 AS STRING)) AS version FROM part WHERE p_size > 20 AND p_brand < 'Brand#4'"


@query("j8_reconcile", f"WITH p AS ({RECENT}), q AS ({QUERIED}) SELECT id, package, version FROM p WHERE CASE WHEN version IS NULL THEN package IN (SELECT package FROM q) ELSE (package, version) IN (SELECT package, version FROM q) END")
def reconciled(spark, sf):
    return X.reconcile(view(spark, sf, RECENT), view(spark, sf, QUERIED))


@query("v15_vulnerability_flow", f"SELECT CASE WHEN scope = 'direct' THEN 'high' ELSE 'ungraded' END AS severity, concat(package, '@', version) AS target, count(*) AS n FROM ({PACKAGES}) GROUP BY 1, 2")
def flow(spark, sf):
    return X.vulnerability_flow(view(spark, sf, PACKAGES).withColumn("severity", F.lit("high")))


TREES = "SELECT c_custkey, c_custkey % 4 AS ahead, c_custkey % 3 AS behind, c_custkey % 2 AS dirty, c_custkey % 5 = 0 AS merged, CASE WHEN c_custkey % 7 <> 0 THEN 'origin' END AS upstream FROM customer"


@query("v22_worktree_state", f"SELECT c_custkey, CASE WHEN merged THEN 'integrated' WHEN ahead = 0 THEN 'empty' WHEN behind > 0 THEN 'diverged' ELSE 'pending' END AS integration, CASE WHEN upstream IS NULL THEN 'local' WHEN ahead > 0 THEN 'unpushed' ELSE 'published' END AS publish, CASE WHEN dirty > 0 THEN 'uncommitted' ELSE 'clean' END AS commit_state FROM ({TREES})")
def trees(spark, sf):
    return X.worktree_state(view(spark, sf, TREES)).select("c_custkey", "integration", "publish", "commit_state")


@query("v18_review_tokens", f"SELECT CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) FILTER (NOT contains(id, 'test')) AS BIGINT) AS non_test_tokens FROM ({NODES})")
def review_tokens(spark, sf):
    return R.review_tokens(view(spark, sf, NODES).select(F.col("id").alias("path"), "tokens"))


@query("v19_vendor_groups", "SELECT p_brand AS vendor, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_name) AS place, p_name AS model FROM part WHERE contains(lower(concat(p_name, ' ', p_brand)), 'brand') AND contains(lower(concat(p_name, ' ', p_brand)), 'l') AND p_retailprice <= 1500")
def vendors(spark, sf):
    return T.search_by_vendor(view(spark, sf, "SELECT p_brand AS vendor, p_name AS name, p_retailprice AS price FROM part"), ["BRAND", "l"], 1500)
