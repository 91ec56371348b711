"""Snapshot comparisons over the adapted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.joins import dealt
from stratalens.operators import diff as D
from stratalens.operators import graph as G
from stratalens.plans.adapters import BASE, EDGES, HEAD, NODES, PAIRS, RISKS_BASE, RISKS_HEAD, view
from stratalens.registry import query

B, H, RB, RH = f"b AS ({BASE})", f"h AS ({HEAD})", f"rb AS ({RISKS_BASE})", f"rh AS ({RISKS_HEAD})"
FILES = f"""d AS (SELECT coalesce(b.path, h.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(h.loc, 0) - coalesce(b.loc, 0) AS loc_delta, coalesce(h.tokens, 0) - coalesce(b.tokens, 0) AS token_delta
  FROM b FULL JOIN h ON b.path = h.path WHERE b.path IS NULL OR h.path IS NULL OR b.loc <> h.loc OR b.tokens <> h.tokens)"""


@query("d1_file_diff", f"WITH {B}, {H}, {FILES} SELECT * FROM d")
def file_diff(spark, sf):
    return D.file_diff(view(spark, sf, BASE), view(spark, sf, HEAD))


@query("d1_top_changes", f"WITH {B}, {H}, {FILES} SELECT path, loc_delta, token_delta FROM d WHERE change = 'changed' ORDER BY abs(token_delta) DESC, path LIMIT 50")
def top_changes(spark, sf):
    return D.file_diff(view(spark, sf, BASE), view(spark, sf, HEAD)).where("change = 'changed'").orderBy(F.abs("token_delta").desc(), "path").limit(50).drop("change")


STATS = {"loc": "sum(loc)", "files": "count(*)", "tokens": "sum(tokens)", "languages": "count(DISTINCT language)", "largest": "max(loc)"}


@query("d2_stat_deltas", f"WITH {B}, {H}, " + " , ".join(f"s{i} AS (SELECT '{k}' AS stat, (SELECT CAST({e} AS DOUBLE) FROM b) AS before, (SELECT CAST({e} AS DOUBLE) FROM h) AS after)" for i, (k, e) in enumerate(STATS.items())) + " SELECT stat, before, after, after - before AS delta FROM (" + " UNION ALL ".join(f"FROM s{i}" for i in range(len(STATS))) + ")")
def stat_deltas(spark, sf):
    return D.stat_deltas(view(spark, sf, BASE), view(spark, sf, HEAD), {k: F.expr(e) for k, e in STATS.items()})


@query("d3_finding_ids", f"WITH {RB}, {RH} SELECT rule, file, 'fixed' AS side FROM (SELECT rule, file FROM rb EXCEPT SELECT rule, file FROM rh) UNION ALL SELECT rule, file, 'new' FROM (SELECT rule, file FROM rh EXCEPT SELECT rule, file FROM rb)")
def finding_ids(spark, sf):
    return D.one_sided(view(spark, sf, RISKS_BASE), view(spark, sf, RISKS_HEAD), ["rule", "file"])


WEIGHT = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 2 END"


@query("a16_severity_shift", f"WITH {RB}, {RH} SELECT x.before, y.after, y.after - x.before AS shift FROM (SELECT CAST(sum({WEIGHT}) AS BIGINT) AS before FROM rb) x, (SELECT CAST(sum({WEIGHT}) AS BIGINT) AS after FROM rh) y")
def severity_shift(spark, sf):
    return D.severity_shift(view(spark, sf, RISKS_BASE), view(spark, sf, RISKS_HEAD))


MULTI = f"""{RB}, {RH}, nb AS (SELECT *, row_number() OVER (PARTITION BY rule, file ORDER BY line, severity, category) AS n FROM rb), nh AS (SELECT *, row_number() OVER (PARTITION BY rule, file ORDER BY line, severity, category) AS n FROM rh),
  m AS (SELECT rule, file, category, severity, line, 'fixed' AS side FROM nb ANTI JOIN nh USING (rule, file, n) UNION ALL SELECT rule, file, category, severity, line, 'new' FROM nh ANTI JOIN nb USING (rule, file, n))"""


@query("d4_risk_multiset_diff", f"WITH {MULTI} SELECT * FROM m")
def risks(spark, sf):
    return D.multiset_diff(view(spark, sf, RISKS_BASE), view(spark, sf, RISKS_HEAD), ["rule", "file"], ["line", "severity", "category"])


@query("d4_moved_risks", f"""WITH {MULTI}, k AS (SELECT *, row_number() OVER (PARTITION BY side, rule, category ORDER BY file, line, severity) AS n FROM m)
  SELECT side, rule, category, file, severity, line FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.side <> k.side AND o.rule = k.rule AND o.category = k.category AND o.n = k.n)""")  # fmt: skip
def moved(spark, sf):
    return D.moved_pairs(risks(spark, sf), ["rule", "category"], ["file", "line", "severity"])


@query("d5_graded_sides", f"WITH {RB}, {RH}, f AS (SELECT rule, file FROM (SELECT DISTINCT rule, file, 1 AS s FROM rb UNION ALL SELECT DISTINCT rule, file, 2 FROM rh) GROUP BY rule, file HAVING count(*) = 1) SELECT rule, file, count(*) AS findings FROM (SELECT rule, file FROM rb UNION ALL SELECT rule, file FROM rh) SEMI JOIN f USING (rule, file) GROUP BY rule, file")
def graded(spark, sf):
    """With different rule revisions only what stands on one side is graded."""
    return D.graded_sides(view(spark, sf, RISKS_BASE), view(spark, sf, RISKS_HEAD), ["rule", "file"], same_rules=False)


@query("d7_keyed_diff", f"WITH {B}, {H}, x AS (SELECT b.path AS o, h.path AS n FROM b FULL JOIN h ON b.path = h.path WHERE b.path IS NULL OR h.path IS NULL OR (b.loc, b.tokens, b.language, b.mtime) IS DISTINCT FROM (h.loc, h.tokens, h.language, h.mtime)) SELECT n AS path, '+' AS op FROM x WHERE n IS NOT NULL UNION ALL SELECT o, 'x' FROM x WHERE o IS NOT NULL")
def keyed(spark, sf):
    added, deleted = D.keyed_diff(view(spark, sf, BASE), view(spark, sf, HEAD), "path")
    return added.select("path", F.lit("+").alias("op")).unionAll(deleted.select("path", F.lit("x").alias("op")))


@query("d8_apply_chain", f"WITH {H} SELECT path, loc, tokens, language FROM h")
def chain(spark, sf):
    """Base plus the change set between base and head is head."""
    base = view(spark, sf, BASE).drop("mtime")
    added, deleted = D.keyed_diff(base, view(spark, sf, HEAD).drop("mtime"), "path")
    gone = deleted.select("path", *[F.lit(None).cast(t).alias(c) for c, t in base.dtypes if c != "path"], F.lit(1).alias("seq"), F.lit("x").alias("op"))
    return D.apply_chain(base, added.withColumn("seq", F.lit(1)).withColumn("op", F.lit("+")).unionByName(gone), "path")


@query("d9_since_mtime", f"WITH {H} SELECT path, mtime FROM h WHERE mtime > TIMESTAMP '1997-01-01 00:00:00'")
def since(spark, sf):
    return D.since_mtime(view(spark, sf, HEAD), "1997-01-01 00:00:00").select("path", "mtime")


@query("d10_since_baseline", f"WITH {B}, {H}, {FILES} SELECT d.path, CASE change WHEN 'changed' THEN 'modified' ELSE change END AS kind, h.mtime FROM d LEFT JOIN h ON h.path = d.path")
def since_base(spark, sf):
    return D.since_baseline(view(spark, sf, BASE), view(spark, sf, HEAD))


@query("d11_route_set_diff", f"WITH {RB}, {RH} SELECT rule, file, category, 'fixed' AS side FROM (SELECT rule, file, category FROM rb EXCEPT SELECT rule, file, category FROM rh) UNION ALL SELECT rule, file, category, 'new' FROM (SELECT rule, file, category FROM rh EXCEPT SELECT rule, file, category FROM rb)")
def route_sets(spark, sf):
    """Set difference by a composite key of three parts, as for routes."""
    return D.one_sided(view(spark, sf, RISKS_BASE), view(spark, sf, RISKS_HEAD), ["rule", "file", "category"])


#: findings of the change: categories so that exposed, possible and fixture secrets and others occur
CHANGE = "SELECT rule, file, CASE WHEN line % 3 = 0 THEN 'secret' ELSE category END AS category, CASE WHEN line % 5 = 0 THEN 'low' WHEN line % 7 = 0 THEN 'info' ELSE severity END AS severity, side FROM m"
STATES = "SELECT concat('c', CAST(n_nationkey AS STRING)) AS scc, CASE WHEN n_nationkey % 3 = 0 THEN 'fresh' WHEN n_nationkey % 3 = 1 THEN 'grown' ELSE 'old' END AS state FROM nation"
VULNS = "SELECT concat('V', CAST(p_partkey AS STRING)) AS id, CASE WHEN p_size % 5 = 0 THEN 'critical' WHEN p_size % 5 = 1 THEN 'unknown' ELSE 'low' END AS severity, CASE WHEN p_size % 5 = 0 THEN 'dev' ELSE 'direct' END AS scope, CASE WHEN p_size > 25 THEN 'new' ELSE 'fixed' END AS side FROM part"


@query("d12_verdict", f"""
    WITH {B}, {H}, {FILES}, {MULTI}, e AS ({EDGES}), reach AS (SELECT dst, count(DISTINCT src) AS reached FROM e GROUP BY dst), c AS (SELECT * FROM ({CHANGE}) WHERE side = 'new'), s AS ({STATES}), v AS (SELECT * FROM ({VULNS}) WHERE side = 'new' AND scope = 'direct'),
    f AS (SELECT 4 AS r FROM c WHERE category = 'secret' AND severity NOT IN ('low', 'info') LIMIT 1), g AS (SELECT 2 AS r FROM c WHERE category <> 'secret' LIMIT 1), l AS (SELECT DISTINCT 3 AS r, state FROM s WHERE state <> 'old'),
    t AS (SELECT CASE WHEN max(reached) >= 20 THEN 3 ELSE 2 END AS r FROM reach HAVING max(reached) >= 5), w AS (SELECT max(CASE severity WHEN 'low' THEN 2 WHEN 'high' THEN 4 WHEN 'critical' THEN 5 ELSE 3 END) AS r FROM v HAVING count(*) > 0),
    every AS (SELECT r FROM f UNION ALL SELECT r FROM g UNION ALL SELECT r FROM l UNION ALL SELECT r FROM t UNION ALL SELECT r FROM w)
    SELECT ['none', 'low', 'medium', 'high', 'critical'][coalesce(max(r), 1)] AS severity, count(*) AS findings, (SELECT count(*) FROM d) AS changed_files, (SELECT CAST(sum(loc_delta) AS BIGINT) FROM d) AS loc_delta FROM every""")  # fmt: skip
def verdict(spark, sf):
    reach = dealt(view(spark, sf, EDGES), "dst", "src").groupBy(F.col("dst").alias("seed")).agg(F.countDistinct("src").alias("reached"))
    change = F.when(F.col("line") % 3 == 0, "secret").otherwise(F.col("category")), F.when(F.col("line") % 5 == 0, "low").when(F.col("line") % 7 == 0, "info").otherwise(F.col("severity"))
    found = risks(spark, sf).select(change[0].alias("category"), change[1].alias("severity"), "side")
    return D.verdict(file_diff(spark, sf), found, reach, view(spark, sf, STATES), view(spark, sf, VULNS))


@query("d12_quiet_verdict", "SELECT 'none' AS severity, CAST(0 AS BIGINT) AS findings, CAST(0 AS BIGINT) AS changed_files, CAST(0 AS BIGINT) AS loc_delta")
def quiet(spark, sf):
    """A snapshot against itself."""
    base = view(spark, sf, BASE)
    same = D.multiset_diff(view(spark, sf, RISKS_BASE), view(spark, sf, RISKS_BASE), ["rule", "file"], ["line", "severity", "category"])
    none = view(spark, sf, EDGES).select(F.col("dst").alias("seed"), F.lit(0).alias("reached")).where(F.lit(False))
    return D.verdict(D.file_diff(base, base), same, none, view(spark, sf, STATES).where("state = 'old'"), view(spark, sf, VULNS).where("scope = 'dev'"))


@query("d13_sync_mode", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = o_custkey % 7 THEN 'unchanged' WHEN o_orderkey % 7 = o_custkey % 5 THEN 'diff' ELSE 'full' END AS mode FROM orders")
def sync(spark, sf):
    req = view(spark, sf, "SELECT o_orderkey, concat('aaaaaaaaaaa', CAST(o_orderkey % 7 AS STRING), 'x') AS have, concat('aaaaaaaaaaa', CAST(o_custkey % 7 AS STRING)) AS current, concat('aaaaaaaaaaa', CAST(o_custkey % 5 AS STRING)) AS parent FROM orders")
    return D.sync_mode(req).select("o_orderkey", "mode")


@query("d14_latest_snapshot", "SELECT max(name) AS name FROM (SELECT concat('snapshot-', strftime(o_orderdate, '%Y-%m-%d')) AS name FROM orders)")
def latest(spark, sf):
    return view(spark, sf, "SELECT concat('snapshot-', date_format(o_orderdate, 'yyyy-MM-dd')) AS name FROM orders").orderBy(F.desc("name")).limit(1)


def scc_sql(name: str, edges: str) -> str:
    return f"{name}_r AS (SELECT src AS a, dst AS b FROM ({edges}) UNION SELECT r.a, e.dst FROM {name}_r r JOIN ({edges}) e ON e.src = r.b), {name} AS (SELECT x.a AS id, min(least(x.a, x.b)) AS scc FROM {name}_r x JOIN {name}_r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"


@query("d6_cycle_delta", f"""WITH RECURSIVE e AS ({PAIRS}), {scc_sql('o', "SELECT * FROM e WHERE src NOT LIKE '%7.ts'")}, {scc_sql('h', 'SELECT * FROM e')},
  n AS (SELECT scc, count(*) AS n FROM h GROUP BY scc), m AS (SELECT scc, max(k) AS k FROM (SELECT h.scc, o.scc AS was, count(*) AS k FROM h JOIN o USING (id) GROUP BY 1, 2) GROUP BY scc)
  SELECT scc, CASE WHEN k IS NULL THEN 'fresh' WHEN k >= n THEN 'old' ELSE 'grown' END AS state FROM n LEFT JOIN m USING (scc)""")  # fmt: skip
def cycle_delta(spark, sf):
    """Cycles of the graph against those with the edges of some sources left out."""
    e = view(spark, sf, PAIRS)
    return D.cycle_delta(G.strongly_connected(e.where("src not like '%7.ts'")), G.strongly_connected(e))


@query("j12_broken_links", f"WITH n AS ({NODES}), t AS (SELECT id, concat(grp, '/n', CAST(nation AS STRING), '/src/f', CAST(k + 1 AS STRING), '.ts') AS target FROM n) SELECT t.id, target, CASE WHEN regexp_replace(target, '\\.ts$', '') IN (SELECT regexp_replace(id, '\\.[a-z]+$', '') FROM n) THEN 'info' ELSE 'medium' END AS severity FROM t WHERE target NOT IN (SELECT id FROM n)")
def broken(spark, sf):
    """Links to files that do not exist; one whose stem exists under another ending is only noted."""
    n = view(spark, sf, NODES)
    t = n.select("id", F.concat("grp", F.lit("/n"), F.col("nation").cast("string"), F.lit("/src/f"), (F.col("k") + 1).cast("string"), F.lit(".ts")).alias("target"))
    missing = t.join(n.select(F.col("id").alias("target")), "target", "left_anti").withColumn("stem", F.regexp_replace("target", r"\.ts$", ""))
    stems = n.select(F.regexp_replace("id", r"\.[a-z]+$", "").alias("stem"), F.lit(True).alias("known")).distinct()
    return missing.join(stems, "stem", "left").select("id", "target", F.when(F.col("known"), "info").otherwise("medium").alias("severity"))


@query("d2_headline_stats", f"""WITH {B}, {H}, {RB}, {RH}, v AS ({VULNS}),
  s AS (SELECT 0 AS i, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS files, CAST(sum(loc % 5) AS BIGINT) AS todos, (SELECT count(*) FROM rb) AS risks, (SELECT count(*) FROM rb WHERE category = 'R' AND severity <> 'low') AS secrets, (SELECT count(DISTINCT id) FROM v WHERE side = 'fixed') AS vulns FROM b
    UNION ALL SELECT 1, CAST(sum(loc) AS BIGINT), CAST(sum(tokens) AS BIGINT), count(*), CAST(sum(loc % 5) AS BIGINT), (SELECT count(*) FROM rh), (SELECT count(*) FROM rh WHERE category = 'R' AND severity <> 'low'), (SELECT count(DISTINCT id) FROM v) FROM h),
  u AS (UNPIVOT s ON loc, tokens, files, todos, risks, secrets, vulns INTO NAME stat VALUE n)
  SELECT stat, max(n) FILTER (i = 0) AS before, max(n) FILTER (i = 1) AS after, max(n) FILTER (i = 1) - max(n) FILTER (i = 0) AS delta FROM u GROUP BY stat""")  # fmt: skip
def headline(spark, sf):
    def side(files, risks, vulns):
        r = view(spark, sf, risks).withColumn("category", F.when(F.col("category") == "R", "secret").otherwise(F.col("category")))
        return view(spark, sf, files).withColumn("todos", F.col("loc") % 5), r, view(spark, sf, vulns)

    return D.headline_stats(side(BASE, RISKS_BASE, f"SELECT * FROM ({VULNS}) WHERE side = 'fixed'"), side(HEAD, RISKS_HEAD, VULNS))
