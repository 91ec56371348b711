"""Flow paths, message order and commit logs, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalens.operators import flow
from stratalens.plans.adapters import BASE, EDGES, HEAD, NODES, view
from stratalens.registry import query
from stratalens.sources import snapshots
from stratalens.sources.commit_log import read_commit_log
from stratalens.storage import shared_dir

#: files in ten tiers, without an entry
TIERS = f"SELECT id, k, CASE WHEN k % 11 = 0 THEN 'test' WHEN language = 'Markdown' THEN 'docs' WHEN language = 'Python' THEN 'data' WHEN k % 5 = 0 THEN 'route' ELSE grp END AS tier FROM ({NODES})"
TIER_SQL = f"""nodes AS ({TIERS}), own AS ({EDGES}),
  boot AS (SELECT '(boot)' AS src, id AS dst FROM nodes LEFT JOIN (SELECT dst, count(*) AS n FROM own GROUP BY dst) d ON d.dst = id WHERE tier = 'route' ORDER BY coalesce(n, 0) DESC, id LIMIT 5),
  every AS (SELECT id, tier FROM nodes UNION ALL SELECT '(boot)', 'entry'), edges AS (SELECT src, dst FROM own UNION ALL SELECT src, dst FROM boot),
  links AS (SELECT a.tier AS f, b.tier AS t, count(*) AS n FROM edges e JOIN every a ON a.id = e.src JOIN every b ON b.id = e.dst WHERE a.tier <> b.tier GROUP BY 1, 2)"""


@query("v10_paths", f"""
  WITH RECURSIVE {TIER_SQL}, walk AS (SELECT [f, t] AS tiers, t AS at, n AS weight FROM links UNION ALL SELECT list_append(w.tiers, l.t), l.t, w.weight + l.n FROM walk w JOIN links l ON l.f = w.at WHERE len(w.tiers) < 5 AND NOT list_contains(w.tiers, l.t))
  SELECT row_number() OVER (ORDER BY weight DESC, tiers) AS place, array_to_string(tiers, '>') AS tiers, CAST(weight AS BIGINT) AS weight FROM walk ORDER BY place LIMIT 5""")  # fmt: skip
def paths(spark, sf):
    nodes, edges = view(spark, sf, TIERS), view(spark, sf, EDGES).select("src", "dst")
    boot = flow.boot_edges(nodes, edges, nodes.where("tier = 'route'"))
    every = nodes.select("id", "tier").unionAll(boot.select(F.col("src"), F.lit("entry")).distinct())
    return flow.tier_paths(flow.tier_edges(every, edges.unionAll(boot), "tier")).withColumn("tiers", F.array_join("tiers", ">"))


@query("v10_tier_links", f"WITH {TIER_SQL} SELECT f AS from_tier, t AS to_tier, n AS links FROM links WHERE f <> 'entry'")
def tier_links(spark, sf):
    return flow.tier_edges(view(spark, sf, TIERS), view(spark, sf, EDGES), "tier")


FIRST = f"(SELECT id FROM ({NODES}) WHERE k = 3)"


@query("v11_sequence_flow", f"""
  WITH RECURSIVE edges AS ({EDGES}), deg AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst),
  ranked AS (SELECT src, e.dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, e.dst) AS r, count(*) OVER (PARTITION BY src) AS outs FROM edges e JOIN deg d ON d.dst = e.dst),
  fan AS (SELECT src, count(*) AS n FROM edges GROUP BY src),
  walk AS (SELECT [r] AS key, [src, dst] AS way, src, dst, 0 AS depth, src = dst AS is_cycle, outs FROM ranked WHERE r <= 2 AND src = {FIRST}
    UNION ALL SELECT list_append(w.key, c.r), list_append(w.way, c.dst), c.src, c.dst, w.depth + 1, list_contains(w.way, c.dst), c.outs FROM walk w JOIN ranked c ON c.src = w.dst WHERE NOT w.is_cycle AND c.r <= 2 AND w.depth < 4),
  msgs AS (SELECT key, src, dst, depth, is_cycle, false AS is_return, key AS call, outs FROM walk UNION ALL SELECT list_append(key, 1000000), dst, src, depth, false, true, key, 0 FROM walk WHERE NOT is_cycle AND dst IN (SELECT src FROM fan)),
  placed AS (SELECT *, row_number() OVER (ORDER BY key) AS pos FROM msgs), kept AS (SELECT * FROM placed WHERE call IN (SELECT call FROM placed WHERE NOT is_return AND pos <= 20))
  SELECT row_number() OVER (ORDER BY key) AS step, src, dst, depth, is_cycle, is_return,
    (SELECT bool_or(NOT is_return AND ((depth = 4 AND NOT is_cycle) OR outs > 2)) OR count(*) FILTER (WHERE NOT is_return) < (SELECT count(*) FROM walk) FROM kept) AS truncated FROM kept""")  # fmt: skip
def sequence(spark, sf):
    entry = view(spark, sf, f"SELECT id FROM ({NODES}) WHERE k = 3").first()["id"]
    return flow.sequence_flow(view(spark, sf, NODES), view(spark, sf, EDGES), entry, max_depth=5, max_branches=2, max_messages=20)


COMMIT = "concat('__C__u', CAST(o_custkey % 50 AS STRING), '@x', chr(31), CASE WHEN o_custkey % 50 <> 7 THEN concat('User ', CAST(o_custkey % 50 AS STRING)) ELSE '' END, CASE WHEN o_orderkey % 11 <> 3 THEN concat(chr(31), CAST(800000000 + o_orderkey * 60 AS STRING)) ELSE '' END)"
LOG_TEXT = f"concat({COMMIT}, chr(10), concat('src/a', CAST(o_orderkey % 7 AS STRING), '.ts'), CASE WHEN o_orderkey % 2 = 0 THEN concat(chr(0), 'lib\\\\b', CAST(o_orderkey % 5 AS STRING), '.py', chr(0)) ELSE '' END, CASE WHEN o_orderkey % 13 = 0 THEN concat(chr(10), chr(10), 'README.md') ELSE '' END)"


@query("s6_commit_log", """
  WITH c AS (SELECT o_orderkey AS k, concat('u', o_custkey % 50, '@x') AS author, CASE WHEN o_custkey % 50 <> 7 THEN concat('User ', o_custkey % 50) ELSE '' END AS name, TIMESTAMP '1970-01-01' + to_seconds(800000000 + o_orderkey * 60) AS ts FROM orders WHERE o_orderkey % 11 <> 3)
  SELECT author, name, ts, concat('src/a', k % 7, '.ts') AS path FROM c UNION ALL SELECT author, name, ts, concat('lib/b', k % 5, '.py') FROM c WHERE k % 2 = 0 UNION ALL SELECT author, name, ts, 'README.md' FROM c WHERE k % 13 = 0""")  # fmt: skip
def commit_log(spark, sf):
    path = f"{shared_dir(spark)}/stratalens/log-{uuid.uuid4().hex}"
    view(spark, sf, f"SELECT {LOG_TEXT} AS value FROM orders").write.text(path)
    return read_commit_log(spark, path).drop("log", "at")


@query("k1_snapshot_store", f"SELECT path, loc, false AS stale FROM ({HEAD}) UNION ALL SELECT path, loc, true FROM ({BASE}) WHERE path NOT IN (SELECT path FROM ({HEAD}))")
def snapshot_store(spark, sf):
    """Two snapshots written, the older one pruned after its stale rows are marked."""
    root = f"{shared_dir(spark)}/stratalens/store-{uuid.uuid4().hex}"
    snapshots.write_snapshot(spark, root, "first", {"files": view(spark, sf, BASE).select("path", "loc")})
    kind = "path string, loc long"
    now = snapshots.with_stale(view(spark, sf, HEAD).select("path", "loc"), snapshots.read_snapshot(spark, root, "files", kind), "path")
    snapshots.write_snapshot(spark, root, "second", {"files": now})
    snapshots.prune(spark, root, 1)
    return snapshots.read_snapshot(spark, root, "files", kind + ", stale boolean")
