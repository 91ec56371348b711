"""Graph queries over the adapted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions.scalar import glob_matches
from stratalens.operators import graph as G
from stratalens.plans import ask
from stratalens.plans.adapters import EDGES, NODES, PAIRS, view
from stratalens.registry import query

N, E, P = f"nodes AS ({NODES})", f"edges AS ({EDGES})", f"edges AS ({PAIRS})"
TS = "kind IN ('import', 'dynamic-import', 'type-import')"


def nodes(spark, sf):
    return view(spark, sf, NODES).withColumn("path", F.col("id")).withColumn("kind", F.lit("file"))


def edges(spark, sf):
    return view(spark, sf, EDGES)


def seed(spark, sf, k):
    return view(spark, sf, f"SELECT id FROM ({NODES}) WHERE k = {k}")


@query("p1_glob_filter", f"WITH {N} SELECT id, tokens FROM nodes WHERE id LIKE '%/src/f_2%.ts'")
def glob_filter(spark, sf):
    return nodes(spark, sf).where(glob_matches(F.col("id"), "*/src/f?2*.ts")).select("id", "tokens")


@query("p2_confidence_filter", f"WITH {E} SELECT src, dst, kind, confidence FROM edges WHERE coalesce(confidence, 'extracted') IN ('extracted', 'inferred')")
def confidence_filter(spark, sf):
    return G.filter_edges(edges(spark, sf), max_confidence="inferred").select("src", "dst", "kind", "confidence")


@query("p6_select_nodes", f"WITH {N} SELECT id, name FROM nodes WHERE lower(name) = 'f12' AND contains(id, 'src')")
def pick_nodes(spark, sf):
    return G.select_nodes(nodes(spark, sf), glob="src", name="F12", kind="file").select("id", "name")


@query("p7_resolve_target", f"WITH {N} SELECT id FROM nodes WHERE lower(name) = 'f33'")
def target(spark, sf):
    return G.resolve_target(nodes(spark, sf), "F33").select("id")


@query("p8_did_you_mean", f"WITH {N} SELECT id FROM nodes WHERE contains(lower(id), 'f12') ORDER BY id LIMIT 10")
def suggestions(spark, sf):
    return G.did_you_mean(nodes(spark, sf), "F12").select("id")


#: resolved imports before the graph is built: repeated rows, loops, unresolved ones and `require`
RAW_IMPORTS = f"SELECT src AS file, dst AS target, CASE WHEN kind = 'dynamic-import' THEN 'require' ELSE kind END AS kind FROM ({EDGES}) UNION ALL SELECT src, src, kind FROM ({EDGES}) UNION ALL SELECT src, CAST(NULL AS STRING), kind FROM ({EDGES}) UNION ALL SELECT src, dst, kind FROM ({EDGES}) WHERE kind = 'import'"


@query("g1_build_graph", f"WITH {E} SELECT DISTINCT src, dst, CASE WHEN kind = 'dynamic-import' THEN 'import' ELSE kind END AS kind FROM edges")
def build_graph(spark, sf):
    return G.build_graph(view(spark, sf, RAW_IMPORTS))


@query("g2_callers", f"WITH {N}, {E} SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM nodes WHERE k = 5)")
def who_calls(spark, sf):
    return G.callers(edges(spark, sf), seed(spark, sf, 5).first()["id"])


@query("a4_caller_index", f"WITH {E}, p AS (SELECT DISTINCT dst AS id, src AS caller FROM edges) SELECT id, caller, count(*) OVER (PARTITION BY id) AS n_callers FROM p")
def caller_index(spark, sf):
    return G.caller_index(edges(spark, sf))


@query("a5_in_degree_top", f"WITH {E} SELECT dst AS id, count(*) AS n_in FROM edges GROUP BY dst ORDER BY n_in DESC, id LIMIT 20")
def in_degree(spark, sf):
    return edges(spark, sf).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in")).orderBy(F.desc("n_in"), "id").limit(20)


def bfs_sql(where: str, a: str, b: str, depth: int, start: str, keep: str = "hops > 0", names: str = f"{N}, {E}") -> str:
    return f"""
    WITH RECURSIVE {names}, pairs AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges WHERE {where}),
    walk AS (SELECT id, 0 AS hops FROM nodes WHERE {start} UNION SELECT p.b, w.hops + 1 FROM walk w JOIN pairs p ON p.a = w.id WHERE w.hops < {depth})
    SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY id HAVING min({keep.split()[0]}) {" ".join(keep.split()[1:])}"""


@query("g3_imports", bfs_sql(TS, "src", "dst", 3, "k = 7"))
def imports(spark, sf):
    return G.imports(edges(spark, sf), seed(spark, sf, 7), 3)


@query("g6_neighbors", f"""
    WITH RECURSIVE {N}, {E}, pairs AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    walk AS (SELECT id, 0 AS hops FROM nodes WHERE k = 9 UNION SELECT p.b, w.hops + 1 FROM walk w JOIN pairs p ON p.a = w.id WHERE w.hops < 2)
    SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY id HAVING min(hops) > 0""")  # fmt: skip
def neighbors(spark, sf):
    return G.neighbors(edges(spark, sf), seed(spark, sf, 9), "both", 2)


#: the same links under symbol kinds
SYMBOL_EDGES = f"SELECT src, dst, CASE kind WHEN 'import' THEN 'call' WHEN 'type-import' THEN 'type-ref' ELSE 'extends' END AS kind, confidence FROM ({EDGES})"


@query("g7_references", bfs_sql("kind IN ('call', 'read', 'jsx', 'type-ref')", "dst", "src", 2, "k % 10 = 1", names=f"{N}, edges AS ({SYMBOL_EDGES})"))
def references(spark, sf):
    return G.references(view(spark, sf, SYMBOL_EDGES), view(spark, sf, f"SELECT id FROM ({NODES}) WHERE k % 10 = 1"), 2)


@query("g8_implementers", bfs_sql("kind IN ('implements', 'extends')", "dst", "src", 1, "k = 5", names=f"{N}, edges AS ({SYMBOL_EDGES})"))
def implementers(spark, sf):
    return G.implementers(view(spark, sf, SYMBOL_EDGES), seed(spark, sf, 5))


@query("g9_impact", bfs_sql(TS, "dst", "src", 3, "k = 3"))
def impact(spark, sf):
    return G.impact(edges(spark, sf), seed(spark, sf, 3))


@query("g10_path_between", f"""
    WITH RECURSIVE {N}, {E}, pairs AS (SELECT DISTINCT src AS a, dst AS b FROM edges),
    walk AS (SELECT id, [id] AS path FROM nodes WHERE k IN (2, 53, 101) UNION ALL SELECT p.b, list_append(w.path, p.b) FROM walk w JOIN pairs p ON p.a = w.id WHERE len(w.path) <= 9 AND NOT list_contains(w.path, p.b)),
    hit AS (SELECT path FROM walk WHERE id IN (SELECT id FROM nodes WHERE k % 40 = 3) ORDER BY len(path), path LIMIT 1)
    SELECT CAST(i - 1 AS INTEGER) AS place, path[i] AS id FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM hit)""")  # fmt: skip
def path_between(spark, sf):
    goals = view(spark, sf, f"SELECT id FROM ({NODES}) WHERE k % 40 = 3")
    return G.path_between(edges(spark, sf), view(spark, sf, f"SELECT id FROM ({NODES}) WHERE k IN (2, 53, 101)"), goals, 9)


@query("g11_focal_nodes", f"WITH f AS ({bfs_sql(TS, 'dst', 'src', 2, 'k = 3', 'hops >= 0')}) SELECT id, hops FROM f ORDER BY hops, id LIMIT 30")
def focal(spark, sf):
    """Reverse neighbourhood of one file, nearest first, at most 30 nodes."""
    return G.reach(G.filter_edges(edges(spark, sf), G.IMPORT_KINDS), seed(spark, sf, 3), "in", 2).orderBy("hops", "id").limit(30)


@query("g12_graph_query", f"WITH f AS ({bfs_sql(f'{TS} AND confidence IN (' + chr(39) + 'extracted' + chr(39) + ', ' + chr(39) + 'inferred' + chr(39) + ')', 'src', 'dst', 3, 'contains(id, ' + chr(39) + '/n5/' + chr(39) + ')', 'hops >= 0')}) SELECT id, hops FROM f WHERE id LIKE '%.ts' ORDER BY id LIMIT 200")
def structured(spark, sf):
    kept, _ = G.graph_query(nodes(spark, sf), edges(spark, sf), {"glob": "/n5/"}, G.IMPORT_KINDS, "out", 3, {"glob": "*.ts"}, "inferred")
    return kept.select("id", "hops")


@query("g13_hop_expansion", bfs_sql("1 = 1", "src", "dst", 2, "k IN (2, 4, 8)", "hops >= 0"))
def expansion(spark, sf):
    return G.reach(edges(spark, sf), view(spark, sf, f"SELECT id FROM ({NODES}) WHERE k IN (2, 4, 8)"), "out", 2)


@query("g17_blast_radius", f"""
    WITH RECURSIVE {N}, {E}, pairs AS (SELECT DISTINCT dst AS a, src AS b FROM edges),
    walk AS (SELECT id AS seed, id, 0 AS hops FROM nodes WHERE k % 25 = 1 UNION SELECT w.seed, p.b, w.hops + 1 FROM walk w JOIN pairs p ON p.a = w.id WHERE w.hops < 2)
    SELECT seed, count(DISTINCT id) AS reached FROM walk WHERE id <> seed GROUP BY seed""")  # fmt: skip
def blast(spark, sf):
    seeds = view(spark, sf, f"SELECT id FROM ({NODES}) WHERE k % 25 = 1")
    return G.multi_reach(edges(spark, sf), seeds, "in", 2).groupBy("seed").agg(F.count("*").alias("reached"))


@query("g5_orphans", f"""
    WITH {N}, {E} SELECT id FROM nodes n WHERE (id LIKE '%.ts' OR id LIKE '%.py') AND NOT regexp_matches(id, '(^|/)tests/') AND id NOT IN (SELECT dst FROM edges) AND id IN (SELECT src FROM edges)""")  # fmt: skip
def orphans(spark, sf):
    return G.orphans(nodes(spark, sf), edges(spark, sf)).select("id")


CLOSURE = f"WITH RECURSIVE {N}, {P}, r AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM r JOIN edges e ON e.src = r.b)"


@query("g4_cycles", f"{CLOSURE}, m AS (SELECT x.a AS id, min(least(x.a, x.b)) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a) SELECT scc, id FROM m")
def cycles(spark, sf):
    return G.strongly_connected(view(spark, sf, PAIRS))


@query("v7_layers", f"""{CLOSURE}, cyclic AS (SELECT DISTINCT a AS id FROM r WHERE a = b), bad AS (SELECT id FROM cyclic UNION SELECT b FROM r WHERE a IN (FROM cyclic)),
    walk AS (SELECT id, CAST(0 AS BIGINT) AS layer FROM nodes WHERE id NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, w.layer + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE e.dst NOT IN (FROM bad))
    SELECT id, max(layer) AS layer FROM walk GROUP BY id""")  # fmt: skip
def layered(spark, sf):
    return G.layers(view(spark, sf, PAIRS), view(spark, sf, NODES))


@query("v6_cycles_with_loops", f"""{CLOSURE.replace(P, f"edges AS ({PAIRS} UNION ALL SELECT id, id FROM ({NODES}) WHERE k % 9 = 0)")}, m AS (SELECT x.a AS id, min(least(x.a, x.b)) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT scc, id FROM m""")
def cycles_with_loops(spark, sf):
    loops = view(spark, sf, f"SELECT id AS src, id AS dst FROM ({NODES}) WHERE k % 9 = 0")
    return G.strongly_connected(view(spark, sf, PAIRS).unionAll(loops), self_loops=True)


def pagerank_sql(rounds: int) -> str:
    parts = [N, P, "deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src)", "size AS (SELECT count(*) AS n FROM nodes)", "r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM nodes, size)"]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        parts.append(f"r{k} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (coalesce(g.x, 0) + l.loose / n) AS r FROM nodes v CROSS JOIN size CROSS JOIN (SELECT coalesce(sum(r), 0) AS loose FROM {p} WHERE id NOT IN (SELECT src FROM deg)) l LEFT JOIN (SELECT e.dst, sum(p.r / d.d) AS x FROM {p} p JOIN edges e ON e.src = p.id JOIN deg d ON d.src = p.id GROUP BY e.dst) g ON g.dst = v.id)")
    return f"WITH {', '.join(parts)} SELECT id, floor(r / (SELECT max(r) FROM r{rounds}) * 10000 + 0.5) / 10000 AS importance FROM r{rounds}"


@query("g14_pagerank", pagerank_sql(30))
def importance(spark, sf):
    return G.pagerank(view(spark, sf, NODES), view(spark, sf, PAIRS))


def labels_sql(rounds: int) -> str:
    parts = [N, P, "two AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)", "l0 AS (SELECT id, id AS label FROM nodes)"]
    for k in range(1, rounds + 1):
        p = f"l{k - 1}"
        parts.append(f"l{k} AS MATERIALIZED (SELECT id, arg_min(label, (-n, label)) AS label FROM (SELECT id, label, count(*) AS n FROM (SELECT two.a AS id, p.label FROM two JOIN {p} p ON p.id = two.b UNION ALL SELECT id, label FROM {p}) GROUP BY 1, 2) GROUP BY id)")
    return f"WITH {', '.join(parts)}, f AS (SELECT label, dense_rank() OVER (ORDER BY first) - 1 AS community FROM (SELECT label, min(id) AS first FROM l{rounds} GROUP BY label)) SELECT id, community FROM l{rounds} JOIN f USING (label)"


@query("g15_label_propagation_synchronous", labels_sql(10))
def communities(spark, sf):
    return G.label_propagation(view(spark, sf, NODES), view(spark, sf, PAIRS))


@query("w9_numbered_communities", f"WITH {N}, l AS (SELECT id, concat(grp, CAST(nation AS STRING)) AS label FROM nodes), f AS (SELECT label, min(id) AS first FROM l GROUP BY label) SELECT first, dense_rank() OVER (ORDER BY first) - 1 AS community FROM f")
def renumbered(spark, sf):
    first = nodes(spark, sf).groupBy(F.concat("grp", F.col("nation").cast("string")).alias("label")).agg(F.min("id").alias("first"))
    return G.numbered(first, "first", "community").select("first", "community")


@query("v1_heatmap", f"WITH {N}, {E} SELECT a.grp AS from_group, b.grp AS to_group, count(*) AS edges FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY 1, 2")
def heat(spark, sf):
    return G.heatmap(nodes(spark, sf), edges(spark, sf))


CELLS = f"WITH {N}, {E}, cells AS (SELECT a.grp AS from_group, b.grp AS to_group, count(*) AS edges FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY 1, 2)"
TOP = "top AS (SELECT grp FROM (SELECT from_group AS grp, edges FROM cells UNION ALL SELECT to_group, edges FROM cells) GROUP BY grp ORDER BY sum(edges) DESC, grp LIMIT 3)"


@query("v2_capped_heatmap", f"{CELLS}, {TOP} SELECT from_group, to_group, edges FROM cells WHERE from_group IN (FROM top) AND to_group IN (FROM top)")
def capped(spark, sf):
    return G.capped_heatmap(G.heatmap(nodes(spark, sf), edges(spark, sf)), 3)


@query("v3_hubs", f"WITH {E} SELECT id, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i + o) AS BIGINT) AS total FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY id ORDER BY total DESC, id LIMIT 10")
def hubs(spark, sf):
    return G.hubs(edges(spark, sf))


@query("v4_couplings", f"{CELLS} SELECT from_group, to_group, edges FROM cells WHERE from_group <> to_group ORDER BY edges DESC, from_group, to_group LIMIT 20")
def couplings(spark, sf):
    return G.heatmap(nodes(spark, sf), edges(spark, sf)).where("from_group <> to_group").orderBy(F.desc("edges"), "from_group", "to_group").limit(20)


@query("v5_group_keys", f"WITH {N} SELECT split_part(id, '/', 1) AS top, concat(split_part(id, '/', 1), '/', split_part(id, '/', 2)) AS two, count(*) AS files FROM nodes GROUP BY 1, 2")
def groups(spark, sf):
    return G.group_keys(nodes(spark, sf)).groupBy("top", "two").agg(F.count("*").alias("files"))


@query("a10_package_edges", f"""
    WITH {N}, {E}, c AS (SELECT a.grp AS from_group, b.grp AS to_group, count(*) AS n, string_agg(DISTINCT e.kind, ',' ORDER BY e.kind) AS kinds FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.grp <> b.grp GROUP BY 1, 2),
    top AS (SELECT grp FROM (SELECT from_group AS grp, n FROM c UNION ALL SELECT to_group, n FROM c) GROUP BY grp ORDER BY sum(n) DESC, grp LIMIT 4)
    SELECT from_group, to_group, n, kinds FROM c WHERE from_group IN (FROM top) AND to_group IN (FROM top)""")  # fmt: skip
def packages(spark, sf):
    return G.package_edges(nodes(spark, sf), edges(spark, sf), 4)


@query("a11_hub_importers", f"""
    WITH {E}, p AS (SELECT DISTINCT src, dst FROM edges), top AS (SELECT dst, count(*) AS n_in FROM p GROUP BY dst ORDER BY n_in DESC, dst LIMIT 10)
    SELECT hub, n_in, importer, place FROM (SELECT p.dst AS hub, n_in, src AS importer, row_number() OVER (PARTITION BY p.dst ORDER BY src) AS place FROM p JOIN top USING (dst)) WHERE place <= 5""")  # fmt: skip
def importers(spark, sf):
    return G.hub_importers(edges(spark, sf))


@query("a12_top_table", f"WITH {N}, {E}, t AS (SELECT id, tokens, loc / 10000 AS importance FROM nodes ORDER BY importance DESC, id LIMIT 20) SELECT t.id, t.tokens, count(e.src) AS n_in FROM t LEFT JOIN edges e ON e.dst = t.id GROUP BY 1, 2")
def top_table(spark, sf):
    return G.top_nodes(nodes(spark, sf).withColumn("importance", F.col("loc") / 10000), edges(spark, sf)).select("id", "tokens", "n_in")


@query("a14_confidence_tally", f"WITH {E} SELECT confidence, count(*) AS n FROM edges GROUP BY confidence")
def confidences(spark, sf):
    return edges(spark, sf).groupBy("confidence").agg(F.count("*").alias("n"))


@query("v12_module_view", f"WITH {N} SELECT grp, count(*) AS files, CAST(sum(tokens) AS BIGINT) AS tokens, arg_min(id, (-loc, id)) AS named FROM nodes GROUP BY grp HAVING count(*) >= 2")
def modules(spark, sf):
    return G.module_view(nodes(spark, sf), "grp", "loc")


@query("v10_tier_flow", f"""
    WITH {N}, {E} SELECT a.language AS from_tier, b.language AS to_tier, count(*) AS links, count(DISTINCT e.src) AS sources FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.language <> b.language GROUP BY 1, 2""")  # fmt: skip
def tier_flow(spark, sf):
    return G.tier_flow(nodes(spark, sf), edges(spark, sf), "language")


@query("v1_heatmap_totals", f"{CELLS} SELECT max(edges) AS max_cell, CAST(sum(edges) FILTER (from_group <> to_group) AS BIGINT) AS cross_edges, (SELECT count(*) FROM edges) AS total_edges FROM cells")
def heat_totals(spark, sf):
    return G.heatmap_totals(G.heatmap(nodes(spark, sf), edges(spark, sf)), edges(spark, sf))


@query("g17_largest_blast", f"""
    WITH RECURSIVE {N}, {E}, pairs AS (SELECT DISTINCT dst AS a, src AS b FROM edges),
    walk AS (SELECT id AS seed, id, 0 AS hops FROM nodes WHERE k % 25 = 1 UNION SELECT w.seed, p.b, w.hops + 1 FROM walk w JOIN pairs p ON p.a = w.id WHERE w.hops < 3)
    SELECT seed AS id, count(DISTINCT id) AS reached FROM walk WHERE id <> seed GROUP BY seed ORDER BY reached DESC, seed LIMIT 1""")  # fmt: skip
def largest_blast(spark, sf):
    return G.blast_radius(edges(spark, sf), view(spark, sf, f"SELECT id FROM ({NODES}) WHERE k % 25 = 1"), 3)


@query("g17_reach_counts", f"""
    WITH RECURSIVE {N}, {E}, pairs AS (SELECT DISTINCT dst AS a, src AS b FROM edges),
    walk AS (SELECT id AS seed, id FROM nodes UNION SELECT w.seed, p.b FROM walk w JOIN pairs p ON p.a = w.id)
    SELECT seed AS id, count(*) AS reached FROM walk WHERE id <> seed GROUP BY seed""")  # fmt: skip
def reach_counts(spark, sf):
    """Every node is a changed file here."""
    return G.reach_counts(edges(spark, sf), nodes(spark, sf))


@query("f40_pick_entity", f"WITH {N} SELECT id FROM nodes WHERE lower(name) = 'f33'")
def picked(spark, sf):
    """The node that a question's words name: stop words and words without a node are passed over."""
    n = nodes(spark, sf)
    return n.where(F.col("id") == ask.pick(n, "Which files depend on the nowhere module F33?")[0]).select("id")


@query("f40_did_you_mean", f"WITH {N} SELECT id FROM nodes WHERE contains(lower(id), '/n5/') ORDER BY id LIMIT 10")
def meant(spark, sf):
    n = nodes(spark, sf)
    return n.where(F.col("id").isin(ask.pick(n, "who imports /n5/ ?")[1])).select("id")
