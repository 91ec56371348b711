"""Graph verbs over nodes (id, ...) and edges (src, dst, kind, confidence).

Traversals go level by level: one join of the frontier with the edges, an anti join with
what was visited, and a written cut, so the work of a level follows its frontier and the
lineage stays short.  Everything that is filtered is filtered on the edges before the
loop.  Edges of hubs are dealt over several tasks in traversals and ranks, else left to adaptive skew
handling; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratalens.functions.scalar import confidence_rank, glob_matches, is_source_path, is_test_or_example_path, round4
from stratalens.joins import hot_keys, spread_join
from stratalens.joins import numbered as in_order
from stratalens.storage import cut

IMPORT_KINDS = ("import", "dynamic-import", "type-import")
REFERENCE_KINDS = ("call", "read", "jsx", "type-ref")
SUBTYPE_KINDS = ("implements", "extends")


def filter_edges(edges: DataFrame, kinds: Iterable[str] | None = None, max_confidence: str | None = None) -> DataFrame:
    """Edges of the kinds given, at most as uncertain as given; a null confidence counts as extracted."""
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(*kinds))
    if max_confidence is not None:
        edges = edges.where(confidence_rank(F.col("confidence")) <= {"extracted": 0, "inferred": 1, "ambiguous": 2}[max_confidence])
    return edges


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b) pairs along which a traversal goes."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction].distinct()


def _hubs(pairs: DataFrame, key: str) -> list[tuple]:
    """The nodes with more than a thousandth of all pairs, whose joins are dealt over several tasks."""
    sizes = pairs.groupBy(key).agg(F.count("*").alias("n"))
    return hot_keys(sizes, key, pairs.count())


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "out", depth: int | None = None) -> DataFrame:
    """id, hops of all nodes within `depth` steps of the seeds (id), seeds at 0."""
    pairs = cut(steps(edges, direction), "reach-pairs")
    hot = _hubs(pairs, "a")
    seen = frontier = cut(seeds.select("id").distinct().withColumn("hops", F.lit(0)), "reach")
    level = 0
    while depth is None or level < depth:
        level += 1
        found = spread_join(pairs, frontier.select(F.col("id").alias("a")), "a", hot).select(F.col("b").alias("id")).distinct()
        frontier = cut(found.join(seen, "id", "left_anti").withColumn("hops", F.lit(level)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def multi_reach(edges: DataFrame, seeds: DataFrame, direction: str = "in", depth: int = 3) -> DataFrame:
    """seed, id, hops: what each seed reaches, itself left out."""
    pairs = cut(steps(edges, direction), "reach-pairs")
    seen = frontier = cut(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("hops", F.lit(0)), "multi-reach")
    for level in range(1, depth + 1):
        found = frontier.select("seed", F.col("id").alias("a")).join(pairs, "a").select("seed", F.col("b").alias("id")).distinct()
        frontier = cut(found.join(seen, ["seed", "id"], "left_anti").withColumn("hops", F.lit(level)), "multi-reach")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen.where("hops > 0")


def callers(edges: DataFrame, target: str) -> DataFrame:
    """Distinct sources of direct edges into the target, of all kinds."""
    return edges.where(F.col("dst") == target).select(F.col("src").alias("id")).distinct()


def caller_index(edges: DataFrame) -> DataFrame:
    """id, caller, n_callers: one row for each distinct caller, so a hub's callers never meet in one row."""
    pairs = edges.select(F.col("dst").alias("id"), F.col("src").alias("caller")).distinct()
    return pairs.join(pairs.groupBy("id").agg(F.count("*").alias("n_callers")), "id")


def build_graph(imports: DataFrame) -> DataFrame:
    """src, dst, kind of resolved imports (file, target, kind): without loops, each once; `require` counts as an import."""
    kind = F.when(F.col("kind") == "require", "import").otherwise(F.col("kind"))
    return imports.where("target is not null and file <> target").select(F.col("file").alias("src"), F.col("target").alias("dst"), kind.alias("kind")).distinct()


def top_nodes(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """The most important nodes (id, importance) with n_in; ties by id."""
    top = nodes.orderBy(F.desc("importance"), "id").limit(most)
    degree = edges.join(F.broadcast(top.select(F.col("id").alias("dst"))), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))  # at most `most` rows
    return top.join(degree, "id", "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))


def group_keys(nodes: DataFrame) -> DataFrame:
    """Adds `top` (first folder, '·' for a root file) and `two` (first two folders)."""
    p = F.split("id", "/")
    return nodes.withColumn("top", F.when(F.size(p) < 2, "·").otherwise(p[0])).withColumn("two", F.array_join(F.slice(p, 1, 2), "/"))


def module_view(nodes: DataFrame, community: str = "community", measure: str = "importance") -> DataFrame:
    """community, files, tokens, named of communities of two or more nodes; named after the member of largest measure, ties by id."""
    g = nodes.groupBy(community).agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.min(F.struct((-F.col(measure)).alias("neg"), "id"))["id"].alias("named"))
    return g.where("files >= 2")


def tier_flow(nodes: DataFrame, edges: DataFrame, tier: str) -> DataFrame:
    """from_tier, to_tier, links, sources of edges between nodes of different tiers."""
    a, b = nodes.select(F.col("id").alias("src"), F.col(tier).alias("from_tier")), nodes.select(F.col("id").alias("dst"), F.col(tier).alias("to_tier"))
    met = edges.join(a, "src").join(b, "dst").where("from_tier <> to_tier")
    return met.groupBy("from_tier", "to_tier").agg(F.count("*").alias("links"), F.countDistinct("src").alias("sources"))


def neighbors(edges: DataFrame, seeds: DataFrame, direction: str = "both", depth: int = 1) -> DataFrame:
    return reach(edges, seeds, direction, depth).where("hops > 0")


def imports(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    return neighbors(filter_edges(edges, IMPORT_KINDS), seeds, "out", depth)


def references(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    return neighbors(filter_edges(edges, REFERENCE_KINDS), seeds, "in", depth)


def implementers(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return neighbors(filter_edges(edges, SUBTYPE_KINDS), seeds, "in", 1)


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3, file_seeds: bool = True) -> DataFrame:
    """What depends on the seeds; file seeds go along import kinds only."""
    return neighbors(filter_edges(edges, IMPORT_KINDS) if file_seeds else edges, seeds, "in", depth)


def path_between(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 50) -> DataFrame:
    """place, id along the shortest directed path; of equal ones that which breadth-first search in id order finds.

    Paths of one level have one length, so the search's queue order is the order of the
    paths as arrays, and the first parent is the least path.
    """
    pairs = cut(steps(edges, "out"), "path-pairs")
    goal = targets.select("id").distinct().join(sources.select("id").distinct(), "id", "left_anti")
    frontier = cut(sources.select("id").distinct().withColumn("path", F.array("id")), "path")
    seen = frontier.select("id")
    for _ in range(max_depth):
        step = frontier.select(F.col("id").alias("a"), "path").join(pairs, "a").select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        frontier = cut(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")), "path")
        hit = frontier.join(goal, "id", "left_semi")
        best = hit.agg(F.min("path").alias("path"))
        if not hit.isEmpty():
            return best.select(F.posexplode("path").alias("place", "id"))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier.select("id"))
    return frontier.where(F.lit(False)).select(F.lit(0).alias("place"), "id")


def resolve_target(nodes: DataFrame, target: str) -> DataFrame:
    """Nodes of the first tier that has any: exact id, name (any case), path suffix."""
    tier = F.when(F.col("id") == target, 0).when(F.lower("name") == target.lower(), 1).when(F.col("path") == target, 2).when(F.col("path").endswith("/" + target), 2)
    tagged = nodes.withColumn("tier", tier).where("tier is not null")
    least = tagged.agg(F.min("tier").alias("tier"))
    return tagged.join(F.broadcast(least), "tier", "left_semi").drop("tier")


def select_nodes(nodes: DataFrame, id: str | None = None, glob: str | None = None, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Nodes that meet all conditions given."""
    if id is not None:
        nodes = nodes.where(F.col("id") == id)
    if glob is not None:
        nodes = nodes.where(glob_matches(F.col("id"), glob) | glob_matches(F.col("path"), glob))
    if name is not None:
        nodes = nodes.where(F.lower("name") == name.lower())
    if kind is not None:
        nodes = nodes.where(F.col("kind") == kind)
    return nodes


def did_you_mean(nodes: DataFrame, text: str, most: int = 10) -> DataFrame:
    t = text.lower()
    hit = F.lower("id").contains(t) | F.lower("name").contains(t) | F.lower("path").contains(t)
    return nodes.where(hit).orderBy("id").limit(most)


def graph_query(nodes: DataFrame, edges: DataFrame, start: dict, edge_kinds: Iterable[str] | None = None, direction: str = "out", max_depth: int = 1, where: dict | None = None, max_confidence: str | None = None, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Seeds, traversal, then the node filter, sorting and limit; with the edges whose two ends are kept."""
    usable = filter_edges(edges, edge_kinds, max_confidence)
    hops = reach(usable, select_nodes(nodes, **start), direction, max_depth)
    kept = select_nodes(nodes.join(hops, "id"), **(where or {})).orderBy("id").limit(limit)
    ends = kept.select("id")
    inside = usable.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inside


def orphans(nodes: DataFrame, edges: DataFrame, package_dirs: DataFrame | None = None) -> DataFrame:
    """Source modules that nothing imports, that import something, and that are neither tests nor entries."""
    path = F.col("path")
    entry = path.rlike(r"(^|/)main\.[^/]+$") | path.rlike(r"(^|/)(scripts|bin)/[^/]+$")
    left = nodes.where(is_source_path(path) & ~is_test_or_example_path(path) & ~entry)
    if package_dirs is not None:
        root = F.regexp_extract(path, r"^(.*?)/?(?:src/)?(?:index|server|cli)\.[^/]+$", 1)
        conventional = nodes.where(path.rlike(r"(^|/)(index|server|cli)\.[^/]+$")).withColumn("dir", root).join(package_dirs.select("dir"), "dir", "left_semi")
        left = left.join(conventional.select("id"), "id", "left_anti")
    return left.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").join(edges.select(F.col("src").alias("id")), "id", "left_semi")


def _numbered_ends(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`pairs` (a, b) with both ends as numbers in the order of their ids, and (id, n) of the ends: loops then move numbers, not ids."""
    ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    ids = cut(in_order(ends, ["id"], "n").select("id", "n"), "graph-ids")
    a, b = (ids.select(F.col("id").alias(x), F.col("n").alias(f"n{x}")).hint("merge") for x in "ab")
    return cut(pairs.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")), "graph-pairs"), ids


def _trimmed(pairs: DataFrame) -> DataFrame:
    """`pairs` without nodes that lack a way in or a way out, round by round while a fiftieth goes; what is left of these does no harm."""
    n = pairs.count()
    while n:
        into, out = pairs.select(F.col("b").alias("a")).distinct().hint("merge"), pairs.select(F.col("a").alias("b")).distinct().hint("merge")
        pairs = cut(pairs.join(into, "a", "left_semi").join(out, "b", "left_semi"), "scc-pairs")
        was, n = n, pairs.count()
        if (was - n) * 50 < was:
            break
    return pairs


def _least_reaching(pairs: DataFrame) -> DataFrame:
    """id, way, c: the least id from which a path of that way leads to each node of `pairs` (a, b, way), itself included.

    What reaches a node's present c reaches the node, so every round also takes c's own c: a
    chain is done in rounds that grow with the logarithm of its length where ids allow it.  All ways go
    in the same rounds.
    """
    pairs = cut(pairs, "scc-ways")
    colour = cut(pairs.select(F.col("a").alias("id"), "way").unionAll(pairs.select(F.col("b").alias("id"), "way")).distinct().withColumn("c", F.col("id")), "scc-colour")
    while True:
        sent = pairs.join(colour.withColumnRenamed("id", "a").hint("merge"), ["a", "way"]).select(F.col("b").alias("id"), "way", "c", F.lit(None).cast(colour.schema["c"].dataType).alias("was"))
        step = colour.select("id", "way", "c", F.col("c").alias("was")).unionAll(sent).groupBy("id", "way").agg(F.min("c").alias("n"), F.max("was").alias("c"))
        jump = step.join(colour.select(F.col("id").alias("n"), "way", F.col("c").alias("further")).hint("merge"), ["n", "way"])
        nxt = cut(jump.select("id", "way", F.least("n", "further").alias("c"), (F.least("n", "further") < F.col("c")).alias("moved")), "scc-colour")
        colour = nxt.select("id", "way", "c")
        if nxt.where("moved").isEmpty():
            return colour


def _components(pairs: DataFrame) -> DataFrame:
    """scc, id of the strong components of more than one node over numbered `pairs`; see `strongly_connected`."""
    pairs = _trimmed(pairs.where("a <> b"))
    done = pairs.where(F.lit(False)).select(F.col("a").alias("scc"), F.col("b").alias("id"))
    while not pairs.isEmpty():
        both = pairs.select("a", "b", F.lit(0).alias("way")).unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("way")))
        named = cut(_least_reaching(both).groupBy("id").agg(F.min(F.expr("if(way = 0, c, null)")).alias("c"), F.min(F.expr("if(way = 1, c, null)")).alias("d")), "scc-named")
        done = done.unionAll(named.where("c = d").select(F.col("c").alias("scc"), "id"))
        left = named.where("c <> d")
        ends = [left.select(*[F.col(x).alias(y) for x, y in (("id", n), ("c", f"c{n}"), ("d", f"d{n}"))]).hint("merge") for n in "ab"]
        pairs = _trimmed(cut(pairs.join(ends[0], "a").join(ends[1], "b").where("ca = cb and da = db").select("a", "b"), "scc-pairs"))
    several = done.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1")
    return cut(done.join(several.select("scc").hint("merge"), "scc", "left_semi"), "scc")


def strongly_connected(edges: DataFrame, self_loops: bool = False) -> DataFrame:
    """scc (least id), id for components of more than one node; with `self_loops` also single nodes with an edge to themselves.

    Nodes without a way in or out are in no cycle and go first.  Every node left takes the least id that reaches it and the least it reaches.  Where the two
    are one, it names the node's component.  Members of a component share both, so edges
    between nodes that differ in either go, and the rest goes round again.
    """
    all_pairs = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "scc-all")
    pairs, ids = _numbered_ends(all_pairs)
    first = ids.select(F.col("id").alias("scc"), F.col("n").alias("least")).hint("merge")
    out = _components(pairs).select(F.col("scc").alias("least"), F.col("id").alias("n")).join(ids.hint("merge"), "n").join(first, "least").select("scc", "id")
    if self_loops:
        loops = all_pairs.where("a = b").select(F.col("a").alias("scc"), F.col("b").alias("id"))
        out = out.unionAll(loops.join(out.select("id"), "id", "left_anti").select("scc", "id"))
    return out


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 30, damping: float = 0.85) -> DataFrame:
    """id, importance: rank over the largest rank, four digits.  Dangling mass is spread evenly."""
    ids = nodes.select("id").distinct()
    out = cut(edges.where("src <> dst").select("src", "dst").distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "rank-edges")
    degree = out.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    base = cut(ids.join(degree, "id", "left"), "rank-nodes")
    n = base.count()
    if not n:
        return base.select("id", F.lit(0.0).alias("importance"))
    hot = _hubs(out, "src")
    rank = base.withColumn("r", F.lit(1.0 / n))
    for k in range(iterations):
        share = rank.where("deg is not null").select(F.col("id").alias("src"), (F.col("r") / F.col("deg")).alias("x"))
        sent = spread_join(out, share, "src", hot).groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("got"))
        dangling = rank.agg(F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("r"))), F.lit(0.0)).alias("loose"))
        rank = base.join(sent, "id", "left").join(F.broadcast(dangling)).select("id", "deg", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("r"))
        if k % 3 == 2 or k == iterations - 1:
            rank = cut(rank, "rank")
    most = rank.agg(F.max("r").alias("most"))  # one row
    return rank.join(F.broadcast(most)).select("id", round4(F.col("r") / F.col("most")).alias("importance"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, community by synchronous label propagation over undirected edges.

    All nodes change at once from the labels of the round before; most frequent label,
    the least on ties, a node's own label counting once.  Communities are numbered by
    their least member.  The order-dependent form, which needs all nodes in one task, is
    left out on purpose.
    """
    two = cut(steps(edges.where("src <> dst"), "both"), "labels-pairs")
    label = cut(nodes.select("id").distinct().withColumn("label", F.col("id")), "labels")
    for _ in range(rounds):
        votes = two.join(label.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "label").unionAll(label.select("id", "label"))
        tally = votes.groupBy("id", "label").agg(F.count("*").alias("n"))
        best = tally.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("neg"), "label")).alias("m")).select("id", F.col("m.label").alias("label"))
        nxt = cut(best, "labels")
        same = nxt.join(label.withColumnRenamed("label", "was"), "id").where("label <> was").isEmpty()
        label = nxt
        if same:
            break
    first = cut(label.groupBy("label").agg(F.min("id").alias("first")), "labels-first")
    return label.join(numbered(first, "first", "community"), "label").select("id", "community")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds `name`: 0, 1, ... in the order of a column without ties; sorted by range, of which only counts reach the driver."""
    ordered = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    split = ordered.withColumn("__part", F.shiftright("__m", 33)).withColumn("__at", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    total, rows = 0, []
    for r in sorted(split.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        rows.append((r["__part"], total))
        total += r["n"]
    before = df.sparkSession.createDataFrame(rows, "__part long, __before long")  # one row a partition
    return split.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__m", "__part", "__at", "__before")


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, layer: longest path from a node without in-edges; nodes on or behind a cycle get none."""
    pairs = cut(steps(edges, "out"), "layer-pairs")
    left = cut(nodes.select("id").distinct(), "layer")
    pairs = cut(pairs.join(left.withColumnRenamed("id", "a").hint("merge"), "a", "left_semi"), "layer-pairs")
    done, level = None, 0
    while True:
        # joins by sorting: the loop must not send a table to the driver each round
        free = cut(left.join(pairs.select(F.col("b").alias("id")).distinct().hint("merge"), "id", "left_anti").withColumn("layer", F.lit(level).cast("long")), "layer")
        if free.isEmpty():
            break
        done = free if done is None else done.unionAll(free)
        left = cut(left.join(free.hint("merge"), "id", "left_anti"), "layer")
        pairs = cut(pairs.join(free.select(F.col("id").alias("a")).hint("merge"), "a", "left_anti"), "layer-pairs")
        level += 1
    return done if done is not None else left.withColumn("layer", F.lit(0).cast("long"))


def heatmap(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """from_group, to_group, edges over nodes (id, grp); edges with an unknown end are left out."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("grp").alias("from_group")), nodes.select(F.col("id").alias("dst"), F.col("grp").alias("to_group"))
    return edges.join(a, "src").join(b, "dst").groupBy("from_group", "to_group").agg(F.count("*").alias("edges"))


def heatmap_totals(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: max_cell, cross_edges (between different groups), total_edges (all, also those of unknown groups)."""
    sums = cells.agg(F.coalesce(F.max("edges"), F.lit(0)).alias("max_cell"), F.coalesce(F.sum(F.when(F.col("from_group") != F.col("to_group"), F.col("edges"))), F.lit(0)).alias("cross_edges"))
    return sums.join(F.broadcast(edges.agg(F.count("*").alias("total_edges"))))  # one row each


def _closure(pairs: DataFrame, start: DataFrame) -> DataFrame:
    """id, way of the nodes that paths over `pairs` (a, b, way) lead to from `start` (id), both ways in the same rounds, itself included.

    A round drops the pairs into what it found, so its work shrinks.
    """
    ways = F.explode(F.array(F.lit(0), F.lit(1)))
    frontier = found = cut(start.select("id", ways.alias("way")), "closure")
    while not frontier.isEmpty():
        pairs = cut(pairs.join(frontier.withColumnRenamed("id", "b").hint("merge"), ["b", "way"], "left_anti"), "closure-pairs")
        frontier = cut(pairs.join(frontier.withColumnRenamed("id", "a").hint("merge"), ["a", "way"], "left_semi").select(F.col("b").alias("id"), "way").distinct(), "closure")
        found = found.unionAll(frontier)
    return cut(found, "closure-found")


def reach_counts(edges: DataFrame, seeds: DataFrame, direction: str = "in", depth: int | None = None) -> DataFrame:
    """id, reached: how many nodes each seed (id) reaches within `depth` steps, itself left out; seeds that reach none have no row.

    A breadth-first search of 64 seeds at a time: seeds are numbered, and a node carries a bit a
    seed, in words of 64.  A level joins the bits that are new with the edges and combines them with those seen by
    `bit_or` before the shuffle.

    Without a depth the largest strong component C goes first, as what one of its nodes reaches (D) all nodes that reach it (B) reach.  So a seed in
    B reaches D and what it reaches outside D, and D is left by no edge; any other seed reaches nothing of B.  The search then runs
    on the graph without D for the former and without B for the latter.  The result is exact; rows are at most nodes *
    seeds / 64, which a deep graph without large components still comes near.
    """
    pairs, ids = _numbered_ends(cut(steps(edges, direction), "bits-pairs"))
    wanted = cut(seeds.select("id").distinct().join(ids.hint("merge"), "id").select("id", "n"), "bits-wanted")
    if depth is None:
        members = _components(pairs)
        largest = members.groupBy("scc").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "scc").limit(1)  # one row
        core = members.join(F.broadcast(largest), "scc").select("id")
        both = pairs.select("a", "b", F.lit(0).alias("way")).unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("way")))
        near = _closure(both, core).groupBy("id").agg(F.count_if(F.col("way") == 0).alias("d"), F.count_if(F.col("way") == 1).alias("b"))
        near = cut(near, "bits-near")
        below = near.where("d > 0").count()
        ends = [near.select(F.col("id").alias(x), F.col("d").alias(f"d{x}"), F.col("b").alias(f"b{x}")).hint("merge") for x in "ab"]
        placed = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").na.fill(0, ["da", "db", "ba", "bb"])
        # the two graphs are kept apart by the last bit of a node's number
        parts = F.array_compact(F.array(F.when((F.col("da") == 0) & (F.col("db") == 0), 0), F.when((F.col("ba") == 0) & (F.col("bb") == 0), 1)))
        pairs = cut(placed.select("a", "b", F.explode(parts).alias("part")).select((F.col("a") * 2 + F.col("part")).alias("a"), (F.col("b") * 2 + F.col("part")).alias("b")), "bits-pairs")
        marked = wanted.join(near.withColumnRenamed("id", "n").hint("merge"), "n", "left").na.fill(0, ["d", "b"])
        marked = marked.select("id", (F.col("n") * 2 + F.when(F.col("b") > 0, 0).otherwise(1)).alias("n"), F.when(F.col("b") > 0, F.lit(below)).otherwise(0).alias("base"), (F.expr("b > 0 and d > 0")).alias("core"))
    else:
        marked = wanted.select("id", "n", F.lit(0).alias("base"), F.lit(False).alias("core"))
    marked = cut(marked, "bits-marked")
    # the seeds of a graph stand next to each other; bits of the two never meet at one node
    order = [F.col("n") % 2, F.col("n")] if depth is None else ["n"]
    marks = cut(in_order(marked.where("not core").select("id", "n", "base"), order).select("id", "n", "base", F.expr("number div 64").alias("word"), F.expr("cast(number % 64 as int)").alias("bit")), "bits-seeds")
    seen = marks.select("word", F.col("n").alias("id"), F.expr("shiftleft(1L, bit)").alias("bits")).withColumn("fresh", F.col("bits"))
    level = 0
    while depth is None or level < depth:
        level += 1
        found = seen.where("fresh <> 0").select("word", F.col("id").alias("a"), "fresh").join(pairs.hint("merge"), "a").select("word", F.col("b").alias("id"), F.lit(0).cast("long").alias("bits"), F.col("fresh").alias("found"))
        every = seen.select("word", "id", "bits", F.lit(0).cast("long").alias("found")).unionAll(found).groupBy("word", "id").agg(F.bit_or("bits").alias("old"), F.bit_or("found").alias("found"))
        seen = cut(every.select("word", "id", F.col("old").bitwiseOR(F.col("found")).alias("bits"), F.col("found").bitwiseAND(F.bitwise_not("old")).alias("fresh")), "bits-seen")
        if seen.where("fresh <> 0").isEmpty():
            break
    sums = seen.groupBy("word").agg(*[F.sum(F.expr(f"shiftrightunsigned(bits, {k}) & 1")).alias(f"n{k}") for k in range(64)])
    counts = sums.select("word", F.posexplode(F.array(*[f"n{k}" for k in range(64)])).alias("bit", "count"))
    # a seed's own bit stands at itself
    searched = marks.join(counts.hint("merge"), ["word", "bit"]).select("id", (F.col("count") - 1 + F.col("base")).alias("reached"))
    return searched.unionAll(marked.where("core").select("id", (F.col("base") - 1).alias("reached"))).where("reached > 0")


def blast_radius(edges: DataFrame, changed: DataFrame, depth: int | None = None) -> DataFrame:
    """id, reached of the changed node (id) with most transitive dependents; ties to the least id; none without any."""
    return reach_counts(edges, changed, "in", depth).orderBy(F.desc("reached"), "id").limit(1)


def capped_heatmap(cells: DataFrame, most: int) -> DataFrame:
    """Cells among the `most` groups of highest degree (ties by name); the diagonal counts twice in the degree."""
    degree = cells.select(F.col("from_group").alias("grp"), "edges").unionAll(cells.select(F.col("to_group").alias("grp"), "edges")).groupBy("grp").agg(F.sum("edges").alias("degree"))
    top = degree.orderBy(F.desc("degree"), "grp").limit(most).select("grp")
    return cells.join(top.withColumnRenamed("grp", "from_group"), "from_group", "left_semi").join(top.withColumnRenamed("grp", "to_group"), "to_group", "left_semi")


def hubs(edges: DataFrame, most: int = 10) -> DataFrame:
    """id, n_in, n_out, total of the nodes with most edges, ties by id."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select(F.col("src").alias("id"), F.lit(0), F.lit(1)))
    total = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).withColumn("total", F.col("n_in") + F.col("n_out"))
    return total.orderBy(F.desc("total"), "id").limit(most)


def hub_importers(edges: DataFrame, most: int = 10, first: int = 5) -> DataFrame:
    """hub, n_in, importer, place: the first importers by id of the nodes with most in-edges."""
    pairs = edges.select("src", "dst").distinct()
    top = pairs.groupBy("dst").agg(F.count("*").alias("n_in")).orderBy(F.desc("n_in"), "dst").limit(most)
    place = F.row_number().over(W.partitionBy("dst").orderBy("src"))
    return pairs.join(F.broadcast(top), "dst").withColumn("place", place).where(F.col("place") <= first).select(F.col("dst").alias("hub"), "n_in", F.col("src").alias("importer"), F.col("place").cast("long").alias("place"))


def package_edges(nodes: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """from_group, to_group, n, kinds without loops, among the `most` groups of largest in and out weight."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("grp").alias("from_group")), nodes.select(F.col("id").alias("dst"), F.col("grp").alias("to_group"))
    cells = edges.join(a, "src").join(b, "dst").where("from_group <> to_group").groupBy("from_group", "to_group").agg(F.count("*").alias("edges"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return capped_heatmap(cells, most).select("from_group", "to_group", F.col("edges").alias("n"), "kinds")
